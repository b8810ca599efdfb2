"""K-d tree partitioning: shards of near-equal bytes that keep alike rows together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from rasterloom.functions.positions import number_within
from rasterloom.llm.tables import stored

SCALE = (1 << 31) - 1
BINS = 1024


def _scaled(named: DataFrame, dims: list[str]) -> DataFrame:
    """``named`` (with ``_dim_<d>`` and ``_tie``) with ``_at``: each dimension scaled to 31 bits, with 31
    bits of the hash below.

    Rows that agree in all of these are never parted; a null counts as the least value.
    """
    edges = named.agg(
        *[f(f"_dim_{d}").alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    low_bits = F.col("_tie").bitwiseAND(F.lit(SCALE).cast("long"))
    held = []
    for d in dims:
        lo, hi = edges[f"lo_{d}"] or 0.0, edges[f"hi_{d}"] or 0.0
        share = (F.coalesce(F.col(f"_dim_{d}"), F.lit(lo)) - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        held.append(F.floor(share * SCALE).cast("long") * (SCALE + 1) + low_bits)
    return named.withColumn("_at", F.array(*held)).drop("_tie", *[f"_dim_{d}" for d in dims])


def _medians(df: DataFrame, open_nodes: list[dict], tolerance: float) -> dict[int, int]:
    """Cut of each node: the coordinate up to which its share of the weight lies.

    Each pass sums weights in ``BINS`` bins a node, keeps the bin with the goal in it, and goes on
    inside that bin until it weighs no more than the tolerance or holds one coordinate.
    """
    spark, cuts = df.sparkSession, {}
    looked = [n | {"below": 0} for n in open_nodes]
    schema = "_node long, dim int, lo long, width long, goal double, below double"
    while looked:
        rows = [
            (n["node"], n["dim"], n["lo"], max(1, -(-(n["hi"] - n["lo"] + 1) // BINS)), float(n["goal"]), float(n["below"]))
            for n in looked
        ]
        at = F.element_at("_at", F.col("dim") + 1)
        bins = (
            df.join(F.broadcast(spark.createDataFrame(rows, schema)), "_node")
            .withColumn("_c", at - F.col("lo"))
            .where(F.col("_c") >= 0)
            .withColumn("bin", F.floor(F.col("_c") / F.col("width")).cast("long"))
            .where(F.col("bin") < BINS)
            .groupBy("_node", "goal", "below", "bin")
            .agg(F.sum("_weight").alias("w"))
        )
        up_to = Window.partitionBy("_node").orderBy("bin")
        crossed = (
            bins.withColumn("total", F.col("below") + F.sum("w").over(up_to))
            .where("total >= goal")
            .groupBy("_node")
            .agg(F.min(F.struct("bin", "total", "w")).alias("hit"))
            .collect()
        )
        hits, after = {r["_node"]: r["hit"] for r in crossed}, []
        for n, (_, _, lo, width, goal, _) in zip(looked, rows, strict=True):
            hit = hits.get(n["node"])
            if hit is None:  # the goal is the whole weight
                cuts[n["node"]] = n["hi"]
                continue
            first, last = lo + hit["bin"] * width, min(n["hi"], lo + (hit["bin"] + 1) * width - 1)
            before = hit["total"] - hit["w"]
            if width == 1 or hit["w"] <= tolerance * goal:
                near = first - 1 if goal - before <= hit["total"] - goal and before > 0 else last
                cuts[n["node"]] = near
            else:
                after.append(n | {"lo": first, "hi": last, "below": before})
        looked = after
    return cuts


def kd_shards(
    df: DataFrame,
    dims: dict[str, Column],
    weight: Column,
    tie: Column,
    shards: int | None = None,
    target: int | None = None,
    tolerance: float = 0.001,
) -> DataFrame:
    """``df`` with ``shard``, numbered from 0 along the tree.

    A node that needs ``k`` shards (given at the root, or its weight by ``target``, rounded up) is
    cut along the dimension that is widest in it, at the weighted median of ``k // 2`` to the rest.
    Medians come from histograms over all rows, within ``tolerance`` of the wanted weight unless a
    single coordinate weighs more. Only one line per node and pass reaches the driver. Cuts are
    broadcast; there are fewer of them than shards. An empty table stays empty. Columns of ``df`` come
    along under any names; one called ``shard`` is replaced. A null weight counts as 0 and a null tie as
    0. ``df`` is computed once and stored, so keep what it does not need (whole texts) out of it.
    """
    spark = df.sparkSession
    # The root's number is stored with the rows: as a literal it would be folded, and joins on it lose their key.
    named = stored(
        df.select(
            F.struct("*").alias("_row"),
            F.coalesce(weight.cast("long"), F.lit(0)).alias("_weight"),
            F.coalesce(tie.cast("long"), F.lit(0)).alias("_tie"),
            *[c.cast("double").alias(f"_dim_{d}") for d, c in dims.items()],
            F.lit(0).cast("long").alias("_node"),
        ),
        "kd-rows",
    )
    placed = _scaled(named, list(dims))
    needs: dict[int, int | None] = {0: shards}
    leaves: dict[int, tuple[int, ...]] = {}
    paths: dict[int, tuple[int, ...]] = {0: ()}
    following = 1
    while needs:
        sides = [F.element_at("_at", i + 1) for i in range(len(dims))]
        stats = (
            placed.where(F.col("_node").isin(*needs) if len(needs) < 100 else F.col("_node") >= min(needs))
            .groupBy("_node")
            .agg(
                F.sum("_weight").alias("w"),
                F.array(*[F.min(s) for s in sides]).alias("lo"),
                F.array(*[F.max(s) for s in sides]).alias("hi"),
            )
            .collect()
        )
        open_nodes, counts = [], {}
        for r in stats:
            k = needs[r["_node"]] or max(1, math.ceil(r["w"] / target))
            wide = [h - l for l, h in zip(r["lo"], r["hi"], strict=True)]
            dim = wide.index(max(wide))
            if k == 1 or wide[dim] == 0:
                leaves[r["_node"]] = paths[r["_node"]]
                continue
            counts[r["_node"]] = k
            open_nodes.append({"node": r["_node"], "dim": dim, "lo": r["lo"][dim], "hi": r["hi"][dim], "goal": r["w"] * (k // 2) / k})
        if not open_nodes:
            break
        cuts, needs, rows = _medians(placed, open_nodes, tolerance), {}, []
        for n in open_nodes:
            node, k = n["node"], counts[n["node"]]
            rows.append((node, n["dim"], cuts[node], following, following + 1))
            for side, own in ((0, k // 2), (1, k - k // 2)):
                needs[following + side], paths[following + side] = own, (*paths[node], side)
            following += 2
        made = spark.createDataFrame(rows, "_node long, _dim int, _cut long, _left long, _right long")
        down = F.element_at("_at", F.col("_dim") + 1) <= F.col("_cut")
        placed = placed.join(F.broadcast(made), "_node", "left").withColumn(
            "_node", F.when(F.col("_cut").isNull(), F.col("_node")).when(down, F.col("_left")).otherwise(F.col("_right"))
        ).drop("_dim", "_cut", "_left", "_right")
    order = sorted(leaves, key=lambda n: leaves[n])
    schema = T.StructType([T.StructField("_node", T.LongType()), T.StructField("shard", T.IntegerType())])
    names = spark.createDataFrame([(n, i) for i, n in enumerate(order)], schema)
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c.lower() != "shard"]
    return placed.join(F.broadcast(names), "_node").select(*kept, "shard")


def with_slots(df: DataFrame, key: str, rows_in_piece: int = 50_000) -> DataFrame:
    """``df`` with ``slot``, gapless from 0 in each shard, numbered in pieces of a hash of ``key``. A column
    ``slot`` of ``df`` is replaced; rows of one key follow each other in any order."""
    bits = max(0, math.ceil(math.log2(max(1, df.count()) / rows_in_piece)))
    hashed = df.select(F.struct("*").alias("_row"), "shard", F.xxhash64(key).alias("_hash"))
    part = F.expr(f"shiftright(_hash, {64 - bits})") if bits else F.lit(0).cast("long")
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c.lower() != "slot"]
    return number_within(hashed, ["shard"], ["_hash"], part, "slot").select(*kept, "slot")
