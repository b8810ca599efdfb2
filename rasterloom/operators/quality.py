"""Frame comparison, frame statistics and step summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.model import is_scanlines, to_pixels, value_bands


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-frame statistics of the absolute difference of two rasters.

    Samples are every pixel of every value band. Two scanline tables meet line by line and are
    exploded after the join, so the shuffle carries arrays. Differences are bytes, so the exact
    percentiles are aggregated as at most 256 counts per frame.
    """
    bands = value_bands(a)
    if bands != value_bands(b):
        raise ValueError("both rasters must have the same bands")
    lines = is_scanlines(a) and is_scanlines(b)
    keys = ["frame_id", "y"] if lines else ["frame_id", "y", "x"]
    if not lines:
        a, b = to_pixels(a), to_pixels(b)
    left = a.select(*keys, *[F.col(c).alias(f"l_{c}") for c in bands])
    right = b.select(*keys, *[F.col(c).alias(f"r_{c}") for c in bands])
    met = left.join(right, keys, "full_outer")
    if lines:
        longest = F.greatest(F.coalesce(F.size(f"l_{bands[0]}"), F.lit(0)),
                             F.coalesce(F.size(f"r_{bands[0]}"), F.lit(0)))
        met = met.withColumn("x", F.explode(F.sequence(F.lit(0), longest - 1))).select(
            "frame_id",
            *[F.get(F.col(f"{s}_{c}"), F.col("x")).alias(f"{s}_{c}") for s in "lr" for c in bands],
        )
    difference = F.array(*[F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) for c in bands])
    changed = reduce(
        lambda p, q: p | q, [F.col(f"l_{c}") != F.col(f"r_{c}") for c in bands]
    )
    one_sided = F.col(f"l_{bands[0]}").isNull() | F.col(f"r_{bands[0]}").isNull()
    samples = met.select(
        "frame_id",
        F.when(one_sided, 1).otherwise(0).alias("missing"),
        F.when(changed, 1).otherwise(0).alias("changed"),
        F.posexplode(difference).alias("band", "d"),
    )
    first = F.col("band") == 0
    # One row per frame and difference, then the frame's statistics from those counts.
    counts = samples.groupBy("frame_id", "d").agg(
        F.count("d").alias("n"),
        F.sum(F.when(first, F.col("missing")).otherwise(0)).alias("missing"),
        F.sum(F.when(first, F.col("changed")).otherwise(0)).alias("changed"),
    )
    d = F.col("d").cast("long")
    sums = counts.groupBy("frame_id").agg(
        F.sum("n").alias("samples"),
        F.sum("missing").alias("missing_pixels"),
        F.sum("changed").alias("changed_pixels"),
        F.coalesce(F.sum(d * F.col("n")), F.lit(0)).alias("s1"),
        F.coalesce(F.sum(d * d * F.col("n")), F.lit(0)).alias("s2"),
        F.max("d").alias("max_diff"),
        F.percentile("d", [0.5, 0.95, 0.99], F.col("n")).alias("p"),
    )
    n, s1, s2 = F.col("samples"), F.col("s1"), F.col("s2")
    have = n > 0

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(have, top / F.when(have, bottom))

    # n*s2 - s1**2 in exact integers, so the spread does not depend on the order of addition.
    spread = (n.cast("decimal(19,0)") * s2 - s1.cast("decimal(19,0)") * s1).cast("double")
    mse = ratio(s2.cast("double"), n.cast("double"))
    return sums.select(
        "frame_id",
        "samples",
        "missing_pixels",
        "changed_pixels",
        "max_diff",
        ratio(s1.cast("double"), n.cast("double")).alias("mean_diff"),
        ratio(F.sqrt(spread), n.cast("double")).alias("std_diff"),
        F.get("p", F.lit(0)).alias("median_diff"),
        F.get("p", F.lit(1)).alias("p95_diff"),
        F.get("p", F.lit(2)).alias("p99_diff"),
        F.when(mse > 0, F.lit(10.0) * F.log10(F.lit(65025.0) / F.when(mse > 0, mse))).alias("psnr"),
    )


def frame_stats(df: DataFrame) -> DataFrame:
    """Per frame: pixel count, black and white pixels, and per band sum, range, distinct values.

    Values are bytes, so a frame is first reduced to at most 256 counts per band, in the map
    stage, and everything else follows from those counts.
    """
    px = to_pixels(df)
    bands = value_bands(px)

    def everywhere(value: int) -> Column:
        same = reduce(lambda p, q: p & q, [F.col(b) == value for b in bands])
        return F.when(same, 1).otherwise(0)

    samples = px.select(
        "frame_id",
        everywhere(0).alias("black"),
        everywhere(255).alias("white"),
        F.posexplode(F.array(*bands)).alias("band", "value"),
    )
    counts = samples.groupBy("frame_id", "band", "value").agg(
        F.count("*").alias("n"), F.sum("black").alias("black"), F.sum("white").alias("white")
    )

    def of_band(i: int, value: Column) -> Column:
        return F.when(F.col("band") == i, value)

    aggregates = [
        F.sum(of_band(0, F.col(c))).alias(name)
        for c, name in (("n", "pixels"), ("black", "black_pixels"), ("white", "white_pixels"))
    ]
    for i, b in enumerate(bands):
        value = of_band(i, F.col("value"))
        aggregates += [
            F.sum(value * F.col("n")).alias(f"sum_{b}"),
            F.min(value).alias(f"min_{b}"),
            F.max(value).alias(f"max_{b}"),
            F.count(value).cast("int").alias(f"distinct_{b}"),
        ]
    return counts.groupBy("frame_id").agg(*aggregates)


def summarize(results: dict[str, DataFrame]) -> DataFrame:
    """Images per step: distinct frames, told apart before the shuffle."""
    parts = []
    for number, (step, df) in enumerate(results.items()):
        images = df.select("frame_id").distinct().agg(F.count("*").alias("images"))
        parts.append(images.select(F.lit(number).alias("step_no"), F.lit(step).alias("step"), "images"))
    return reduce(DataFrame.unionAll, parts)
