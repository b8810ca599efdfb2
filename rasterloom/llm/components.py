"""Connected components by star contraction, all of it joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.tables import scope, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``edges`` (a, b): the least node that each can reach.

    Every round hangs all neighbours of a node on its least one, first the larger, then the
    smaller; the number of rounds grows with the logarithm of a component. Each round's edges are
    stored, at most as many as before; rounds end when two 64-bit sums over them repeat. A node in no edge, and a table without edges, gives no rows.
    """
    with scope(edges.sparkSession):
        now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
        mark = None
        while True:
            now = stored(_small_star(_large_star(now)).distinct(), "edges")
            sums = [F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in range(2)]
            seen = now.agg(F.count("*").alias("n"), *[s.alias(f"h{i}") for i, s in enumerate(sums)]).first()
            if seen == mark or not seen["n"]:
                break
            mark = seen
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        return stored(found, "components", outlives=True)
