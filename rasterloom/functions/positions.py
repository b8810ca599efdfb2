"""Positions within groups and integer ranges, without gathering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(
    df: DataFrame, keys: list[str], order: list[str], part: Column, name: str
) -> DataFrame:
    """0-based position within ``keys`` by ``order``, counted part by part.

    ``part`` is a non-decreasing function of the order, so a hot key is sorted in pieces: only
    the piece sizes of a key are ever gathered together. Rows are dealt out by pieces once, for their
    positions and for the sizes.
    """
    split = df.withColumn("_part", part).repartition(*keys, "_part")
    sizes = split.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        split.withColumn("_nth", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_part"])
        .withColumn(name, (F.col("_nth") + F.col("_before")).cast("long"))
        .drop("_part", "_nth", "_before")
    )


def explode_range(
    df: DataFrame, first: Column, last: Column, name: str, chunk: int = 65536
) -> DataFrame:
    """One row per integer ``first..last``, in chunks that are dealt to all tasks: neither a large array
    nor a row with a large range is one task's work."""
    step = F.lit(chunk).cast("long")
    return (
        df.withColumns({"_lo": first.cast("long"), "_hi": last.cast("long")})
        .where("_lo <= _hi")
        .withColumn("_at", F.explode(F.sequence("_lo", F.greatest("_lo", "_hi"), step)))
        .repartition("_at", *df.columns)
        .withColumn(name, F.explode(F.sequence("_at", F.least(F.col("_at") + step - 1, F.col("_hi")))))
        .drop("_lo", "_hi", "_at")
    )
