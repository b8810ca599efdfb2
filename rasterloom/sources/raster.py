"""Raster tables on disk: one Parquet folder per step."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import all_bands, check_range, to_scanlines

MOST_PARTS = 4_096
#: A part's lines are dealt to this many tasks by their height in the picture, so one hot frame is not one task's.
BANDS_OF_PART = 8


def write_step(df: DataFrame, folder: str, step: str) -> str:
    """Write a step's scanlines to ``folder/step=<name>``, replacing that step only."""
    scan = to_scanlines(df)
    target = f"{folder.rstrip('/')}/step={step}"
    scan.select("frame_id", "height", "width", "y", *all_bands(scan)).write.mode(
        "overwrite"
    ).parquet(target)
    return target


def read_raster(spark: SparkSession, folder: str, step: str | None = None) -> DataFrame:
    """Read one step's scanlines, or every step's with a ``step`` column.

    One step is read from its own folder, so its bands are its own; over all steps a band that
    some step lacks is null there. Filters on ``step`` skip whole folders.
    """
    folder = folder.rstrip("/")
    if step is not None:
        return spark.read.parquet(f"{folder}/step={step}")
    reader = spark.read.option("basePath", folder).option("mergeSchema", "true")
    return reader.parquet(f"{folder}/step=*")


def write_parts(df: DataFrame, folder: str, step: str, parts: int = 256) -> str:
    """Write a step's scanlines cut by ranges of ``frame_id`` into folders of about as many lines each.

    Reading some frames then opens their own folders only. Ranges end at quantiles of all lines; a frame is
    never parted, so one with very many lines may leave less than ``parts`` folders. ``index/step=<name>``
    lists each part's first and last frame, and the bands; it is written last. ``df`` is read twice.
    """
    check_range("parts", parts, 1, MOST_PARTS)
    scan, spark = to_scanlines(df), df.sparkSession
    shares = [i / parts for i in range(1, parts)] or [1.0]
    edges = sorted(set(scan.agg(F.percentile_approx("frame_id", shares, max(10_000, 10 * parts)).alias("e")).first()["e"] or []))
    below = F.filter(F.array(*map(F.lit, edges)).cast("array<bigint>"), lambda e: e < F.col("frame_id"))
    base = f"{folder.rstrip('/')}/parts"
    band = F.expr(f"y * {BANDS_OF_PART} div greatest(height, 1)")
    cut = scan.select("frame_id", "height", "width", "y", *all_bands(scan), F.size(below).alias("part"))
    cut.repartition("part", band).sortWithinPartitions("part", "frame_id", "y").write.mode("overwrite").partitionBy(
        "part"
    ).parquet(f"{base}/step={step}")
    whole = spark.read.schema(cut.schema).parquet(f"{base}/step={step}")
    listed = whole.groupBy("part").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))
    bands = [F.lit(None).cast("array<int>").alias(b) for b in all_bands(scan)]
    listed.select("*", *bands).coalesce(1).write.mode("overwrite").parquet(f"{base}/index/step={step}")
    return f"{base}/step={step}"


def read_parts(spark: SparkSession, folder: str, step: str, frames: Iterable[int] | None = None) -> DataFrame:
    """A step written by ``write_parts``, or some frames of it from the parts that hold them."""
    base = f"{folder.rstrip('/')}/parts"
    index = spark.read.parquet(f"{base}/index/step={step}")
    bands = [f"{b} array<int>" for b in all_bands(index)]
    schema = ", ".join(["frame_id long, height int, width int, y int", *bands, "part int"])
    raster = spark.read.schema(schema).parquet(f"{base}/step={step}")
    if frames is not None:
        wanted = sorted(set(frames))
        met = [r["part"] for r in index.select("part", "first", "last").collect() if bisect_left(wanted, r["last"] + 1) > bisect_left(wanted, r["first"])]
        raster = raster.where(F.col("part").isin(met) & F.col("frame_id").isin(wanted))
    return raster.select("frame_id", "height", "width", "y", *all_bands(raster))
