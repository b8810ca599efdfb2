"""File inventories: size, limits, retention and clearing policy.

An inventory has ``path, modificationTime, length``, as the ``binaryFile`` source lists them.
"Now" is always an argument, so a job gives the same answer when it is run again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import check_choice, check_range

GIB = 1024**3
POLICIES = ("on_start", "on_exit", "manual", "never")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """List files below ``path``; their content is never read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", "modificationTime", "length")


def inventory_size(files: DataFrame) -> DataFrame:
    """Total ``bytes`` and ``size_gb``."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes")).select(
        "bytes", (F.col("bytes") / F.lit(float(GIB))).alias("size_gb")
    )


def check_size(files: DataFrame, max_size_gb: float = 10.0, strict: bool = True) -> DataFrame:
    """The inventory's size beside ``within_limit``; with ``strict`` an excess is an error."""
    check_range("max_size_gb", max_size_gb, 1e-9, float("inf"))
    sized = inventory_size(files).withColumn(
        "within_limit", F.when(F.col("size_gb") > F.lit(float(max_size_gb)), 0).otherwise(1)
    )
    if not strict:
        return sized
    message = F.concat(F.lit("inventory exceeds its limit: "), F.col("size_gb").cast("string"))
    checked = F.when(F.col("within_limit") == 0, F.raise_error(message).cast("int")).otherwise(F.lit(1))
    return sized.withColumn("within_limit", checked)


def _expired(files: DataFrame, now: datetime, days: int) -> Column:
    """Older than the cutoff, in the column's own kind of time (with or without a zone)."""
    kind = files.schema["modificationTime"].dataType
    return F.col("modificationTime") < F.lit(str(now)).cast(kind) - F.make_dt_interval(F.lit(days))


def split_retention(
    files: DataFrame, now: datetime, days: int = 7
) -> tuple[DataFrame, DataFrame]:
    """``(keep, expire)``: files older than ``days`` before ``now`` expire."""
    check_range("days", days, 0, 1_000_000)
    old = _expired(files, now, days)
    return files.where(~old), files.where(old)


def apply_policy(
    files: DataFrame, policy: str, phase: str, now: datetime, days: int = 7
) -> DataFrame:
    """Files left after a run's ``start`` or ``end``.

    ``on_start`` empties the inventory at the start, ``on_exit`` at the end; otherwise expired
    files go at the end.
    """
    check_choice("policy", policy, POLICIES)
    check_choice("phase", phase, ("start", "end"))
    if (policy, phase) in (("on_start", "start"), ("on_exit", "end")):
        return files.where(F.lit(False))
    return files if phase == "start" else split_retention(files, now, days)[0]
