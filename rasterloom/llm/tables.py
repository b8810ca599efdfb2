"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from rasterloom.session import shared_folder


#: Spark's own setting by which a write removes its shuffle files when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own limit of a batch of rows, beside that of 10,000 rows; none by default.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, but for those that outlive it."""
    folders: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), folders))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, purpose: str, outlives: bool = False) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back.

    What follows starts from the files: it is not computed twice, lost executors cost nothing, and
    the shuffle files behind it can go at once. A table that ``outlives`` its ``scope`` belongs to
    the one around that; without a scope it stays.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, purpose)
    scopes = _SCOPES.get()[: -1 if outlives else None]
    if scopes:
        scopes[-1].append(folder)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Tables stored inside reach Python functions in batches that end with the row that passes ``size`` bytes."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def schema_of(df: DataFrame, columns: list[str]) -> str:
    """DDL of some columns."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
