"""Token counts with a digest cache: only distinct texts that no run has met are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe

SCHEMA = "content binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """``content, n_tokens`` of a tokenizer in the cache; None where there is no cache yet."""
    try:
        held = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException:
        return None
    held = held.where(F.col("tokenizer") == version)
    return held.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


class _Counter:
    """The library's counts. Ranks give the same ids as the JSON file, several times faster; texts
    that the faster library gives up on (a million spaces in a row) go to the other."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks, specials = bpe.read_ranks(path)
        self.fast = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
        self.path, self.slow = path, None

    def __call__(self, text: str) -> int:
        try:
            return len(self.fast.encode(text, allowed_special="all"))
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return len(self.slow.encode(text, add_special_tokens=False).ids)


def _encoded(path: str, pattern: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe.worker_cache(("counter", path), lambda: _Counter(path, pattern))
        for batch in batches:
            found = [count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict(
                {
                    "content": batch.column("content"),
                    "n_tokens": pa.array(found, pa.int64()),
                    "tokenizer": pa.array([version] * len(found), pa.string()),
                }
            )

    return run


def count_tokens(
    df: DataFrame,
    cache: str,
    path: str,
    pattern: str,
    keep: list[str],
    limit: int = 512,
    normalise: Callable[[Column], Column] = lambda text: F.coalesce(text, F.lit("")),
) -> DataFrame:
    """Columns ``keep`` of ``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of ``text``.

    Texts are known by the SHA-256 of their normalised content (by default only null becomes empty).
    Contents without a stored count for this tokenizer's digest are encoded once each and appended
    to the Parquet folder ``cache``, which executors must share; counts then come from there by a
    join, so a content that fills a third of the rows is one row of the cache, and adaptive
    execution splits its side of the join. Rows added twice by runs at the same time do no harm.
    Empty tables add nothing. Repeated rows stay. Of other columns only ``keep`` is read.
    """
    spark, version = df.sparkSession, tokenizer_digest(path)
    read = df.select(*keep, normalise(F.col("text")).alias("text"))
    content = F.unhex(F.sha2("text", 256)).alias("content")
    missing = read.select(content, "text")
    stored = stored_counts(spark, cache, version)
    if stored is not None:
        missing = missing.join(stored, "content", "left_anti")
    distinct = missing.groupBy("content").agg(F.first("text").alias("text"))
    encoded = distinct.mapInArrow(_encoded(path, pattern, version), SCHEMA)
    encoded.write.mode("append").parquet(cache)
    counts = stored_counts(spark, cache, version)
    rows = read.select(*keep, content, F.octet_length("text").cast("long").alias("n_bytes"))
    return (
        rows.join(counts, "content")
        .withColumn("over_limit", F.col("n_tokens") > limit)
        .select(*keep, "n_bytes", "n_tokens", "over_limit")
    )
