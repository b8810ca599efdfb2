"""A corpus pipeline: quality rules, language ID, line dedup, near duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all but the last return
the columns of ``docs``. Columns of any name are carried along unread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import jaccard, langid, linededup, packing, quality
from rasterloom.llm.tables import scope, stored

#: A document goes when no language has so large a share of its words.
LANGUAGE_SHARE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("_row"), "text")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted to ``labels``."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(_rows(docs), forest, ["_row"]).where("kept").select("_row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, most of whose words are in one learned language."""
    usable = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False))
    found = langid.label(_rows(docs), langid.train(docs, usable), ["_row"])
    kept = (F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)
    return found.where(kept).select("_row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated passages; one of which no word is left goes."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    found = linededup.dedup_lines(rows, ["_row"])
    left = (F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = F.col("n_deleted") > 0
    changed = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text")).otherwise(F.col("_row.n_chars"))}
    return found.where(left).select(
        *[changed.get(c, F.col(f"_row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, nulls last, then the first row.

    Rows are told by a stored number, not by ``doc_id``: of rows with one id, or none, only near
    duplicates go. Rows without words are near duplicates of nothing and stay.
    """
    rows = stored(docs.select(F.struct("*").alias("_kept"), F.monotonically_increasing_id().alias("_row")), "numbered")
    found = jaccard.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "_kept.text"), n=5, percent=80, numbered=True)
    named = found.withColumnRenamed("doc_id", "_row").join(rows.select("_row", "_kept.doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    kept = named.groupBy("component_id").agg(F.min(order)["_row"].alias("_row")).select("_row")
    return rows.join(kept, "_row", "left_semi").select("_kept.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 2,048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each),
    ("packing", packed),
]

#: SQL has no boosted trees and no best-fit packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored and read by the next; what a stage stored
    besides goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = stored(stage(spark, docs, sf_dir), name, outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
