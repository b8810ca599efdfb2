"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import (
    alignment,
    audio,
    bpe,
    collocations,
    counts,
    jaccard,
    langid,
    linededup,
    packing,
    pii,
    quality,
    shards,
    urls,
)
from rasterloom.session import shared_folder

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_audio(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        audio.payload(F.col("text")).alias("payload"),
    )
    stored = audio.store(docs, ["doc_id", "n_bytes"]).select(
        "doc_id",
        "n_bytes",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "media",
    )
    back = audio.features(stored, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    loud = F.aggregate("segments", F.lit(0.0), lambda t, s: t + s["end_ms"] - s["start_ms"])
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(
            ":", "n_frames", F.size("segments"), loud.cast("long"), F.sha2("tensors", 256)
        ).alias("feature"),
        "n_frames",
        F.size("segments").alias("n_segments"),
    )


def op2_kd_shards(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length("text")
    docs = table(spark, d, "documents").select("doc_id", text.alias("text")).select(
        "doc_id",
        (n + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.length("text").alias("chars"),
        ((n - F.length("text")) / F.greatest(n, F.lit(1))).alias("wide_share"),
        (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("lines"),
        F.xxhash64("text").alias("tie"),
    )
    dims = {c: F.col(c) for c in ("chars", "wide_share", "lines")}
    placed = shards.kd_shards(docs, dims, F.col("size"), F.col("tie"), shards=8)
    return shards.with_slots(placed, "doc_id").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    host, path = urls.host_and_path(F.col("url"))
    known = urls.weak_labels(pages.select("url", host.alias("host"), path.alias("path")))
    return urls.judge(pages, RULES, *urls.train(known))


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.count_tokens(
        table(spark, d, "documents"),
        shared_folder(spark, "token-counts"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        ["doc_id"],
    )


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, d, "documents"), ["doc_id"])
    return found.select("doc_id", "text", "n_lines", "n_deleted")


def op6_bpe(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, d, "documents"), path, ["doc_id"]), path, ["doc_id"])


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, d, "labels")), ["doc_id"])


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_documents(table(spark, d, "documents"), path, ["doc_id"])


def op9_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, d, "documents"), n=3, percent=90)


def op10_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = langid.label(docs, langid.train(docs, ~held_out), ["doc_id"])
    return found.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )


def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(table(spark, d, "documents"))


def op12_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.report(pii.find(table(spark, d, "documents"), ["doc_id"]), ["doc_id"])


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, d, "documents"), first, second, ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_audio": op1_audio,
        "op2_kd_shards": op2_kd_shards,
        "op3_urls": op3_urls,
        "op4_token_counts": op4_token_counts,
        "op5_line_dedup": op5_line_dedup,
        "op6_bpe": op6_bpe,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_jaccard": op9_jaccard,
        "op10_language": op10_language,
        "op11_collocations": op11_collocations,
        "op12_pii": op12_pii,
        "op13_alignment": op13_alignment,
    }


def oracles() -> dict[str, str]:
    return {
        "op5_line_dedup": linededup.sql(),
        "op9_jaccard": jaccard.sql(3, 90),
        "op11_collocations": collocations.sql(),
    }
