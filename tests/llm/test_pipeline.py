import os
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import jaccard, langid, quality
from rasterloom.llm.tables import scope, stored

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark):
    """The small documents with a passage, near copies and odd rows added, and clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("doc_id % 3 = 0 AND n_chars > 1500").orderBy("doc_id").collect()
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(1000 + i, f"{r['text']}\n{passage}", r["lang"], "src0", len(r["text"]) + 61) for i, r in enumerate(base[:6])]
    rows += [(2000 + i, r["text"].replace("the ", "tha ", 2), r["lang"], "src1", r["n_chars"]) for i, r in enumerate(base[:6])]
    rows += [(3000, None, "en", None, None), (3001, "", None, "s", 0), (3002, base[0]["text"], "en", "s", 1), (3002, base[0]["text"], "en", "s", 1)]
    whole = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for c in ("score", "kept", "lang_pred", "spans", "n_deleted", "set", "component_id"):
        whole = whole.withColumn(c, F.lit(c))
    return stored(whole, "test-corpus")


def test_stages_one_by_one(spark, corpus):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "test-stage")
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        seen[name] = (docs, out)
        docs = out
    before, after = seen["quality"]
    verdict = quality.judge(before, quality.train(before, spark.read.parquet(f"{SF}/labels.parquet")), ["doc_id"])
    assert ids(after) == ids(verdict.where("kept"))
    assert {3000, 3001}.isdisjoint(ids(after))
    before, after = seen["language"]
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    labels = langid.label(before, langid.train(before, usable), ["doc_id"])
    assert ids(after) == ids(labels.where("lang_pred <> 'und' AND score >= 0.5"))
    before, after = seen["line_dedup"]
    texts = [r["text"] for r in after.collect()]
    assert sum("shared3" in t for t in texts) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    lines = [line for t in texts for line in t.split("\n") if len(line.split()) >= 30]
    assert len(lines) == len(set(lines))
    before, after = seen["near_duplicates"]
    rows = [(r["doc_id"], shingles(r["text"])) for r in before.collect()]
    kept = {r["doc_id"]: shingles(r["text"]) for r in after.collect()}
    assert len(kept) == after.count()
    pairs = [(a, b) for a in kept for b in kept if a < b and similar(kept[a], kept[b])]
    assert not pairs
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(before, 5, 80).collect()}
    assert set(groups.values()) == set(kept) and {i for i, _ in rows} == set(groups)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_rows_with_one_id_or_none(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    held = [(None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "d"), (7, "d"), (9, "e"), (None, "e"), (8, "e"), (3, "f"), (2, "f")]
    rows = [(i, text[k]) for i, k in held] + [(None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("clash"))
    out = STAGES["near_duplicates"](spark, docs.repartition(3), SF)
    assert out.columns == docs.columns
    want = [(None, "a"), (None, "b"), (7, "c"), (7, "d"), (8, "e"), (2, "f")]
    want = [(i, text[k]) for i, k in want] + [(None, None), (5, "")]
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=repr) == sorted(want, key=repr)


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    total, fewest = out.length.sum(), out.sequence_id.nunique()
    assert fewest <= int(np.ceil(total / 2048)) + 1
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stored(stage(spark, docs, SF), f"empty-{name}").count() == 0


def test_what_stages_store_besides_is_dropped(spark, corpus):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    with scope(spark):
        kept = stored(STAGES["near_duplicates"](spark, corpus, SF), "test-kept", outlives=True)
    new = [f for f in set(os.listdir(base)) - before if f.startswith("rasterloom-")]
    assert len(new) == 1 and new[0].startswith("rasterloom-test-kept-")
    assert kept.count() > 0
