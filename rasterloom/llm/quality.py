"""Quality rules: document statistics and boosted trees with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import texts, trees
from rasterloom.llm.tables import schema_of

COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_digits n_marks "
    "n_distinct n_ends n_pipes"
).split()

#: Feature and the way the score may go with it: -1 never up, 1 never down, 0 either way.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": -1,
    "distinct_share": 0,
    "end_share": 0,
    "pipe_share": -1,
}


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    found = texts.words(data, offsets)
    documents, n_words = found.documents, found.counts

    def per_document(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def chars(held: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(held)] = True
        return per_document(table[data])

    separators = bytes([9, 10, 11, 12, 13, 32])
    word_chars = per_document((data & 0xC0) != 0x80) - chars(separators)
    split = texts.lines(data, offsets)
    full = np.searchsorted(found.starts, split.ends) > np.searchsorted(found.starts, split.starts)
    owner = split.documents[full]
    keyed = texts.splitmix(split.hashes[full] ^ texts.splitmix(owner.astype(np.uint64)))
    again = texts.earlier_equal(keyed)
    first, grams = texts.windows(found, 5)
    repeated = np.zeros(len(documents) + 1, np.int64)
    if len(first):
        twice = texts.found_twice(texts.splitmix(grams ^ texts.splitmix(documents[first].astype(np.uint64))))
        np.add.at(repeated, first[twice], 1)
        np.add.at(repeated, np.minimum(first[twice] + 5, len(documents)), -1)
    covered = np.cumsum(repeated)[:-1] > 0
    distinct = ~texts.earlier_equal(
        texts.splitmix(found.hashes ^ texts.splitmix(documents.astype(np.uint64)))
    )
    ends = np.isin(data[found.ends - 1], list(b".?!")) if len(found.ends) else np.zeros(0, bool)

    def by_word(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, flags, rows).astype(np.int64)

    return np.stack(
        [
            n_words,
            word_chars,
            chars(b"#*$%&|<>"),
            by_word(again, owner),
            by_word(covered, documents),
            by_word(np.ones(len(owner)), owner),
            chars(bytes(range(65, 91))),
            chars(bytes(range(48, 58))),
            chars(b"!?"),
            by_word(distinct, documents),
            by_word(ends, documents),
            chars(b"|"),
        ],
        1,
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Feature columns from rows of counts in the order of ``COUNTS``."""
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    held = {
        "log_words": np.log1p(c["n_words"]),
        "word_length": c["word_chars"] / n,
        "symbol_share": c["n_symbols"] / chars,
        "dup_line_share": c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        "repeat_share": c["n_repeat_words"] / n,
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
        "mark_share": c["n_marks"] / chars,
        "distinct_share": c["n_distinct"] / n,
        "end_share": c["n_ends"] / n,
        "pipe_share": c["n_pipes"] / chars,
    }
    return np.stack([held[f] for f in FEATURES], 1)


def _mapped(forest: trees.Forest | None, ids: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            counts = np.zeros((batch.num_rows, len(COUNTS)), np.int64)
            for first, last, data, offsets in texts.text_blocks(text):
                counts[first:last] = _statistics(data, offsets)
            out = {c: batch.column(c) for c in ids}
            out |= {c: pa.array(counts[:, i]) for i, c in enumerate(COUNTS)}
            if forest is not None:
                score = forest.probability(features(counts))
                n, repeated = counts[:, 0], counts[:, 4]
                failed = (n < 10) | (100 * repeated > 20 * n)
                out |= {
                    "score": pa.array(score),
                    "base_failed": pa.array(failed),
                    "kept": pa.array(~failed & (score >= threshold)),
                }
            yield pa.RecordBatch.from_pydict(out)

    return run


def statistics(df: DataFrame, ids: list[str]) -> DataFrame:
    """Counts of each document (``COUNTS``) beside its columns ``ids``. A null text has no words."""
    schema = schema_of(df, ids) + "".join(f", {c} long" for c in COUNTS)
    return df.select(*ids, "text").mapInArrow(_mapped(None, ids, 0.0), schema)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, **settings) -> trees.Forest:
    """Trees from ``labels`` (doc_id, quality 0 or 1) and the statistics of those documents.

    ``most`` bounds the labelled documents used: those with the smallest hashes of their ids.
    Repeated labels of a document are averaged, rows without an id or label left out. Without
    usable labels the forest accepts every document.
    """
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .transform(statistics, ["doc_id", "_label"])
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .toPandas()
    )
    if not len(found):
        blank = np.zeros((1, len(FEATURES)))
        return trees.fit(blank, np.ones(1), list(FEATURES.values()), **settings)
    x = features(found[COUNTS].to_numpy())
    y = (found["_label"].to_numpy(float) >= 0.5).astype(float)
    return trees.fit(x, y, list(FEATURES.values()), **settings)


def judge(df: DataFrame, forest: trees.Forest, ids: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, ``score`` (probability of good quality), ``base_failed`` and ``kept`` of each row.

    A row fails the base rules with fewer than 10 words, or with over a fifth of its words in
    five-word windows that the text has twice. ``kept`` needs the base rules and a score of at
    least ``threshold``. A null or empty text has no words and so fails. Equal rows are judged
    alike, and each stays a row; other columns of ``df`` are not read.
    """
    schema = schema_of(df, ids) + "".join(f", {c} long" for c in COUNTS) + ", score double, base_failed boolean, kept boolean"
    return df.select(*ids, "text").mapInArrow(_mapped(forest, ids, threshold), schema)
