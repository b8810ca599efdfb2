"""Line dedup: repeated runs of lines found by ranking line sequences with prefix doubling.

Lines with a word get ids; in round k every position is ranked by its first ``2^k`` lines, from the
ranks of the two halves, and positions whose lines occur nowhere else leave. Ranks keep the order
of the sorted sequences, so they are the groups of a suffix array cut at that depth: equal ranks are
an interval of suffixes with a common prefix of ``2^k`` lines.

A run counts when it has ``min_words`` words, and every line of a repeated run goes but in its first copy.
Let ``n(p)`` be the fewest lines from position p with so many words. The windows ``[p, p + n(p))`` and
the shortest windows of enough words that end at each line cover such a run: a line from which there are enough
words to the run's end begins one, a line up to which there are enough from its start ends one, and any
other line is in the window that opens the run.

So it is enough to find, for every window, the interval of suffixes that share its lines, which are
at most ``min_words``; that bounds the rounds. A prefix of ``n`` lines is told by two ranks of
``2^k <= n`` lines that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.llm import texts
from rasterloom.llm.tables import scope, stored


def _line_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ids = batch.column("_uid").to_numpy(), batch.column("doc_id")
            for first, last, data, offsets in texts.text_blocks(batch.column("text")):
                found, split = texts.words(data, offsets), texts.lines(data, offsets)
                at = np.searchsorted(found.starts, split.starts)
                words = np.searchsorted(found.starts, split.ends) - at
                full = np.flatnonzero(words)
                owner, total = split.documents[full], np.concatenate([[0], np.cumsum(words[full])])
                bounds = np.searchsorted(owner, np.arange(last - first + 1))
                end = np.searchsorted(total, total[:-1] + min_words)
                fits = end <= bounds[owner + 1]
                begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
                closes = (begin >= bounds[owner]) & (end[begin] != np.arange(1, len(full) + 1))
                raw = data.tobytes()
                lines = [
                    hashlib.blake2b(raw[a:b], digest_size=16).digest()
                    for a, b in zip(split.starts[full].tolist(), split.ends[full].tolist(), strict=True)
                ]
                picked = pa.array(first + owner)
                place = (full - split.bounds[owner]).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "uid": pa.array(uids[first + owner]),
                        "doc_id": ids.take(picked).cast(pa.int64()),
                        "at": pa.array((np.arange(len(full)) - bounds[owner]).astype(np.int64)),
                        "line": pa.array(lines, pa.binary()),
                        "need": pa.array(np.where(fits, end - np.arange(len(full)), 0).astype(np.int64)),
                        "first": pa.array(place),
                        "last": pa.array(place[np.where(fits, end, np.arange(1, len(full) + 1)) - 1]),
                        "back": pa.array(np.where(closes, np.arange(1, len(full) + 1) - begin, 0).astype(np.int64)),
                        "begin": pa.array(np.where(closes, place[begin], 0).astype(np.int64)),
                    }
                )

    return run


def ranked(rows: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """``uid, at, rank`` of the rows whose ``keys`` occur twice or more; ranks rise with the keys."""
    groups = rows.groupBy(*keys).count().where("count > 1").orderBy(*keys)
    groups = groups.select(*keys, F.monotonically_increasing_id().alias("rank"))
    return stored(rows.join(groups, keys).select("uid", "at", "rank"), purpose)


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """``level, uid, at, rank``: positions ranked by their first ``2^level`` lines, up to ``depth``."""
    rank = ranked(lines.select("uid", "at", "line"), ["line"], "lines-0")
    found, level = rank.select(F.lit(0).alias("level"), "*"), 0
    while 2 << level <= depth:
        half = 1 << level
        after = rank.select("uid", (F.col("at") - half).alias("at"), F.col("rank").alias("second"))
        pairs = rank.withColumnRenamed("rank", "first").join(after, ["uid", "at"])
        level += 1
        rank = ranked(pairs, ["first", "second"], f"lines-{level}")
        found = found.unionByName(rank.select(F.lit(level).alias("level"), "*"))
    return found


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """``uid, at, need, first, last`` of the windows of enough words that occur earlier in the corpus:
    place and number of their lines with words, and their first and last of all lines.

    Earlier means a smaller ``doc_id`` (null first), then an earlier row, then an earlier line.
    """
    ranks = suffix_ranks(lines, min_words)
    onward = F.struct("at", "need", "first", "last")
    closing = F.struct(
        F.expr("at - back + 1").alias("at"), F.col("back").alias("need"), F.col("begin").alias("first"), F.col("first").alias("last")
    )
    windows = lines.select("uid", "doc_id", F.inline(F.filter(F.array(onward, closing), lambda w: w["need"] > 0)))
    windows = windows.withColumn("level", F.floor(F.log2("need") + 1e-9).cast("int"))
    windows = windows.withColumn("tail", F.expr("at + need - shiftleft(1L, level)"))
    head = ranks.withColumnRenamed("rank", "head")
    tail = ranks.select("level", "uid", F.col("at").alias("tail"), F.col("rank").alias("rest"))
    found = windows.join(head, ["level", "uid", "at"]).join(tail, ["level", "uid", "tail"])
    keys = ["need", "head", "rest"]
    own = F.struct("doc_id", "uid", "at")
    kinds = found.groupBy(*keys).agg(F.min(own).alias("original"), F.count("*").alias("n")).where("n > 1")
    return found.join(kinds.drop("n"), keys).where(own != F.col("original")).select(
        "uid", "at", "need", "first", "last"
    )


def merged(windows: DataFrame) -> DataFrame:
    """``uid, runs``: sorted runs (``first, last``) of the lines that windows cover.

    Windows whose lines with words touch are one run, so lines without a word between them go too. A row's
    windows are sorted once, whatever their number.
    """
    order = Window.partitionBy("uid").orderBy("at", "need")
    reach = F.max(F.col("at") + F.col("need")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("at") > reach, F.lit(True)).cast("long")
    marked = windows.withColumn("opens", opens).withColumn(
        "run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    runs = marked.groupBy("uid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """Lines outside the sorted runs, cut out as slices."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines).cast("long")))
    return F.flatten(
        F.zip_with(begins, ends, lambda a, b: F.slice(lines, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    )


def dedup_lines(df: DataFrame, keep: list[str], min_words: int = 30) -> DataFrame:
    """Columns ``keep`` and ``text`` without later copies of repeated runs of lines.

    Lines are parted by ``\\n``; ids are digests of whole lines, and lines without a word are passed
    over (they go where the lines with words on both sides go). A run is deleted, to its last line, where the
    same lines, ``min_words`` words or more, stand earlier in the corpus; its first copy stays. ``n_lines``
    counts the lines there were, ``n_deleted`` those that went, ``runs`` holds their numbers from 0. All
    lines of a row may go; the text is then empty. Null and empty texts stay as they are, repeated rows
    lose what the first of them has. ``df`` needs an integer ``doc_id`` and ``text``; ``keep`` may not
    have the other names of the result.
    """
    if taken := [c for c in keep if c.lower() in ("n_lines", "n_deleted", "runs")]:
        raise ValueError(f"columns {taken} are made here")
    columns = [c for c in keep if c != "text"]
    with scope(df.sparkSession):
        held = stored(
            df.select(F.struct(*columns).alias("_kept"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
                "_uid", F.monotonically_increasing_id()
            ),
            "line-texts",
            outlives=True,
        )
        lines = stored(
            held.select("_uid", "doc_id", "text").mapInArrow(
                _line_rows(min_words),
                "uid long, doc_id long, at long, line binary, need long, first long, last long, back long, begin long",
            ),
            "line-ids",
        )
        copies = merged(later_copies(lines, min_words)).withColumnRenamed("uid", "_uid")
        copies = stored(copies, "line-runs", outlives=True)
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    parted = F.split(F.coalesce("text", F.lit("")), "\n")
    return (
        held.join(copies, "_uid", "left")
        .withColumns({"runs": F.coalesce("runs", none), "_lines": parted})
        .withColumn("_left", F.when(F.size("runs") > 0, _without(F.col("_lines"), F.col("runs"))).otherwise(F.col("_lines")))
        .select(
            "_kept.*",
            F.when(F.size("runs") > 0, F.array_join("_left", "\n")).otherwise(F.col("text")).alias("text"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_left")).cast("long").alias("n_deleted"),
            "runs",
        )
    )


#: The rule by maximal runs: equal lines whose places differ by the same number follow one another.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
f AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f WHERE n > 0),
m AS (SELECT a.doc_id, a.r, a.i, a.n, b.doc_id AS other, a.r - b.r AS apart FROM g a JOIN g b
  ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.r < a.r))),
s AS (SELECT *, r - row_number() OVER (PARTITION BY doc_id, other, apart ORDER BY r) AS run FROM m),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, other, apart, run) AS words FROM s),
full_gone AS (SELECT DISTINCT doc_id, r, i FROM t WHERE words >= {words}),
between_gone AS (SELECT a.doc_id, unnest(range(a.i + 1, b.i)) AS i
  FROM full_gone a JOIN full_gone b ON a.doc_id = b.doc_id AND b.r = a.r + 1),
gone AS (SELECT doc_id, i FROM full_gone UNION ALL SELECT doc_id, i FROM between_gone)
SELECT l.doc_id, any_value(d.text IS NULL) AS was_null,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text,
  count(*) AS n_lines, count(gone.i) AS n_deleted
FROM l JOIN d USING (doc_id) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i
GROUP BY l.doc_id
"""


def sql(min_words: int = 30) -> str:
    """SQL for ``doc_id, text, n_lines, n_deleted`` over ``documents`` with distinct ids."""
    body = SQL.replace("{words}", str(min_words))
    return f"SELECT doc_id, CASE WHEN was_null THEN NULL ELSE text END AS text, n_lines, n_deleted FROM ({body})"
