"""Language identification: script ranges, n-gram scores of words, and Viterbi over the words.

Words are runs of letters (of ASCII) and bytes beyond ASCII. A word's score in a language is the
sum of the log shares of its hashed byte trigrams. The script of a word leaves only languages that
were seen in that script; words in a script of no learned language belong to none. Viterbi with a penalty
for switching then labels spans, so a text in two languages has two spans and not one label for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import texts
from rasterloom.llm.tables import schema_of

BUCKETS = 1 << 16

#: First code point of each range of scripts, and the script that begins there. Signs,
#: ligatures of Latin letters, variation selectors, the byte order mark and emoji count as Latin.
SCRIPT_RANGES = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Latin"),
    (0x2E80, "Han"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD800, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB07, "Other"),
    (0xFE00, "Latin"),
    (0xFE10, "Other"),
    (0xFEFF, "Latin"),
    (0xFF00, "Other"),
    (0x1F000, "Latin"),
    (0x1FB00, "Other"),
    (0x20000, "Han"),
    (0x30000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES}, key=lambda s: (s != "Latin", s))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages


@dataclass
class Scan:
    """Words of a block: byte spans, documents' bounds, script, and n-grams with their bounds."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    scripts: np.ndarray
    grams: np.ndarray
    places: np.ndarray


def _letters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


def scan(data: np.ndarray, offsets: np.ndarray) -> Scan:
    """Words and trigrams of a block; each document is set between blanks."""
    rows = len(offsets) - 1
    held = np.full(len(data) + rows + 1, 32, np.uint8)
    moved = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    held[moved] = _letters()[data]
    upper = np.flatnonzero((held[1:] >= 0x80) & (held[1:] <= 0x9E) & (held[1:] != 0x97) & (held[:-1] == 0xC3)) + 1
    held[upper] += 32
    inside = held != 32
    edges = np.flatnonzero(np.diff(inside.astype(np.int8)))
    starts, ends = edges[::2] + 1, edges[1::2] + 1
    at = np.flatnonzero(inside)
    wide = held.astype(np.uint32)
    gram = (wide[at - 1] << 16) | (wide[at] << 8) | wide[at + 1]
    grams = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    places = np.cumsum(ends - starts) - (ends - starts)
    script = np.zeros(len(at), np.int64)
    lead = np.flatnonzero(held[at] >= 0xC2)
    if len(lead):
        padded = np.concatenate([held, np.zeros(4, np.uint8)]).astype(np.int64)
        p, b = at[lead], padded[at[lead]]
        one, two, three = (padded[p + k] & 0x3F for k in (1, 2, 3))
        point = np.where(
            b < 0xE0,
            (b & 0x1F) << 6 | one,
            np.where(b < 0xF0, (b & 0x0F) << 12 | one << 6 | two, (b & 7) << 18 | one << 12 | two << 6 | three),
        )
        first = np.array([c for c, _ in SCRIPT_RANGES])
        names = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
        script[lead] = names[np.searchsorted(first, point, "right") - 1]
    scripts = np.maximum.reduceat(script, places) if len(places) else script[:0]
    moved_offsets = offsets + np.arange(rows + 1)
    bounds = np.searchsorted(starts, moved_offsets)
    owner = np.repeat(np.arange(1, rows + 1), np.diff(bounds))
    return Scan(starts - owner, ends - owner, bounds, scripts, grams, places)


def word_scores(found: Scan, model: Model, floor: float = -12.0) -> np.ndarray:
    """Scores of the words, languages across, each word's best at 0; all 0 where no script fits."""
    if not len(found.starts):
        return np.zeros((0, len(model.languages)), np.float32)
    total = np.add.reduceat(model.scores[found.grams], found.places, axis=0)
    fits = model.allowed[found.scripts]
    total = np.where(fits, total, -np.inf)
    best = total.max(1, keepdims=True)
    with np.errstate(invalid="ignore"):
        total = np.where(np.isfinite(best), total - best, 0)
    lengths = (found.ends - found.starts)[:, None]
    return np.maximum(total, floor * np.maximum(lengths, 3)).astype(np.float32)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of all words; one step does the n-th word of every document that has one."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, sizes = bounds[:-1][order], lengths[order]
    back = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    value = scores[begin[: active[0]]].copy()
    ends = np.zeros(len(order), np.int64)
    own = np.arange(scores.shape[1], dtype=back.dtype)
    for t in range(1, longest + 1):
        n = active[t] if t < longest else 0
        if n < len(value):
            ends[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        if not n:
            break
        at = begin[:n] + t
        best = value.argmax(1)
        switched = value[np.arange(n), best] - penalty
        stay = value >= switched[:, None]
        back[at] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, switched[:, None]) + scores[at]
    state = ends
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def train(
    df: DataFrame, usable: Column, most: int = 20_000, least_share: float = 0.005, most_languages: int = 200
) -> Model:
    """Model from ``text`` and ``lang`` of the rows of ``df`` that are ``usable``.

    ``most`` bounds the documents used: those with the smallest hashes of ``doc_id``. Counts of
    hashed trigrams are summed by Spark; the driver gets at most 65,536 a language, and at most
    ``most_languages`` are learned: the most frequent in the sample, the first by name where even. A
    language is allowed in a script that at least ``least_share`` of its words are in.
    """
    good = df.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for first, last, data, offsets in texts.text_blocks(batch.column("text")):
                found = scan(data, offsets)
                sizes = np.add.reduceat(np.ones(len(found.grams), np.int64), found.places) if len(found.places) else []
                of_word = np.repeat(np.arange(last - first), np.diff(found.bounds))
                of_gram = np.repeat(of_word, sizes) if len(found.places) else of_word
                for name in set(names[first:last]):
                    mine = np.array([n == name for n in names[first:last]])
                    held = grams.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    held[:BUCKETS] += np.bincount(found.grams[mine[of_gram]], minlength=BUCKETS)
                    held[BUCKETS:] += np.bincount(found.scripts[mine[of_word]], minlength=len(SCRIPTS))
        for name, held in grams.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(held[at])}
            )

    sample = good.join(F.broadcast(picked), "doc_id", "left_semi").select("lang", "text")
    frequent = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).select("lang")
    counted = (
        sample.join(F.broadcast(frequent), "lang", "left_semi")
        .select("lang", "text")
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counted["lang"].unique())
    held = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    column = {name: i for i, name in enumerate(languages)}
    held[counted["bucket"].to_numpy(), counted["lang"].map(column).to_numpy(dtype=np.int64)] = counted["n"].to_numpy()
    grams, scripts = held[:BUCKETS] + 0.5, held[BUCKETS:]
    return Model(
        languages,
        np.log(grams / grams.sum(0)).astype(np.float32),
        scripts >= least_share * np.maximum(scripts.sum(0), 1),
    )


def label(df: DataFrame, model: Model, keep: list[str], penalty: float = 10.0) -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, ``score`` and ``spans`` of each row's ``text``.

    A span is a run of words in one language, with its place in the bytes of the text. The
    predicted language has the most bytes of words (the first by name where even), and the score is
    its share of the bytes of all words. Words in a script that no learned language allows are in no
    language and no span, and part the spans around them; a text of only such words has score 0, no
    spans, and the first language by name. A text that is null or has no letters is ``und`` with score 0
    and no spans; so is every text when no language was learned. Rows do not depend on each other.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        count = len(own.languages)
        for batch in batches:
            predicted, scores, spans = [], [], []
            for first, last, data, offsets in texts.text_blocks(batch.column("text")):
                found = scan(data, offsets)
                rows = last - first
                if not count:
                    predicted += ["und"] * rows
                    scores += [0.0] * rows
                    spans += [[]] * rows
                    continue
                labels = viterbi(word_scores(found, own), found.bounds, penalty)
                labels[~own.allowed[found.scripts].any(1)] = count
                owner = np.repeat(np.arange(rows), np.diff(found.bounds))
                sizes = found.ends - found.starts
                share = np.bincount(owner * (count + 1) + labels, sizes, rows * (count + 1)).reshape(rows, count + 1)
                whole, share = share.sum(1), share[:, :count]
                best = share.argmax(1)
                plain = np.zeros(256, bool)
                plain[[*range(65, 91), *range(97, 123)]] = True
                total = np.concatenate([[0], np.cumsum(plain[data])])[offsets]
                new = np.ones(len(labels), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(labels)) - 1 if len(begin) else begin
                by_row = np.searchsorted(owner[begin], np.arange(rows + 1))
                for i in range(rows):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode() if total[i + 1] == total[i] else "a"
                    if not any(c.isalpha() for c in text):
                        predicted.append("und")
                        scores.append(0.0)
                        spans.append([])
                        continue
                    predicted.append(own.languages[best[i]])
                    scores.append(float(share[i, best[i]] / max(whole[i], 1)))
                    spans.append(
                        [
                            {
                                "start": int(found.starts[begin[k]] - offsets[i]),
                                "end": int(found.ends[end[k]] - offsets[i]),
                                "lang": own.languages[labels[begin[k]]],
                            }
                            for k in range(by_row[i], by_row[i + 1])
                            if labels[begin[k]] < count
                        ]
                    )
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            out = {c: batch.column(c) for c in keep}
            out |= {"lang_pred": pa.array(predicted, pa.string()), "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, kind)}
            yield pa.RecordBatch.from_pydict(out)

    schema = schema_of(df, keep) + ", lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return df.select(*keep, "text").mapInArrow(run, schema)
