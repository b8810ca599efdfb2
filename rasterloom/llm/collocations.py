"""Phrase collocation mining on Rabin-Karp fingerprints.

A block of texts becomes word hashes; prefix sums of ``hash * c^i`` give the polynomial fingerprint
of any run of words as a difference, so all runs of a length cost one numpy expression. Languages and
lengths are mixed into the fingerprint. Fingerprints are counted level by level: words, then pairs of
frequent words, then longer runs whose pairs are all frequent; what is shuffled is each task's sum for a
fingerprint and a pointer, the id of a document that has it. A run that is frequent has frequent
parts, so nothing is lost. Equal fingerprints of different runs can only make counts larger.

Only frequent phrases become strings, each where its pointer says. Then all occurrences of frequent
fingerprints are held against the text at the pointer, by a second hash of their letters. A
fingerprint of which one differs stands for several phrases: these are read from the texts and counted
by their words. So the result does not depend on the fingerprints.

Frequent fingerprints, pointers and second hashes reach the tasks as Bloom filters of at most ``2^27``
bits. Past their capacity they let more runs into the shuffle, which counts them all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.llm import texts
from rasterloom.llm.tables import batches_of, scope, stored

#: What ends a piece, and what parts the words of a piece.
ENDS, BLANKS = ".,;:!?\n\v\f\r", " \t"
#: An odd multiplier and its inverse modulo 2^64.
C = 0xD1342543DE82EF95
C_INVERSE = pow(C, -1, 1 << 64)
#: Fingerprints that a task holds before it sums and sends them, and rows of a batch that it sends.
HELD, SENT = 1 << 18, 1 << 16
#: Bytes of text worked on at once, whose arrays take many times as much, and of a batch of rows that
#: reaches a task; a longer text is a block of its own and ends its batch.
BLOCK, BATCH = 1 << 20, 1 << 22
#: Bits of a part of the filter: what ``bitmap_construct_agg`` fills.
PART = 1 << 15
#: Tasks at least that a language's phrases are dealt to.
DEALS = 256
#: Values of the bytes in the second hash.
OTHER_LETTERS = texts.splitmix(np.arange(1_000, 1_256, dtype=np.uint64)) | np.uint64(1)
#: The place of an occurrence without an id.
NO_ID = -(1 << 63)


def _table(signs: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in signs]] = True
    return found


def _prefix_sums(hashes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * texts.powers(len(hashes))[: len(hashes)], out=sums[1:])
    return sums


class Runs:
    """Words of a block and the fingerprints of their runs inside a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, bits: int):
        """``langs`` is a hash of each row's language; fingerprints keep ``bits`` bits."""
        ends, blanks = _table(ENDS)[data], _table(BLANKS)[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~(ends | blanks)
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        stops = inside[:-1] & ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        lower = data.copy()
        upper = (data >= 65) & (data <= 90)
        lower[upper] += 32
        self.data, self.starts, self.ends = lower, np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        # both rise, so their sum is equal where both are
        self.pieces = np.cumsum(ends)[self.starts] + self.rows
        self.hashes = texts.span_hashes(lower, self.starts, self.ends, texts._letters(False))
        if bits < 64:
            self.hashes &= np.uint64((1 << bits) - 1)
        self.langs, self.bits = langs, bits
        self.sums = _prefix_sums(self.hashes)
        back = np.full(max(len(self.starts), 1), C_INVERSE, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def at(self, n: int) -> np.ndarray:
        """First words of all runs of ``n`` words."""
        last = len(self.starts) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.pieces[:last] == self.pieces[n - 1 :]) if n > 1 else np.arange(last)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the runs of ``n`` words from ``at`` on."""
        found = (self.sums[at + n] - self.sums[at]) * self.back[at]
        found = texts.splitmix(found + self.langs[self.rows[at]] + np.uint64(n))
        return found & np.uint64((1 << self.bits) - 1) if self.bits < 64 else found

    def with_checks(self) -> Runs:
        """Adds sums of other hashes of the words, for ``checks``."""
        self.others = _prefix_sums(texts.span_hashes(self.data, self.starts, self.ends, OTHER_LETTERS))
        return self

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        """A second hash of runs, all bits of it."""
        return texts.splitmix((self.others[at + n] - self.others[at]) * self.back[at] + self.langs[self.rows[at]])

    def passing(self, most: int, frequent: np.ndarray | None, known: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``n, first words, fingerprints`` of runs of up to ``most`` words all of whose parts of up to
        ``known`` words are in the filter ``frequent``."""
        part = None
        for n in range(1, most + 1):
            at = self.at(n)
            if n > 1 and frequent is not None and known:
                at = at[part[at] & part[at + 1]]
            found = self.prints(at, n)
            if n <= known:
                fits = contains(frequent, found)
                at, found = at[fits], found[fits]
            if known:
                part = np.zeros(len(self.starts) + 1, bool)
                part[at] = True
            yield n, at, found


def contains(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the filter holds them: bits at the lowest and at the highest digits."""
    size = np.uint64(len(bits) * 8)
    width = int(size).bit_length() - 1

    def held(place: np.ndarray) -> np.ndarray:
        return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    found = held(prints & (size - np.uint64(1)))
    found[found] = held(prints[found] >> np.uint64(64 - width))
    return found


def filter_of(prints: DataFrame, n: int, least_bits: int = 20, most_bits: int = 27) -> np.ndarray:
    """A Bloom filter of the column ``print`` of ``n`` rows, at most ``2^most_bits`` bits in all."""
    width = min(max((256 * n).bit_length(), least_bits), most_bits)
    places = F.array(
        F.col("print").bitwiseAND(F.lit((1 << width) - 1)), F.shiftrightunsigned("print", 64 - width)
    )
    place = prints.select(F.explode(places).alias("place"))
    part, bit = F.floor(F.col("place") / PART).cast("int"), F.col("place") % PART
    found = place.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    bits = np.zeros((1 << width) // 8, np.uint8)
    for row in found.collect():
        bits[row["part"] * PART // 8 : (row["part"] + 1) * PART // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def joined(prints: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One key of a fingerprint and another number."""
    return texts.splitmix(prints ^ texts.splitmix(other.view(np.uint64)))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct fingerprints of ``(fingerprints, counts, documents)``, sums, and a document of each."""
    prints, counts, docs = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(prints)
    prints = prints[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])[: len(prints)])
    sums = np.add.reduceat(counts[order], first) if len(first) else counts
    return prints[first], sums, docs[order[first]]


def _lang_hashes(names: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct names, the name of each row, and a hash of each row's name."""
    coded = names.dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    data, offsets = texts.utf8(pa.array(kinds, pa.string()))
    full = np.flatnonzero(np.diff(offsets))
    hashes = np.zeros(max(len(kinds), 1), np.uint64)
    hashes[full] = texts.span_hashes(data, offsets[:-1][full], offsets[1:][full], texts._letters(False))
    codes = coded.indices.to_numpy()
    return kinds, codes, texts.splitmix(hashes)[codes]  # unlike the hash of a word that is spelt the same


def _counted(lengths: range, held, known: int, bits: int):
    """Counts of fingerprints of a task's runs of ``lengths`` words, and a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def send(prints: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(prints), SENT):
                columns = (prints[i : i + SENT].view(np.int64), counts[i : i + SENT], docs[i : i + SENT])
                yield pa.RecordBatch.from_pydict(dict(zip(("print", "n", "doc_id"), map(pa.array, columns), strict=True)))

        for batch in batches:
            _, _, hashes = _lang_hashes(batch.column("lang"))
            ids = batch.column("doc_id").to_numpy()
            for first, last, data, offsets in texts.text_blocks(batch.column("text"), BLOCK):
                runs = Runs(data, offsets, hashes[first:last], bits)
                for n, at, found in runs.passing(lengths[-1], held.value if held else None, known):
                    if n in lengths:
                        kinds, one, times = np.unique(found, return_index=True, return_counts=True)
                        parts.append((kinds, times, ids[first + runs.rows[at[one]]]))
                        waiting += len(kinds)
                if waiting >= HELD:
                    parts = [_summed(parts)]
                    waiting = 0
                    if len(parts[0][0]) >= HELD:
                        yield from send(*parts.pop())
        if parts:
            yield from send(*_summed(parts))

    return run


def _differing(most: int, held, texts_held, bits: int):
    """Frequent fingerprints of occurrences that are not the text at the pointer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, hashes = _lang_hashes(batch.column("lang"))
            for first, last, data, offsets in texts.text_blocks(batch.column("text"), BLOCK):
                runs, odd = Runs(data, offsets, hashes[first:last], bits).with_checks(), []
                for n, at, prints in runs.passing(most, None, 0):
                    fits = contains(held.value, prints)
                    at, prints = at[fits], prints[fits]
                    same = contains(texts_held.value, joined(prints, runs.checks(at, n)))
                    odd.append(prints[~same])
                yield pa.RecordBatch.from_pydict({"print": pa.array(np.unique(np.concatenate(odd)).view(np.int64))})

    return run


class _Pool:
    """Phrases of a task: counts and a place by the words themselves."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.held: dict[int, tuple[np.ndarray, ...]] = {}
        self.apart: list[tuple[np.ndarray, ...]] = []

    def word_ids(self, runs: Runs, used: np.ndarray) -> np.ndarray:
        """Numbers of the words that are ``used``; equal numbers are equal words, whatever their hashes."""
        found = np.full(len(runs.starts), -1, np.int64)
        at = np.flatnonzero(used)
        if not len(at):
            return found
        _, one, kind = np.unique(runs.hashes[at], return_index=True, return_inverse=True)
        starts, lengths = runs.starts[at], runs.ends[at] - runs.starts[at]
        alike = one[kind]
        same = np.array_equal(lengths[alike], lengths)
        if same:
            begin = np.cumsum(lengths) - lengths
            within = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
            same = np.array_equal(
                runs.data[within + np.repeat(starts, lengths)], runs.data[within + np.repeat(starts[alike], lengths)]
            )
        if not same:
            one, kind = np.arange(len(at)), np.arange(len(at))
        raw, own = runs.data.tobytes(), self.words
        ids = [
            own.setdefault(raw[a:b], len(own))
            for a, b in zip(starts[one].tolist(), (starts + lengths)[one].tolist(), strict=True)
        ]
        found[at] = np.array(ids)[kind]
        return found

    def add(self, n: int, prints: np.ndarray, words: np.ndarray, langs: np.ndarray, places: np.ndarray) -> None:
        """Occurrences: fingerprint, ``n`` word numbers, language, and ``(id, start, second hash)``."""
        _, one, kind, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        if not (np.array_equal(words[one[kind]], words) and np.array_equal(langs[one[kind]], langs)):
            # a fingerprint of several phrases: tell them by their words
            keys = np.column_stack([prints.view(np.int64), langs, words])
            _, one, counts = np.unique(keys, axis=0, return_index=True, return_counts=True)
            order = np.argsort(prints[one], kind="stable")
            one, counts = one[order], counts[order]
            double = np.zeros(len(one), bool)
            double[1:] = prints[one][1:] == prints[one][:-1]
            self.apart.append((prints[one][double], words[one][double], langs[one][double], counts[double], places[one][double]))
            one, counts = one[~double], counts[~double]
        new = (prints[one], words[one], langs[one], counts, places[one])
        old = self.held.get(n)
        if old is None:
            self.held[n] = new
            return
        at = np.minimum(np.searchsorted(old[0], new[0]), len(old[0]) - 1)
        hit = old[0][at] == new[0]
        same = hit & (old[1][at] == new[1]).all(1) & (old[2][at] == new[2])
        old[3][at[same]] += new[3][same]
        other = hit & ~same
        if other.any():
            self.apart.append(tuple(a[other] for a in new))
        if not hit.all():
            joined = [np.concatenate([a, b[~hit]]) for a, b in zip(old, new, strict=True)]
            order = np.argsort(joined[0], kind="stable")
            self.held[n] = tuple(a[order] for a in joined)

    def __len__(self) -> int:
        return sum(len(h[0]) for h in self.held.values()) + sum(len(a[0]) for a in self.apart)

    def sent(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """All phrases as rows; the pool is empty then."""
        by_id = list(self.words)
        for found in [*self.held.values(), *self.apart]:
            for i in range(0, len(found[0]), SENT):
                prints, words, langs, counts, places = (a[i : i + SENT] for a in found)
                phrases = [b" ".join([by_id[w] for w in row]).decode() for row in words.tolist()]
                yield _rows([names[i] for i in langs.tolist()], phrases, words.shape[1], counts, places, prints)
        self.__init__()


def _rows(langs, phrases, size: int, counts: np.ndarray, places: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "lang": pa.array(langs, pa.string()),
            "phrase": pa.array(phrases, pa.string()),
            "words": pa.array([size] * len(phrases), pa.int32()),
            "n": pa.array(counts.astype(np.int64)),
            "doc_id": pa.array(places[:, 0]),
            "start": pa.array(places[:, 1]),
            "print": pa.array(prints.view(np.int64)),
            "other": pa.array(places[:, 2]),
        }
    )


PHRASES = "lang string, phrase string, words int, n long, doc_id long, start long, print long, other long"


def _materialised(most: int, held, pointers, bits: int):
    """Phrases of a task with their counts: those at ``pointers``, or without them all in ``held``.

    With pointers, a row of 0 words has all words of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, names, total = _Pool(), {}, {}
        for batch in batches:
            kinds, codes, hashes = _lang_hashes(batch.column("lang"))
            numbers = np.array([names.setdefault(k, len(names)) for k in kinds] or [0])[codes]
            ids = batch.column("doc_id").to_numpy()
            for first, last, data, offsets in texts.text_blocks(batch.column("text"), BLOCK):
                runs = Runs(data, offsets, hashes[first:last], bits).with_checks()
                for number, words in enumerate(np.bincount(numbers[first:last][runs.rows], minlength=len(names))):
                    total[number] = total.get(number, 0) + int(words)
                chosen, used = [], np.zeros(len(runs.starts), bool)
                for n, at, prints in runs.passing(most, None, 0):
                    if pointers:
                        fits = contains(pointers.value, joined(prints, ids[first + runs.rows[at]]))
                        at, prints = at[fits], prints[fits]
                    fits = contains(held.value, prints)
                    at, prints = at[fits], prints[fits]
                    chosen.append((n, at, prints))
                    for k in range(n):
                        used[at + k] = True
                word_ids = pool.word_ids(runs, used)
                for n, at, prints in chosen:
                    if len(at):
                        words = np.column_stack([word_ids[at + k] for k in range(n)])
                        row = runs.rows[at]
                        places = np.column_stack(
                            [ids[first + row], runs.starts[at] - offsets[row], runs.checks(at, n).view(np.int64)]
                        )
                        pool.add(n, prints, words, numbers[first:last][row], places)
                if len(pool) >= HELD:
                    yield from pool.sent(list(names))
        by_number = list(names)
        yield from pool.sent(by_number)
        if total and pointers:
            nowhere = np.column_stack([np.full(len(total), NO_ID)] + 2 * [np.zeros(len(total), np.int64)])
            counts = np.array(list(total.values()))
            yield _rows(
                [by_number[i] for i in total], [""] * len(total), 0, counts, nowhere, np.zeros(len(total), np.uint64)
            )

    return run


def _sent(spark, prints: DataFrame, n: int):
    return spark.sparkContext.broadcast(filter_of(prints, n))


def _key(other: str):
    """``joined`` as rows of a table have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = joined(batch.column("print").to_numpy().view(np.uint64), batch.column(other).to_numpy())
            yield pa.RecordBatch.from_pydict({"print": pa.array(keys.view(np.int64))})

    return run


def frequent_phrases(df: DataFrame, most: int = 5, least: int = 100, bits: int = 64) -> DataFrame:
    """``lang, phrase, words, n, doc_id`` of the runs of 1 to ``most`` words found ``least`` times or more in a
    language, and of each language's words in all (``words`` 0, an empty phrase).

    ``n`` counts occurrences inside pieces, overlaps included; ``doc_id`` is a document that has one. A-Z
    are lowered, a null text is empty, a null ``lang`` is ``und``. Repeated rows and ids count as often as
    they stand there. An empty table gives no rows. Of other columns none is read. ``bits`` is the width
    of the fingerprints and does not change the result.
    """
    with batches_of(df.sparkSession, BATCH):
        return _frequent_phrases(df, most, least, bits)


def _frequent_phrases(df: DataFrame, most: int, least: int, bits: int) -> DataFrame:
    spark = df.sparkSession
    read = df.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    held, known, prints = None, 0, None
    levels = [range(n, n + 1) for n in (1, 2) if n <= most] + ([range(3, most + 1)] if most > 2 else [])
    for lengths in levels:
        counted = read.mapInArrow(_counted(lengths, held, known, bits), "print long, n long, doc_id long")
        level = counted.groupBy("print").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))
        level = stored(level.where(F.col("n") >= least), "frequent-prints")
        prints = level if prints is None else prints.unionByName(level)
        size = prints.count()
        held = _sent(spark, prints.select("print"), size)
        known = lengths[-1]
    if bits < 64:  # levels may share fingerprints
        prints = prints.groupBy("print").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))
    pointers = _sent(spark, prints.select("print", "doc_id").mapInArrow(_key("doc_id"), "print long"), size)
    found = stored(read.mapInArrow(_materialised(most, held, pointers, bits), PHRASES), "phrases")
    whole = found.where("words = 0").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    # the filter of pointers may let other documents through: their text is as good
    one = F.min(F.struct("lang", "phrase", "words", "other", "doc_id")).alias("_one")
    named = found.where("words > 0").join(prints.select("print", F.col("n").alias("_n")), "print")
    named = named.groupBy("print", F.col("_n").alias("n")).agg(one).select("print", "n", "_one.*")
    named = stored(named, "named")
    checks = _sent(spark, named.select("print", "other").mapInArrow(_key("other"), "print long"), size)
    odd = read.mapInArrow(_differing(most, held, checks, bits), "print long").distinct()
    odd = stored(odd.join(prints.select("print"), "print", "left_semi"), "collisions")
    columns = ["lang", "phrase", "words", "n", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id")]
    result = named.join(odd, "print", "left_anti").select(*columns)
    differing = odd.count()
    if differing:
        again = read.mapInArrow(_materialised(most, _sent(spark, odd, differing), None, bits), PHRASES)
        again = again.join(odd, "print", "left_semi").groupBy("lang", "phrase", "words")
        again = again.agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")).where(F.col("n") >= least)
        result = result.unionByName(stored(again.select(*columns), "told-apart"))
    return result.unionByName(whole.select("lang", "phrase", "words", "n", F.lit(None).cast("long").alias("doc_id")))


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of phrases of two words or more, by their lowest cut.

    The score of a cut is ``1000 * a * n / (l * r)``, floored, in decimal numbers of 38 digits; of even
    cuts the one with the shortest first part counts.
    """
    counts = phrases.where("words > 0").select("lang", "phrase", "n")
    # one row a language, dealt out so that a frequent language is not one task
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALS)).cast("int").alias("deal")
    whole = phrases.where("words = 0").select("lang", F.col("n").alias("total"))
    whole = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    split = F.split("phrase", " ")
    cuts = (
        phrases.where("words > 1")
        .select("lang", "phrase", "words", F.col("n").alias("a"), split.alias("_w"))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .select(
            "lang", "phrase", "words", "a", "k",
            F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("left"),
            F.array_join(F.slice("_w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
        )
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    found = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    found = found.select("*", deal).join(whole, ["lang", "deal"])
    wide = "decimal(19,0)"
    up = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("total").cast("decimal(17,0)")
    found = found.withColumn("_up", up).withColumn("_down", F.col("l").cast(wide) * F.col("r").cast("decimal(18,0)"))
    found = found.withColumn("score", F.expr("_up div _down"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("_cut")
    best = found.groupBy("lang", "phrase", "words", "a", F.col("total").alias("n")).agg(lowest)
    return best.select("lang", "phrase", "words", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def without_inner(found: DataFrame, percent: int = 100) -> DataFrame:
    """``found`` without phrases whose words stand inside a longer one that is ``percent`` as frequent."""
    words = F.split("phrase", " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")
            ),
        )
    )
    inner = found.where("words > 2").select("lang", "a", F.explode(spans).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    joined = found.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def collocations(df: DataFrame, top: int = 2000, most: int = 5, least: int = 100, bits: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` collocations of each language.

    ``df`` has ``doc_id, lang, text``; see ``frequent_phrases`` for what counts. Ties in score go by
    ``a`` downwards, then by the bytes of the phrase. A language without a frequent phrase of two words
    has no rows.
    """
    with scope(df.sparkSession):
        phrases = stored(frequent_phrases(df, most, least, bits), "phrases", outlives=True)
    found = without_inner(scored(phrases))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^ \t]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM
    (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {most} + 1)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {least}),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, t.n,
    (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM
    (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM
      (SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM
        (SELECT lang, a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))) GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= {top}
"""


def sql(top: int = 2000, most: int = 5, least: int = 100) -> str:
    """SQL for ``collocations`` over ``documents``."""
    return SQL.replace("{top}", str(top)).replace("{most}", str(most)).replace("{least}", str(least))
