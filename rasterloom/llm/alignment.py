"""Cross-tokenizer alignment: links of two tokenizers' tokens, counted on inverted pair bitmaps.

Two tokenizers cut the same bytes. Where tokens of both end at one byte they are linked, and such
ends cut a text into groups. Documents are numbered inside chunks; for each pair of ids a chunk holds
the documents with such a link as bitmaps: plane k has the documents whose number of links has bit k.
The OR of the planes, popcounted, is the pair's documents; popcounts weighted by ``2^k`` are its
links. Bitmaps are compressed: places as 16-bit numbers where there are few, else bits.

Counts of pairs are summed over chunks. A pair's count goes back along its postings: every chunk adds the
counts of its pairs to the documents that its bitmaps name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import bpe, texts
from rasterloom.llm.tables import schema_of, stored

#: Documents of a chunk, and postings after which a chunk is closed.
CHUNK, POSTINGS = 1 << 16, 1 << 21
#: Texts are encoded in blocks of so many bytes.
BLOCK = 1 << 21
#: Encoded segments that a worker keeps.
SEGMENTS = 1 << 20


class _Bytewise:
    """Ids by a file of ranks, special strings being plain text."""

    def __init__(self, path: str):
        self.codec = bpe.Codec(path)
        self.codec.specials = {}
        self.lengths, self.starts, self.bytes = self.codec.token_lengths, self.codec.token_starts, self.codec.token_bytes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.codec.encode_block(data, offsets)[0]


class _Pieces:
    """Ids by a sentencepiece model, which itself adds the space that each text begins with.

    No piece of such a model has a space behind another sign, so merges never go across the begin of a
    run of spaces: segments from one such begin to the next are encoded apart, equal ones once.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        held = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i)
            else b"" if self.model.is_control(i)
            else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        ]
        self.lengths = np.array([len(t) for t in held])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(held), np.uint8)
        self.known: dict[bytes, list[int]] = {b" ": [self.model.piece_to_id("▁")]}

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1]] = True
        if self.apart:
            blank = data == 32
            begins |= blank
            begins[1:] &= ~(blank[1:] & blank[:-1])
            begins[offsets[:-1]] = True
        return np.flatnonzero(begins)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts = self._segments(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        hashes = texts.span_hashes(data, starts, starts + lengths, texts._letters(False))
        _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
        alike = one[kind]
        if not (
            np.array_equal(lengths[alike], lengths) and np.array_equal(data, data[bpe.spans_of(starts[alike], lengths)])
        ):
            one, kind = np.arange(len(starts)), np.arange(len(starts))
        raw, known = data.tobytes(), self.known
        wanted = [raw[a : a + n] for a, n in zip(starts[one].tolist(), lengths[one].tolist(), strict=True)]
        new = [s for s in dict.fromkeys(wanted) if s not in known]
        if len(known) + len(new) > SEGMENTS:
            self.known = known = {b" ": known[b" "]}
            new = [s for s in dict.fromkeys(wanted) if s not in known]
        known.update(zip(new, self.model.encode([s[1:].decode() for s in new], num_threads=1), strict=True))
        ids = [known[s] for s in wanted]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for s in ids for i in s), np.int32, int(counts.sum()))
        begin = np.cumsum(counts) - counts
        return flat[bpe.spans_of(begin[kind], counts[kind])]


def _bytes_of(coder, ids: np.ndarray) -> np.ndarray:
    lengths = coder.lengths[ids]
    return coder.bytes[bpe.spans_of(coder.starts[ids], lengths)]


def _owners(ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each token ends in."""
    return np.searchsorted(offsets, ends - 1, "right") - 1


def encoded(data: np.ndarray, offsets: np.ndarray, a, b):
    """``(rows, ids, ends) of both`` for rows that are not empty and whose tokens give back their bytes."""
    rows = np.flatnonzero(np.diff(offsets))
    while True:
        lengths = offsets[rows + 1] - offsets[rows]
        own = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(lengths + 1, out=own[1:])
        held = np.full(int(own[-1]), 32, np.uint8)
        held[bpe.spans_of(own[:-1] + 1, lengths)] = data[bpe.spans_of(offsets[rows], lengths)]
        if not len(rows):
            none = np.zeros(0, np.int64)
            return rows, own, none, none, none, none
        found, whole = [], np.ones(len(rows), bool)
        for coder in (a, b):
            ids = coder.encode(held, own)
            back = _bytes_of(coder, ids)
            if not np.array_equal(back, held):
                whole &= _unchanged(coder, held, own)
            found += [ids.astype(np.int64), np.cumsum(coder.lengths[ids])]
        if whole.all():
            return rows, own, *found
        rows = rows[whole]


def _unchanged(coder, held: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which rows come back as they were, each encoded by itself."""
    found = np.zeros(len(own) - 1, bool)
    for i in range(len(found)):
        row = held[own[i] : own[i + 1]]
        found[i] = np.array_equal(_bytes_of(coder, coder.encode(row, np.array([0, len(row)]))), row)
    return found


def _names(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimals of the ids, each with room for a sign behind it."""
    names = [str(i).encode() + b"," for i in range(size)]
    lengths = np.array([len(n) for n in names])
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(lengths) - lengths, lengths


def group_digests(ids_a, linked_a, ids_b, linked_b, owner_a, owner_b, rows: int, names) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each row; ``linked`` marks the last token of a group."""
    group_a, group_b = np.cumsum(linked_a) - linked_a, np.cumsum(linked_b) - linked_b
    last_a, last_b = np.flatnonzero(linked_a) + 1, np.flatnonzero(linked_b) + 1
    at_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b])[group_a]
    at_b = np.arange(len(ids_b)) + last_a[group_b]
    merged, signs = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    merged[at_a], merged[at_b] = ids_a, ids_b
    signs[at_a[linked_a]], signs[at_b[linked_b]] = ord("|"), ord(";")
    letters, starts, lengths = names
    tokens = np.bincount(owner_a, minlength=rows) + np.bincount(owner_b, minlength=rows)
    parts = np.concatenate([[0], np.cumsum(tokens)])
    found = []
    for first, last in texts.blocks(parts, 1 << 18):
        lo, hi = parts[first], parts[last]
        own = merged[lo:hi]
        text = letters[bpe.spans_of(starts[own], lengths[own])]
        ends = np.cumsum(lengths[own])
        text[ends - 1] = signs[lo:hi]
        cuts = np.concatenate([[0], ends])[parts[first : last + 1] - lo]
        raw = text.tobytes()
        found += [
            hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else ""
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]
    return found


def packed(places: np.ndarray) -> bytes:
    """A compressed bitmap of sorted places below ``CHUNK``: the places, or bits where they take less."""
    if 2 * len(places) < CHUNK // 8:
        return b"a" + places.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, bool)
    bits[places] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    if held[:1] == b"a":
        return np.frombuffer(held, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8, offset=1), bitorder="little"))


def popcount(held: bytes) -> int:
    if held[:1] == b"a":
        return (len(held) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(held, np.uint8, offset=1)).sum())


class _Chunk:
    """Postings of up to ``CHUNK`` documents: sorted ``a << 40 | b << 16 | slot`` with numbers of links."""

    def __init__(self):
        self.docs, self.waiting, self.parts = 0, 0, []

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            kinds, counts = np.unique(keys, return_counts=True)
            self.parts.append((kinds, counts))
            self.waiting += len(kinds)

    def rows(self, chunk: int) -> Iterator[dict[str, pa.Array]]:
        """``chunk, a, b, n_docs, n_links, planes`` of each pair."""
        if not self.parts:
            return
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        pair, slot = keys >> np.uint64(16), (keys & np.uint64(CHUNK - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        bounds = np.append(first, len(pair))
        links = np.add.reduceat(counts, first)
        flat, ends = [], [0]
        single = np.maximum.reduceat(counts, first) == 1
        for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = slot[lo:hi]
            if single[i]:
                flat.append(packed(own))
            else:
                times = counts[lo:hi]
                for k in range(int(times.max()).bit_length()):
                    flat.append(packed(own[(times >> k) & 1 > 0]))
            ends.append(len(flat))
            if len(flat) >= 1 << 16 or i == len(first) - 1:
                done = i + 1
                size = len(ends) - 1
                at = slice(done - size, done)
                own_pair = pair[first[at]]
                yield {
                    "chunk": pa.array(np.full(size, chunk)),
                    "a": pa.array((own_pair >> np.uint64(24)).astype(np.int32)),
                    "b": pa.array((own_pair & np.uint64((1 << 24) - 1)).astype(np.int32)),
                    "n_docs": pa.array(np.diff(bounds)[at].astype(np.int64)),
                    "n_links": pa.array(links[at].astype(np.int64)),
                    "planes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary())),
                }
                flat, ends = [], [0]


ROWS = "chunk long, slot int, n_a long, n_b long, n_groups long, groups_sha256 string"
POSTED = "a int, b int, n_docs long, n_links long, planes array<binary>"


def _scan(path_a: str, path_b: str, keep: list[str], chunk_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = bpe.worker_cache(("bytewise", path_a), lambda: _Bytewise(path_a))
        b = bpe.worker_cache(("pieces", path_b), lambda: _Pieces(path_b))
        names = bpe.worker_cache(("decimals",), lambda: _names(max(len(a.lengths), len(b.lengths))))
        number, open_ = TaskContext.get().partitionId() << 32, _Chunk()

        def whole(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema
            )

        for batch in batches:
            kept = batch.select(keep)
            schema = pa.schema(
                [pa.field(f"_{i}", f.type) for i, f in enumerate(kept.schema)]
                + [("chunk", pa.int64()), ("slot", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64())]
                + [("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32())]
                + [("n_docs", pa.int64()), ("n_links", pa.int64()), ("planes", pa.list_(pa.binary()))]
            )
            for first, last, data, offsets in texts.text_blocks(batch.column("text"), BLOCK):
                while first < last:
                    size = min(last - first, chunk_docs - open_.docs)
                    rows, own, ids_a, ends_a, ids_b, ends_b = encoded(data, offsets[: size + 1], a, b)
                    linked_a = linked_b = np.zeros(0, bool)
                    owner_a, owner_b = _owners(ends_a, own), _owners(ends_b, own)
                    if len(rows):
                        mark = np.zeros(int(own[-1]) + 1, np.uint8)
                        mark[ends_a] |= 1
                        mark[ends_b] |= 2
                        linked_a, linked_b = mark[ends_a] == 3, mark[ends_b] == 3
                    at = rows[owner_a[linked_a]]
                    key = ids_a[linked_a].astype(np.uint64) << np.uint64(40) | ids_b[linked_b].astype(np.uint64) << np.uint64(16)
                    open_.add(key | (open_.docs + at).astype(np.uint64))
                    said = np.full(size, "", object)
                    said[rows] = group_digests(
                        ids_a, linked_a, ids_b, linked_b, owner_a, owner_b, len(rows), names
                    )
                    out = {f"_{i}": kept.column(i).slice(first, size) for i in range(len(keep))}
                    out |= {
                        "chunk": pa.array(np.full(size, number)),
                        "slot": pa.array(np.arange(open_.docs, open_.docs + size, dtype=np.int32)),
                        "n_a": pa.array(np.bincount(rows[owner_a], minlength=size)),
                        "n_b": pa.array(np.bincount(rows[owner_b], minlength=size)),
                        "n_groups": pa.array(np.bincount(at, minlength=size)),
                        "groups_sha256": pa.array(said, pa.string()),
                    }
                    yield whole(out, schema)
                    open_.docs += size
                    if open_.docs == chunk_docs or open_.waiting >= POSTINGS:
                        for columns in open_.rows(number):
                            yield whole(columns, schema)
                        number, open_ = number + 1, _Chunk()
                    first += size
                    offsets = offsets[size:]
        for columns in open_.rows(number):
            yield whole(columns, schema)

    return run


def _scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk with the counts that its postings carry to them."""
    best, total = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
    counts, tops = right.column("count").to_pylist(), right.column("best").to_pylist()
    for planes, count, top in zip(right.column("planes").to_pylist(), counts, tops, strict=True):
        for k, held in enumerate(planes):
            at = unpacked(held)
            total[at] += count << k
            if top:
                best[at] += 1 << k
    slot = left.column("slot").to_numpy()
    out = left.drop_columns(["chunk", "slot"])
    out = out.append_column("n_best", pa.array(best[slot], pa.int64()))
    return out.append_column("count_sum", pa.array(total[slot], pa.int64()))


def scanned(df: DataFrame, path_a: str, path_b: str, keep: list[str], chunk_docs: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(rows, postings)`` of one pass over the texts, stored.

    Rows have ``keep`` (as ``_0, _1, ...``), their ``chunk`` and ``slot``, ``n_a, n_b, n_groups,
    groups_sha256``. Postings have ``chunk, a, b, n_docs, n_links, planes``: the pair's documents of the
    chunk as compressed bitmaps of the bits of their numbers of links.
    """
    if not 0 < chunk_docs <= CHUNK:
        raise ValueError(f"chunk_docs must be 1 to {CHUNK}")
    kept = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    names = [f"_{i}" for i in range(len(keep))]
    schema = ", ".join(filter(None, [schema_of(kept, names) if names else "", ROWS, POSTED]))
    found = stored(
        kept.select(*names, F.col("_text").alias("text")).mapInArrow(_scan(path_a, path_b, names, chunk_docs), schema),
        "aligned",
    )
    rows = found.where("slot IS NOT NULL").select(*names, "chunk", "slot", "n_a", "n_b", "n_groups", "groups_sha256")
    return rows, found.where("slot IS NULL").select("chunk", "a", "b", "n_docs", "n_links", "planes")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links, best``: documents and links of each pair in the whole corpus, and whether
    no other ``a`` has more links with that ``b``."""
    pairs = stored(
        postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")), "pairs"
    )
    top = pairs.groupBy("b").agg(F.max("n_links").alias("_top"))  # at most a row for each id of one vocabulary
    found = pairs.join(F.broadcast(top), "b")
    return found.select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_top")).alias("best"))


def align(df: DataFrame, path_a: str, path_b: str, keep: list[str], chunk_docs: int = CHUNK) -> DataFrame:
    """Columns ``keep`` with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``path_a`` is a file of byte-level ranks that reads a space and the text, ``path_b`` a sentencepiece
    model that reads the text and adds the space. A text that is null, empty or not given back byte
    by byte by the tokens of both has no tokens: zeros and an empty digest, and it counts nowhere.
    ``n_links`` counts pairs of tokens that end together, ``n_best`` those whose pair has the most links
    of its ``b`` in the corpus, ``count_sum`` sums the pairs' links over them. Repeated rows count as
    often as they stand there. An empty table stays empty. Of other columns only ``keep`` is read, and
    may have any names.
    """
    rows, postings = scanned(df, path_a, path_b, keep, chunk_docs)
    scores = pair_counts(postings).select("a", "b", F.col("n_links").alias("count"), "best")
    carried = postings.select(F.col("chunk").alias("of_chunk"), "a", "b", "planes").join(scores, ["a", "b"])
    carried = carried.select("of_chunk", "planes", "count", "best")
    names = [f"_{i}" for i in range(len(keep))]
    kept = ", ".join(filter(None, [schema_of(rows, names) if names else ""]))
    schema = ", ".join(filter(None, [kept, "n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"]))
    found = rows.groupBy("chunk").cogroup(carried.groupBy("of_chunk")).applyInArrow(_scores, schema)
    return found.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256",
    )
