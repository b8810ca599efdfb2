"""Byte-level BPE on padded numpy matrices.

Texts of a block are cut by character classes into the matches of the usual pattern (contractions,
letters, numbers, other signs, spaces), equal matches are encoded once, and the distinct ones are
put by length into matrices. In each round every row of a matrix merges its leftmost pair of least
rank; pairs are looked up in an open hash table, rows without a pair left are taken out, and the
matrix loses a column. Matches of over ``LONG`` bytes go through a heap, as a matrix would need as
many rounds as they have bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.llm import texts
from rasterloom.llm.tables import schema_of

NONE = np.int32(0x7FFFFFFF)
LONG = 128
BLOCK = 1 << 22
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, LONG)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def worker_cache(key: tuple, make: Callable):
    """``make()``, once per process: task code is unpickled anew for each task."""
    held = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of all spans, one after another."""
    begin = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - begin, lengths)


def character_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number, other."""
    found = np.full(0x110000, OTHER, np.uint8)
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    found[first == "L"] = LETTER
    found[first == "N"] = NUMBER
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    found[spaces] = SPACE
    return found


def _plain_bytes() -> dict[str, int]:
    """The byte that each sign of a JSON vocabulary stands for: printable ones for themselves."""
    held = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in held]
    return {chr(b): b for b in held} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a file: ``base64 rank`` lines, or a JSON vocabulary with merges.

    A JSON file must be byte-level BPE without a normaliser, whose merges stand in the order of the
    ids they make; then ids serve as ranks.
    """
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, {}
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    plain, model = _plain_bytes(), held["model"]
    specials = {t["content"]: t["id"] for t in held["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in specials}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if held["normalizer"] or merged != sorted(merged):
        raise ValueError(f"{path}: not plain byte-level BPE with merges in the order of ids")
    return {bytes(plain[c] for c in t): i for t, i in vocabulary.items()}, specials


class Codec:
    """Encoder and decoder for a file of ranks (``read_ranks``)."""

    def __init__(self, path: str, specials: dict[str, int] | None = None):
        ranks, own = read_ranks(path)
        self.specials = {k.encode(): v for k, v in (specials or own).items()}
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.classes = worker_cache(("classes",), character_classes)
        by_id = {v: k for k, v in [*ranks.items(), *self.specials.items()]}
        size = max(by_id) + 1
        held = [by_id.get(i, b"") for i in range(size)]
        self.token_lengths = np.array([len(t) for t in held])
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(held), np.uint8)
        pairs = [
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None
            and (right := ranks.get(token[cut:])) is not None
        ]
        self._build(np.array([k for k, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (texts.splitmix(keys) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(size, texts.MASK, np.uint64), np.full(size, NONE, np.int32)
        slots, left = self._slots(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            free = left[self.keys[slots[left]] == texts.MASK]
            _, one = np.unique(slots[free], return_index=True)
            put = free[one]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & (size - 1)
            self.probes += 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, ``NONE`` without one or where an id is below 0."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | right.astype(np.int64).astype(np.uint64)
        slots = self._slots(keys)
        seen = self.keys[slots]
        found = np.where(seen == keys, self.values[slots], NONE)
        open_rows = np.flatnonzero((seen != keys) & (seen != texts.MASK))
        for _ in range(self.probes):
            if not len(open_rows):
                break
            slots[open_rows] = (slots[open_rows] + 1) & (len(self.keys) - 1)
            seen = self.keys[slots[open_rows]]
            hit = seen == keys[open_rows]
            found[open_rows[hit]] = self.values[slots[open_rows[hit]]]
            open_rows = open_rows[~hit & (seen != texts.MASK)]
        return np.where((left < 0) | (right < 0), NONE, found)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of all matches of the pattern; a match ends where the next one begins."""
        if not len(data):
            return np.zeros(0, np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[points]
        marks = []
        for text in self.specials:
            place = raw.find(text)
            while place >= 0:
                marks.append((place, place + len(text)))
                place = raw.find(text, place + len(text))
        owner = np.searchsorted(offsets, [p for p, _ in marks], "right")
        marks = [m for m, o in zip(marks, owner, strict=True) if m[1] <= offsets[o]]
        edges = np.unique(np.concatenate([offsets, np.array(marks, np.int64).ravel()]))
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(at, edges)] = True
        first[-1] = True
        same = np.zeros(len(points), bool)  # as the character before
        same[1:] = (kind[1:] == kind[:-1]) & ~first[1:-1]
        space = kind == SPACE
        after_blank = np.zeros(len(points), bool)
        after_blank[1:] = (points[:-1] == 32) & ~first[1:-1]
        begins = ~same & (space | ~after_blank)
        begins[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
        self._contractions(points, kind, same, after_blank, first, begins)
        for lo, hi in marks:
            lo, hi = np.searchsorted(at, (lo, hi))
            begins[lo + 1 : hi] = False
            begins[lo] = True
        return at[begins]

    def _contractions(self, points, kind, same, after_blank, first, begins) -> None:
        """Cut ``'s 't 'm 'd 're 've 'll`` where a match begins at the apostrophe."""
        n = len(points)
        quote = np.flatnonzero((points == 39) & ~same & ~after_blank)
        quote = quote[quote + 1 < n]
        quote = quote[~first[quote + 1] & (kind[quote + 1] == LETTER)]
        one = points[quote + 1]
        following = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~first[quote + 2], points[following], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        begins[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        after = after[after < n]
        begins[after[same[after]]] = True

    def _heap(self, piece: bytes) -> list[int]:
        """One long match: a heap of pairs over a linked list."""
        ids = [int(self.bytes[b]) for b in piece]
        held = [bytes([b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = self.ranks.get
        queue = [(r, i, held[i] + held[i + 1]) for i in range(len(ids) - 1) if (r := rank(held[i] + held[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, joined = heapq.heappop(queue)
            j = after[i]
            if held[i] is None or j >= len(ids) or held[i] + held[j] != joined:
                continue
            ids[i], held[i], held[j] = r, joined, None
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (q := rank(held[a] + held[b])) is not None:
                    heapq.heappush(queue, (q, a, held[a] + held[b]))
        return [i for i, h in zip(ids, held, strict=True) if h is not None]

    def _matrix(self, matrix: np.ndarray, rows: np.ndarray, out: np.ndarray, counts: np.ndarray) -> None:
        """Merge all rows of ``matrix`` (ids, -1 behind the end) and put them at ``rows`` of ``out``."""
        rank = self.pair_ranks(matrix[:, :-1].ravel(), matrix[:, 1:].ravel())
        rank = rank.reshape(len(rows), matrix.shape[1] - 1)
        while True:
            best = rank.min(1) if rank.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                out[rows[done], : matrix.shape[1]] = matrix[done]
                counts[rows[done]] = (matrix[done] >= 0).sum(1)
                keep = ~done
                matrix, rank, rows, best = matrix[keep], rank[keep], rows[keep], best[keep]
            if not len(rows):
                return
            place = rank.argmin(1)
            n, width = matrix.shape
            column = np.arange(width - 1)
            shifted = column[None, :] > place[:, None]
            matrix = np.where(shifted, matrix[:, 1:], matrix[:, :-1])
            line = np.arange(n)
            matrix[line, place] = best
            if width == 2:
                rank = np.full((n, 0), NONE)
                continue
            rank = np.where(shifted[:, :-1] | (column[None, :-1] == place[:, None]), rank[:, 1:], rank[:, :-1])
            left = np.flatnonzero(place > 0)
            rank[left, place[left] - 1] = self.pair_ranks(matrix[left, place[left] - 1], best[left])
            right = np.flatnonzero(place < width - 2)
            rank[right, place[right]] = self.pair_ranks(best[right], matrix[right, place[right] + 1])

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, one after another, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        found, order = [], []
        least = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            if not len(rows):
                continue
            column = np.arange(width)
            inside = column[None, :] < lengths[rows, None]
            places = np.minimum(starts[rows, None] + column[None, :], len(data) - 1)
            matrix = np.where(inside, self.bytes[data[places]], np.int32(-1))
            out, own = np.full((len(rows), width), -1, np.int32), np.zeros(len(rows), np.int64)
            self._matrix(matrix, np.arange(len(rows)), out, own)
            counts[rows] = own
            found.append(out[out >= 0])
            order.append(rows)
        for row in np.flatnonzero(lengths > LONG):
            ids = self._heap(data[starts[row] : starts[row] + lengths[row]].tobytes())
            counts[row] = len(ids)
            found.append(np.array(ids, np.int32))
            order.append(np.array([row]))
        for text, value in self.specials.items():
            same = np.flatnonzero(lengths == len(text))
            same = [r for r in same if data[starts[r] : starts[r] + lengths[r]].tobytes() == text]
            if same:  # in place of what the text itself would give
                wrong = set(same)
                flat, rows = np.concatenate(found), np.concatenate(order)
                keep = np.repeat([r not in wrong for r in rows], counts[rows])
                rows = np.concatenate([[r for r in rows if r not in wrong], same]).astype(np.int64)
                counts[same] = 1
                found, order = [flat[keep], np.full(len(same), value, np.int32)], [rows]
        if not found:
            return np.zeros(0, np.int32), counts
        flat, rows = np.concatenate(found), np.concatenate(order)
        at = np.zeros(len(starts), np.int64)
        at[rows] = np.cumsum(counts[rows]) - counts[rows]
        return flat[spans_of(at, counts)], counts

    def _distinct(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One piece of each kind and the kind of each piece; equal hashes are compared byte by byte."""
        hashes = texts.span_hashes(data, starts, starts + lengths, texts._letters(False))
        _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
        alike = one[kind]
        if np.array_equal(lengths[alike], lengths) and np.array_equal(data, data[spans_of(starts[alike], lengths)]):
            return one, kind
        return np.arange(len(starts)), np.arange(len(starts))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block and the offsets that part them."""
        starts = self.cut(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        one, kind = self._distinct(data, starts, lengths)
        flat, counts = self.encode_pieces(data, starts[one], lengths[one])
        begin = np.cumsum(counts) - counts
        ids = flat[spans_of(begin[kind], counts[kind])]
        total = np.concatenate([[0], np.cumsum(counts[kind])])
        return ids, total[np.searchsorted(starts, offsets)]

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids and the offsets that part them."""
        lengths = self.token_lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.token_bytes[spans_of(self.token_starts[ids], lengths)], total[offsets]


def codec(path: str, specials: dict[str, int] | None = None) -> Codec:
    """The codec of a file, built once per worker process."""
    return worker_cache((path, tuple(sorted((specials or {}).items()))), lambda: Codec(path, specials))


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from flat bytes and offsets."""
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of over 2 GB")
    return pa.Array.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())],
    )


def encode(df: DataFrame, path: str, keep: list[str], specials: dict[str, int] | None = None) -> DataFrame:
    """Columns ``keep`` with ``ids``, the token ids of ``text`` as little-endian unsigned 32-bit numbers.

    A null or empty text has no ids. Rows are independent of each other, repeated ones too. The
    file of ranks must be readable by ``path`` on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, specials)
        for batch in batches:
            held, ends = [], [0]
            for _, _, data, offsets in texts.text_blocks(batch.column("text"), BLOCK):
                ids, parts = own.encode_block(data, offsets)
                held.append(ids.astype("<u4").view(np.uint8))
                ends.extend((ends[-1] + 4 * parts[1:]).tolist())
            flat = np.concatenate(held) if held else np.zeros(0, np.uint8)
            out = {c: batch.column(c) for c in keep} | {"ids": binary(flat, np.array(ends))}
            yield pa.RecordBatch.from_pydict(out)

    return df.select(*keep, "text").mapInArrow(run, f"{schema_of(df, keep)}, ids binary")


def decode(df: DataFrame, path: str, keep: list[str], specials: dict[str, int] | None = None) -> DataFrame:
    """Columns ``keep`` with ``decoded``, the bytes of the numbers in ``ids``; a null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, specials)
        for batch in batches:
            ids, offsets = id_rows(batch.column("ids"))
            data, ends = own.decode_flat(ids, offsets)
            out = {c: batch.column(c) for c in keep} | {"decoded": binary(data, ends)}
            yield pa.RecordBatch.from_pydict(out)

    return df.select(*keep, "ids").mapInArrow(run, f"{schema_of(df, keep)}, decoded binary")


def id_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of ids and the offsets that part its rows."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return raw.view("<u4") if raw.ctypes.data % 4 == 0 else raw.copy().view("<u4"), (offsets - offsets[0]) // 4


def digests(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``n_tokens``, and SHA-256 of the ids as decimals joined by commas and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = [str(i).encode() + b"," for i in range(len(own.token_lengths))]
        lengths = np.array([len(n) for n in names])
        starts, letters = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(names), np.uint8)
        for batch in batches:
            ids, offsets = id_rows(batch.column("ids"))
            said, back = [], []
            for first, last in texts.blocks(offsets, texts.BLOCK // 4):
                own_ids, parts = ids[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                text = letters[spans_of(starts[own_ids], lengths[own_ids])]
                ends = np.concatenate([[0], np.cumsum(lengths[own_ids])])[parts]
                data, places = own.decode_flat(own_ids, parts)
                for i in range(last - first):
                    said.append(hashlib.sha256(text[ends[i] : max(ends[i], ends[i + 1] - 1)]).hexdigest())
                    back.append(hashlib.sha256(data[places[i] : places[i + 1]]).hexdigest())
            out = {c: batch.column(c) for c in keep}
            out |= {"n_tokens": pa.array(np.diff(offsets)), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    schema = f"{schema_of(df, keep)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(*keep, "ids").mapInArrow(run, schema)
