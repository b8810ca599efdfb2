"""Best-fit packing of token pieces into sequences, improved by bin completion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.positions import number_within
from rasterloom.llm import bpe, texts
from rasterloom.llm.tables import schema_of, stored


def piece_spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: only the first may be under ``capacity``."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def pieces(
    df: DataFrame, path: str, keep: list[str], capacity: int = 2048, ending: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of each row's text: ``keep``, ``piece, start, length, ids_crc32`` and perhaps ``ids``.

    The tokens of a text are the ids of the vocabulary file and then ``ending``, so that a null or
    empty text is one piece of one token. ``ids`` are little-endian unsigned 32-bit numbers. Texts
    of over ``capacity`` tokens are cut; repeated rows give repeated pieces. ``keep`` must not have the
    names of the columns made here.
    """
    made = {"piece", "start", "length", "ids_crc32", "ids"}
    if taken := [c for c in keep if c.lower() in made]:
        raise ValueError(f"columns {taken} are made here")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        tail = np.array([ending], "<u4").tobytes()
        for batch in batches:
            for first, last, data, offsets in texts.text_blocks(batch.column("text"), bpe.BLOCK):
                ids, parts = codec.encode_block(data, offsets)
                ids, rows, found = ids.astype("<u4"), [], []
                for i in range(last - first):
                    own = ids[parts[i] : parts[i + 1]].tobytes() + tail
                    for k, (start, length) in enumerate(piece_spans(len(own) // 4, capacity)):
                        part = own[4 * start : 4 * (start + length)]
                        rows.append(first + i)
                        found.append((k, start, length, zlib.crc32(part), part if with_ids else None))
                picked = batch.select(keep).take(pa.array(rows, pa.int64()))
                k, start, length, crc, part = zip(*found, strict=True)
                out = {c: picked.column(c) for c in keep}
                out |= {"piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64())}
                out |= {"length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(part, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = schema_of(df, keep) + ", piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(*keep, "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size goes where the least room is left. Returns bins of sizes."""
    bins, by_room, rooms = [], {}, 0
    for size in np.sort(sizes)[::-1].tolist():
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[place].append(size)
        else:
            room, place = capacity, len(bins)
            bins.append([size])
        room -= size
        if room:
            held = by_room.setdefault(room, [])
            held.append(place)
            rooms |= 1 << room
    return bins


def _below(present: int, limit: int) -> int:
    """Largest size held that is at most ``limit``, or 0."""
    held = present & ((1 << (limit + 1)) - 2) if limit > 0 else 0
    return held.bit_length() - 1 if held else 0


class _Left:
    """Sizes that are still to be packed, and sums that they can reach.

    ``reach[s]`` has bit t where some of the sizes up to s may sum to t. It is worked out when a sixth of
    the sizes has gone, so in between it may name sums that are no longer there, but misses none.
    """

    def __init__(self, sizes: np.ndarray, capacity: int, steps: int):
        self.counts = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.present = sum(1 << s for s, c in enumerate(self.counts) if c)
        self.capacity, self.steps = capacity, steps
        self.work_out()

    def work_out(self) -> None:
        mask, sums = (1 << (self.capacity + 1)) - 1, 1
        self.reach, self.known = {}, self.present.bit_count()
        for size in (s for s, c in enumerate(self.counts) if c and s):
            copies, part = min(self.counts[size], self.capacity // size), 1
            while copies:
                taken = min(part, copies)
                sums |= (sums << (size * taken)) & mask
                copies, part = copies - taken, part * 2
            self.reach[size] = sums

    def stale(self) -> bool:
        return 6 * self.present.bit_count() < 5 * self.known

    def take(self, bin_: tuple[int, ...], sign: int = -1) -> None:
        for s in bin_:
            self.counts[s] += sign
            self.present = self.present | 1 << s if self.counts[s] else self.present & ~(1 << s)

    def exact(self, target: int) -> Iterator[tuple[int, ...]]:
        """All fillings of just ``target``, those with larger sizes first. ``counts`` must be the same
        whenever the next one is asked for."""
        if not target:
            yield ()
            return
        reach, counts = self.reach, self.counts
        head: list[int] = []
        left, size, run = target, _below(self.present, target), 0  # ``run``: copies of ``size`` in the head
        while True:
            while size:
                self.steps -= 1
                if self.steps < 0:
                    return
                if size <= left and counts[size] > run and reach[size] >> left & 1:
                    if size == left:
                        yield (*head, size)
                    else:
                        head.append(size)
                        left, run = left - size, run + 1
                        if size > left:
                            size, run = _below(self.present, left), 0
                        continue
                size, run = _below(self.present, min(size - 1, left)), 0
            if not head:
                return
            last = head.pop()
            left += last
            size, run = _below(self.present, last - 1), 0

    def dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        """Whether another filling is as good or better for the bins behind: one size left over takes the
        place of one smaller size, or of several, or fits in what is wasted."""
        free = self.present
        for s in set(filling):
            if filling.count(s) == self.counts[s]:
                free &= ~(1 << s)
        if waste and free & ((1 << (waste + 1)) - 2):
            return True
        single = several = 0
        for s in filling:
            several |= (several | single) << s
            single |= 1 << s
        if not waste:
            return bool(several & free)
        # a single size only gives way to a larger one
        return bool((self._smeared(several, waste) | self._smeared(single << 1, waste - 1)) & free)

    @staticmethod
    def _smeared(bits: int, waste: int) -> int:
        wide = 1
        while wide <= waste:
            step = min(wide, waste - wide + 1)
            bits |= bits << step
            wide += step
        return bits

    def fillings(self, room: int, allowed: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """``(waste, filling)`` of all undominated fillings of ``room`` that waste at most ``allowed``, the
        fullest first. They are found as they are asked for, until the steps are used up."""
        for waste in range(min(room, allowed) + 1):
            for filling in self.exact(room - waste):
                if not self.dominated(filling, waste):
                    yield waste, filling
            if self.steps < 0:
                return


def completed(sizes: np.ndarray, capacity: int, steps: int) -> list[list[int]]:
    """Each bin in turn is the fullest around the largest size left; best fit for what ``steps`` leave."""
    left, bins = _Left(sizes, capacity, steps), []
    while left.present:
        if left.stale():
            left.work_out()
        largest = left.present.bit_length() - 1
        left.take((largest,))
        found = next(left.fillings(capacity - largest, capacity), None)
        if found is None:
            left.take((largest,), 1)
            rest = np.repeat(np.arange(capacity + 1), left.counts)
            return bins + best_fit(rest, capacity)
        bins.append([largest, *found[1]])
        left.take(found[1])
    return bins


def _fewer(sizes: np.ndarray, capacity: int, allowed: int, steps: int) -> tuple[list[list[int]] | None, int]:
    """Bins of ``sizes`` that waste at most ``allowed`` (or None), and how many of ``steps`` are left.

    Steps are sizes tried. What is left to pack is remembered where no way on was found, so that no
    set of sizes is searched twice.
    """
    left = _Left(sizes, capacity, steps)
    marks = texts.splitmix(np.arange(capacity + 1, dtype=np.uint64)).tolist()
    waste, key, failed = 0, sum(marks[s] for s in sizes.tolist()) & texts.MASK, set()

    def opened() -> tuple:
        held = (left.reach, left.known)
        if left.stale():
            left.work_out()
        largest = left.present.bit_length() - 1
        left.take((largest,))
        return largest, left.fillings(capacity - largest, allowed - waste), held

    path, bins = [opened()], []
    while path:
        largest, ways, held = path[-1]
        found = next(ways, None) if left.steps >= 0 else None
        if found is None:
            if left.steps < 0:
                return None, 0
            path.pop()
            left.take((largest,), 1)
            left.reach, left.known = held
            failed.add((key, len(path)))
            if bins:
                lost, bin_ = bins.pop()
                left.take(bin_[1:], 1)
                waste -= lost
                key = (key + sum(marks[s] for s in bin_)) & texts.MASK
            continue
        lost, filling = found
        bin_ = (largest, *filling)
        after = (key - sum(marks[s] for s in bin_)) & texts.MASK
        if (after, len(path)) in failed:
            continue
        left.take(filling)
        waste, key = waste + lost, after
        bins.append((lost, bin_))
        if not left.present:
            return [list(b) for _, b in bins], left.steps
        path.append(opened())
    return None, left.steps


def bin_completion(sizes: np.ndarray, capacity: int, steps: int = 400_000) -> list[list[int]]:
    """Bins of ``sizes``: a best-fit solution as the incumbent, improved by branch and bound.

    The incumbent is the better of best-fit decreasing and of taking the fullest bin around the
    largest size left again and again. Then the largest size left opens a bin, and the search
    branches over all undominated fillings of the rest, the fullest first; a branch ends when its waste
    exceeds what one bin fewer than the incumbent allows. A solution at the lower bound (weight over
    capacity) ends the search, and so does a search without a result: the incumbent is then
    optimal. The only bound is that of ``steps``, the sizes tried, after which the incumbent stands.

    Where there are many bins, steps back from the end of a path change only its last bins. So
    the fullest bins of the incumbent are kept first, and the search is for its 8, 32, 128, ... least
    full bins with an even part of the steps, then for all of them with the rest. A part that gets
    fewer bins is tried again.
    """
    least = -(-int(sizes.sum()) // capacity)
    incumbent = best_fit(sizes, capacity)
    if len(incumbent) > least:
        incumbent = min(incumbent, completed(sizes, capacity, steps), key=len)
    opened = 8
    while len(incumbent) > least and steps > 0:
        incumbent.sort(key=sum)
        part = np.array([s for b in incumbent[:opened] for s in b])
        whole = opened >= len(incumbent)
        allowed = (min(opened, len(incumbent)) - 1) * capacity - int(part.sum())
        share = steps if whole else steps // 4
        found, spare = _fewer(part, capacity, allowed, share) if allowed >= 0 else (None, share)
        steps -= share - spare
        if found:
            incumbent = found + incumbent[opened:]
        elif whole:
            break
        else:
            opened *= 4
    return incumbent


def placed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size."""
    order = np.argsort(sizes, kind="stable")
    begin = np.searchsorted(sizes[order], np.arange(capacity + 2))
    used = begin.tolist()
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes == capacity)
    number[full] = np.arange(len(full))
    rows, values, at = [], [], []
    for i, bin_ in enumerate(bin_completion(sizes[sizes < capacity], capacity), len(full)):
        place = 0
        for s in bin_:
            rows.append(order[used[s]])
            values.append(i)
            at.append(place)
            used[s] += 1
            place += s
    number[rows], offset[rows] = values, at
    return number, offset


def pack(found: DataFrame, capacity: int = 2048, rows_in_group: int = 16_384) -> DataFrame:
    """``found`` (with ``length``, at most ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces are packed in groups. Those of each length are dealt round robin to the groups, from a
    group on that depends on the length, so that all groups have the same mix but for one piece of a
    length. Sequence ids are unique, not gapless. Other columns, also ids of pieces, are carried along; columns
    named ``sequence_id``, ``offset`` or from ``_group`` on are an error. An empty table stays empty.
    ``found`` should be a stored table, as it is read several times.
    """
    taken = [c for c in found.columns if c.lower() in ("sequence_id", "offset") or c.startswith("_group")]
    if taken:
        raise ValueError(f"columns {taken} are made here")
    groups = max(1, -(-found.count() // rows_in_group))
    row = found.withColumn("_group_row", F.monotonically_increasing_id())
    dealt = number_within(row, ["length"], ["_group_row"], F.shiftright("_group_row", 33), "_group_nth")
    start = F.pmod(F.xxhash64("length"), F.lit(groups))
    dealt = dealt.withColumn("_group", F.pmod(F.col("_group_nth") + start, F.lit(groups)).cast("long"))
    columns = found.columns

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy().astype(np.int64)
        number, offset = placed(sizes, capacity)
        base = table.column("_group")[0].as_py() << 32 if table.num_rows else 0
        out = table.select(columns)
        out = out.append_column("sequence_id", pa.array(number + base, pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    dealt = dealt.select(*[F.col(f"`{c}`") for c in columns], "_group")
    return dealt.groupBy("_group").applyInArrow(run, f"{schema_of(found, columns)}, sequence_id long, offset long")


def packed_documents(df: DataFrame, path: str, keep: list[str], capacity: int = 2048, ending: int = 0) -> DataFrame:
    """Pieces of all texts with their places (``pieces``, then ``pack``)."""
    return pack(stored(pieces(df, path, keep, capacity, ending), "pieces"), capacity)
