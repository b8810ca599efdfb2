"""Chains of kernels over scanlines, run in one pass.

A kernel is vectorised work on matrices of lines. Line kernels need nothing but their own lines, so
a chain of them is one map over batches, without a shuffle. Area kernels also read lines near by;
a chain with them is one pass over strips. Going back through the chain tells which lines each
kernel has to make for a strip, and so which the strip has to be sent. Between kernels only lines
inside the picture are kept, and lines beyond it are mirrored anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.model import KEYS, all_bands, to_scanlines
from rasterloom.operators import strips as strips_module
from rasterloom.operators.strips import Planes, Strip, list_column, planes_of, with_halo

#: Lines that one pass may read above or below a strip, unless one kernel reads more.
MOST_HALO = 512
Bands = Callable[[list[str]], list[str]]


class Lines(NamedTuple):
    """Which lines a kernel's planes hold: frame and number of each, and their frames' size."""

    frame_id: np.ndarray
    height: int
    width: int
    y: np.ndarray


@dataclass(frozen=True)
class LineKernel:
    """``run(planes, lines)`` changes each line by itself; ``bands`` tells the bands it returns."""

    run: Callable[[Planes, Lines], Planes]
    bands: Bands = list


@dataclass(frozen=True)
class AreaKernel:
    """``run(planes, strip)`` reads ``before`` lines above and ``after`` below those it returns.

    With ``align`` it works on whole groups of so many lines, counted from a frame's first. With
    ``need(first, last, height, width, frame_id)`` what it reads depends on the place: the bounds of
    the lines it is given, in place of ``before`` and ``after``.
    """

    run: Callable[[Planes, Strip], Planes]
    before: int = 0
    after: int = 0
    align: int = 1
    bands: Bands = list
    need: Callable[[int, int, int, int, int], tuple[int, int]] | None = None


Kernel = LineKernel | AreaKernel


def ranges_of(
    chain: list[Kernel], first: int, last: int, height: int, width: int = 0, frame_id: int = 0
) -> list[tuple[int, int]]:
    """Bounds of the lines at hand before the chain and after each kernel, to make ``first..last-1``.

    A kernel that reads ``n`` lines one way is given as many both ways, so that mirrored lines
    at a picture's edge are at hand as well.
    """
    found, lo, hi = [], first, last
    for kernel in reversed(chain):
        if isinstance(kernel, AreaKernel):
            step = kernel.align
            lo, hi = lo // step * step, min(height, -(-hi // step) * step)
            found.append((lo, hi))
            if kernel.need is not None:
                lo, hi = kernel.need(lo, hi, height, width, frame_id)
            else:
                most = max(kernel.before, kernel.after)
                lo, hi = max(0, lo - most), min(height, hi + most)
        else:
            found.append((lo, hi))
    return [(lo, hi), *reversed(found)]


def reach(chain: list[Kernel], aligned: int) -> int:
    """Lines that a chain reads above or below a strip whose bounds are multiples of ``aligned``;
    kernels whose needs depend on the place are not counted."""
    fixed = [k for k in chain if isinstance(k, LineKernel) or k.need is None]
    first = aligned * 1_000_000
    lo, hi = ranges_of(fixed, first, first + aligned, 2 * first)[0]
    return max(first - lo, hi - first - aligned)


def alignment(chain: list[Kernel]) -> int:
    return max([1, *(k.align for k in chain if isinstance(k, AreaKernel))])


def bands_after(bands: list[str], chain: list[Kernel]) -> list[str]:
    for kernel in chain:
        bands = kernel.bands(bands)
    return bands


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Source index of each place, the edge element repeated."""
    m = np.mod(at, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def _run_area(
    kernel: AreaKernel, planes: Planes, given: tuple[int, int], made: tuple[int, int], height: int, width: int, frame_id: int
) -> Planes:
    """Lines ``made`` of a kernel from the lines ``given``."""
    (lo, hi), (first, last) = given, made
    if kernel.need is not None:
        return kernel.run(planes, Strip(first, last - first, first - lo, height, width, frame_id))
    at = mirrored(np.arange(first - kernel.before, last + kernel.after), height) - lo
    whole = len(at) == hi - lo and (at[0], at[-1]) == (0, hi - lo - 1)
    held = planes if whole else {b: p[at] for b, p in planes.items()}
    return kernel.run(held, Strip(first, last - first, kernel.before, height, width, frame_id))


def _table(planes: Planes, bands: list[str], frame_id: np.ndarray, height: int, width: int, y) -> pa.Table:
    n = len(y)
    columns = {
        "frame_id": pa.array(frame_id.astype(np.int64)),
        "height": pa.array(np.full(n, height, np.int32)),
        "width": pa.array(np.full(n, width, np.int32)),
        "y": pa.array(np.asarray(y, np.int32)),
    }
    return pa.table(columns | {b: list_column(planes[b]) for b in bands})


class _Taps:
    """After which kernels of a chain lines are given out, and the columns of what is.

    Without places only the chain's end is given out. With them every row has ``tap``, the place, and a
    band that is lacking there is null.
    """

    def __init__(self, bands: list[str], chain: list[Kernel], places: list[int] | None):
        self.tagged = places is not None
        self.made = {i: bands_after(bands, chain[:i]) for i in (places if self.tagged else [len(chain)])}
        self.every = [b for b in ("v", "r", "g", "b", "a") if any(b in made for made in self.made.values())]
        tag = "tap int, " if self.tagged else ""
        lists = ", ".join(f"{b} array<int>" for b in self.every)
        self.schema = f"{tag}frame_id long, height int, width int, y int, {lists}"

    def table(self, place: int, planes: Planes, frame_id: np.ndarray, height: int, width: int, y) -> pa.Table:
        held = _table(planes, self.made[place], frame_id, height, width, y)
        if not self.tagged:
            return held
        for lacking in (b for b in self.every if b not in self.made[place]):
            held = held.append_column(lacking, pa.nulls(len(y), pa.list_(pa.int32())))
        held = held.append_column("tap", pa.array(np.full(len(y), place, np.int32)))
        return held.select(["tap", *KEYS, *self.every])


def _line_pass(scan: DataFrame, chain: list[LineKernel], bands: list[str], taps: _Taps) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            sizes = np.stack([table.column(c).to_numpy() for c in ("height", "width")], 1)
            for height, width in np.unique(sizes, axis=0).tolist():
                rows = np.flatnonzero((sizes == (height, width)).all(1))
                part = table if len(rows) == len(sizes) else table.take(rows)
                lines = Lines(part.column("frame_id").to_numpy(), height, width, part.column("y").to_numpy())
                planes = planes_of(part, bands, slice(None))
                for place, kernel in enumerate(chain, 1):
                    planes = kernel.run(planes, lines)
                    if place in taps.made:
                        yield from taps.table(place, planes, lines.frame_id, height, width, lines.y).to_batches()

    return scan.select(*KEYS, *bands).mapInArrow(run, taps.schema)


def _dealt(scan: DataFrame, chain: list[Kernel], bands: list[str], step: int) -> DataFrame:
    """Lines beside the strips that need them, worked out for each frame size (or frame) by itself."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scan.select(*KEYS, *bands).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[tuple[int, int]]] = {}
        for batch in batches:
            table = pa.table(batch)
            key = np.stack([table.column(c).to_numpy() for c in ("frame_id", "height", "width")], 1)
            y = table.column("y").to_numpy()
            picked, strips, heights = [], [], []
            for frame_id, height, width in np.unique(key, axis=0).tolist():
                rows = -(-max(64, strips_module.STRIP_PIXELS // width) // step) * step
                size = (frame_id, height, width)
                if size not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[size] = [
                        ranges_of(chain, first, min(first + rows, height), height, width, frame_id)[0]
                        for first in range(0, height, rows)
                    ]
                own = np.flatnonzero((key == size).all(1))
                for number, (lo, hi) in enumerate(known[size]):
                    read = own[(y[own] >= lo) & (y[own] < hi)]
                    picked.append(read)
                    strips.append(np.full(len(read), number, np.int32))
                    heights.append(np.full(len(read), rows, np.int32))
            dealt = table.take(np.concatenate(picked))
            dealt = dealt.append_column("rows", pa.array(np.concatenate(heights)))
            yield from dealt.append_column("strip", pa.array(np.concatenate(strips))).to_batches()

    dealt = scan.select(*KEYS, *bands).mapInArrow(run, f"{schema}, rows int, strip int")
    return dealt.withColumn("at", F.col("y"))


def _strip_pass(scan: DataFrame, chain: list[Kernel], bands: list[str], taps: _Taps) -> DataFrame:
    step = alignment(chain)
    placed = any(isinstance(k, AreaKernel) and k.need is not None for k in chain)
    halo = reach(chain, step)

    def run(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[0].as_py() for c in ("frame_id", "height", "width", "rows", "strip")}
        frame_id, height, width = one["frame_id"], one["height"], one["width"]
        first = one["strip"] * one["rows"]
        last = min(first + one["rows"], height)
        at = table.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        ranges = ranges_of(chain, first, last, height, width, frame_id)
        lo, hi = ranges[0] if placed else (max(0, first - halo), min(height, last + halo))
        if not np.array_equal(at[order], np.arange(lo, hi)):
            raise ValueError(
                f"a frame must have each of its lines exactly once: frame {frame_id}, lines {lo} to {hi - 1}"
            )
        planes = planes_of(table, bands, order[ranges[0][0] - lo : ranges[0][1] - lo])
        found = []
        for place, (kernel, given, out) in enumerate(zip(chain, ranges[:-1], ranges[1:]), 1):
            if isinstance(kernel, LineKernel):
                y = np.arange(*out)
                planes = kernel.run(planes, Lines(np.full(len(y), frame_id), height, width, y))
            else:
                planes = _run_area(kernel, planes, given, out, height, width, frame_id)
            if place in taps.made:
                own = {b: planes[b][first - out[0] : last - out[0]] for b in taps.made[place]}
                numbers = np.full(last - first, frame_id)
                found.append(taps.table(place, own, numbers, height, width, np.arange(first, last)))
        return pa.concat_tables(found)

    if placed:
        dealt = _dealt(scan, chain, bands, step)
    else:
        dealt = with_halo(scan, halo, halo, mirror=False, multiple=step)
    grouped = dealt.select(*KEYS, "rows", "strip", "at", *bands).drop("y")
    return grouped.groupBy("frame_id", "strip").applyInArrow(run, taps.schema)


def apply(df: DataFrame, chain: list[Kernel]) -> DataFrame:
    """Run a chain on a raster; an empty one returns it as it is.

    A chain that reads over ``MOST_HALO`` lines above or below a strip is run in several passes.
    """
    if not chain:
        return df
    held = len(chain)
    while held > 1 and reach(chain[:held], alignment(chain[:held])) > MOST_HALO:
        held -= 1
    if held < len(chain):
        return apply(apply(df, chain[:held]), chain[held:])
    return _one_pass(df, chain, None)


def _one_pass(df: DataFrame, chain: list[Kernel], places: list[int] | None) -> DataFrame:
    scan = to_scanlines(df)
    bands = all_bands(scan)
    lines_only = all(isinstance(k, LineKernel) for k in chain)
    return (_line_pass if lines_only else _strip_pass)(scan, chain, bands, _Taps(bands, chain, places))


def fits_one_pass(chain: list[Kernel]) -> bool:
    return len(chain) < 2 or reach(chain, alignment(chain)) <= MOST_HALO


def apply_with_taps(df: DataFrame, chain: list[Kernel], places: list[int]) -> DataFrame:
    """The raster after each of some kernels, from one pass: scanlines with ``tap``, the number of kernels
    that have run (1 and up). Places must be given once each and the chain must fit one pass; a band that
    only some of them have is null at the others. A task holds a strip's lines of all places."""
    if not places or len(set(places)) < len(places) or not set(places) <= set(range(1, len(chain) + 1)):
        raise ValueError(f"places must be different numbers from 1 to {len(chain)}")
    if not fits_one_pass(chain):
        raise ValueError("the chain reads too many lines for one pass")
    return _one_pass(df, chain[: max(places)], places)
