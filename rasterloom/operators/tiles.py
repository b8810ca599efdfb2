"""Random-tile operators.

A tile's place depends only on the seed, its number and the frame size, so any batch of lines
works out by itself which tiles cross it: no tile join and no shuffle. Tiles are applied in order,
so overlaps come out as if drawn one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import draws
from rasterloom.functions import ordered as ordered_draws
from rasterloom.model import all_bands, check_choice, check_range
from rasterloom.operators.passes import Kernel, LineKernel, Lines, apply
from rasterloom.operators.strips import Planes

# Source band of each output band.
PERMUTATIONS = {
    "GRB": (1, 0, 2),
    "BGR": (2, 1, 0),
    "BRG": (2, 0, 1),
    "GBR": (1, 2, 0),
    "RBG": (0, 2, 1),
}
ALL_ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
TILE_SIZE_RANGE = (0.05, 0.2)
CELLS = 1 << 20  # grid cells drawn at a time


def check_tiles(tile_count, most: int, tile_size_range) -> tuple[float, float]:
    if not isinstance(tile_count, int):
        raise ValueError("tile_count must be an integer")
    check_range("tile_count", tile_count, 1, most)
    if len(tile_size_range) != 2:
        raise ValueError("tile_size_range needs two numbers")
    lo, hi = tile_size_range
    check_range("tile_size_range[0]", lo, 0.01, 1.0)
    check_range("tile_size_range[1]", hi, 0.01, 1.0)
    if lo > hi:
        raise ValueError("tile_size_range minimum must not exceed its maximum")
    return float(lo), float(hi)


def _drawn_tiles(count: int, lo: float, hi: float, seed: int) -> Column:
    """Array of each tile's draws: its share of the frame and its place."""
    rows = []
    for i in range(count):
        share = lo + draws.uniform_value(seed, "tile_size", i) * (hi - lo)
        at = [draws.uniform_value(seed, label, i) for label in ("tile_y", "tile_x")]
        rows.append(f"named_struct('i',{i},'share',{share!r}D,'uy',{at[0]!r}D,'ux',{at[1]!r}D)")
    return F.expr(f"array({','.join(rows)})")


def _placed_tiles(count: int, lo: float, hi: float, seed: int) -> Column:
    """Array of ``(i, y0, x0, th, tw)`` as an expression of ``height`` and ``width``."""
    h, w = F.col("height"), F.col("width")

    def sized(t: Column) -> Column:
        return F.struct(
            t["i"].alias("i"),
            F.greatest(F.lit(1), (h * t["share"]).cast("int")).alias("th"),
            F.greatest(F.lit(1), (w * t["share"]).cast("int")).alias("tw"),
            t["uy"].alias("uy"),
            t["ux"].alias("ux"),
        )

    def placed(t: Column) -> Column:
        free_y, free_x = (F.greatest(F.lit(1), s - t[c] + 1) for s, c in ((h, "th"), (w, "tw")))
        return F.struct(
            t["i"].alias("i"),
            F.floor(t["uy"] * free_y).cast("int").alias("y0"),
            F.floor(t["ux"] * free_x).cast("int").alias("x0"),
            t["th"].alias("th"),
            t["tw"].alias("tw"),
        )

    return F.transform(F.transform(_drawn_tiles(count, lo, hi, seed), sized), placed)


def tile_geometry(
    height: int, width: int, count: int, lo: float, hi: float, base: int, frame: list[int] = ()
) -> list[tuple[int, int, int, int]]:
    """``(y0, x0, th, tw)`` of each tile of one frame size (of one frame, given its keys)."""
    out = []
    for i in range(count):
        share = lo + draws.uniform_value(base, "tile_size", *frame, i) * (hi - lo)
        th, tw = max(1, int(height * share)), max(1, int(width * share))
        y0 = int(draws.uniform_value(base, "tile_y", *frame, i) * max(1, height - th + 1))
        x0 = int(draws.uniform_value(base, "tile_x", *frame, i) * max(1, width - tw + 1))
        out.append((y0, x0, th, tw))
    return out


def tile_table(
    frames: DataFrame,
    tile_count: int,
    tile_size_range: tuple[float, float] = TILE_SIZE_RANGE,
    seed: int = 0,
    ordered: bool = False,
) -> DataFrame:
    """One row per distinct frame size and tile: ``height, width, i, y0, x0, th, tw``.

    ``ordered`` draws are those of numpy's default generator for the seed.
    """
    lo, hi = check_tiles(tile_count, 50, tile_size_range)
    if ordered:
        ordered_draws.check(ordered, seed)

        def run(batches):
            for batch in batches:
                sizes = zip(*(batch.column(c).to_pylist() for c in ("height", "width")), strict=True)
                rows = [
                    (h, w, i, *tile[:4])
                    for h, w in sizes
                    for i, tile in enumerate(ordered_draws.tiles(seed, h, w, tile_count, lo, hi))
                ]
                names = ["height", "width", "i", "y0", "x0", "th", "tw"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int32()) for k in range(len(names))], names=names
                )

        sizes = frames.select("height", "width").distinct()
        return sizes.mapInArrow(run, "height int, width int, i int, y0 int, x0 int, th int, tw int")
    tiles = _placed_tiles(tile_count, lo, hi, seed)
    return (
        frames.select("height", "width")
        .distinct()
        .select("height", "width", F.explode(tiles).alias("t"))
        .select("height", "width", "t.i", "t.y0", "t.x0", "t.th", "t.tw")
    )


Tile = tuple[int, int, int, int, int]  # first line, first column, lines, columns, band order


def _tiles_of(
    height: int, width: int, count: int, lo: float, hi: float, base: int, frame: list[int], shuffles: float | None
) -> list[Tile]:
    """The tiles of one frame size (of one frame when ``frame`` has its keys), in drawing order."""
    out = []
    for i, place in enumerate(tile_geometry(height, width, count, lo, hi, base, frame)):
        order = 0
        if shuffles and draws.uniform_value(base, "tile_happens", *frame, i) < shuffles:
            order = int(draws.uniform_value(base, "tile_order", *frame, i) * len(ALL_ORDERS))
        out.append((*place, order))
    return out


def _tile_kernel(
    change, count: int, lo: float, hi: float, seed: int | None, shuffles: float | None = None, listed=None
) -> LineKernel:
    """Apply ``change(cut, number, order, y, x, keys) -> cut`` to every tile's part of the lines.

    A tile's place depends on the seed, its number and the frame size only (without a seed also on
    the frame), so any batch of lines knows its tiles. They are applied in drawing order. ``listed(height,
    width)`` gives the tiles of a frame size where they are drawn otherwise.
    """
    base = draws.fresh_seed(seed)
    known: dict[tuple, list[Tile]] = {}

    def run(planes: Planes, lines: Lines) -> Planes:
        done = {b: p if b == "a" else p.copy() for b, p in planes.items()}
        bands = [b for b in planes if b != "a"]
        keys = draws.key_arrays(seed, lines.frame_id)
        groups = [np.arange(len(lines.y))]
        if keys:
            ids, place = np.unique(lines.frame_id, return_inverse=True)
            groups = [np.flatnonzero(place == i) for i in range(len(ids))]
        for rows in groups:
            frame = tuple(int(k[rows[0]]) for k in keys)
            size = (lines.height, lines.width, frame)
            if size not in known:
                known.clear()
                own = listed(*size[:2]) if listed else _tiles_of(*size[:2], count, lo, hi, base, list(frame), shuffles)
                known[size] = own
            y = lines.y[rows]
            for i, (y0, x0, th, tw, order) in enumerate(known[size]):
                crossed = rows[(y >= y0) & (y < y0 + th)]
                if not len(crossed):
                    continue
                whole = crossed[-1] - crossed[0] + 1 == len(crossed)
                at = slice(crossed[0], crossed[-1] + 1) if whole else crossed
                cut = [done[b][at, x0 : x0 + tw] for b in bands]
                x = np.arange(x0, x0 + tw)[None, :]
                new = change(cut, i, order, lines.y[at][:, None], x, frame)
                for b, c in zip(bands, [n.copy() if n.base is not None else n for n in new]):
                    done[b][at, x0 : x0 + tw] = c
        return done

    return LineKernel(run)


def band_swap_chain(
    bands: list[str],
    tile_count: int,
    permutation: str,
    tile_size_range: tuple[float, float] = TILE_SIZE_RANGE,
    seed: int | None = None,
    ordered: bool = False,
) -> list[Kernel]:
    lo, hi = check_tiles(tile_count, 50, tile_size_range)
    check_choice("permutation", permutation, tuple(PERMUTATIONS))
    ordered_draws.check(ordered, seed)
    if "v" in bands:
        raise ValueError("band_swap needs a colour raster")
    order = PERMUTATIONS[permutation]

    def swap(cut, *_):
        return [cut[k] for k in order]

    def listed(height: int, width: int) -> list[Tile]:
        return ordered_draws.tiles(seed, height, width, tile_count, lo, hi)

    return [_tile_kernel(swap, tile_count, lo, hi, seed, listed=listed if ordered else None)]


def band_swap(
    df: DataFrame,
    tile_count: int,
    permutation: str,
    tile_size_range: tuple[float, float] = TILE_SIZE_RANGE,
    seed: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Permute the colour bands inside random tiles."""
    return apply(df, band_swap_chain(all_bands(df), tile_count, permutation, tile_size_range, seed, ordered))


def buffer_corruption_chain(
    bands: list[str],
    tile_count: int,
    corruption_type: str,
    severity: float,
    tile_size_range: tuple[float, float] = TILE_SIZE_RANGE,
    seed: int | None = None,
    ordered: bool = False,
) -> list[Kernel]:
    lo, hi = check_tiles(tile_count, 20, tile_size_range)
    ordered_draws.check(ordered, seed)
    check_choice("corruption_type", corruption_type, ("xor", "invert", "channel_shuffle"))
    check_range("severity", severity, 0.0, 1.0)
    most = int(255 * severity)
    if (
        severity == 0
        or (corruption_type == "xor" and most == 0)
        or (corruption_type == "channel_shuffle" and "v" in bands)
    ):
        return []
    seed_used = draws.fresh_seed(seed)
    keep, flip = 1.0 - severity, float(severity)
    inverted = np.array([int(v * keep + (255 - v) * flip) for v in range(256)], np.int32)

    def change(cut, i, order, y, x, frame):
        if corruption_type == "invert":
            return [inverted[c] for c in cut]
        if corruption_type == "channel_shuffle":
            return [cut[k] for k in ALL_ORDERS[order]]
        if ordered:
            state, first, th, tw = order
            rows = y[:, 0] - first
            lo_row, hi_row = int(rows.min()), int(rows.max()) + 1
            mask = ordered_draws.byte_rows(state, most, th, tw * len(cut), lo_row, hi_row)
            mask = mask.reshape(-1, tw, len(cut))[rows - lo_row]
            return [c ^ mask[:, :, k].astype(np.int32) for k, c in enumerate(cut)]
        return [
            c ^ draws.uniform_int_array(seed_used, "xor", 0, most + 1, *frame, y, k, i, x).astype(np.int32)
            for k, c in enumerate(cut)
        ]

    bands_in = len([b for b in bands if b != "a"])

    def listed(height: int, width: int) -> list[Tile]:
        """Tiles, and what each one draws besides its place: an order of bands, or where its masks begin."""

        def after(rng: np.random.Generator, th: int, tw: int):
            if corruption_type == "channel_shuffle":
                happens = rng.random() < severity
                return ALL_ORDERS.index(tuple(rng.permutation(3).tolist())) if happens else 0
            if corruption_type == "xor":
                state = rng.bit_generator.state
                for _ in ordered_draws.bounded_bytes(rng.bit_generator, most, th * tw * bands_in):
                    pass
                return state
            return None

        found = ordered_draws.tiles(seed, height, width, tile_count, lo, hi, after)
        if corruption_type == "xor":
            return [(y0, x0, th, tw, (state, y0, th, tw)) for y0, x0, th, tw, state in found]
        return found

    shuffles = severity if corruption_type == "channel_shuffle" else None
    return [_tile_kernel(change, tile_count, lo, hi, seed, shuffles, listed if ordered else None)]


def buffer_corruption(
    df: DataFrame,
    tile_count: int,
    corruption_type: str,
    severity: float,
    tile_size_range: tuple[float, float] = TILE_SIZE_RANGE,
    seed: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Corrupt random tiles: ``xor`` with random masks, ``invert`` blend, or ``channel_shuffle``."""
    return apply(
        df,
        buffer_corruption_chain(all_bands(df), tile_count, corruption_type, severity, tile_size_range, seed, ordered),
    )


def grid_cutoff(down: int, across: int, picked: int, seed: int) -> tuple[int, int]:
    """``(draw, cell)`` of the last of the ``picked`` cells with the least draws, in that order.

    Cells are counted by 4096 ranges of draws, a chunk at a time; only the range that holds the last
    one is kept and sorted, so memory does not follow the number of cells.
    """
    cells = down * across

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first in range(0, cells, CELLS):
            cell = np.arange(first, min(cells, first + CELLS))
            yield cell, draws.state_array(seed, "grid_pick", cell // across, cell % across)

    counts = np.zeros(4096, np.int64)
    for _, drawn in chunks():
        counts += np.bincount(drawn >> 19, minlength=4096)
    total = np.cumsum(counts)
    part = int(np.searchsorted(total, picked))
    kept = [(cell[drawn >> 19 == part], drawn[drawn >> 19 == part]) for cell, drawn in chunks()]
    cell, drawn = (np.concatenate(k) for k in zip(*kept))
    nth = np.lexsort((cell, drawn))[picked - int(total[part] - counts[part]) - 1]
    return int(drawn[nth]), int(cell[nth])


def buffer_corruption_grid_chain(
    bands: list[str],
    tile_size: int = 64,
    severity: float = 0.5,
    magnitude: int = 255,
    corruption_type: str = "xor",
    seed: int = 42,
) -> list[Kernel]:
    check_choice("corruption_type", corruption_type, ("xor", "invert", "channel_shuffle"))
    check_range("severity", severity, 0.0, 1.0)
    check_range("magnitude", magnitude, 0, 255)
    check_range("tile_size", tile_size, 1, float("inf"))
    if "v" in bands:
        raise ValueError("buffer_corruption_grid needs a colour raster")
    s = int(tile_size)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def run(planes: Planes, lines: Lines) -> Planes:
        colour = [planes[b] for b in "rgb"]
        across, down = -(-lines.width // s), -(-lines.height // s)
        picked = int(float(severity) * across * down)
        if not picked:
            return dict(zip("rgb", colour))
        if (down, across) not in known:
            known[down, across] = grid_cutoff(down, across, picked, seed)
        last_draw, last_cell = known[down, across]
        tile_rows, place = np.unique(lines.y // s, return_inverse=True)
        ty, tx = tile_rows[:, None].astype(np.int64), np.arange(across)[None, :]
        drawn = draws.state_array(seed, "grid_pick", ty, tx)
        active = (drawn < last_draw) | ((drawn == last_draw) & (ty * across + tx <= last_cell))
        hit = active[place][:, np.arange(lines.width) // s]
        y, x = lines.y[:, None], np.arange(lines.width)[None, :]
        if corruption_type == "invert":
            changed = [255 - c for c in colour]
        elif corruption_type == "xor":
            mask = (draws.state_array(seed, "grid_value", y, x) >> 23) % (int(magnitude) + 1)
            changed = [c ^ mask for c in colour]
        else:
            n = draws.uniform_int_array(seed, "grid_value", 0, len(ALL_ORDERS), y, x)
            changed = [np.choose(np.array(ALL_ORDERS)[:, c][n], colour) for c in range(3)]
        return {b: np.where(hit, new, c).astype(np.int32) for b, new, c in zip("rgb", changed, colour)}

    return [LineKernel(run, lambda _: ["r", "g", "b"])]


def buffer_corruption_grid(
    df: DataFrame,
    tile_size: int = 64,
    severity: float = 0.5,
    magnitude: int = 255,
    corruption_type: str = "xor",
    seed: int = 42,
) -> DataFrame:
    """Corrupt ``int(severity*tiles)`` cells of a fixed grid; draws are per pixel; alpha is dropped."""
    return apply(
        df, buffer_corruption_grid_chain(all_bands(df), tile_size, severity, magnitude, corruption_type, seed)
    )
