"""Lossy-compression artefacts: YCbCr, chroma averaging, 8x8 transform, quantisation.

All arithmetic is on integers (kept exactly in doubles inside the matrix products), so results
do not depend on how blocks are batched. The work is local to 16-line bands of a frame, which
is why strips need no halo and any number of generations costs one shuffle of scanlines.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import draws
from rasterloom.functions import ordered as ordered_draws
from rasterloom.functions.binding import int_array
from rasterloom.model import (
    KEYS,
    all_bands,
    check_choice,
    check_range,
    clip_byte,
    is_scanlines,
    to_scanlines,
    value_bands,
)
from rasterloom.operators.passes import AreaKernel, Kernel, LineKernel, Lines, apply
from rasterloom.operators.pixelwise import gamma_table
from rasterloom.operators.strips import Planes, Strip, list_column, planes_of
from rasterloom.operators.tiles import TILE_SIZE_RANGE, check_tiles, tile_geometry

# The standard luminance and chrominance quantisation tables, row by row.
LUMA_TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_TABLE = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
# Chroma cell (lines, columns) of each subsampling mode.
CELLS = {0: (1, 1), 1: (1, 2), 2: (2, 2)}
# 8x8 cosine basis in 13-bit fixed point.
BASIS = np.array(
    [
        [
            round(8192 * math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16))
            for x in range(8)
        ]
        for u in range(8)
    ],
    dtype=np.int64,
)


def quantisers(quality: int, chroma: bool = False) -> list[int]:
    """The 64 divisors of a quality between 1 and 100."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    base = CHROMA_TABLE if chroma else LUMA_TABLE
    return [min(255, max(1, math.floor((q * scale + 50) / 100))) for q in base]


def check_quality(name: str, value, lo: int = 1, hi: int = 100) -> None:
    if not isinstance(value, int) or isinstance(value, bool):
        raise ValueError(f"{name} must be an integer")
    check_range(name, value, lo, hi)


# --- colour space ------------------------------------------------------------------------


def to_ycbcr(df: DataFrame) -> DataFrame:
    """Colour to ``yy, cb, cr`` in 16-bit fixed point (alpha dropped), in the layout given."""
    half = (128 << 16) + 32767
    weights = {
        "yy": (19595, 38470, 7471, 32768), "cb": (-11059, -21709, 32768, half), "cr": (32768, -27439, -5329, half)
    }
    if not is_scanlines(df):
        r, g, b = F.col("r"), F.col("g"), F.col("b")
        made = [
            F.shiftright(r * k[0] + g * k[1] + b * k[2] + k[3], 16).cast("int").alias(n) for n, k in weights.items()
        ]
        return df.select(*KEYS, "x", *made)

    def band(k: tuple[int, int, int, int]) -> Column:
        red_green = F.zip_with("r", "g", lambda r, g: r * k[0] + g * k[1] + k[3])
        return F.zip_with(red_green, "b", lambda s, b: F.shiftright(s + b * k[2], 16).cast("int"))

    return df.select(*KEYS, *[band(k).alias(n) for n, k in weights.items()])


def to_rgb(df: DataFrame) -> DataFrame:
    """``yy, cb, cr`` back to clipped ``r, g, b``, in the layout given."""

    def red(y: Column, cr: Column) -> Column:
        return y + F.shiftright((cr - 128) * 91881 + 32768, 16)

    def blue(y: Column, cb: Column) -> Column:
        return y + F.shiftright((cb - 128) * 116130 + 32768, 16)

    def green(y: Column, chroma: Column) -> Column:
        return y - F.shiftright(chroma + 32768, 16)

    def chroma(cb: Column, cr: Column) -> Column:
        return (cb - 128) * 22554 + (cr - 128) * 46802

    def byte(c: Column) -> Column:
        return clip_byte(c).cast("int")

    if isinstance(df.schema["yy"].dataType, T.IntegerType):
        y, cb, cr = F.col("yy"), F.col("cb"), F.col("cr")
        made = [byte(red(y, cr)), byte(green(y, chroma(cb, cr))), byte(blue(y, cb))]
        return df.select(*KEYS, "x", *[c.alias(b) for c, b in zip(made, "rgb")])
    return df.select(
        *KEYS,
        F.zip_with("yy", "cr", lambda y, c: byte(red(y, c))).alias("r"),
        F.zip_with("yy", F.zip_with("cb", "cr", chroma), lambda y, c: byte(green(y, c))).alias("g"),
        F.zip_with("yy", "cb", lambda y, c: byte(blue(y, c))).alias("b"),
    )


def cell_means(plane: np.ndarray, tall: int, broad: int) -> np.ndarray:
    """Mean of each cell, half rounded up; cells at the rim may be smaller."""
    rows, columns = np.arange(0, plane.shape[0], tall), np.arange(0, plane.shape[1], broad)
    total = np.add.reduceat(np.add.reduceat(plane, rows, axis=0), columns, axis=1)
    count = np.diff([*rows, plane.shape[0]])[:, None] * np.diff([*columns, plane.shape[1]])[None, :]
    return (total + count // 2) // count


def subsample_chroma(df: DataFrame, subsampling: int = 2) -> DataFrame:
    """Replace ``cb`` and ``cr`` of scanlines by their mean over 1x1, 1x2 or 2x2 cells.

    Half rounds up. Cells of one line need no shuffle; cells of two lines meet in strips.
    """
    check_choice("subsampling", subsampling, tuple(CELLS))
    tall, broad = CELLS[subsampling]
    if tall * broad == 1:
        return df
    names = {"yy": "r", "cb": "g", "cr": "b"}

    def run(planes: Planes, strip: Strip) -> Planes:
        done = {"r": planes["r"]}
        for band in "gb":
            mean = cell_means(planes[band], tall, broad)
            done[band] = mean.repeat(tall, 0)[: strip.rows].repeat(broad, 1)[:, : strip.width]
        return done

    def lines(planes: Planes, at: Lines) -> Planes:
        return run(planes, Strip(0, len(at.y), 0, at.height, at.width))

    chain: list[Kernel] = [AreaKernel(run, align=tall) if tall > 1 else LineKernel(lines)]
    renamed = df.select(*KEYS, *[F.col(c).alias(b) for c, b in names.items()])
    made = apply(renamed, chain)
    return made.select(*KEYS, *[F.col(b).alias(c) for c, b in names.items()])


# --- rows of 8x8 blocks --------------------------------------------------------------------


def to_blocks(df: DataFrame, partial: str = "pad") -> DataFrame:
    """Scanlines to rows of blocks: ``frame_id, height, width, by, <band> ARRAY<BIGINT>``.

    A row holds the blocks of eight lines, 64 values each, from left to right. Partial blocks at the
    right and bottom repeat the last column and line (``pad``) or are left out (``skip``). The
    eight lines of a row meet in one shuffle.
    """
    check_choice("partial", partial, ("pad", "skip"))
    scan = to_scanlines(df)
    bands = value_bands(scan)

    def run(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[0].as_py() for c in ("frame_id", "height", "width", "by")}
        height, width = one["height"], one["width"]
        order = np.argsort(table.column("y").to_numpy(), kind="stable")
        y = table.column("y").to_numpy()[order]
        first = 8 * one["by"]
        if not np.array_equal(y, np.arange(first, min(first + 8, height))):
            raise ValueError(f"a frame must have each of its lines exactly once: frame {one['frame_id']}")
        planes = planes_of(table, bands, order)
        if partial == "skip":
            keep = len(y) == 8 and width >= 8
            planes = {b: p[:, : width - width % 8] if keep else p[:0, :0] for b, p in planes.items()}
        else:
            planes = {b: np.pad(p, ((0, 8 - len(y)), (0, -width % 8)), mode="edge") for b, p in planes.items()}
        if not planes[bands[0]].size:
            return pa.table({f.name: pa.array([], f.type) for f in arrow})
        flat = {b: p.reshape(8, -1, 8).transpose(1, 0, 2).reshape(1, -1) for b, p in planes.items()}
        offsets = pa.array([0, flat[bands[0]].size], pa.int32())
        columns = {c: pa.array([one[c]], arrow.field(c).type) for c in ("frame_id", "height", "width", "by")}
        columns |= {b: pa.ListArray.from_arrays(offsets, pa.array(f[0].astype(np.int64))) for b, f in flat.items()}
        return pa.table(columns)

    arrow = pa.schema(
        [("frame_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("by", pa.int32())]
        + [(b, pa.list_(pa.int64())) for b in bands]
    )
    schema = "frame_id long, height int, width int, by int, " + ", ".join(f"{b} array<bigint>" for b in bands)
    rows = scan.select(*KEYS, F.floor(F.col("y") / 8).cast("int").alias("by"), *bands)
    return rows.groupBy("frame_id", "by").applyInArrow(run, schema)


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Rows of blocks back to scanlines, padding dropped; each row gives its eight lines."""
    bands = value_bands(blocks)
    schema = "frame_id long, height int, width int, y int, " + ", ".join(f"{b} array<int>" for b in bands)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in ("frame_id", "height", "width", "by")}
                first = 8 * one["by"]
                n = min(8, one["height"] - first)
                columns = {
                    "frame_id": pa.array(np.full(n, one["frame_id"], np.int64)),
                    "height": pa.array(np.full(n, one["height"], np.int32)),
                    "width": pa.array(np.full(n, one["width"], np.int32)),
                    "y": pa.array(np.arange(first, first + n, dtype=np.int32)),
                }
                for b in bands:
                    flat = batch.column(b)[i].values.to_numpy()
                    plane = flat.reshape(-1, 8, 8).transpose(1, 0, 2).reshape(8, -1)
                    columns[b] = list_column(plane[:n, : one["width"]])
                yield from pa.table(columns).to_batches()

    return blocks.mapInArrow(run, schema)


def _map_blocks(blocks: DataFrame, fn) -> DataFrame:
    """Apply ``fn`` to batches of 8x8 integer matrices; no shuffle."""
    bands = value_bands(blocks)

    def run(batches):
        for batch in batches:
            table = pa.table(batch)
            for b in bands:
                lists = table.column(b).combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                done = fn(lists.flatten().to_numpy().astype(np.int64).reshape(-1, 8, 8)).ravel()
                offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(done))
                table = table.set_column(table.schema.get_field_index(b), b, column)
            yield from table.to_batches()

    return blocks.mapInArrow(run, blocks.schema)


def block_dct(blocks: DataFrame) -> DataFrame:
    """Forward transform of level-shifted blocks; coefficients are scaled by 2**13."""
    return _map_blocks(blocks, lambda x: (BASIS @ (x - 128) @ BASIS.T + (1 << 12)) >> 13)


def quantize(blocks: DataFrame, quality: int, chroma: bool = False) -> DataFrame:
    """Coefficients to the nearest multiple of their divisor (half away from zero)."""
    check_quality("quality", quality)
    table = int_array(quantisers(quality, chroma)).cast("array<bigint>")

    def nearest(c: Column, place: Column) -> Column:
        q = F.get(table, place % 64)
        level = F.floor((F.abs(c) + q * 4096) / (q * 8192)).cast("long")
        return F.when(c < 0, -level).otherwise(level) * q * 8192

    kept = [c for c in blocks.columns if c not in value_bands(blocks)]
    return blocks.select(*kept, *[F.transform(b, nearest).alias(b) for b in value_bands(blocks)])


def block_idct(blocks: DataFrame) -> DataFrame:
    """Inverse transform to clipped bytes."""
    return _map_blocks(
        blocks,
        lambda y: np.clip(((BASIS.T @ y @ BASIS + (1 << 38)) >> 39) + 128, 0, 255),
    )


# --- whole codec round trips over strips -------------------------------------------------


def _transform(lines: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Apply ``matrix`` along the lines' and then the columns' groups of eight."""
    height, width = lines.shape
    across = (lines.reshape(-1, 8) @ matrix).reshape(height // 8, 8, width)
    down = np.ascontiguousarray(across.transpose(0, 2, 1)).reshape(-1, 8) @ matrix
    return down.reshape(height // 8, width, 8).transpose(0, 2, 1).reshape(height, width)


def _plane_round_trip(plane: np.ndarray, table: list[int]) -> np.ndarray:
    """Transform, quantise and rebuild one plane whose sides are multiples of eight."""
    height, width = plane.shape
    basis = BASIS.astype(np.float64)
    divisor = np.tile(np.array(table, dtype=np.float64).reshape(8, 8), (height // 8, width // 8))
    c = np.floor((_transform(plane - 128.0, basis.T) + 4096) / 8192)
    level = np.sign(c) * np.floor((np.abs(c) + divisor * 4096) / (divisor * 8192))
    rebuilt = _transform(level * divisor, basis)
    return np.clip(np.floor((rebuilt + (1 << 25)) / (1 << 26)).astype(np.int64) + 128, 0, 255)


def _padded(plane: np.ndarray) -> np.ndarray:
    height, width = plane.shape
    return np.pad(plane, ((0, -height % 16), (0, -width % 16)), mode="edge")


def _between(plane: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours before and behind each value along an axis, the rim's value repeated."""
    last = plane.shape[axis] - 1
    at = np.arange(last + 1)
    return plane.take(np.maximum(at - 1, 0), axis), plane.take(np.minimum(at + 1, last), axis)


def smooth_chroma(plane: np.ndarray, tall: int, broad: int) -> np.ndarray:
    """Chroma at full size: three parts of the own cell and one of the next one, each way.

    Rounding alternates from column to column; planes of one or two columns are only repeated.
    """
    if broad == 1:
        return plane
    if plane.shape[1] <= 2:
        return plane.repeat(tall, axis=0).repeat(broad, axis=1)
    sums, shift, rounding = plane, 2, (1, 2)
    if tall == 2:
        above, below = _between(plane, 0)
        sums = np.stack([3 * plane + above, 3 * plane + below], 1).reshape(-1, plane.shape[1])
        shift, rounding = 4, (8, 7)
    before, behind = _between(sums, 1)
    pairs = [(3 * sums + other + r) >> shift for other, r in zip((before, behind), rounding)]
    return np.stack(pairs, 2).reshape(len(sums), -1)


def codec_round_trip(
    planes: list[np.ndarray], quality: int, subsampling: int, partial: str = "pad", smooth: bool = False
) -> list[np.ndarray]:
    """One generation of compression of a grey plane or of red, green and blue planes."""
    height, width = planes[0].shape
    luma, chroma = quantisers(quality), quantisers(quality, chroma=True)
    if partial == "skip":
        tall, broad = CELLS[subsampling]
        whole = (slice(0, height - height % (8 * tall)), slice(0, width - width % (8 * broad)))
        done = [p.copy() for p in planes]
        if done[0][whole].size:
            inner = codec_round_trip([p[whole] for p in planes], quality, subsampling)
            for p, new in zip(done, inner):
                p[whole] = new
        return done
    if len(planes) == 1:
        return [_plane_round_trip(_padded(planes[0]), luma)[:height, :width]]
    r, g, b = (_padded(p) for p in planes)
    half = (128 << 16) + 32767
    y = (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16
    tall, broad = CELLS[subsampling]
    colour = []
    for c in (
        (r * -11059 - g * 21709 + b * 32768 + half) >> 16,
        (r * 32768 - g * 27439 - b * 5329 + half) >> 16,
    ):
        cells = c.reshape(c.shape[0] // tall, tall, c.shape[1] // broad, broad)
        mean = (cells.sum(axis=(1, 3)) + tall * broad // 2) // (tall * broad)
        rebuilt = _plane_round_trip(mean, chroma)[: -(-height // tall), : -(-width // broad)]
        whole = smooth_chroma(rebuilt, tall, broad) if smooth else rebuilt.repeat(tall, axis=0).repeat(broad, axis=1)
        colour.append(whole[:height, :width] - 128)
    y = _plane_round_trip(y, luma)[:height, :width]
    cb, cr = colour
    rgb = (
        y + ((cr * 91881 + 32768) >> 16),
        y - ((cb * 22554 + cr * 46802 + 32768) >> 16),
        y + ((cb * 116130 + 32768) >> 16),
    )
    return [np.clip(p, 0, 255) for p in rgb]


def _generations(
    qualities: list[int], subsampling: int, gamma: float | None = None, partial: str = "pad", smooth: bool = False
) -> list[Kernel]:
    """All generations on strips of whole 16-line bands; alpha is dropped.

    They are one kernel, as bands do not depend on each other. With ``smooth`` chroma of two lines a
    cell, a line at a band's rim also depends on the next band's chroma, so each generation is a kernel
    that reads a band more on either side.
    """
    tone = np.array(gamma_table(gamma), dtype=np.int64) if gamma else None
    kept = {"align": 16, "bands": lambda bands: [b for b in bands if b != "a"]}

    def kernel(qualities: list[int], tone, reach: int) -> AreaKernel:
        def run(planes: Planes, strip: Strip) -> Planes:
            bands = [b for b in planes if b != "a"]
            # mirrored lines beyond the picture go: the codec has its own way to fill the last band
            above = max(0, strip.top - strip.first)
            below = strip.height - strip.first + strip.top
            work = [planes[b][above:below].astype(np.int64) for b in bands]
            work = work if tone is None else [tone[p] for p in work]
            for quality in qualities:
                work = codec_round_trip(work, quality, subsampling, partial, smooth)
            first = strip.top - above
            return {b: p[first : first + strip.rows] for b, p in zip(bands, work)}

        return AreaKernel(run, before=reach, after=reach, **kept)

    if smooth and CELLS[subsampling][0] == 2:
        return [kernel([q], None if i else tone, 16) for i, q in enumerate(qualities)]
    return [kernel(qualities, tone, 0)]


def _check_smooth(smooth: bool, partial: str) -> None:
    if not isinstance(smooth, bool):
        raise ValueError("smooth must be true or false")
    if smooth and partial == "skip":
        raise ValueError("partial blocks are left out only without smooth chroma")


def compression_chain(
    bands: list[str],
    quality: int,
    subsampling: int = 2,
    optimize: bool = True,
    gamma: float | None = None,
    partial: str = "pad",
    smooth: bool = False,
) -> list[Kernel]:
    check_quality("quality", quality)
    check_choice("subsampling", subsampling, tuple(CELLS))
    check_choice("partial", partial, ("pad", "skip"))
    if not isinstance(optimize, bool):
        raise ValueError("optimize must be true or false")
    if gamma is not None and (isinstance(gamma, bool) or not isinstance(gamma, (int, float)) or gamma <= 0):
        raise ValueError("gamma must be a positive number")
    _check_smooth(smooth, partial)
    return _generations([quality], subsampling, gamma, partial, smooth)


def compression(
    df: DataFrame,
    quality: int,
    subsampling: int = 2,
    optimize: bool = True,
    gamma: float | None = None,
    partial: str = "pad",
    smooth: bool = False,
) -> DataFrame:
    """One lossy generation after an optional tone curve. ``optimize`` never changes a pixel.

    ``smooth`` enlarges chroma with a triangle filter on decoding; else its cells are repeated.
    """
    return apply(df, compression_chain(all_bands(df), quality, subsampling, optimize, gamma, partial, smooth))


def quality_schedule(
    iterations: int, quality_start: int, quality_end: int | None = None, decay: str = "fixed"
) -> list[int]:
    """Quality of each generation: constant, linear, or exponential from start to end."""
    if not isinstance(iterations, int) or isinstance(iterations, bool):
        raise ValueError("iterations must be an integer")
    check_range("iterations", iterations, 1, 50)
    check_quality("quality_start", quality_start)
    check_choice("decay", decay, ("fixed", "linear", "exponential"))
    if decay == "fixed":
        return [quality_start] * iterations
    if quality_end is None:
        raise ValueError(f"{decay} decay needs quality_end")
    check_quality("quality_end", quality_end)
    if quality_end >= quality_start:
        raise ValueError("quality_end must be below quality_start")
    if iterations == 1:
        return [quality_start]
    steps = [i / (iterations - 1) for i in range(iterations)]
    if decay == "linear":
        return [int(quality_start + (quality_end - quality_start) * s) for s in steps]
    rate = math.log(quality_end / quality_start)
    return [max(1, int(quality_start * math.exp(rate * s))) for s in steps]


def multi_compress_chain(
    bands: list[str],
    iterations: int,
    quality_start: int,
    quality_end: int | None = None,
    decay: str = "fixed",
    subsampling: int = 2,
    smooth: bool = False,
) -> list[Kernel]:
    check_choice("subsampling", subsampling, tuple(CELLS))
    _check_smooth(smooth, "pad")
    qualities = quality_schedule(iterations, quality_start, quality_end, decay)
    return _generations(qualities, subsampling, smooth=smooth)


def multi_compress(
    df: DataFrame,
    iterations: int,
    quality_start: int,
    quality_end: int | None = None,
    decay: str = "fixed",
    subsampling: int = 2,
    smooth: bool = False,
) -> DataFrame:
    """Chained lossy generations, all inside one pass over the strips; with ``smooth`` chroma of two
    lines a cell, a pass has as many generations as its halo allows."""
    return apply(
        df, multi_compress_chain(all_bands(df), iterations, quality_start, quality_end, decay, subsampling, smooth)
    )


def compression_artifact_chain(
    bands: list[str],
    tile_count: int,
    quality: int,
    tile_size_range: tuple[float, float] = TILE_SIZE_RANGE,
    seed: int | None = None,
    partial: str = "pad",
    ordered: bool = False,
    smooth: bool = False,
) -> list[Kernel]:
    lo, hi = check_tiles(tile_count, 30, tile_size_range)
    _check_smooth(smooth, partial)
    more = 16 if smooth else 0  # smooth chroma reads the bands beside
    ordered_draws.check(ordered, seed)
    check_quality("quality", quality, 1, 20)
    check_choice("partial", partial, ("pad", "skip"))
    base = draws.fresh_seed(seed)
    known: dict[tuple[int, int, int], list[tuple[int, int, int, int]]] = {}

    def placed(height: int, width: int, frame_id: int) -> list[tuple[int, int, int, int]]:
        start = draws.start(base, f"frame {frame_id}") if seed is None else base
        if (height, width, start) not in known:
            known.clear()
            if ordered:
                found = [t[:4] for t in ordered_draws.tiles(seed, height, width, tile_count, lo, hi)]
            else:
                found = tile_geometry(height, width, tile_count, lo, hi, start)
            known[height, width, start] = found
        return known[height, width, start]

    def need(first: int, last: int, height: int, width: int, frame_id: int) -> tuple[int, int]:
        """Going back through the tiles, each one asks for the whole of the 16-line bands it makes."""
        for y0, _, th, _ in reversed(placed(height, width, frame_id)):
            if y0 < last and first < y0 + th:
                above, below = max(first, y0) - y0, min(last, y0 + th) - y0
                first = min(first, y0 + max(0, above // 16 * 16 - more))
                last = max(last, y0 + min(th, -(-below // 16) * 16 + more))
        return first, last

    def run(planes: Planes, strip: Strip) -> Planes:
        bands = [b for b in planes if b != "a"]
        work = [planes[b].copy() for b in bands]
        begin, lines = strip.first - strip.top, len(work[0])
        for y0, x0, th, tw in placed(strip.height, strip.width, strip.frame_id):
            # The tile's bands that lie wholly inside the lines at hand.
            top = max(0, -(-(begin - y0) // 16) * 16)
            end = th if y0 + th <= begin + lines else (begin + lines - y0) // 16 * 16
            if top >= end:
                continue
            part = (slice(y0 + top - begin, y0 + end - begin), slice(x0, x0 + tw))
            source = [p[part] for p in work]
            grey = len(bands) == 1
            done = codec_round_trip(
                source * 3 if grey else source, quality, 0 if partial == "skip" else 2, partial, smooth
            )
            for p, new in zip(work, done):
                p[part] = new
        own = slice(strip.top, strip.top + strip.rows)
        done = {b: p[own] for b, p in zip(bands, work)}
        return done | ({"a": planes["a"][own]} if "a" in planes else {})

    return [AreaKernel(run, need=need)]


def compression_artifact(
    df: DataFrame,
    tile_count: int,
    quality: int,
    tile_size_range: tuple[float, float] = TILE_SIZE_RANGE,
    seed: int | None = None,
    partial: str = "pad",
    ordered: bool = False,
    smooth: bool = False,
) -> DataFrame:
    """Compress random tiles, each on its own block grid, in order; later tiles see earlier ones.

    A tile's 16-line bands are independent, so a strip needs, besides its own lines, only the rest of
    the bands that it shares with tiles, and of the bands that those lines are in before them.
    ``skip`` leaves partial blocks alone and does not subsample chroma. With ``smooth`` chroma a strip
    needs one band more on either side for each tile.
    """
    return apply(
        df,
        compression_artifact_chain(
            all_bands(df), tile_count, quality, tile_size_range, seed, partial, ordered, smooth
        ),
    )
