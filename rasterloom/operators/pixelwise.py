"""Operators that change each pixel on its own: no shuffle, on either layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import draws
from rasterloom.functions import ordered as ordered_draws
from rasterloom.functions.binding import int_array
from rasterloom.model import (
    KEYS,
    all_bands,
    check_choice,
    check_range,
    is_grey,
    is_scanlines,
    looked_up,
    map_bands,
    map_pixels,
    value_bands,
)
from rasterloom.operators.passes import Kernel, LineKernel, Lines, apply
from rasterloom.operators.strips import Planes

DRAWS = 1 << 20  # draws made at a time
HELD_DRAWS = 1 << 22  # most hits kept for the next lines of frames of the same size


def _saturation_draw(mode: str, value, range_, seed: int | None) -> tuple[float, float, int | None]:
    """``(low, spread, seed)`` of the factor: ``low`` alone when it is fixed."""
    check_choice("mode", mode, ("fixed", "random"))
    if mode == "fixed":
        if value is None:
            raise ValueError("fixed mode needs 'value'")
        check_range("value", value, -1.0, float("inf"))
        return max(0.0, 1.0 + value), 0.0, None
    if range_ is None or len(range_) != 2:
        raise ValueError("random mode needs 'range' with two numbers")
    lo, hi = (float(v) for v in range_)
    check_range("range[0]", lo, -1.0, float("inf"))
    if lo >= hi:
        raise ValueError("range minimum must be below its maximum")
    return lo, hi - lo, draws.fresh_seed(seed)


def saturation_chain(
    bands: list[str],
    mode: str = "fixed",
    value: float | None = None,
    range: list[float] | None = None,
    seed: int | None = None,
) -> list[Kernel]:
    lo, spread, base = _saturation_draw(mode, value, range, seed)

    def run(planes: Planes, lines: Lines) -> Planes:
        factor = lo
        if base is not None:
            u = draws.uniform_array(base, "saturation", *draws.key_arrays(None, lines.frame_id))
            factor = np.maximum(0.0, 1.0 + lo + u * spread)[:, None]
        colour = [planes["v"]] * 3 if "v" in planes else [planes[b] for b in "rgb"]
        top, low = np.maximum.reduce(colour), np.minimum.reduce(colour)
        flat = top == low
        own = np.where(flat, 1.0, (top - low) / np.maximum(top, 1))
        ratio = np.minimum(1.0, own * factor) / own
        moved = [np.where(flat, c, (top - (top - c) * ratio).astype(np.int32)) for c in colour]
        return dict(zip("rgb", moved))

    return [LineKernel(run, lambda _: ["r", "g", "b"])]


def saturation(
    df: DataFrame,
    mode: str = "fixed",
    value: float | None = None,
    range: list[float] | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Scale HSV saturation by ``1 + value``, or by a factor drawn per frame from ``range``.

    With V the largest and m the smallest band, s = (V-m)/V becomes min(1, s*f), and each band
    moves along V - (V-c) * s'/s. Grey input becomes colour and alpha is dropped.
    """
    if is_scanlines(df):
        return apply(df, saturation_chain(all_bands(df), mode, value, range, seed))
    lo, spread, base = _saturation_draw(mode, value, range, seed)
    factor = F.lit(lo)
    if base is not None:
        u = draws.uniform(base, "saturation", *draws.FRAME_KEYS)
        factor = F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(lo) + u * F.lit(spread))
    px = convert(df, "RGB")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    own = (F.col("top") - F.col("low")) / F.greatest(F.col("top"), F.lit(1))
    flat = F.col("top") == F.col("low")
    staged = px.withColumns({"top": F.greatest(r, g, b), "low": F.least(r, g, b)}).withColumn(
        "ratio", F.when(flat, F.lit(1.0)).otherwise(F.least(F.lit(1.0), own * factor) / F.when(~flat, own))
    )

    def moved(c: Column) -> Column:
        return F.when(flat, c).otherwise((F.col("top") - (F.col("top") - c) * F.col("ratio")).cast("int"))

    return staged.select(*KEYS, "x", moved(r).alias("r"), moved(g).alias("g"), moved(b).alias("b"))


def _ordered_noise(mode: str, amount: float, seed: int) -> LineKernel:
    """Noise whose draws are those of a generator that goes along the whole picture, band by band."""
    walks: dict[tuple[int, int], ordered_draws.Walk] = {}

    def shifts(lines: Lines, bands: int) -> np.ndarray:
        if mode == "row":
            return ordered_draws.row_uniforms(seed, lines.y, bands, -amount, amount)[:, None, :]
        if mode == "column":
            return ordered_draws.generator(seed).uniform(-amount, amount, (1, lines.width, bands))
        size = (lines.width, bands)
        if size not in walks:
            walks[size] = ordered_draws.Walk(seed, lambda rng, _: rng.normal(0, amount, size))
        return walks[size].values(lines.y)

    def run(planes: Planes, lines: Lines) -> Planes:
        names = [b for b in planes if b != "a"]
        drawn = shifts(lines, len(names))
        done = dict(planes)
        for i, band in enumerate(names):
            share = planes[band].astype(np.float32) / np.float32(255.0)
            done[band] = (np.clip(share + drawn[:, :, i], 0.0, 1.0) * 255.0).astype(np.int32)
        return done

    return LineKernel(run)


def noise_chain(
    bands: list[str], mode: str, amount: float, seed: int | None = None, ordered: bool = False
) -> list[Kernel]:
    check_choice("mode", mode, ("gaussian", "row", "column"))
    check_range("amount", amount, 0.0, 1.0)
    ordered_draws.check(ordered, seed)
    if amount == 0:
        return []
    if ordered:
        return [_ordered_noise(mode, amount, seed)]
    base = draws.fresh_seed(seed)

    def run(planes: Planes, lines: Lines) -> Planes:
        frame = [k[:, None] for k in draws.key_arrays(seed, lines.frame_id)]
        y, x = lines.y[:, None], np.arange(lines.width)[None, :]
        done = dict(planes)
        for i, band in enumerate(b for b in planes if b != "a"):
            if mode == "gaussian":
                shift = draws.normal_array(base, mode, *frame, y, x, i) * (amount * 255.0)
            else:
                u = draws.uniform_array(base, mode, *frame, y if mode == "row" else x, i)
                shift = (u * 2.0 - 1.0) * (amount * 255.0)
            done[band] = np.clip(planes[band] + shift, 0.0, 255.0).astype(np.int32)
        return done

    return [LineKernel(run)]


def noise(
    df: DataFrame, mode: str, amount: float, seed: int | None = None, ordered: bool = False
) -> DataFrame:
    """Additive noise per pixel and band (``gaussian``), per row and band, or per column and band.

    ``ordered`` draws are those of numpy's default generator for the seed, in the order of the picture; pixel
    rows are collected to lines for them.
    """
    chain = noise_chain(all_bands(df), mode, amount, seed, ordered)
    if is_scanlines(df) or not chain or ordered:
        return apply(df, chain)
    per_frame, base = draws.frame_keys(seed), draws.fresh_seed(seed)
    names = value_bands(df)

    def noisy(cols: dict[str, Column]) -> dict[str, Column]:
        out = {}
        for i, name in enumerate(names):
            if mode == "gaussian":
                shift = draws.normal(base, "gaussian", *per_frame, "y", "x", i) * F.lit(amount * 255.0)
            else:
                u = draws.uniform(base, mode, *per_frame, "y" if mode == "row" else "x", i)
                shift = (u * F.lit(2.0) - F.lit(1.0)) * F.lit(amount * 255.0)
            out[name] = F.greatest(F.lit(0.0), F.least(F.lit(255.0), cols[name] + shift))
        return out

    return map_pixels(df, noisy)


def _hits(
    base: int, amount: float, salt_vs_pepper: float, height: int, width: int, frame: list, wanted
) -> Iterator[np.ndarray]:
    """Hits of a frame in the wanted lines, as ``2 * (y * width + x) + salt``, a chunk of draws each."""
    total = int(amount * height * width)
    for first in range(0, total, DRAWS):
        i = np.arange(first, min(total, first + DRAWS))
        y = draws.uniform_int_array(base, "sp_y", 0, height, *frame, i)
        if wanted is not None:
            inside = wanted[y]
            i, y = i[inside], y[inside]
        x = draws.uniform_int_array(base, "sp_x", 0, width, *frame, i)
        salt = draws.uniform_array(base, "sp_salt", *frame, i) < salt_vs_pepper
        yield 2 * (y * width + x) + salt


def _settled(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places hit, in order, and their values; pepper wins where draws meet."""
    drawn = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    place = drawn >> 1
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    return place[first], (drawn[first] & 1) * 255


def _ordered_hits(
    seed: int, amount: float, salt_vs_pepper: float, height: int, width: int, wanted
) -> Iterator[np.ndarray]:
    """As ``_hits``, with the draws of a sequential generator."""
    for y, x, salt in ordered_draws.hits(seed, amount, salt_vs_pepper, height, width):
        found = 2 * (y * width + x) + salt
        yield found if wanted is None else found[wanted[y]]


def salt_pepper_chain(
    bands: list[str], amount: float, salt_vs_pepper: float = 0.5, seed: int | None = None, ordered: bool = False
) -> list[Kernel]:
    check_range("amount", amount, 0.0, 1.0)
    check_range("salt_vs_pepper", salt_vs_pepper, 0.0, 1.0)
    ordered_draws.check(ordered, seed)
    if amount == 0:
        return []
    base = draws.fresh_seed(seed)
    held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def hits_of(height: int, width: int, frame: tuple, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All hits of a frame if they are few enough to keep, else those of the lines ``y``."""
        if (height, width, frame) in held:
            return held[height, width, frame]
        args = (base, amount, salt_vs_pepper, height, width, *([] if ordered else [list(frame)]))
        hits = _ordered_hits if ordered else _hits
        if int(amount * height * width) <= HELD_DRAWS:
            held.clear()
            held[height, width, frame] = _settled(list(hits(*args, None)))
            return held[height, width, frame]
        wanted = np.zeros(height, bool)
        wanted[y] = True
        return _settled(list(hits(*args, wanted)))

    def run(planes: Planes, lines: Lines) -> Planes:
        done = {b: p if b == "a" else p.copy() for b, p in planes.items()}
        keys = draws.key_arrays(seed, lines.frame_id)
        groups = [((), np.arange(len(lines.y)))]
        if keys:
            ids, place = np.unique(lines.frame_id, return_inverse=True)
            rows = [np.flatnonzero(place == i) for i in range(len(ids))]
            groups = [(tuple(int(k[r[0]]) for k in keys), r) for r in rows]
        for frame, rows in groups:
            y = lines.y[rows].astype(np.int64)
            place, value = hits_of(lines.height, lines.width, frame, y)
            begin, end = (np.searchsorted(place, (y + k) * lines.width) for k in (0, 1))
            count = end - begin
            at = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
            row, x = np.repeat(rows, count), place[at] % lines.width
            for b, p in done.items():
                if b != "a":
                    p[row, x] = value[at]
        return done

    return [LineKernel(run)]


def salt_pepper(
    df: DataFrame, amount: float, salt_vs_pepper: float = 0.5, seed: int | None = None, ordered: bool = False
) -> DataFrame:
    """Set ``int(amount*height*width)`` draws of a pixel, with replacement, to 255 or 0 in all value bands.

    Draws depend on the frame's size only (without a seed also on the frame), so every batch of
    lines finds its own hits: no join, and nothing to learn about the raster first. ``ordered`` draws are
    those of numpy's default generator for the seed.
    """
    return apply(df, salt_pepper_chain(all_bands(df), amount, salt_vs_pepper, seed, ordered))


def gamma_table(gamma: float) -> list[int]:
    """``trunc(255 * (v/255) ** gamma)`` for each byte."""
    return [int(255.0 * (v / 255.0) ** gamma) for v in range(256)]


def gamma_map(df: DataFrame, gamma: float) -> DataFrame:
    """Tone curve ``trunc(255 * (v/255) ** gamma)`` through a 256-entry literal table."""
    if isinstance(gamma, bool) or not isinstance(gamma, (int, float)) or gamma <= 0:
        raise ValueError(f"gamma must be a positive number, got {gamma!r}")
    table = int_array(gamma_table(float(gamma)))
    if not is_scanlines(df):
        return map_bands(df, lambda v, _: F.get(table, v))
    return df.withColumns({b: looked_up(b, table) for b in value_bands(df)})


def luma(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 grey level in 16-bit fixed point."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def convert(df: DataFrame, mode: str) -> DataFrame:
    """Change mode: ``L`` (601 luma), ``RGB`` (alpha dropped, grey replicated) or ``RGBA``."""
    check_choice("mode", mode, ("L", "RGB", "RGBA"))
    lines = is_scanlines(df)
    keys = [*KEYS] if lines else [*KEYS, "x"]
    if mode == "L":
        if is_grey(df):
            return df.select(*keys, "v")
        if not lines:
            return df.select(*keys, luma(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("v"))
        red_green = F.zip_with("r", "g", lambda r, g: r * 19595 + g * 38470 + 32768)
        grey = F.zip_with(red_green, "b", lambda s, b: F.shiftright(s + b * 7471, 16).cast("int"))
        return df.select(*keys, grey.alias("v"))
    source = {"r": "v", "g": "v", "b": "v"} if is_grey(df) else {b: b for b in "rgb"}
    cols = [F.col(source[b]).alias(b) for b in "rgb"]
    if mode == "RGBA":
        opaque = F.array_repeat(F.lit(255), F.col("width")) if lines else F.lit(255)
        cols.append((F.col("a") if "a" in all_bands(df) else opaque).alias("a"))
    return df.select(*keys, *cols)
