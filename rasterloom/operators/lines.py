"""Per-line operators: detector striping and scan-line gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import draws
from rasterloom.functions import ordered as ordered_draws
from rasterloom.model import all_bands, check_choice, check_range, is_scanlines, value_bands
from rasterloom.operators.passes import Kernel, LineKernel, Lines, apply
from rasterloom.operators.strips import Planes

# Fixed values.
GAP_DRIFT = 0.3  # sideways drift of a scan-line gap, in pixels per row
FILL_SPREAD = 5  # a mean fill varies by -5..5
STRIPE_SPREAD = 0.2  # a stripe's gain is within 1 +- 0.2*strength


def stripes(side: int, density: float, spread: float, base: int, frame: list[int]) -> np.ndarray:
    """16-bit gain of each line of an image side; the ``int(density*side)`` least draws are striped."""
    line = np.arange(side)
    drawn = draws.state_array(base, "stripe_pick", *frame, line)
    picked = np.lexsort((line, drawn))[: int(density * side)]
    gains = np.full(side, 65536, np.int64)
    u = draws.uniform_array(base, "stripe_gain", *frame, picked)
    gains[picked] = np.floor(((1.0 - spread) + u * (2.0 * spread)) * 65536.0).astype(np.int64)
    return gains


def ordered_stripes(side: int, density: float, spread: float, seed: int) -> np.ndarray:
    """Gain of each line of an image side, with the draws of a sequential generator."""
    rng, count = ordered_draws.generator(seed), int(density * side)
    gains = np.ones(side, np.float32)
    if count:
        picked = rng.choice(side, size=count, replace=False)
        gains[picked] = rng.uniform(1.0 - spread, 1.0 + spread, size=count)
    return gains


def _ordered_corduroy(orientation: str, density: float, spread: float, seed: int) -> LineKernel:
    def run(planes: Planes, lines: Lines) -> Planes:
        upright = orientation == "vertical"
        gains = ordered_stripes(lines.width if upright else lines.height, density, spread, seed)
        gain = gains[None, :] if upright else gains[lines.y][:, None]
        done = dict(planes)
        for b, p in planes.items():
            if b != "a":
                share = np.clip(p.astype(np.float32) * np.float32(1 / 255) * gain, 0.0, 1.0)
                done[b] = np.rint(share * np.float32(255)).astype(np.int32)
        return done

    return LineKernel(run)


def corduroy_chain(
    bands: list[str],
    strength: float,
    orientation: str,
    density: float,
    seed: int | None = None,
    ordered: bool = False,
) -> list[Kernel]:
    check_range("strength", strength, 0.0, 1.0)
    check_choice("orientation", orientation, ("vertical", "horizontal"))
    check_range("density", density, 0.0, 1.0)
    ordered_draws.check(ordered, seed)
    if strength == 0 or density == 0:
        return []
    base, spread = draws.fresh_seed(seed), STRIPE_SPREAD * strength
    if ordered:
        return [_ordered_corduroy(orientation, density, spread, seed)]

    def run(planes: Planes, lines: Lines) -> Planes:
        side = lines.width if orientation == "vertical" else lines.height
        keys = draws.key_arrays(seed, lines.frame_id)
        ids, place = np.unique(lines.frame_id, return_inverse=True) if keys else ([0], np.zeros(len(lines.y), int))
        first = [int(np.flatnonzero(place == i)[0]) for i in range(len(ids))] if keys else [0]
        gains = np.stack([stripes(side, density, spread, base, [int(k[f]) for k in keys]) for f in first])
        gain = gains[place] if orientation == "vertical" else gains[place, lines.y][:, None]
        return {
            b: p if b == "a" else np.minimum(255, np.rint(p * gain / 65536.0)).astype(np.int32)
            for b, p in planes.items()
        }

    return [LineKernel(run)]


def corduroy(
    df: DataFrame,
    strength: float,
    orientation: str,
    density: float,
    seed: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Multiply ``int(density*lines)`` random columns (vertical) or rows by 1 +- 0.2*strength.

    Which lines of a side are striped depends on its length (without a seed also on the frame), so
    every batch of lines works it out by itself.
    """
    return apply(df, corduroy_chain(all_bands(df), strength, orientation, density, seed, ordered))


def with_gaps(df: DataFrame, gap_width: float, scan_period: int) -> DataFrame:
    """Add ``gap_from, gap_to``: the masked columns ``[gap_from, gap_to)`` of each row.

    Bands of ``scan_period`` rows alternate direction; which way a band leans depends on how
    many earlier bands are wide enough to show. That count has a closed form, because a band
    shows exactly when its first row is at least ``reach`` rows from the centre.
    """
    h, w, y = F.col("height"), F.col("width"), F.col("y")
    centre = F.floor(h / 2).cast("int")

    def width_at(distance: Column) -> Column:
        return distance / (h / F.lit(2.0)) * F.lit(float(gap_width)) * w

    guess = F.ceil(h / (w * F.lit(2.0 * gap_width))).cast("int")
    reach = (
        F.when((guess > 1) & (width_at(guess - 1) >= 1), guess - 1)
        .when(width_at(guess) >= 1, guess)
        .otherwise(guess + 1)
    )
    period = F.lit(int(scan_period))
    first = y - y % period
    earlier = F.col("_first") / period
    shown_above = F.when(
        F.col("_reach") <= centre,
        F.least(earlier, F.floor((centre - F.col("_reach")) / period) + 1),
    ).otherwise(F.lit(0))
    shown_below = F.greatest(
        F.lit(0), earlier - F.ceil((centre + F.col("_reach")) / period)
    )
    lean = F.when((shown_above + shown_below) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    half = F.floor(F.floor(width_at(F.abs(y - centre))) / 2).cast("int")
    shows = F.abs(F.col("_first") - centre) >= F.col("_reach")
    middle = F.floor(w / 2).cast("int") + (
        F.lit(GAP_DRIFT) * (y - F.col("_first")) * F.col("_lean")
    ).cast("int")
    return (
        df.withColumns({"_first": first, "_reach": reach})
        .withColumns({"_lean": lean, "_half": F.when(shows, half).otherwise(F.lit(0))})
        .withColumn("_middle", middle)
        .withColumns(
            {
                "gap_from": F.greatest(F.lit(0), F.col("_middle") - F.col("_half")),
                "gap_to": F.least(w, F.col("_middle") + F.col("_half")),
            }
        )
        .drop("_first", "_reach", "_lean", "_half", "_middle")
    )


def gap_bounds(height: int, width: int, gap_width: float, scan_period: int) -> tuple[np.ndarray, np.ndarray]:
    """``gap_from, gap_to`` of every row of one frame size."""
    y = np.arange(height)
    reach = (np.abs(y - height // 2) / (height / 2.0) * gap_width * width).astype(np.int64)
    first = y - y % scan_period
    shown = (reach > 0) & (y == first)
    lean = np.where((np.cumsum(shown) - shown)[first] % 2 == 0, 1, -1)
    half = np.where(reach[first] > 0, reach // 2, 0)
    middle = width // 2 + (GAP_DRIFT * (y - first) * lean).astype(np.int64)
    return np.maximum(0, middle - half), np.minimum(width, middle + half)


def _ordered_shifts(height: int, width: int, gap_width: float, scan_period: int, seed: int, bands: int) -> np.ndarray:
    """What a mean fill adds in each line and band: lines with a gap draw one after another."""
    lo, hi = gap_bounds(height, width, gap_width, scan_period)
    rng, found = ordered_draws.generator(seed), np.zeros((height, bands), np.int64)
    for y in np.flatnonzero(lo < hi):
        if bands == 1:
            found[y] = rng.integers(-FILL_SPREAD, FILL_SPREAD + 1)
        else:
            found[y] = rng.integers(-FILL_SPREAD, FILL_SPREAD + 1, size=bands, dtype=np.int16)
    return found


def slc_off_chain(
    bands: list[str],
    gap_width: float,
    scan_period: int,
    fill_mode: str = "black",
    seed: int | None = None,
    ordered: bool = False,
) -> list[Kernel]:
    check_range("gap_width", gap_width, 0.0, 0.5)
    if not isinstance(scan_period, int):
        raise ValueError("scan_period must be an integer")
    check_range("scan_period", scan_period, 2, 100)
    check_choice("fill_mode", fill_mode, ("black", "white", "mean"))
    ordered_draws.check(ordered, seed)
    if gap_width == 0:
        return []
    base = draws.fresh_seed(seed)
    known: dict[tuple[int, int, int], np.ndarray] = {}

    def ordered_shift(lines: Lines, bands: int) -> np.ndarray:
        size = (lines.height, lines.width, bands)
        if size not in known:
            known.clear()
            known[size] = _ordered_shifts(*size[:2], gap_width, scan_period, seed, bands)
        return known[size][lines.y]

    def run(planes: Planes, lines: Lines) -> Planes:
        lo, hi = (b[lines.y][:, None] for b in gap_bounds(lines.height, lines.width, gap_width, scan_period))
        x = np.arange(lines.width)[None, :]
        inside = (x >= lo) & (x < hi)
        outside = np.maximum(1, (~inside).sum(1, keepdims=True))
        keys = draws.key_arrays(seed, lines.frame_id)
        done = dict(planes)
        names = [b for b in planes if b != "a"]
        for i, band in enumerate(names):
            fill = 0 if fill_mode == "black" else 255
            if fill_mode == "mean":
                mean = np.where(inside, 0, planes[band]).sum(1, keepdims=True, dtype=np.int64) // outside
                if ordered:
                    shift = ordered_shift(lines, len(names))[:, i]
                else:
                    shift = draws.uniform_int_array(base, "gap_fill", -FILL_SPREAD, FILL_SPREAD + 1, *keys, lines.y, i)
                fill = np.clip(mean + shift[:, None], 0, 255)
            done[band] = np.where(inside, fill, planes[band]).astype(np.int32)
        return done

    return [LineKernel(run)]


def slc_off(
    df: DataFrame,
    gap_width: float,
    scan_period: int,
    fill_mode: str = "black",
    seed: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Wedge-shaped scan-line gaps filled with black, white or the row's varied mean.

    The mask is one column range per row. Pixels are tested against two numbers and stay pixels;
    only a mean fill of pixel rows has to collect lines first.
    """
    chain = slc_off_chain(all_bands(df), gap_width, scan_period, fill_mode, seed, ordered)
    if is_scanlines(df) or fill_mode == "mean" or not chain:
        return apply(df, chain)
    bands = value_bands(df)
    inside = (F.col("x") >= F.col("gap_from")) & (F.col("x") < F.col("gap_to"))
    fill = F.lit(0 if fill_mode == "black" else 255)
    return with_gaps(df, gap_width, scan_period).select(
        *[F.when(inside, fill).otherwise(F.col(c)).alias(c) if c in bands else c for c in df.columns]
    )
