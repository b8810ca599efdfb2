"""Neighbourhood operators: blurs, band shifts and sensor-mosaic simulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from rasterloom.functions import kernels
from rasterloom.functions.kernels import Tap
from rasterloom.model import all_bands, check_choice, check_range
from rasterloom.operators.passes import AreaKernel, Kernel, LineKernel, Lines, apply, mirrored
from rasterloom.operators.strips import Planes, Strip

# Colour (0 red, 1 green, 2 blue) of the top-left 2x2 sensor cells, row by row.
MOSAICS = {
    "RGGB": ((0, 1), (1, 2)),
    "BGGR": ((2, 1), (1, 0)),
    "GRBG": ((1, 0), (2, 1)),
    "GBRG": ((1, 2), (0, 1)),
}


BLOCK = 1 << 15  # pixels summed at a time


Run = tuple[int, int, int, int]  # dy, first and last dx, weight


def runs_of(taps: list[Tap]) -> list[Run]:
    """Merge neighbouring taps of equal weight in a kernel row."""
    runs: list[Run] = []
    for dy, dx, w in sorted(taps):
        if runs and runs[-1][0] == dy and runs[-1][2] == dx - 1 and runs[-1][3] == w:
            runs[-1] = (dy, runs[-1][1], dx, w)
        else:
            runs.append((dy, dx, dx, w))
    return runs


def weighted_sum(plane: np.ndarray, runs: list[Run], strip: Strip, largest: int = 255) -> np.ndarray:
    """Integer sum of ``w * plane[y+dy, x+dx]`` over the strip's own lines, for runs of taps.

    Runs of equal weight cost two lookups in a running sum, whatever their length. Sums that
    fit 32 bits (``largest`` bounds the plane's values) are kept in 32 bits.
    """
    width = plane.shape[1]
    weights = sum(abs(w) * (hi - lo + 1) for _, lo, hi, w in runs)
    longest = width + max(0, -min(r[1] for r in runs)) + max(0, max(r[2] for r in runs))
    bound = largest * max(weights, longest)
    plane = plane.astype(np.int32 if bound < 1 << 31 else np.int64, copy=False)
    left = max(0, -min(r[1] for r in runs))
    right = max(0, max(r[2] for r in runs))
    wide = plane[:, mirrored(np.arange(-left, width + right), width)]
    running = None
    if any(r[1] != r[2] for r in runs):
        running = np.zeros((wide.shape[0], wide.shape[1] + 1), dtype=plane.dtype)
        np.cumsum(wide, axis=1, out=running[:, 1:])
    total = np.zeros((strip.rows, width), dtype=plane.dtype)
    # A few lines at a time, so that the sums stay in the processor's cache. Taps of equal weight
    # are added up first and multiplied once, which halves the work of symmetric kernels.
    by_weight: dict[int, list[tuple[int, int, int]]] = {}
    for dy, lo, hi, w in runs:
        by_weight.setdefault(w, []).append((dy, lo, hi))
    few = max(1, BLOCK // width)
    for start in range(0, strip.rows, few):
        block = total[start : start + few]
        for w, same in by_weight.items():
            part = np.zeros_like(block)
            for dy, lo, hi in same:
                first = strip.top + dy + start
                lines = slice(first, first + len(block))
                if lo == hi:
                    part += wide[lines, left + lo : left + lo + width]
                else:
                    part += running[lines, left + hi + 1 : left + hi + 1 + width]
                    part -= running[lines, left + lo : left + lo + width]
            block += part if w == 1 else part * plane.dtype.type(w)
    return total


def _stencil_kernel(runs: list[Run], divisor: int, alpha: bool) -> AreaKernel:
    before, after = max(0, -min(r[0] for r in runs)), max(0, max(r[0] for r in runs))

    def run(planes: Planes, strip: Strip) -> Planes:
        own = slice(strip.top, strip.top + strip.rows)
        return {
            b: p[own] if b == "a" and not alpha
            else np.clip(weighted_sum(p, runs, strip) // divisor, 0, 255)
            for b, p in planes.items()
        }

    return AreaKernel(run, before, after)


def stencil(df: DataFrame, taps: list[Tap], divisor: int, alpha: bool = False) -> DataFrame:
    """``sum(w * in[y+dy, x+dx]) div divisor``, clipped to a byte, with mirrored edges.

    ``taps`` are ``(dy, dx, weight)``. Alpha is kept as it is unless ``alpha`` is set.
    """
    if not taps or divisor <= 0:
        raise ValueError("a stencil needs taps and a positive divisor")
    return apply(df, [_stencil_kernel(runs_of(taps), divisor, alpha)])


def blur_gaussian_chain(bands: list[str], sigma: float) -> list[Kernel]:
    check_range("sigma", sigma, 0.0, float("inf"))
    if sigma == 0:
        return []
    weights = kernels.gaussian(float(sigma))
    radius = len(weights) // 2
    vertical = [(k - radius, 0, 0, w) for k, w in enumerate(weights)]
    across = [(0, k - radius, k - radius, w) for k, w in enumerate(weights)]

    def blurred(plane: np.ndarray, strip: Strip) -> np.ndarray:
        # Values below 2**24 after the first pass, below 2**40 after the second.
        down = weighted_sum(plane, vertical, strip)
        return weighted_sum(down, across, strip._replace(top=0), 255 * kernels.ONE) >> 32

    def run(planes: Planes, strip: Strip) -> Planes:
        own = slice(strip.top, strip.top + strip.rows)
        return {b: p[own] if b == "a" else blurred(p, strip) for b, p in planes.items()}

    return [AreaKernel(run, radius, radius)]


def blur_gaussian(df: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian in 16-bit weights; nothing is rounded between the two passes."""
    return apply(df, blur_gaussian_chain(all_bands(df), sigma))


def blur_circular_chain(bands: list[str], radius: int) -> list[Kernel]:
    if not isinstance(radius, int) or isinstance(radius, bool) or radius < 0:
        raise ValueError(f"radius must be a non-negative integer, got {radius!r}")
    if radius == 0:
        return []
    runs = kernels.disc_runs(radius)
    return [_stencil_kernel(runs, sum(hi - lo + 1 for _, lo, hi, _ in runs), False)]


def blur_circular(df: DataFrame, radius: int) -> DataFrame:
    """Mean over a disc; alpha is kept."""
    return apply(df, blur_circular_chain(all_bands(df), radius))


def motion_blur_chain(bands: list[str], kernel_size: int, angle: float = 0.0) -> list[Kernel]:
    if not isinstance(kernel_size, int) or isinstance(kernel_size, bool):
        raise ValueError("kernel_size must be an integer")
    check_range("kernel_size", kernel_size, 1, 100)
    check_range("angle", angle, 0.0, 360.0)
    if angle >= 360:
        raise ValueError("angle must be below 360")
    if kernel_size == 1:
        return []
    taps = kernels.motion(kernel_size, float(angle))
    return [_stencil_kernel(runs_of(taps), kernel_size if angle == 0 else kernels.ONE, True)]


def motion_blur(df: DataFrame, kernel_size: int, angle: float = 0.0) -> DataFrame:
    """Mean along a line of ``kernel_size`` pixels at ``angle`` degrees; alpha is blurred too."""
    return apply(df, motion_blur_chain(all_bands(df), kernel_size, angle))


def _shifted(plane: np.ndarray, dx: int) -> np.ndarray:
    """Lines moved ``dx`` places to the right, uncovered places 0."""
    out = np.zeros_like(plane)
    width = plane.shape[1]
    if abs(dx) < width:
        out[:, max(0, dx) : width + min(0, dx)] = plane[:, max(0, -dx) : width - max(0, dx)]
    return out


def chromatic_aberration_chain(bands: list[str], shift_x: int = 0, shift_y: int = 0) -> list[Kernel]:
    for name, value in (("shift_x", shift_x), ("shift_y", shift_y)):
        if not isinstance(value, int) or isinstance(value, bool):
            raise ValueError(f"{name} must be an integer")
    if "v" in bands or (shift_x == 0 and shift_y == 0):
        return []
    moves = {"r": (shift_y, shift_x), "b": (-shift_y, -shift_x)}
    if shift_y == 0:

        def sideways(planes: Planes, lines: Lines) -> Planes:
            return planes | {b: _shifted(planes[b], dx) for b, (_, dx) in moves.items()}

        return [LineKernel(sideways)]

    def run(planes: Planes, strip: Strip) -> Planes:
        y = np.arange(strip.first, strip.first + strip.rows)
        own = slice(strip.top, strip.top + strip.rows)
        done = {b: p[own] for b, p in planes.items()}
        for b, (dy, dx) in moves.items():
            inside = (y - dy >= 0) & (y - dy < strip.height)
            moved = planes[b][strip.top - dy : strip.top - dy + strip.rows]
            done[b] = _shifted(np.where(inside[:, None], moved, 0), dx)
        return done

    return [AreaKernel(run, abs(shift_y), abs(shift_y))]


def chromatic_aberration(df: DataFrame, shift_x: int = 0, shift_y: int = 0) -> DataFrame:
    """Move red by ``(shift_y, shift_x)`` and blue the other way; uncovered places become 0."""
    return apply(df, chromatic_aberration_chain(all_bands(df), shift_x, shift_y))


def _cells(cells: tuple, strip: Strip, lines: int) -> np.ndarray:
    """Sensor colour under each place of a strip's planes (mirrored lines keep their own)."""
    source = mirrored(np.arange(lines) + strip.first - strip.top, strip.height)
    return np.array(cells)[source[:, None] % 2, np.arange(strip.width)[None, :] % 2]


def _sixteenths(total: np.ndarray) -> np.ndarray:
    """``total / 16`` rounded half to even and clipped to a byte."""
    low = total >> 4
    rest = total & 15
    return np.clip(low + ((rest > 8) | ((rest == 8) & (low & 1 == 1))), 0, 255)


def _square(rows) -> list[Run]:
    return runs_of([(y - 2, x - 2, w) for y, row in enumerate(rows) for x, w in enumerate(row) if w])


def bayer_filter_chain(bands: list[str], pattern: str = "RGGB", method: str = "linear") -> list[Kernel]:
    check_choice("pattern", pattern, tuple(MOSAICS))
    check_choice("method", method, ("linear", "bilinear"))
    if "v" in bands:
        return []
    cells = MOSAICS[pattern]
    red_rows = [0 in row for row in cells]
    green = _square(kernels.GREEN_AT_COLOUR)
    in_row = _square(kernels.COLOUR_IN_ROW)
    in_column = _square(tuple(zip(*kernels.COLOUR_IN_ROW)))
    diagonal = _square(kernels.COLOUR_DIAGONAL)

    def linear(planes: Planes, strip: Strip) -> Planes:
        own = slice(strip.top, strip.top + strip.rows)
        colour = _cells(cells, strip, len(planes["r"]))
        mosaic = np.choose(colour, [planes["r"], planes["g"], planes["b"]])
        here, value = colour[own], mosaic[own]
        rows = np.array(red_rows)[np.arange(strip.first, strip.first + strip.rows) % 2][:, None]
        across, down, corner = (
            _sixteenths(weighted_sum(mosaic, runs, strip)) for runs in (in_row, in_column, diagonal)
        )
        done = {
            "r": np.where(here == 0, value, np.where(here == 2, corner, np.where(rows, across, down))),
            "g": np.where(here == 1, value, _sixteenths(weighted_sum(mosaic, green, strip))),
            "b": np.where(here == 2, value, np.where(here == 0, corner, np.where(rows, down, across))),
        }
        return done | ({"a": planes["a"][own]} if "a" in planes else {})

    def bilinear(planes: Planes, strip: Strip) -> Planes:
        own = slice(strip.top, strip.top + strip.rows)
        here = _cells(cells, strip, len(planes["r"]))[own]
        y = np.arange(strip.first, strip.first + strip.rows)[:, None]
        x = np.arange(strip.width)[None, :]
        inside_y = [y > 0, y < strip.height - 1]
        inside_x = [x > 0, x < strip.width - 1]
        inner = inside_y[0] & inside_y[1] & inside_x[0] & inside_x[1]

        def pair(band: str, offsets) -> np.ndarray:
            return weighted_sum(planes[band], [(dy, dx, dx, 1) for dy, dx in offsets], strip)

        across, down = ((0, -1), (0, 1)), ((-1, 0), (1, 0))
        corners = ((-1, -1), (-1, 1), (1, -1), (1, 1))
        side = {n: pair("g", [o]) for n, o in zip("nswe", (*down, *across))}
        # Green follows the smaller gradient; at the border it is the mean of what exists.
        flat, steep = np.abs(side["w"] - side["e"]), np.abs(side["n"] - side["s"])
        directed = np.where(
            flat < steep, (side["w"] + side["e"]) // 2,
            np.where(steep < flat, (side["n"] + side["s"]) // 2, sum(side.values()) // 4),
        )
        exists = dict(zip("nswe", (*inside_y, *inside_x)))
        count = sum(np.broadcast_to(e, here.shape).astype(np.int64) for e in exists.values())
        border = sum(np.where(exists[n], side[n], 0) for n in "nswe") // np.maximum(count, 1)
        done = {"g": np.where(here == 1, planes["g"][own], np.where(inner, directed, border))}
        # At green, red and blue come from the row or the column. Fixed rule: with a coloured
        # top-left cell red follows its own rows; with a green one it follows the column where
        # the cell's column parity matches the pattern's first row.
        if cells[0][0] != 1:
            red_across = np.array(red_rows)[y % 2]
        else:
            red_across = (x % 2 == 1) if pattern == "GRBG" else (x % 2 == 0)
        for band, code, opposite, across_here in (
            ("r", 0, 2, red_across), ("b", 2, 0, ~red_across)
        ):
            at_green = np.where(across_here, pair(band, across) // 2, pair(band, down) // 2)
            far = pair(band, corners) // 4
            built = np.where(here == opposite, far, at_green)
            own_band = planes[band][own]
            done[band] = np.where((here == code) | ~inner, own_band, built)
        return done | ({"a": planes["a"][own]} if "a" in planes else {})

    return [AreaKernel(bilinear, 1, 1) if method == "bilinear" else AreaKernel(linear, 2, 2)]


def bayer_filter(df: DataFrame, pattern: str = "RGGB", method: str = "linear") -> DataFrame:
    """Sample one colour per pixel through a 2x2 mosaic and rebuild the other two.

    ``linear`` uses the 5x5 gradient-corrected filters, ``bilinear`` neighbour averages whose
    border pixels keep their own colours. Alpha is kept; grey input is returned as it is.
    """
    return apply(df, bayer_filter_chain(all_bands(df), pattern, method))
