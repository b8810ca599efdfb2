"""Integer kernels, built once on the driver."""

from __future__ import annotations

import math

ONE = 1 << 16  # one, in the 16-bit fixed point of kernel weights

# 5x5 linear demosaicing filters, times 16.
GREEN_AT_COLOUR = (
    (0, 0, -2, 0, 0),
    (0, 0, 4, 0, 0),
    (-2, 4, 8, 4, -2),
    (0, 0, 4, 0, 0),
    (0, 0, -2, 0, 0),
)
COLOUR_IN_ROW = (
    (0, 0, 1, 0, 0),
    (0, -2, 0, -2, 0),
    (-2, 8, 10, 8, -2),
    (0, -2, 0, -2, 0),
    (0, 0, 1, 0, 0),
)
COLOUR_DIAGONAL = (
    (0, 0, -3, 0, 0),
    (0, 4, 0, 4, 0),
    (-3, 0, 12, 0, -3),
    (0, 4, 0, 4, 0),
    (0, 0, -3, 0, 0),
)

Tap = tuple[int, int, int]  # dy, dx, weight


def rounded_to_one(weights: list[float], total: int = ONE) -> list[int]:
    """Integer weights that sum exactly to ``total``; the largest takes the remainder."""
    scale = total / sum(weights)
    whole = [round(w * scale) for w in weights]
    top = max(range(len(whole)), key=lambda i: (weights[i], -abs(2 * i - len(whole) + 1)))
    whole[top] += total - sum(whole)
    return whole


def gaussian(sigma: float) -> list[int]:
    """One-dimensional weights for offsets ``-radius..radius``, radius = int(4*sigma + 0.5)."""
    radius = int(4.0 * sigma + 0.5)
    return rounded_to_one(
        [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    )


def disc(radius: int) -> list[Tap]:
    """Every offset within ``radius``, with weight 1."""
    side = range(-radius, radius + 1)
    return [(dy, dx, 1) for dy in side for dx in side if dy * dy + dx * dx <= radius * radius]


def disc_runs(radius: int) -> list[tuple[int, int, int, int]]:
    """The same as rows of neighbouring offsets: ``(dy, first dx, last dx, 1)``."""
    halves = [(dy, math.isqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)]
    return [(dy, -half, half, 1) for dy, half in halves]


def motion(size: int, angle: float) -> list[Tap]:
    """A centred line of ``size`` taps, turned about the kernel's centre by bilinear sampling.

    Weights sum to ``size`` for a horizontal line and to ONE otherwise. Offsets are those of a
    convolution, so an even kernel reaches one further right and below than left and above.
    """
    row = (size - 1) // 2
    origin = size // 2
    if angle == 0:
        return [(origin - row, origin - k, 1) for k in range(size)]
    middle = (size - 1) / 2.0
    cos, sin = math.cos(math.radians(angle)), math.sin(math.radians(angle))

    def near(distance: float) -> float:
        return max(0.0, 1.0 - abs(distance))

    weights: dict[tuple[int, int], float] = {}
    for y in range(size):
        for x in range(size):
            sx = round(cos * (x - middle) - sin * (y - middle) + middle, 9)
            sy = round(sin * (x - middle) + cos * (y - middle) + middle, 9)
            # Bilinear sampling of the line: how much of this point lies in its columns,
            # times how near it is to its row.
            along = sum(near(sx - k) for k in (math.floor(sx), math.floor(sx) + 1) if 0 <= k < size)
            value = along * near(sy - row)
            if value > 0:
                weights[(origin - y, origin - x)] = value
    if not weights:
        return []
    offsets = sorted(weights)
    whole = rounded_to_one([weights[o] for o in offsets])
    return [(dy, dx, w) for (dy, dx), w in zip(offsets, whole) if w]
