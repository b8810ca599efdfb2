"""Constants and tables of the SQL side, written out apart from the operators', so that an error in
one of the two shows."""

from __future__ import annotations

import hashlib

import numpy as np

# Moduli, multipliers and masks of the draws.
MODULI = (2147483647, 2147483629)
MULTIPLIERS = (1103515245, 1597334677, 1220703125)
MASKS = (1540483477, 625341585)

# Every order of three bands, and the quantisation tables of the standard, by rows.
ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
LUMINANCE = """
16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99
"""
CHROMINANCE = """
17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99
"""

# The gradient-corrected mosaic filters as (dy, dx, sixteenths).
GREEN = [(0, 0, 8), *[(s, 0, 4) for s in (-1, 1)], *[(0, s, 4) for s in (-1, 1)],
         *[(s, 0, -2) for s in (-2, 2)], *[(0, s, -2) for s in (-2, 2)]]
IN_ROW = [(0, 0, 10), (0, -1, 8), (0, 1, 8), (0, -2, -2), (0, 2, -2), (-2, 0, 1), (2, 0, 1),
          *[(a, b, -2) for a in (-1, 1) for b in (-1, 1)]]
DIAGONAL = [(0, 0, 12), *[(a, b, 4) for a in (-1, 1) for b in (-1, 1)],
            *[(s, 0, -3) for s in (-2, 2)], *[(0, s, -3) for s in (-2, 2)]]


def stream_start(seed: int, label: str) -> int:
    """First state of a named stream: 31 bits of an MD5 digest."""
    return int.from_bytes(hashlib.md5(f"{seed}:{label}".encode()).digest()[:4], "big") % (1 << 31)


def quantiser_table(chroma: bool) -> list[int]:
    return [int(v) for v in (CHROMINANCE if chroma else LUMINANCE).split()]


def turned_line(size: int, angle: float) -> list[tuple[int, int, int]]:
    """Taps of a line of ones in a square, sampled bilinearly at rotated places; sum 65536."""
    line = np.zeros((size + 2, size + 2))
    line[(size - 1) // 2 + 1, 1:-1] = 1.0
    middle, turn = (size - 1) / 2, np.radians(angle)
    y, x = np.mgrid[0:size, 0:size] - middle
    at_x = np.round(np.cos(turn) * x - np.sin(turn) * y + middle, 9)
    at_y = np.round(np.sin(turn) * x + np.cos(turn) * y + middle, 9)
    low_y, low_x = np.floor(at_y).astype(int), np.floor(at_x).astype(int)
    value = np.zeros((size, size))
    for dy in (0, 1):
        for dx in (0, 1):
            weight = (1 - abs(at_y - low_y - dy)) * (1 - abs(at_x - low_x - dx))
            inside = (low_y + dy >= -1) & (low_y + dy <= size) & (low_x + dx >= -1) & (low_x + dx <= size)
            picked = line[np.clip(low_y + dy + 1, 0, size + 1), np.clip(low_x + dx + 1, 0, size + 1)]
            value += np.where(inside, weight * picked, 0)
    taps = [(size // 2 - i, size // 2 - j, value[i, j]) for i in range(size) for j in range(size) if value[i, j] > 0]
    taps.sort()
    scale = 65536 / sum(w for _, _, w in taps)
    whole = [int(np.rint(w * scale)) for _, _, w in taps]
    top = max(range(len(taps)), key=lambda k: (taps[k][2], -abs(2 * k - len(taps) + 1)))
    whole[top] += 65536 - sum(whole)
    return [(dy, dx, k) for (dy, dx, _), k in zip(taps, whole) if k]
