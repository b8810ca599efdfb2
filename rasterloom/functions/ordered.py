"""Draws in the order of one sequential generator, from any line on.

A seed names the stream of numpy's default generator (PCG64, seeded by its ``SeedSequence``), so a published
seed gives the published picture. Where every line takes as many outputs, its place in the stream is
reached by a jump. Where it takes as many as it happens to (normal draws, bounded integers), the
generator is walked along the lines once for a frame size, and its state at each line is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

CHUNK = 1 << 20  # values drawn at a time where they are not kept


def check(ordered: bool, seed: int | None) -> None:
    if ordered and seed is None:
        raise ValueError("ordered draws need a seed")


def generator(seed: int, skipped: int = 0) -> np.random.Generator:
    """The generator of a seed, ``skipped`` 64-bit outputs on."""
    bits = np.random.PCG64(seed)
    return np.random.Generator(bits.advance(skipped) if skipped else bits)


def at_state(state: dict) -> np.random.Generator:
    bits = np.random.PCG64(0)
    bits.state = state
    return np.random.Generator(bits)


def row_uniforms(seed: int, y: np.ndarray, each: int, lo: float, hi: float) -> np.ndarray:
    """``each`` uniform draws for each of the lines ``y``, which are numbered in the order of the stream."""
    lines, place = np.unique(y, return_inverse=True)
    starts = np.flatnonzero(np.diff(lines, prepend=-2) != 1)
    parts = [
        generator(seed, int(run[0]) * each).uniform(lo, hi, (len(run), each)) for run in np.split(lines, starts[1:])
    ]
    return np.concatenate(parts)[place]


class Walk:
    """What ``draw(rng, line)`` gives for each line, however many outputs that takes."""

    def __init__(self, seed: int, draw: Callable[[np.random.Generator, int], np.ndarray]):
        self.draw, self.rng, self.states = draw, generator(seed), []

    def value(self, line: int) -> np.ndarray:
        while len(self.states) < line:
            self._step()
        if len(self.states) == line:
            return self._step()
        return self.draw(at_state(self.states[line]), line)

    def _step(self) -> np.ndarray:
        self.states.append(self.rng.bit_generator.state)
        return self.draw(self.rng, len(self.states) - 1)

    def values(self, y: np.ndarray) -> np.ndarray:
        lines, place = np.unique(y, return_inverse=True)
        return np.stack([self.value(int(line)) for line in lines])[place]


def bounded_bytes(bits: np.random.PCG64, most: int, total: int) -> Iterator[np.ndarray]:
    """``total`` bytes of 0..``most`` (1 to 255) in chunks, as one call for an array of them draws them.

    Such a call takes the stream's 32-bit halves byte by byte, and multiplies and rejects; what it leaves
    of its last half is lost. Behind the last chunk ``bits`` stands where it would stand after the call.
    """
    state, span = bits.state, most + 1
    held = np.array([state["uinteger"]] * state["has_uint32"], "<u4").view(np.uint8)
    bits.state = state | {"has_uint32": 0, "uinteger": 0}
    while total:
        before, lead = bits.state, len(held)
        raw = np.atleast_1d(bits.random_raw(min(CHUNK, -(-total // 8)))).astype("<u8")
        data = np.concatenate([held, raw.view(np.uint8)])
        scaled = data.astype(np.uint16) * np.uint16(span)
        places = np.flatnonzero((scaled & 255) >= (255 - most) % span)[:total]
        total -= len(places)
        if not total:
            halves = -(-(int(places[-1]) + 1) // 4) - lead // 4
            bits.state = before
            if halves > 0:
                bits.advance((halves + 1) // 2)
                if halves % 2:
                    spare = int(raw.view("<u4")[halves])
                    bits.state = bits.state | {"has_uint32": 1, "uinteger": spare}
        held = held[:0]
        yield (scaled[places] >> 8).astype(np.uint8)


def byte_rows(state: dict, most: int, rows: int, each: int, first: int, last: int) -> np.ndarray:
    """Rows ``first..last-1`` of an array of ``rows`` by ``each`` bounded bytes drawn from ``state`` on."""
    bits, kept, seen = at_state(state).bit_generator, [], 0
    for part in bounded_bytes(bits, most, rows * each):
        lo, hi = max(0, first * each - seen), min(len(part), last * each - seen)
        if lo < hi:
            kept.append(part[lo:hi])
        seen += len(part)
        if seen >= last * each:
            break
    return np.concatenate(kept).reshape(last - first, each)


Tile = tuple[int, int, int, int, object]


def tiles(
    seed: int, height: int, width: int, count: int, lo: float, hi: float, after: Callable | None = None
) -> list[Tile]:
    """``(y0, x0, th, tw, extra)`` of each tile; ``after(rng, th, tw)`` draws what an operation draws in
    between and gives ``extra``."""
    rng, out = generator(seed), []
    for _ in range(count):
        share = rng.uniform(lo, hi)
        th, tw = max(1, int(height * share)), max(1, int(width * share))
        y0 = int(rng.integers(0, max(1, height - th + 1)))
        x0 = int(rng.integers(0, max(1, width - tw + 1)))
        out.append((y0, x0, th, tw, after(rng, th, tw) if after else None))
    return out


def hits(seed: int, amount: float, salt_share: float, height: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(y, x, salt)`` of all hits of a frame size, a chunk at a time: lines, columns and kinds are drawn one
    after another, so three generators go along."""
    total = int(amount * height * width)

    def chunks() -> Iterator[int]:
        return (min(CHUNK, total - first) for first in range(0, total, CHUNK))

    y, x, salt = generator(seed), generator(seed), generator(seed)
    for size in chunks():
        x.integers(0, height, size=size)
    salt.bit_generator.state = x.bit_generator.state
    for size in chunks():
        salt.integers(0, width, size=size)
    for size in chunks():
        yield y.integers(0, height, size=size), x.integers(0, width, size=size), salt.random(size) < salt_share
