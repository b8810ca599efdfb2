"""Counter-based random draws as plain column arithmetic.

A draw is a function of ``(seed, label, key...)`` and nothing else, so it does not depend on
partitioning, task retries or row order, and any SQL engine with 64-bit integers can repeat it.
Every product stays below 2**63, so the arithmetic is safe under ANSI mode. Each key is used
once in the expression, which keeps the whole draw inside one generated-code span.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Two primes below 2**31, odd multipliers below 2**31, xor masks below 2**31.
P1, P2 = 2147483647, 2147483629
A1, A2 = 1103515245, 1220703125
B1 = 1597334677
X1, X2 = 1540483477, 625341585


def start(seed: int, label: str) -> int:
    """31-bit starting state for one named stream of draws."""
    digest = hashlib.md5(f"{seed}:{label}".encode()).hexdigest()
    return int(digest[:8], 16) & 0x7FFFFFFF


def fresh_seed(seed: int | None) -> int:
    """The caller's seed, or a new one for unseeded use."""
    return secrets.randbelow(1 << 31) if seed is None else int(seed)


# Keys that make unseeded draws differ from frame to frame: the frame id's low and high bits.
FRAME_KEYS = ("frame_id & 2147483647", f"shiftrightunsigned(frame_id, 31) % {P2}L")


def frame_keys(seed: int | None) -> list[str]:
    """Extra keys for draws without a seed."""
    return [] if seed is not None else list(FRAME_KEYS)


def _mix(h: str, key: str) -> str:
    h = f"(((({h}) + cast({key} as bigint)) * {A1}L) % {P1}L)"
    return f"((({h} ^ {X1}L) * {B1}L) % {P2}L)"


def _last(h: str) -> str:
    return f"((({h} ^ {X2}L) * {A2}L) % {P1}L)"


def _state_text(seed: int, label: str, *keys: str | int) -> str:
    h = f"{start(seed, label)}L"
    for key in keys:
        h = _mix(h, str(key))
    return _last(h)


def state(seed: int, label: str, *keys: str | int) -> Column:
    """Integer draw in ``[0, P1)``.

    Keys are integers, column names or SQL expressions, not negative and below 2**31. The draw is
    one parsed expression, which keeps long plans quick to build.
    """
    return F.expr(_state_text(seed, label, *keys))


def uniform(seed: int, label: str, *keys: str | int) -> Column:
    """Uniform double in ``[0, 1)``."""
    return F.expr(f"{_state_text(seed, label, *keys)} / {P1}.0D")


def uniform_int(seed: int, label: str, lo: str | int, hi: str | int, *keys: str | int) -> Column:
    """Uniform integer in ``[lo, hi)``."""
    u = f"({_state_text(seed, label, *keys)} / {P1}.0D)"
    return F.expr(f"cast(({lo}) + floor({u} * (({hi}) - ({lo}))) as int)")


def normal(seed: int, label: str, *keys: str | int) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    u1 = f"(({_state_text(seed, label, *keys, 0)} + 1) / {P1}.0D)"
    u2 = f"({_state_text(seed, label, *keys, 1)} / {P1}.0D)"
    return F.expr(f"sqrt(-2.0D * ln({u1})) * cos(6.283185307179586D * {u2})")


def prefix(seed: int, label: str, *keys: str | int) -> Column:
    """The part of a draw that many draws share; :func:`finish` adds the last key."""
    h = f"{start(seed, label)}L"
    for key in keys:
        h = _mix(h, str(key))
    return F.expr(h)


def extend(shared: Column, key: Column) -> Column:
    """A shared part with one more key, such as a lambda variable."""
    h = ((shared + key.cast("long")) * F.lit(A1)) % F.lit(P1)
    return (h.bitwiseXOR(F.lit(X1).cast("long")) * F.lit(B1)) % F.lit(P2)


def finish(shared: Column, key: Column) -> Column:
    """Uniform double in ``[0, 1)`` from a shared part and its last key."""
    h = extend(shared, key).bitwiseXOR(F.lit(X2).cast("long"))
    return (h * F.lit(A2)) % F.lit(P1) / F.lit(float(P1))


def state_value(seed: int, label: str, *keys: int) -> int:
    """The same draw as :func:`state`, as a Python integer."""
    h = start(seed, label)
    for key in keys:
        h = ((h + key) * A1) % P1
        h = ((h ^ X1) * B1) % P2
    return ((h ^ X2) * A2) % P1


def uniform_value(seed: int, label: str, *keys: int) -> float:
    """The same draw as :func:`uniform`, as a Python float."""
    return state_value(seed, label, *keys) / float(P1)


# --- the same draws for arrays of keys -----------------------------------------------------


def key_arrays(seed: int | None, frame_id: np.ndarray) -> list[np.ndarray]:
    """:func:`frame_keys` of an array of frame ids."""
    if seed is not None:
        return []
    frame_id = np.asarray(frame_id, np.int64)
    high = (frame_id.view(np.uint64) >> np.uint64(31)).astype(np.int64) % P2
    return [frame_id & 2147483647, high]


def state_array(seed: int, label: str, *keys) -> np.ndarray:
    """:func:`state` for integer arrays that broadcast against each other."""
    h = np.int64(start(seed, label))
    for key in keys:
        h = ((h + np.asarray(key, np.int64)) * A1) % P1
        h = ((h ^ X1) * B1) % P2
    return ((h ^ X2) * A2) % P1


def uniform_array(seed: int, label: str, *keys) -> np.ndarray:
    return state_array(seed, label, *keys) / float(P1)


def uniform_int_array(seed: int, label: str, lo: int, hi: int, *keys) -> np.ndarray:
    return lo + np.floor(uniform_array(seed, label, *keys) * (hi - lo)).astype(np.int64)


def normal_array(seed: int, label: str, *keys) -> np.ndarray:
    u1 = (state_array(seed, label, *keys, 0) + 1) / float(P1)
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(6.283185307179586 * uniform_array(seed, label, *keys, 1))
