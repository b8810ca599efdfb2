"""Pieces of SQL shared by the independent checks (DuckDB dialect)."""

from __future__ import annotations

from rasterloom.checks import constants

# Every pixel of the raster, its frame size, and the lines' size table.
PX = """
px0 AS (
  SELECT vec_id // 64 AS frame_id, (vec_id % 64)::INT AS y, x::INT AS x,
    greatest(0,least(255,floor((embedding[x+1]::DOUBLE+0.4::DOUBLE)*320)))::INT AS r,
    greatest(0,least(255,floor((embedding[(x+21)%64+1]::DOUBLE+0.4::DOUBLE)*320)))::INT AS g,
    greatest(0,least(255,floor((embedding[(x+42)%64+1]::DOUBLE+0.4::DOUBLE)*320)))::INT AS b
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS x FROM embeddings)
),
fr AS MATERIALIZED (
  SELECT frame_id, (max(y)+1)::INT AS h, (max(x)+1)::INT AS w FROM px0 GROUP BY frame_id
),
px AS MATERIALIZED (
  SELECT p.*, ((x*4+y) % 256)::INT AS a, f.h, f.w FROM px0 p JOIN fr f USING (frame_id)
)"""

# The same in long form, one row per pixel and channel (0, 1, 2).
CH = """
ch AS MATERIALIZED (
  SELECT frame_id, h, w, y, x, 0 AS c, r AS v FROM px
  UNION ALL SELECT frame_id, h, w, y, x, 1, g FROM px
  UNION ALL SELECT frame_id, h, w, y, x, 2, b FROM px
)"""

# Long form `res(frame_id, y, x, c, v)` back to one row per pixel.
WIDE = """
SELECT frame_id, y::INT AS y, x::INT AS x,
  max(CASE WHEN c=0 THEN v END)::INT AS r,
  max(CASE WHEN c=1 THEN v END)::INT AS g,
  max(CASE WHEN c=2 THEN v END)::INT AS b
FROM res GROUP BY frame_id, y, x"""


def state(seed: int, label: str, *keys) -> str:
    """SQL for one integer draw."""
    (p, q), (a, b, c), (x, z) = constants.MODULI, constants.MULTIPLIERS, constants.MASKS
    h = f"{constants.stream_start(seed, label)}::BIGINT"
    for key in keys:
        h = f"((({h})+({key})::BIGINT)*{a})%{p}"
        h = f"(xor({h},{x}::BIGINT)*{b})%{q}"
    return f"((xor({h},{z}::BIGINT)*{c})%{p})"


def uniform(seed: int, label: str, *keys) -> str:
    return f"({state(seed, label, *keys)}::DOUBLE/{constants.MODULI[0]}.0::DOUBLE)"


def uniform_int(seed: int, label: str, lo, hi, *keys) -> str:
    return f"(({lo})+floor({uniform(seed, label, *keys)}*(({hi})-({lo})))::INT)"


def fold(i: str, n: str) -> str:
    """Mirror index ``i`` into ``0..n-1`` with the edge element repeated."""
    m = f"((({i})%(2*{n})+2*{n})%(2*{n}))"
    return f"(CASE WHEN {m}<{n} THEN {m} ELSE 2*{n}-1-{m} END)"
