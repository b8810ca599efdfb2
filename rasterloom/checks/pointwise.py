"""Queries and SQL checks: per-pixel, per-line and random-tile operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.checks import constants, sql
from rasterloom.model import frames_of, is_scanlines, to_pixels, value_bands
from rasterloom.operators import lines, pixelwise, tiles
from rasterloom.sources.vectors import grey, scanlines_from_vectors


def out(df: DataFrame) -> DataFrame:
    """The result columns every raster query returns."""
    px = to_pixels(df)
    bands = value_bands(px) + (["a"] if "a" in px.columns else [])
    return px.select("frame_id", "y", "x", *bands)


def colour(spark: SparkSession, d: str) -> DataFrame:
    return scanlines_from_vectors(spark, d)


def on_colour(op, **params):
    return lambda spark, d: out(op(colour(spark, d), **params))


def on_pixels(op, **params):
    return lambda spark, d: out(op(to_pixels(colour(spark, d)), **params))


def on_alpha(op, **params):
    return lambda spark, d: out(op(scanlines_from_vectors(spark, d, alpha=True), **params))


def on_grey(op, **params):
    return lambda spark, d: out(op(grey(colour(spark, d)), **params))


SEED = 42


def queries() -> dict:
    q = {
        "p1_saturation_fixed": on_colour(pixelwise.saturation, mode="fixed", value=0.5),
        "p1_saturation_muted": on_colour(pixelwise.saturation, mode="fixed", value=-0.6),
        "p2_saturation_random": on_colour(
            pixelwise.saturation, mode="random", range=[-0.5, 0.8], seed=7
        ),
        "p3_noise_gaussian": on_alpha(pixelwise.noise, mode="gaussian", amount=0.1, seed=SEED),
        "p4_salt_pepper": on_pixels(
            pixelwise.salt_pepper, amount=0.05, salt_vs_pepper=0.4, seed=SEED
        ),
        "p4_salt_pepper_lines": on_colour(
            pixelwise.salt_pepper, amount=0.3, salt_vs_pepper=0.5, seed=11
        ),
        "p5_gamma": on_pixels(pixelwise.gamma_map, gamma=1.8),
        "p6_to_grey": on_colour(pixelwise.convert, mode="L"),
        "p6_grey_to_rgb": on_grey(pixelwise.convert, mode="RGB"),
        "p6_drop_alpha": on_alpha(pixelwise.convert, mode="RGB"),
        "l1_noise_row": on_pixels(pixelwise.noise, mode="row", amount=0.2, seed=SEED),
        "l1_noise_row_lines": on_colour(pixelwise.noise, mode="row", amount=0.2, seed=SEED),
        "l2_noise_column": on_grey(pixelwise.noise, mode="column", amount=0.2, seed=SEED),
        "l1_noise_row_ordered": on_colour(pixelwise.noise, mode="row", amount=0.2, seed=SEED, ordered=True),
        "l2_noise_column_ordered": on_alpha(pixelwise.noise, mode="column", amount=0.2, seed=SEED, ordered=True),
        "l7_gaps_mean_ordered": on_alpha(
            lines.slc_off, gap_width=0.3, scan_period=7, fill_mode="mean", seed=SEED, ordered=True
        ),
        "t0_tiles_ordered": lambda spark, d: tiles.tile_table(
            frames_of(colour(spark, d)), 12, (0.05, 0.4), SEED, ordered=True
        ),
        "l3_corduroy_vertical": on_colour(
            lines.corduroy, strength=0.8, orientation="vertical", density=0.3, seed=SEED
        ),
        "l4_corduroy_horizontal": on_colour(
            lines.corduroy, strength=1.0, orientation="horizontal", density=0.8, seed=200
        ),
        "l5_gap_mask": gap_mask,
        "l6_gaps_black": on_colour(lines.slc_off, gap_width=0.22, scan_period=14),
        "l6_gaps_white": lambda spark, d: out(
            lines.slc_off(
                to_pixels(colour(spark, d)), gap_width=0.5, scan_period=8, fill_mode="white"
            )
        ),
        "l7_gaps_mean": on_alpha(
            lines.slc_off, gap_width=0.3, scan_period=7, fill_mode="mean", seed=SEED
        ),
        "t0_tiles": lambda spark, d: tiles.tile_table(
            frames_of(colour(spark, d)), 12, (0.05, 0.4), SEED
        ),
        "t1_band_swap_bgr": on_colour(
            tiles.band_swap, tile_count=15, permutation="BGR", tile_size_range=(0.1, 0.5), seed=SEED
        ),
        "t1_band_swap_gbr": on_alpha(
            tiles.band_swap, tile_count=9, permutation="GBR", tile_size_range=(0.2, 0.6), seed=3
        ),
        "t2_corrupt_xor": on_colour(
            tiles.buffer_corruption,
            tile_count=10, corruption_type="xor", severity=0.7, tile_size_range=(0.1, 0.5), seed=100,
        ),
        "t3_corrupt_invert": on_colour(
            tiles.buffer_corruption,
            tile_count=10, corruption_type="invert", severity=0.6, tile_size_range=(0.1, 0.6), seed=5,
        ),
        "t4_corrupt_shuffle": on_colour(
            tiles.buffer_corruption,
            tile_count=10, corruption_type="channel_shuffle", severity=0.8,
            tile_size_range=(0.1, 0.5), seed=100,
        ),
    }
    for kind in ("xor", "invert", "channel_shuffle"):
        q[f"t5_grid_{kind}"] = on_colour(
            tiles.buffer_corruption_grid,
            tile_size=12, severity=0.4, magnitude=99, corruption_type=kind, seed=SEED,
        )
    return q


def gap_mask(spark: SparkSession, d: str) -> DataFrame:
    bounds = lines.with_gaps(colour(spark, d).select("frame_id", "height", "width", "y"), 0.22, 14)
    return bounds.where("gap_from < gap_to").select(
        "frame_id", "y", F.col("gap_from").cast("int"), F.col("gap_to").cast("int")
    )


def _px(select: str, ctes: str = "") -> str:
    return f"WITH {sql.PX}{',' + ctes if ctes else ''}\nSELECT frame_id, y, x, {select} FROM px"


def _per_band(template: str) -> str:
    """`{b}` is the band name, `{i}` its number."""
    return ", ".join(template.format(b=b, i=i) + f" AS {b}" for i, b in enumerate("rgb"))


def _saturation(factor: str) -> str:
    s = "((greatest(r,g,b)-least(r,g,b))::DOUBLE/greatest(r,g,b)::DOUBLE)"
    move = (
        "CASE WHEN greatest(r,g,b)=least(r,g,b) THEN {b} ELSE "
        f"trunc(greatest(r,g,b)-(greatest(r,g,b)-{{b}})*(least(1.0::DOUBLE,{s}*({factor}))/{s}))::INT END"
    )
    return _px(_per_band(move))


def _noise(shift: str, bands: str) -> str:
    return ", ".join(
        f"trunc(greatest(0.0::DOUBLE,least(255.0::DOUBLE,{b}+{shift.format(i=i)})))::INT AS {n}"
        for i, (b, n) in enumerate(zip(bands, "v" if len(bands) == 1 else bands))
    )


def _normal(seed: int, label: str) -> str:
    u1 = f"(({sql.state(seed, label, 'y', 'x', '{i}', 0)}+1)::DOUBLE/2147483647.0::DOUBLE)"
    u2 = sql.uniform(seed, label, "y", "x", "{i}", 1)
    return f"(sqrt(-2.0::DOUBLE*ln({u1}))*cos(6.283185307179586::DOUBLE*{u2}))"


def _stripes(side: str, line: str, density: float, strength: float, seed: int) -> str:
    col = {"w": "width", "h": "height"}[side]
    lo, hi = 1.0 - 0.2 * strength, 2.0 * 0.2 * strength
    return f"""
WITH {sql.PX},
cand AS (SELECT s, n, unnest(range(s))::INT AS line FROM
  (SELECT DISTINCT {side} AS s, trunc({density}::DOUBLE*{side})::INT AS n FROM fr)),
picked AS (
  SELECT s, line, floor(({lo!r}::DOUBLE+{sql.uniform(seed, 'stripe_gain', 'line')}*{hi!r}::DOUBLE)*65536.0::DOUBLE) AS gain
  FROM cand
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY {sql.state(seed, 'stripe_pick', 'line')}, line) <= n)
SELECT frame_id, y, x, {_per_band("CASE WHEN gain IS NULL THEN {b} ELSE least(255, round_even({b}*gain/65536.0::DOUBLE,0))::INT END")}
FROM px LEFT JOIN picked ON s={side} AND line={line}  -- {col}
"""


def _gap_ctes(gap: float, period: int) -> str:
    """Row-by-row mask: bands are counted by listing them."""
    width = f"(abs({{y}}-h//2)/(h/2.0::DOUBLE)*{gap}::DOUBLE*w)"
    return f"""
rows AS (SELECT frame_id, h, w, unnest(range(h))::INT AS y FROM fr),
starts AS (
  SELECT frame_id, y AS y0,
    row_number() OVER (PARTITION BY frame_id ORDER BY y)-1 AS nth
  FROM rows WHERE y%{period}=0 AND trunc({width.format(y='y')})>0),
gaps AS (
  SELECT r.frame_id, r.y, r.w,
    w//2+trunc((0.3::DOUBLE*(y-y0))*(CASE WHEN nth%2=0 THEN 1 ELSE -1 END))::INT AS mid,
    trunc({width.format(y='y')})::INT//2 AS half
  FROM rows r JOIN starts s ON s.frame_id=r.frame_id AND s.y0=r.y-r.y%{period}),
mask AS MATERIALIZED (
  SELECT frame_id, y, greatest(0,mid-half)::INT AS gap_from, least(w,mid+half)::INT AS gap_to
  FROM gaps WHERE half>0)"""


def _gap_fill(gap: float, period: int, fill: str) -> str:
    return f"""
WITH {sql.PX}, {_gap_ctes(gap, period)}
SELECT px.frame_id, px.y, x, {_per_band("CASE WHEN x>=gap_from AND x<gap_to THEN " + fill + " ELSE {b} END")}
FROM px LEFT JOIN mask ON mask.frame_id=px.frame_id AND mask.y=px.y"""


def _gap_mean(gap: float, period: int, seed: int) -> str:
    means = ", ".join(
        f"sum(CASE WHEN gap_from IS NULL OR x<gap_from OR x>=gap_to THEN {b} END)::BIGINT"
        f"//count(CASE WHEN gap_from IS NULL OR x<gap_from OR x>=gap_to THEN 1 END) AS m{b}"
        for b in "rgb"
    )
    fill = ", ".join(
        f"CASE WHEN x>=gap_from AND x<gap_to THEN greatest(0,least(255,m{b}+"
        f"{sql.uniform_int(seed, 'gap_fill', -5, 6, 'j.y', i)}))::INT ELSE {b} END AS {b}"
        for i, b in enumerate("rgb")
    )
    return f"""
WITH {sql.PX}, {_gap_ctes(gap, period)},
j AS (SELECT px.*, gap_from, gap_to FROM px
  LEFT JOIN mask ON mask.frame_id=px.frame_id AND mask.y=px.y),
m AS (SELECT frame_id, y, {means} FROM j GROUP BY frame_id, y)
SELECT j.frame_id, j.y, x, {fill}, a FROM j JOIN m ON m.frame_id=j.frame_id AND m.y=j.y"""


def _rows(values) -> str:
    return ", ".join(f"({', '.join(str(v) for v in row)})" for row in values)


def _ordered_noise(seed: int, amount: float, key: str, more: str = "") -> str:
    """All draws of a line of 64 by 3, in the order of one generator."""
    drawn = np.random.default_rng(seed).uniform(-amount, amount, (64, 3))
    listed = _rows((i, *(f"{v!r}::DOUBLE" for v in row)) for i, row in enumerate(drawn.tolist()))
    bands = ", ".join(
        f"trunc(greatest(0.0::DOUBLE,least(1.0::DOUBLE,({b}::FLOAT/255::FLOAT)::DOUBLE+d{b}))*255.0::DOUBLE)::INT AS {b}"
        for b in "rgb"
    )
    return f"WITH {sql.PX}, d(k, dr, dg, db) AS (VALUES {listed}) SELECT frame_id, y, x, {bands}{more} FROM px JOIN d ON d.k = px.{key}"


def _ordered_gap_mean(gap: float, period: int, seed: int) -> str:
    """Lines with a gap take draws one after another; which those are follows from the height."""
    rng = np.random.default_rng(seed)
    listed = _rows((i, *(int(v) for v in rng.integers(-5, 6, size=3, dtype=np.int16))) for i in range(64))
    means = ", ".join(
        f"sum(CASE WHEN gap_from IS NULL OR x<gap_from OR x>=gap_to THEN {b} END)::BIGINT"
        f"//count(CASE WHEN gap_from IS NULL OR x<gap_from OR x>=gap_to THEN 1 END) AS m{b}"
        for b in "rgb"
    )
    fill = ", ".join(
        f"CASE WHEN x>=gap_from AND x<gap_to THEN greatest(0,least(255,m{b}+d{b}))::INT ELSE {b} END AS {b}" for b in "rgb"
    )
    return f"""
WITH {sql.PX}, {_gap_ctes(gap, period)}, d(k, dr, dg, db) AS (VALUES {listed}),
nth AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y)-1 AS k FROM mask WHERE gap_from<gap_to),
j AS (SELECT px.*, gap_from, gap_to, dr, dg, db FROM px
  LEFT JOIN nth ON nth.frame_id=px.frame_id AND nth.y=px.y LEFT JOIN d ON d.k=nth.k),
m AS (SELECT frame_id, y, {means} FROM j GROUP BY frame_id, y)
SELECT j.frame_id, j.y, x, {fill}, a FROM j JOIN m ON m.frame_id=j.frame_id AND m.y=j.y"""


def _ordered_tiles(count: int, lo: float, hi: float, seed: int) -> str:
    """Tiles of every height up to 64, each height with a generator of its own."""
    rows = []
    for height in range(1, 65):
        rng = np.random.default_rng(seed)
        for i in range(count):
            share = rng.uniform(lo, hi)
            th, tw = max(1, int(height * share)), max(1, int(64 * share))
            y0, x0 = (int(rng.integers(0, side - part + 1)) for side, part in ((height, th), (64, tw)))
            rows.append((height, 64, i, y0, x0, th, tw))
    return f"""
WITH {sql.PX}, t(height, width, i, y0, x0, th, tw) AS (VALUES {_rows(rows)})
SELECT t.* FROM t JOIN (SELECT DISTINCT h, w FROM fr) f ON f.h=t.height AND f.w=t.width"""


def tile_cte(count: int, lo: float, hi: float, seed: int) -> str:
    share = f"({lo!r}::DOUBLE+{sql.uniform(seed, 'tile_size', 'i')}*{hi - lo!r}::DOUBLE)"
    return f"""
sized AS (
  SELECT h, w, i, greatest(1,trunc(h*{share}))::INT AS th, greatest(1,trunc(w*{share}))::INT AS tw
  FROM (SELECT h, w, unnest(range({count}))::INT AS i FROM (SELECT DISTINCT h, w FROM fr))),
tiles AS MATERIALIZED (
  SELECT h, w, i, th, tw,
    {sql.uniform_int(seed, 'tile_y', 0, 'greatest(1,h-th+1)', 'i')}::INT AS y0,
    {sql.uniform_int(seed, 'tile_x', 0, 'greatest(1,w-tw+1)', 'i')}::INT AS x0
  FROM sized)"""


IN_TILE = "t.h=px.h AND t.w=px.w AND y>=y0 AND y<y0+th AND x>=x0 AND x<x0+tw"
COVER = f"""
cover AS (SELECT frame_id, y, x, count(*) AS k FROM px JOIN tiles t ON {IN_TILE} GROUP BY ALL)"""


def _band_swap(count, lo, hi, seed, order, alpha=False) -> str:
    """The same permutation k times over: walk the band index k times (order 2 or 3)."""
    names = "rgb"

    def walked(c: int) -> str:
        arms = []
        for k in range(6):
            source = c
            for _ in range(k):
                source = order[source]
            arms.append(f"WHEN {k} THEN {names[source]}")
        return f"CASE coalesce(k,0)%6 {' '.join(arms)} END AS {names[c]}"

    return f"""
WITH {sql.PX}, {tile_cte(count, lo, hi, seed)}, {COVER}
SELECT px.frame_id, px.y, px.x, {', '.join(walked(c) for c in range(3))}{', a' if alpha else ''}
FROM px LEFT JOIN cover c ON c.frame_id=px.frame_id AND c.y=px.y AND c.x=px.x"""


def _xor(count, lo, hi, seed, severity) -> str:
    most = int(255 * severity)
    masks = ", ".join(
        f"bit_xor({sql.uniform_int(seed, 'xor', 0, most + 1, 'y', c, 'i', 'x')}::INT) AS m{b}"
        for c, b in enumerate("rgb")
    )
    return f"""
WITH {sql.PX}, {tile_cte(count, lo, hi, seed)},
m AS (SELECT frame_id, y, x, {masks} FROM px JOIN tiles t ON {IN_TILE} GROUP BY frame_id, y, x)
SELECT px.frame_id, px.y, px.x, {_per_band("xor({b},coalesce(m{b},0))::INT")}
FROM px LEFT JOIN m ON m.frame_id=px.frame_id AND m.y=px.y AND m.x=px.x"""


def _invert(count, lo, hi, seed, severity) -> str:
    keep = 1.0 - severity
    return f"""
WITH RECURSIVE {sql.PX}, {tile_cte(count, lo, hi, seed)}, {COVER},
j AS (SELECT px.*, coalesce(k,0) AS k FROM px
  LEFT JOIN cover c ON c.frame_id=px.frame_id AND c.y=px.y AND c.x=px.x),
steps AS (
  SELECT frame_id, y, x, r, g, b, k FROM j
  UNION ALL
  SELECT frame_id, y, x, {_per_band(f"trunc({{b}}*{keep!r}::DOUBLE+(255-{{b}})*{severity!r}::DOUBLE)::INT")}, k-1
  FROM steps WHERE k>0)
SELECT frame_id, y, x, r, g, b FROM steps WHERE k=0"""


def _shuffle(count, lo, hi, seed, severity) -> str:
    """Follow each output band back through the covering tiles, last tile first."""
    orders = constants.ORDERS
    table = "[" + ",".join("[" + ",".join(map(str, o)) + "]" for o in orders) + "]"
    pick = (
        f"CASE WHEN {sql.uniform(seed, 'tile_happens', 'i')}<{severity!r}::DOUBLE "
        f"THEN {sql.uniform_int(seed, 'tile_order', 0, 6, 'i')} ELSE 0 END"
    )
    final = ", ".join(f"[r,g,b][s{c}+1] AS {b}" for c, b in enumerate("rgb"))
    return f"""
WITH RECURSIVE {sql.PX}, {tile_cte(count, lo, hi, seed)},
hits AS (SELECT frame_id, y, x, list({pick} ORDER BY i DESC) AS o
  FROM px JOIN tiles t ON {IN_TILE} GROUP BY frame_id, y, x),
j AS (SELECT px.*, coalesce(o, []) AS o FROM px
  LEFT JOIN hits c ON c.frame_id=px.frame_id AND c.y=px.y AND c.x=px.x),
steps AS (
  SELECT frame_id, y, x, r, g, b, o, 1 AS n, 0 AS s0, 1 AS s1, 2 AS s2 FROM j
  UNION ALL
  SELECT frame_id, y, x, r, g, b, o, n+1, {table}[o[n]+1][s0+1], {table}[o[n]+1][s1+1], {table}[o[n]+1][s2+1]
  FROM steps WHERE n<=len(o))
SELECT frame_id, y, x, {final} FROM steps WHERE n=len(o)+1"""


def _grid(kind: str, size: int, severity: float, magnitude: int, seed: int) -> str:
    orders = constants.ORDERS
    if kind == "xor":
        change = f"xor({{b}},(({sql.state(seed, 'grid_value', 'y', 'x')}>>23)%{magnitude + 1})::INT)::INT"
    elif kind == "invert":
        change = "255-{b}"
    else:
        n = sql.uniform_int(seed, "grid_value", 0, 6, "y", "x")
        arms = " ".join(
            f"WHEN {k} THEN [r,g,b][{{i}}+1]" if o == (0, 1, 2) else
            f"WHEN {k} THEN CASE {{i}} WHEN 0 THEN {'rgb'[o[0]]} WHEN 1 THEN {'rgb'[o[1]]} ELSE {'rgb'[o[2]]} END"
            for k, o in enumerate(orders)
        )
        change = f"CASE {n} {arms} END"
    return f"""
WITH {sql.PX},
cells AS (SELECT h, w, ty, unnest(range(ceil(w/{size}.0)::INT)) AS tx FROM
  (SELECT h, w, unnest(range(ceil(h/{size}.0)::INT)) AS ty FROM (SELECT DISTINCT h, w FROM fr))),
active AS (SELECT h, w, ty, tx FROM cells
  QUALIFY row_number() OVER (PARTITION BY h, w ORDER BY {sql.state(seed, 'grid_pick', 'ty', 'tx')}, ty, tx)
    <= trunc({severity!r}::DOUBLE*ceil(h/{size}.0)*ceil(w/{size}.0)))
SELECT frame_id, y, x, {_per_band("CASE WHEN t.ty IS NULL THEN {b} ELSE " + change + " END")}
FROM px LEFT JOIN active t ON t.h=px.h AND t.w=px.w AND t.ty=y//{size} AND t.tx=x//{size}"""


def _salt_pepper(amount: float, ratio: float, seed: int) -> str:
    return f"""
WITH {sql.PX},
draws AS (SELECT h, w, unnest(range(trunc({amount!r}::DOUBLE*h*w)::INT)) AS i
  FROM (SELECT DISTINCT h, w FROM fr)),
hits AS (
  SELECT h, w, {sql.uniform_int(seed, 'sp_y', 0, 'h', 'i')} AS y,
    {sql.uniform_int(seed, 'sp_x', 0, 'w', 'i')} AS x,
    bool_and({sql.uniform(seed, 'sp_salt', 'i')}<{ratio!r}::DOUBLE) AS salt
  FROM draws GROUP BY ALL)
SELECT frame_id, px.y, px.x, {_per_band("CASE WHEN salt IS NULL THEN {b} WHEN salt THEN 255 ELSE 0 END")}
FROM px LEFT JOIN hits t ON t.h=px.h AND t.w=px.w AND t.y=px.y AND t.x=px.x"""


def oracles() -> dict[str, str]:
    row = sql.uniform(SEED, "row", "y", "{i}")
    column = sql.uniform(SEED, "column", "x", "{i}")
    grow = "greatest(0.0::DOUBLE,1.0::DOUBLE+-0.5::DOUBLE+{u}*1.3::DOUBLE)".format(
        u=sql.uniform(7, "saturation", "frame_id&2147483647", "(frame_id>>31)%2147483629")
    )
    noise_row = _px(_noise(f"({row}*2.0::DOUBLE-1.0::DOUBLE)*{0.2 * 255.0!r}::DOUBLE", "rgb"))
    o = {
        "p1_saturation_fixed": _saturation("1.5::DOUBLE"),
        "p1_saturation_muted": _saturation("0.4::DOUBLE"),
        "p2_saturation_random": _saturation(grow),
        "p3_noise_gaussian": _px(
            _noise(_normal(SEED, "gaussian") + f"*{0.1 * 255.0!r}::DOUBLE", "rgb") + ", a"
        ),
        "p4_salt_pepper": _salt_pepper(0.05, 0.4, SEED),
        "p4_salt_pepper_lines": _salt_pepper(0.3, 0.5, 11),
        "p5_gamma": _px(_per_band("trunc(255.0::DOUBLE*pow({b}/255.0::DOUBLE,1.8::DOUBLE))::INT")),
        "p6_to_grey": _px("((r*19595+g*38470+b*7471+32768)>>16)::INT AS v"),
        "p6_grey_to_rgb": _px("r AS r, r AS g, r AS b"),
        "p6_drop_alpha": _px("r, g, b"),
        "l1_noise_row": noise_row,
        "l1_noise_row_lines": noise_row,
        "l2_noise_column": _px(
            _noise(f"({column}*2.0::DOUBLE-1.0::DOUBLE)*{0.2 * 255.0!r}::DOUBLE", "r")
        ),
        "l3_corduroy_vertical": _stripes("w", "x", 0.3, 0.8, SEED),
        "l4_corduroy_horizontal": _stripes("h", "y", 0.8, 1.0, 200),
        "l5_gap_mask": f"WITH {sql.PX}, {_gap_ctes(0.22, 14)} SELECT * FROM mask WHERE gap_from<gap_to",
        "l6_gaps_black": _gap_fill(0.22, 14, "0"),
        "l6_gaps_white": _gap_fill(0.5, 8, "255"),
        "l7_gaps_mean": _gap_mean(0.3, 7, SEED),
        "l1_noise_row_ordered": _ordered_noise(SEED, 0.2, "y"),
        "l2_noise_column_ordered": _ordered_noise(SEED, 0.2, "x", ", a"),
        "l7_gaps_mean_ordered": _ordered_gap_mean(0.3, 7, SEED),
        "t0_tiles_ordered": _ordered_tiles(12, 0.05, 0.4, SEED),
        "t0_tiles": f"WITH {sql.PX}, {tile_cte(12, 0.05, 0.4, SEED)} "
        "SELECT h AS height, w AS width, i, y0, x0, th, tw FROM tiles",
        "t1_band_swap_bgr": _band_swap(15, 0.1, 0.5, SEED, (2, 1, 0)),
        "t1_band_swap_gbr": _band_swap(9, 0.2, 0.6, 3, (1, 2, 0), alpha=True),
        "t2_corrupt_xor": _xor(10, 0.1, 0.5, 100, 0.7),
        "t3_corrupt_invert": _invert(10, 0.1, 0.6, 5, 0.6),
        "t4_corrupt_shuffle": _shuffle(10, 0.1, 0.5, 100, 0.8),
    }
    for kind in ("xor", "invert", "channel_shuffle"):
        o[f"t5_grid_{kind}"] = _grid(kind, 12, 0.4, 99, SEED)
    return o
