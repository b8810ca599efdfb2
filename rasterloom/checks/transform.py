"""Queries and SQL checks: the block transform and lossy generations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.checks import constants, sql
from rasterloom.checks.pointwise import colour, on_alpha, on_colour, on_grey, out, tile_cte
from rasterloom.operators import blocks
from rasterloom.sources.vectors import grey

TILE_ARGS = {"tile_count": 3, "quality": 6, "tile_size_range": (0.3, 0.7), "seed": 400}
SCHEDULES = ((7, 60, 20, "linear"), (7, 80, 10, "exponential"), (7, 13, 4, "exponential"))


def _ycc(df: DataFrame) -> DataFrame:
    places = F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x")
    return df.select("frame_id", "y", places, "yy", "cb", "cr").select(
        "frame_id", "y", "x", *[F.get(F.col(c), F.col("x")).alias(c) for c in ("yy", "cb", "cr")]
    )


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Every transform coefficient of the first band, one row each."""
    made = blocks.block_dct(blocks.to_blocks(grey(colour(spark, d))))
    return _coefficient_rows(made)


def quantised(spark: SparkSession, d: str) -> DataFrame:
    made = blocks.block_dct(blocks.to_blocks(grey(colour(spark, d))))
    return _coefficient_rows(blocks.quantize(made, 35, chroma=True))


def _coefficient_rows(made: DataFrame) -> DataFrame:
    rows = made.select("frame_id", F.col("by").alias("block_y"), F.posexplode("v").alias("at", "coefficient"))
    return rows.select(
        "frame_id",
        "block_y",
        F.floor(F.col("at") / 64).cast("int").alias("block_x"),
        (F.col("at") % 64).alias("place"),
        "coefficient",
    )


def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Transform, quantise, rebuild: the same result as one grey generation."""
    made = blocks.quantize(blocks.block_dct(blocks.to_blocks(grey(colour(spark, d)))), 25)
    return out(blocks.from_blocks(blocks.block_idct(made)))


def schedules(spark: SparkSession, d: str) -> DataFrame:
    """Line items counted by the quality their line number gets in three schedules."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber")
    named = [
        F.get(F.array(*[F.lit(q) for q in blocks.quality_schedule(*s)]), F.col("l_linenumber") - 1)
        .alias(f"quality_{i}")
        for i, s in enumerate(SCHEDULES)
    ]
    return (
        items.select("l_linenumber", *named)
        .groupBy("l_linenumber", *[f"quality_{i}" for i in range(len(SCHEDULES))])
        .agg(F.count("*").alias("items"))
    )


def queries() -> dict:
    return {
        "b1_compression": on_colour(blocks.compression, quality=10),
        "b1_compression_gamma_422": on_alpha(
            blocks.compression, quality=60, subsampling=1, gamma=1.4
        ),
        "b1_compression_grey": on_grey(blocks.compression, quality=20),
        "b2_to_ycbcr": lambda spark, d: _ycc(blocks.to_ycbcr(colour(spark, d))),
        "b2_and_back": lambda spark, d: out(blocks.to_rgb(blocks.to_ycbcr(colour(spark, d)))),
        "b3_chroma_420": lambda spark, d: _ycc(
            blocks.subsample_chroma(blocks.to_ycbcr(colour(spark, d)), 2)
        ),
        "b3_chroma_422": lambda spark, d: _ycc(
            blocks.subsample_chroma(blocks.to_ycbcr(colour(spark, d)), 1)
        ),
        "b4_block_dct": coefficients,
        "b5_quantize": quantised,
        "b6_block_idct": round_trip,
        "b6_skip_partial": on_colour(
            blocks.compression, quality=15, subsampling=0, partial="skip"
        ),
        "b7_quality_schedule": schedules,
        "b8_multi_compress": on_colour(
            blocks.multi_compress, iterations=4, quality_start=40, quality_end=5,
            decay="exponential",
        ),
        "b8_multi_compress_444_grey": on_grey(
            blocks.multi_compress, iterations=3, quality_start=50, quality_end=20,
            decay="linear", subsampling=0,
        ),
        "t6_compression_artifact": on_alpha(blocks.compression_artifact, **TILE_ARGS),
        "b1_compression_smooth": on_alpha(blocks.compression, quality=10, smooth=True),
        "b1_compression_smooth_422": on_colour(blocks.compression, quality=30, subsampling=1, smooth=True),
        "b8_multi_compress_smooth": on_colour(
            blocks.multi_compress, iterations=3, quality_start=40, quality_end=5, decay="linear", smooth=True
        ),
        "t6_compression_artifact_smooth": on_alpha(blocks.compression_artifact, **TILE_ARGS, smooth=True),
    }


def quantiser_values(quality: int, chroma: bool) -> str:
    """``(pos, q)`` rows of a quality's divisors, by the textbook formula in SQL."""
    base = constants.quantiser_table(chroma)
    scale = 5000.0 / quality if quality < 50 else 200.0 - 2 * quality
    rows = ",".join(f"({i},{q})" for i, q in enumerate(base))
    return (
        f"SELECT pos, greatest(1,least(255,floor((q*{scale!r}::DOUBLE+50)/100)))::BIGINT AS q "
        f"FROM (VALUES {rows}) b(pos,q)"
    )


BASIS = """
cosines AS MATERIALIZED (
  SELECT u, x, round_even(8192*sqrt((CASE WHEN u=0 THEN 1 ELSE 2 END)/8.0::DOUBLE)
    *cos((2*x+1)*u*pi()/16),0)::BIGINT AS k
  FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS x))"""


def _forward(p: str, source: str) -> str:
    """``source(frame_id, c, y, x, v)`` to ``p_dct(frame_id, c, bv, bx, u, w, k)``."""
    return f"""
{p}_r AS MATERIALIZED (
  SELECT frame_id, c, s.y, s.x//8 AS bx, t.u AS w, sum(t.k*(v-128))::BIGINT AS v
  FROM {source} s JOIN cosines t ON t.x=s.x%8 GROUP BY ALL),
{p}_dct AS MATERIALIZED (
  SELECT frame_id, c, s.y//8 AS bv, bx, t.u, s.w, ((sum(t.k*v)::BIGINT+4096)>>13) AS k
  FROM {p}_r s JOIN cosines t ON t.x=s.y%8 GROUP BY ALL)"""


def _levels(p: str, quality: int, both: bool, tables: str | None = None) -> str:
    """Coefficients to multiples of their divisors."""
    chroma = f" UNION ALL SELECT 1, * FROM ({quantiser_values(quality, True)})" if both else ""
    divisors = tables or f"SELECT 0 AS kind, * FROM ({quantiser_values(quality, False)}){chroma}"
    return f"""
{p}_q AS ({divisors}),
{p}_lv AS MATERIALIZED (
  SELECT frame_id, c, bv, bx, u, w, sign(k)*((abs(k)+q*4096)//(q*8192))*q AS k
  FROM {p}_dct d JOIN {p}_q t ON t.pos=d.u*8+d.w AND t.kind=least(d.c,1))"""


def _inverse(p: str) -> str:
    return f"""
{p}_ir AS MATERIALIZED (
  SELECT frame_id, c, bv, bx, s.u, t.x, sum(t.k*s.k)::BIGINT AS v
  FROM {p}_lv s JOIN cosines t ON t.u=s.w GROUP BY ALL),
{p}_pl AS MATERIALIZED (
  SELECT frame_id, c, bv*8+t.x AS y, bx*8+s.x AS x,
    greatest(0,least(255,((sum(t.k*v)::BIGINT+33554432)>>26)+128)) AS v
  FROM {p}_ir s JOIN cosines t ON t.u=s.u GROUP BY ALL)"""


def _enlarged(p: str, source: str, size: str, cell: tuple[int, int]) -> str:
    """Chroma at every pixel: three parts of its cell and one of the cell it is nearest to, each way."""
    near = "greatest(0,least(({side}+1)//2-1,{at}//2+CASE WHEN {at}%2=1 THEN 1 ELSE -1 END))"
    if cell[0] == 2:
        i, i2 = "s.y//2", near.format(side="z.h", at="s.y")
        value = "(3*(3*a.v+b.v)+(3*d.v+e.v)+CASE WHEN s.x%2=1 THEN 7 ELSE 8 END)>>4"
    else:
        i, i2 = "s.y", "s.y"
        value = "(3*a.v+d.v+CASE WHEN s.x%2=1 THEN 2 ELSE 1 END)>>2"

    def beside(name: str, row: str, column: str) -> str:
        return f"JOIN {p}_pl {name} ON {name}.c=s.c AND {name}.frame_id=s.frame_id AND {name}.y=s.{row} AND {name}.x=s.{column}"

    return f"""
{p}_near AS MATERIALIZED (
  SELECT s.frame_id, s.y, s.x, c, {i} AS i, {i2} AS i2, s.x//2 AS j, {near.format(side="z.w", at="s.x")} AS j2
  FROM {source} s JOIN {size} z ON z.frame_id=s.frame_id, (VALUES (1),(2)) v(c)),
{p}_up AS MATERIALIZED (
  SELECT s.frame_id, s.c, s.y, s.x, {value} AS v FROM {p}_near s
  {beside('a', 'i', 'j')} {beside('b', 'i2', 'j')} {beside('d', 'i', 'j2')} {beside('e', 'i2', 'j2')}),"""


def generation(
    p: str, source: str, size: str, quality: int, cell: tuple[int, int], smooth: bool = False
) -> str:
    """One colour generation of ``source(frame_id, y, x, r, g, b)`` as ``p_out`` (same columns)."""
    tall, broad = cell
    chroma, (tall_out, broad_out) = (f"{p}_up", (1, 1)) if smooth else (f"{p}_pl", cell)
    return f"""
{p}_pad AS MATERIALIZED (
  SELECT g.frame_id, g.y, g.x, s.r, s.g, s.b FROM (
    SELECT frame_id, y, unnest(range((w+15)//16*16)) AS x, h, w FROM (
      SELECT frame_id, h, w, unnest(range((h+15)//16*16)) AS y FROM {size})) g
  JOIN {source} s ON s.frame_id=g.frame_id AND s.y=least(g.y,g.h-1) AND s.x=least(g.x,g.w-1)),
{p}_ycc AS MATERIALIZED (
  SELECT frame_id, y, x, (19595*r+38470*g+7471*b+32768)>>16 AS yy,
    (-11059*r-21709*g+32768*b+8421375)>>16 AS cb, (32768*r-27439*g-5329*b+8421375)>>16 AS cr
  FROM {p}_pad),
{p}_in AS MATERIALIZED (
  SELECT frame_id, 0 AS c, y, x, yy AS v FROM {p}_ycc
  UNION ALL SELECT frame_id, 1, y//{tall}, x//{broad}, (sum(cb)::BIGINT+{tall * broad // 2})//{tall * broad} FROM {p}_ycc GROUP BY ALL
  UNION ALL SELECT frame_id, 2, y//{tall}, x//{broad}, (sum(cr)::BIGINT+{tall * broad // 2})//{tall * broad} FROM {p}_ycc GROUP BY ALL),
{_forward(p, f'{p}_in')},{_levels(p, quality, True)},{_inverse(p)},{_enlarged(p, source, size, cell) if smooth else ""}
{p}_out AS MATERIALIZED (
  SELECT s.frame_id, s.y, s.x,
    greatest(0,least(255,yy.v+((91881*(cr.v-128)+32768)>>16)))::INT AS r,
    greatest(0,least(255,yy.v-((22554*(cb.v-128)+46802*(cr.v-128)+32768)>>16)))::INT AS g,
    greatest(0,least(255,yy.v+((116130*(cb.v-128)+32768)>>16)))::INT AS b
  FROM {source} s
  JOIN {p}_pl yy ON yy.c=0 AND yy.frame_id=s.frame_id AND yy.y=s.y AND yy.x=s.x
  JOIN {chroma} cb ON cb.c=1 AND cb.frame_id=s.frame_id AND cb.y=s.y//{tall_out} AND cb.x=s.x//{broad_out}
  JOIN {chroma} cr ON cr.c=2 AND cr.frame_id=s.frame_id AND cr.y=s.y//{tall_out} AND cr.x=s.x//{broad_out})"""


def grey_generation(p: str, source: str, size: str, quality: int) -> str:
    """One grey generation of ``source(frame_id, y, x, v)`` as ``p_out``."""
    return f"""
{p}_in AS MATERIALIZED (
  SELECT g.frame_id, 0 AS c, g.y, g.x, s.v FROM (
    SELECT frame_id, y, unnest(range((w+7)//8*8)) AS x, h, w FROM (
      SELECT frame_id, h, w, unnest(range((h+7)//8*8)) AS y FROM {size})) g
  JOIN {source} s ON s.frame_id=g.frame_id AND s.y=least(g.y,g.h-1) AND s.x=least(g.x,g.w-1)),
{_forward(p, f'{p}_in')},{_levels(p, quality, False)},{_inverse(p)},
{p}_out AS MATERIALIZED (
  SELECT s.frame_id, s.y, s.x, p.v::INT AS v FROM {source} s
  JOIN {p}_pl p ON p.frame_id=s.frame_id AND p.y=s.y AND p.x=s.x)"""


def colour_chain(
    source: str, qualities: list[int], cell: tuple[int, int], size: str = "fr", smooth: bool = False
) -> tuple[str, str]:
    """CTEs of chained generations and the name of the last result."""
    parts = []
    for i, quality in enumerate(qualities):
        parts.append(generation(f"g{i}", source, size, quality, cell, smooth))
        source = f"g{i}_out"
    return ", ".join(parts), source


def _colour(qualities: list[int], cell: tuple[int, int], first: str = "r, g, b", smooth: bool = False) -> str:
    ctes, last = colour_chain("src", qualities, cell, smooth=smooth)
    return f"""
WITH {sql.PX}, {BASIS}, src AS MATERIALIZED (SELECT frame_id, y, x, {first} FROM px), {ctes}
SELECT frame_id, y, x, r, g, b FROM {last}"""


def _grey(qualities: list[int]) -> str:
    parts, source = [], "src"
    for i, quality in enumerate(qualities):
        parts.append(grey_generation(f"g{i}", source, "fr", quality))
        source = f"g{i}_out"
    return f"""
WITH {sql.PX}, {BASIS}, src AS MATERIALIZED (SELECT frame_id, y, x, r AS v FROM px), {', '.join(parts)}
SELECT frame_id, y, x, v FROM {source}"""


def _coefficients(quality: int | None) -> str:
    padded = """
src AS MATERIALIZED (SELECT frame_id, y, x, r AS v FROM px),
g_in AS MATERIALIZED (
  SELECT g.frame_id, 0 AS c, g.y, g.x, s.v FROM (
    SELECT frame_id, y, unnest(range((w+7)//8*8)) AS x, h, w FROM (
      SELECT frame_id, h, w, unnest(range((h+7)//8*8)) AS y FROM fr)) g
  JOIN src s ON s.frame_id=g.frame_id AND s.y=least(g.y,g.h-1) AND s.x=least(g.x,g.w-1))"""
    ctes, last, scale = _forward("g", "g_in"), "g_dct", 1
    if quality:
        table = f"SELECT 0 AS kind, * FROM ({quantiser_values(quality, True)})"
        ctes += "," + _levels("g", quality, False, table)
        last, scale = "g_lv", 8192
    return f"""
WITH {sql.PX}, {BASIS}, {padded}, {ctes}
SELECT frame_id, bv::INT AS block_y, bx::INT AS block_x, (u*8+w)::INT AS place, (k*{scale})::BIGINT AS coefficient FROM {last}"""


def _skip(quality: int) -> str:
    """Only whole blocks change: cut frames down to whole blocks, then put the rest back."""
    return f"""
WITH {sql.PX}, {BASIS},
cut AS MATERIALIZED (SELECT frame_id, h//8*8 AS h, w//8*8 AS w FROM fr),
src AS MATERIALIZED (SELECT p.frame_id, y, x, r, g, b FROM px p JOIN cut c ON c.frame_id=p.frame_id AND y<c.h AND x<c.w),
{generation('g0', 'src', 'cut', quality, (1, 1))}
SELECT p.frame_id, p.y, p.x, coalesce(n.r,p.r) AS r, coalesce(n.g,p.g) AS g, coalesce(n.b,p.b) AS b
FROM px p LEFT JOIN g0_out n ON n.frame_id=p.frame_id AND n.y=p.y AND n.x=p.x"""


def artifact_chain(
    source: str, count: int, quality: int, prefix: str = "", smooth: bool = False
) -> tuple[str, str]:
    """CTEs that compress the tiles of table ``tiles`` one after another."""
    parts = []
    for i in range(count):
        t = f"{prefix}t{i}"
        parts.append(f"""
{t}_at AS MATERIALIZED (SELECT frame_id, y0, x0, th AS h, tw AS w FROM fr JOIN tiles t ON t.h=fr.h AND t.w=fr.w AND i={i}),
{t}_src AS MATERIALIZED (
  SELECT s.frame_id, s.y-y0 AS y, s.x-x0 AS x, r, g, b FROM {source} s JOIN {t}_at a
  ON a.frame_id=s.frame_id AND s.y>=y0 AND s.y<y0+h AND s.x>=x0 AND s.x<x0+w),
{generation(t, f'{t}_src', f'{t}_at', quality, (2, 2), smooth)},
{t}_all AS MATERIALIZED (
  SELECT s.frame_id, s.y, s.x, coalesce(n.r,s.r) AS r, coalesce(n.g,s.g) AS g, coalesce(n.b,s.b) AS b
  FROM {source} s JOIN {t}_at a ON a.frame_id=s.frame_id
  LEFT JOIN {t}_out n ON n.frame_id=s.frame_id AND n.y=s.y-y0 AND n.x=s.x-x0)""")
        source = f"{t}_all"
    return ", ".join(parts), source


def _artifact(smooth: bool = False) -> str:
    lo, hi = TILE_ARGS["tile_size_range"]
    count, quality, seed = (TILE_ARGS[k] for k in ("tile_count", "quality", "seed"))
    ctes, last = artifact_chain("src", count, quality, smooth=smooth)
    return f"""
WITH {sql.PX}, {tile_cte(count, lo, hi, seed)}, {BASIS},
src AS MATERIALIZED (SELECT frame_id, y, x, r, g, b FROM px), {ctes}
SELECT s.*, p.a FROM {last} s JOIN px p USING (frame_id, y, x)"""


def _ycc_sql(down: int, across: int) -> str:
    n = down * across
    mean = (
        "(sum({c}) OVER cell::BIGINT+count(*) OVER cell//2)//(count(*) OVER cell)" if n > 1 else "{c}"
    )
    cb, cr = (mean.format(c=c).replace("OVER cell::BIGINT", "OVER cell") + f" AS {c}" for c in ("cb", "cr"))
    return f"""
WITH {sql.PX},
ycc AS (SELECT frame_id, y, x, ((19595*r+38470*g+7471*b+32768)>>16)::INT AS yy,
  ((-11059*r-21709*g+32768*b+8421375)>>16)::INT AS cb, ((32768*r-27439*g-5329*b+8421375)>>16)::INT AS cr FROM px),
m AS (SELECT frame_id, y, x, yy, {cb}, {cr} FROM ycc
  WINDOW cell AS (PARTITION BY frame_id, y//{down}, x//{across}))
SELECT frame_id, y, x, yy, cb::INT AS cb, cr::INT AS cr FROM m"""


def _schedule_sql() -> str:
    rows = ", ".join(
        f"({i + 1}," + ",".join(str(q) for q in qs) + ")"
        for i, qs in enumerate(zip(*(_by_hand(*s) for s in SCHEDULES)))
    )
    names = ", ".join(f"quality_{i}" for i in range(len(SCHEDULES)))
    return f"""
WITH plan(line, {names}) AS (VALUES {rows})
SELECT l_linenumber, {names}, count(*)::BIGINT AS items
FROM lineitem JOIN plan ON line=l_linenumber GROUP BY ALL"""


def _by_hand(n: int, first: int, last: int, decay: str) -> list[int]:
    """The schedule from its definition, as a geometric or arithmetic series."""
    if decay == "linear":
        return [int(first + (last - first) * (i / (n - 1))) for i in range(n)]
    return [max(1, int(first * math.exp(math.log(last / first) * (i / (n - 1))))) for i in range(n)]


def oracles() -> dict[str, str]:
    tone = ", ".join(
        f"trunc(255.0::DOUBLE*pow({b}/255.0::DOUBLE,1.4::DOUBLE))::INT AS {b}" for b in "rgb"
    )
    back = f"""
WITH {sql.PX},
ycc AS (SELECT frame_id, y, x, (19595*r+38470*g+7471*b+32768)>>16 AS yy,
  ((-11059*r-21709*g+32768*b+8421375)>>16)-128 AS cb, ((32768*r-27439*g-5329*b+8421375)>>16)-128 AS cr FROM px)
SELECT frame_id, y, x, greatest(0,least(255,yy+((91881*cr+32768)>>16)))::INT AS r,
  greatest(0,least(255,yy-((22554*cb+46802*cr+32768)>>16)))::INT AS g,
  greatest(0,least(255,yy+((116130*cb+32768)>>16)))::INT AS b FROM ycc"""
    return {
        "b1_compression": _colour([10], (2, 2)),
        "b1_compression_gamma_422": _colour([60], (1, 2), tone),
        "b1_compression_grey": _grey([20]),
        "b2_to_ycbcr": _ycc_sql(1, 1),
        "b2_and_back": back,
        "b3_chroma_420": _ycc_sql(2, 2),
        "b3_chroma_422": _ycc_sql(1, 2),
        "b4_block_dct": _coefficients(None),
        "b5_quantize": _coefficients(35),
        "b6_block_idct": _grey([25]),
        "b6_skip_partial": _skip(15),
        "b7_quality_schedule": _schedule_sql(),
        "b8_multi_compress": _colour(_by_hand(4, 40, 5, "exponential"), (2, 2)),
        "b8_multi_compress_444_grey": _grey(_by_hand(3, 50, 20, "linear")),
        "t6_compression_artifact": _artifact(),
        "b1_compression_smooth": _colour([10], (2, 2), smooth=True),
        "b1_compression_smooth_422": _colour([30], (1, 2), smooth=True),
        "b8_multi_compress_smooth": _colour(_by_hand(3, 40, 5, "linear"), (2, 2), smooth=True),
        "t6_compression_artifact_smooth": _artifact(smooth=True),
    }
