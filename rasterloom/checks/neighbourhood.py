"""Queries and SQL checks: stencils and resampling."""

from __future__ import annotations


from rasterloom.checks import constants, sql
from rasterloom.checks.pointwise import on_alpha, on_colour, on_grey
from rasterloom.operators import resample, stencils

BOX3 = [(dy, dx, w) for dy, row in enumerate(((1, 2, 1), (2, 4, 2), (1, 2, 1)), -1)
        for dx, w in enumerate(row, -1)]
METHODS = ("box", "bilinear", "bicubic", "lanczos")


def queries() -> dict:
    q = {
        "c1_blur_gaussian": on_colour(stencils.blur_gaussian, sigma=1.5),
        "c1_blur_gaussian_wide": on_grey(stencils.blur_gaussian, sigma=20.0),
        "c2_blur_circular": on_alpha(stencils.blur_circular, radius=4),
        "c3_motion_blur_odd": on_alpha(stencils.motion_blur, kernel_size=9),
        "c3_motion_blur_even": on_colour(stencils.motion_blur, kernel_size=6),
        "c4_motion_blur_angled": on_colour(stencils.motion_blur, kernel_size=7, angle=45),
        "c4_motion_blur_vertical_even": on_grey(stencils.motion_blur, kernel_size=4, angle=90),
        "c5_chromatic_aberration": on_alpha(
            stencils.chromatic_aberration, shift_x=3, shift_y=-2
        ),
        "c5_chromatic_sideways": on_colour(stencils.chromatic_aberration, shift_x=-5),
        "c7_stencil": on_colour(stencils.stencil, taps=BOX3, divisor=16),
        "r2_nearest": on_colour(
            resample.downscale, scale=0.3, upscale=False, downscale_method="nearest"
        ),
        "r8_bilinear_point": on_colour(
            resample.downscale, scale=0.37, upscale=False, downscale_method="bilinear_point"
        ),
        "r8_nearest_floor": on_colour(
            resample.downscale, scale=0.37, upscale=False, downscale_method="nearest_floor"
        ),
        "r1_downscale_default": on_colour(resample.downscale, scale=0.15),
        "r1_downscale_smooth": on_alpha(
            resample.downscale, scale=0.4, downscale_method="lanczos", upscale_method="bilinear"
        ),
    }
    for pattern in stencils.MOSAICS:
        q[f"c6_bayer_{pattern.lower()}"] = on_alpha(stencils.bayer_filter, pattern=pattern)
        q[f"c8_bayer_bilinear_{pattern.lower()}"] = on_colour(
            stencils.bayer_filter, pattern=pattern, method="bilinear"
        )
    for n, method in enumerate(METHODS, 3):
        q[f"r{n}_{method}"] = on_colour(
            resample.downscale, scale=0.35, upscale=False, downscale_method=method
        )
    return q


def _values(rows) -> str:
    return ", ".join("(" + ",".join(str(v) for v in r) + ")" for r in rows)


def _needed(source: str, dy: str = "t.dy", dx: str = "t.dx", where: str = "") -> str:
    """Each place and tap with the mirrored place it reads."""
    return f"""
needed AS MATERIALIZED (
  SELECT p.* EXCLUDE (h, w), t.*, {sql.fold(f'p.y+{dy}', 'p.h')} AS sy, {sql.fold(f'p.x+{dx}', 'p.w')} AS sx
  FROM {source} p CROSS JOIN taps t {where})"""


def _stencil(taps, finish: str, source: str = "ch", alpha: str = "", grey: bool = False) -> str:
    """Gather form: each pixel joins its taps and looks the mirrored source up."""
    final = f"""{_needed(source)},
res AS (
  SELECT t.frame_id, t.y, t.x, t.c, {finish} AS v
  FROM needed t JOIN {source} s ON s.frame_id=t.frame_id AND s.c=t.c AND s.y=t.sy AND s.x=t.sx
  GROUP BY ALL)"""
    wide = f"SELECT w.*, px.a FROM ({sql.WIDE}) w JOIN px USING (frame_id, y, x)" if alpha else sql.WIDE
    if grey:
        wide = "SELECT frame_id, y::INT AS y, x::INT AS x, v::INT AS v FROM res WHERE c=0"
    return f"""
WITH {sql.PX}, {sql.CH}, taps(dy,dx,k) AS (VALUES {_values(taps)}), {final}
{wide}"""


def _gaussian(sigma: float, grey: bool) -> str:
    """Scatter-free two passes: weights from the formula, remainder on the centre."""
    radius = int(4.0 * sigma + 0.5)
    last = (
        "SELECT frame_id, y::INT AS y, x::INT AS x, v::INT AS v FROM res" if grey else sql.WIDE
    )
    return f"""
WITH {sql.PX}, {sql.CH},
raw AS (SELECT d, exp(-0.5::DOUBLE*pow(d/{sigma!r}::DOUBLE,2)) AS e FROM (SELECT unnest(range(-{radius},{radius + 1})) AS d)),
whole AS (SELECT d, round_even(e*(65536.0::DOUBLE/(SELECT sum(e) FROM raw)),0)::BIGINT AS k FROM raw),
taps AS MATERIALIZED (SELECT d, (k+CASE WHEN d=0 THEN 65536-(SELECT sum(k) FROM whole) ELSE 0 END)::BIGINT AS k FROM whole),
below AS MATERIALIZED (
  SELECT p.*, t.k, {sql.fold('p.y+t.d', 'p.h')} AS sy FROM ch p CROSS JOIN taps t {'WHERE p.c=0' if grey else ''}),
down AS MATERIALIZED (
  SELECT p.frame_id, p.h, p.w, p.y, p.x, p.c, sum(p.k*s.v)::BIGINT AS v
  FROM below p JOIN ch s ON s.frame_id=p.frame_id AND s.c=p.c AND s.x=p.x AND s.y=p.sy
  GROUP BY ALL),
beside AS MATERIALIZED (
  SELECT p.*, t.k, {sql.fold('p.x+t.d', 'p.w')} AS sx FROM down p CROSS JOIN taps t),
res AS (
  SELECT p.frame_id, p.y, p.x, p.c, (sum(p.k*s.v)::BIGINT>>32) AS v
  FROM beside p JOIN down s ON s.frame_id=p.frame_id AND s.c=p.c AND s.y=p.y AND s.x=p.sx
  GROUP BY ALL)
{last}"""


def _disc(radius: int) -> str:
    return f"""
WITH {sql.PX}, {sql.CH},
side AS (SELECT unnest(range(-{radius},{radius + 1})) AS d),
taps AS (SELECT a.d AS dy, b.d AS dx, 1 AS k FROM side a, side b WHERE a.d*a.d+b.d*b.d<={radius * radius}),
{_needed('ch')},
res AS (
  SELECT t.frame_id, t.y, t.x, t.c, sum(s.v)::BIGINT//count(*) AS v
  FROM needed t JOIN ch s ON s.frame_id=t.frame_id AND s.c=t.c AND s.y=t.sy AND s.x=t.sx
  GROUP BY ALL)
SELECT w.*, px.a FROM ({sql.WIDE}) w JOIN px USING (frame_id, y, x)"""


CH_ALPHA = """
ch AS MATERIALIZED (
  SELECT frame_id, h, w, y, x, 0 AS c, r AS v FROM px
  UNION ALL SELECT frame_id, h, w, y, x, 1, g FROM px
  UNION ALL SELECT frame_id, h, w, y, x, 2, b FROM px
  UNION ALL SELECT frame_id, h, w, y, x, 3, a FROM px)"""
WIDE_ALPHA = sql.WIDE.replace(
    "FROM res", ", max(CASE WHEN c=3 THEN v END)::INT AS a FROM res"
)


def _box_blur(size: int, alpha: bool) -> str:
    """A horizontal line of ``size`` offsets; an even one reaches right and looks one line down."""
    odd = size % 2
    lo, hi, dy = (-(size // 2), size // 2, 0) if odd else (-(size // 2 - 1), size // 2, 1)
    return f"""
WITH {sql.PX}, {CH_ALPHA if alpha else sql.CH},
taps AS (SELECT unnest(range({lo},{hi + 1})) AS dx),{_needed('ch', dy=str(dy))},
res AS (
  SELECT t.frame_id, t.y, t.x, t.c, sum(s.v)::BIGINT//{size} AS v
  FROM needed t JOIN ch s ON s.frame_id=t.frame_id AND s.c=t.c AND s.y=t.sy AND s.x=t.sx
  GROUP BY ALL)
{WIDE_ALPHA if alpha else sql.WIDE}"""


def _shifted(dx: int, dy: int, alpha: bool) -> str:
    return f"""
WITH {sql.PX}
SELECT p.frame_id, p.y, p.x, coalesce(s.r,0)::INT AS r, p.g, coalesce(t.b,0)::INT AS b{', p.a' if alpha else ''}
FROM px p
LEFT JOIN px s ON s.frame_id=p.frame_id AND s.y=p.y-({dy}) AND s.x=p.x-({dx})
LEFT JOIN px t ON t.frame_id=p.frame_id AND t.y=p.y+({dy}) AND t.x=p.x+({dx})"""


def _code(pattern: str, y: str, x: str) -> str:
    """Colour under a place, from the pattern's letters."""
    at = {"R": 0, "G": 1, "B": 2}
    a, b, c, d = (at[letter] for letter in pattern)
    return (
        f"(CASE WHEN {y}%2=0 THEN CASE WHEN {x}%2=0 THEN {a} ELSE {b} END "
        f"ELSE CASE WHEN {x}%2=0 THEN {c} ELSE {d} END END)"
    )


def _bayer(pattern: str) -> str:
    weights = {"g": {}, "h": {}, "u": {}, "d": {}}
    for name, filter_taps in (("g", constants.GREEN), ("h", constants.IN_ROW), ("d", constants.DIAGONAL)):
        weights[name] = {(y, x): k for y, x, k in filter_taps}
    weights["u"] = {(x, y): k for (y, x), k in weights["h"].items()}
    places = sorted({at for one in weights.values() for at in one})
    taps = [(*at, *(weights[n].get(at, 0) for n in "ghud")) for at in places]
    red_even = "R" in pattern[:2]
    red_row = f"y%2={0 if red_even else 1}"
    code = _code(pattern, "y", "x")
    half = "greatest(0,least(255,round_even({}/16.0::DOUBLE,0)))::INT"
    s = {n: half.format(f"s{n}") for n in "ghud"}
    return f"""
WITH {sql.PX},
cfa AS MATERIALIZED (SELECT frame_id, h, w, y, x, a, {code} AS code,
  CASE {code} WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS m FROM px),
taps(dy,dx,kg,kh,ku,kd) AS (VALUES {_values(taps)}),
{_needed('cfa')},
f AS (
  SELECT p.frame_id, p.y, p.x, p.a, p.code, p.m, sum(kg*s.m)::BIGINT AS sg, sum(kh*s.m)::BIGINT AS sh,
    sum(ku*s.m)::BIGINT AS su, sum(kd*s.m)::BIGINT AS sd
  FROM needed p JOIN cfa s ON s.frame_id=p.frame_id AND s.y=p.sy AND s.x=p.sx
  GROUP BY ALL)
SELECT frame_id, y, x,
  (CASE code WHEN 0 THEN m WHEN 2 THEN {s['d']} ELSE CASE WHEN {red_row} THEN {s['h']} ELSE {s['u']} END END)::INT AS r,
  (CASE code WHEN 1 THEN m ELSE {s['g']} END)::INT AS g,
  (CASE code WHEN 2 THEN m WHEN 0 THEN {s['d']} ELSE CASE WHEN {red_row} THEN {s['u']} ELSE {s['h']} END END)::INT AS b,
  a FROM f"""


def _bayer_bilinear(pattern: str) -> str:
    """Neighbours by window functions; borders from what exists."""
    code = _code(pattern, "y", "x")
    red_across = {
        "RGGB": "y%2=0", "BGGR": "y%2=1", "GRBG": "x%2=1", "GBRG": "x%2=0",
    }[pattern]
    across, down = "PARTITION BY frame_id, y ORDER BY x", "PARTITION BY frame_id, x ORDER BY y"
    near = ", ".join(
        f"lag({b}) OVER ({across}) AS {b}w, lead({b}) OVER ({across}) AS {b}e, "
        f"lag({b}) OVER ({down}) AS {b}n, lead({b}) OVER ({down}) AS {b}s"
        for b in "rgb"
    )
    corner = ", ".join(
        f"lag({b}w) OVER ({down}) AS {b}nw, lag({b}e) OVER ({down}) AS {b}ne, "
        f"lead({b}w) OVER ({down}) AS {b}sw, lead({b}e) OVER ({down}) AS {b}se"
        for b in "rb"
    )
    inner = "y>0 AND y<h-1 AND x>0 AND x<w-1"

    def rebuilt(b: str, own: int, opposite: int, here: str) -> str:
        return (
            f"(CASE WHEN code={own} OR NOT ({inner}) THEN {b} "
            f"WHEN code={opposite} THEN ({b}nw+{b}ne+{b}sw+{b}se)//4 "
            f"WHEN {here} THEN ({b}w+{b}e)//2 ELSE ({b}n+{b}s)//2 END)::INT AS {b}"
        )

    return f"""
WITH {sql.PX},
one AS (SELECT *, {code} AS code, {near} FROM px),
two AS (SELECT *, {corner} FROM one)
SELECT frame_id, y, x,
  {rebuilt('r', 0, 2, red_across)},
  (CASE WHEN code=1 THEN g
    WHEN {inner} THEN CASE WHEN abs(gw-ge)<abs(gn-gs) THEN (gw+ge)//2
      WHEN abs(gn-gs)<abs(gw-ge) THEN (gn+gs)//2 ELSE (gn+gs+gw+ge)//4 END
    ELSE (coalesce(gn,0)+coalesce(gs,0)+coalesce(gw,0)+coalesce(ge,0))
      //((gn IS NOT NULL)::INT+(gs IS NOT NULL)::INT+(gw IS NOT NULL)::INT+(ge IS NOT NULL)::INT) END)::INT AS g,
  {rebuilt('b', 2, 0, 'NOT (' + red_across + ')')}
FROM two"""


FILTERS = {
    "box": (0.5, "CASE WHEN abs(t)<=0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "bilinear": (1.0, "greatest(0.0::DOUBLE,1.0::DOUBLE-abs(t))"),
    "bicubic": (
        2.0,
        "CASE WHEN abs(t)<1 THEN 1.5::DOUBLE*pow(abs(t),3)-2.5::DOUBLE*pow(abs(t),2)+1 "
        "WHEN abs(t)<2 THEN -0.5::DOUBLE*pow(abs(t),3)+2.5::DOUBLE*pow(abs(t),2)-4*abs(t)+2 "
        "ELSE 0.0::DOUBLE END",
    ),
    "lanczos": (
        3.0,
        "CASE WHEN t=0 THEN 1.0::DOUBLE WHEN abs(t)<3 THEN "
        "sin(pi()*t)/(pi()*t)*sin(pi()*t/3)/(pi()*t/3) ELSE 0.0::DOUBLE END",
    ),
}


def weight_ctes(name: str, pairs: str, method: str) -> str:
    """Tap table ``name(n, m, dst, src, k)`` for each source/target side in ``pairs(n, m)``."""
    if method == "bilinear_point":
        return f"""
{name}_at AS (SELECT n, m, i, (i+0.5::DOUBLE)*n/m-0.5::DOUBLE AS p FROM
  (SELECT n, m, unnest(range(m)) AS i FROM ({pairs}))),
{name} AS MATERIALIZED (SELECT n, m, i AS dst, src, sum(k)::BIGINT AS k FROM (
  SELECT n, m, i, least(n-1,greatest(0,floor(p)::INT)) AS src, 4194304-round_even((p-floor(p))*4194304,0)::BIGINT AS k FROM {name}_at
  UNION ALL
  SELECT n, m, i, least(n-1,greatest(0,floor(p)::INT+1)), round_even((p-floor(p))*4194304,0)::BIGINT FROM {name}_at)
  GROUP BY n, m, i, src)"""
    support, formula = FILTERS[method]
    return f"""
{name}_c AS (SELECT n, m, i, (i+0.5::DOUBLE)*(n::DOUBLE/m) AS c, greatest(1.0::DOUBLE,n::DOUBLE/m) AS fs FROM
  (SELECT n, m, unnest(range(m)) AS i FROM ({pairs}))),
{name}_t AS (SELECT n, m, i, src, (src-c+0.5::DOUBLE)/fs AS t FROM
  (SELECT *, unnest(range(greatest(0,trunc(c-{support}::DOUBLE*fs+0.5::DOUBLE)::INT),
     least(n,trunc(c+{support}::DOUBLE*fs+0.5::DOUBLE)::INT))) AS src FROM {name}_c)),
{name}_f AS (SELECT *, {formula} AS f FROM {name}_t),
{name} AS MATERIALIZED (SELECT n, m, i AS dst, src,
  floor(0.5::DOUBLE+f/sum(f) OVER (PARTITION BY n, m, i)*4194304)::BIGINT AS k FROM {name}_f)"""


def _resized(source: str, prefix: str, method: str, new_h: str, new_w: str, size: str) -> str:
    """CTEs turning ``source(frame_id, y, x, c, v)`` of sizes ``size(frame_id, h, w)`` into ``prefix_out``."""
    sizes = f"""
{prefix}_sz AS MATERIALIZED (SELECT frame_id, h, w, {new_h} AS nh, {new_w} AS nw FROM {size})"""
    if method in ("nearest", "nearest_floor"):
        shift = "0.5" if method == "nearest" else "0.0"
        return f"""{sizes},
{prefix}_out AS MATERIALIZED (
  SELECT g.frame_id, g.y, g.x, s.c, s.v FROM (
    SELECT frame_id, y, unnest(range(nw)) AS x, h, w, nh, nw FROM (
      SELECT frame_id, unnest(range(nh)) AS y, h, w, nh, nw FROM {prefix}_sz)) g
  JOIN {source} s ON s.frame_id=g.frame_id AND s.y=floor((g.y+{shift}::DOUBLE)*g.h/g.nh)::INT
    AND s.x=floor((g.x+{shift}::DOUBLE)*g.w/g.nw)::INT)"""
    point = method == "bilinear_point"
    byte = "greatest(0,least(255,(sum(k*v)::BIGINT+2097152)>>22))"
    first = "sum(k*v)::BIGINT" if point else byte
    second = "(sum(k::HUGEINT*v)//17592186044416)::INT" if point else byte
    return f"""{sizes},
{weight_ctes(prefix + '_wx', f'SELECT DISTINCT w AS n, nw AS m FROM {prefix}_sz', method)},
{weight_ctes(prefix + '_wy', f'SELECT DISTINCT h AS n, nh AS m FROM {prefix}_sz', method)},
{prefix}_h AS MATERIALIZED (
  SELECT s.frame_id, s.y, t.dst AS x, s.c, {first} AS v
  FROM {source} s JOIN {prefix}_sz z ON z.frame_id=s.frame_id
  JOIN {prefix}_wx t ON t.n=z.w AND t.m=z.nw AND t.src=s.x GROUP BY ALL),
{prefix}_out AS MATERIALIZED (
  SELECT s.frame_id, t.dst AS y, s.x, s.c, {second} AS v
  FROM {prefix}_h s JOIN {prefix}_sz z ON z.frame_id=s.frame_id
  JOIN {prefix}_wy t ON t.n=z.h AND t.m=z.nh AND t.src=s.y GROUP BY ALL)"""


def _downscale(scale: float, down: str, up: str | None = None, alpha: bool = False) -> str:
    small = [f"greatest(1,trunc({s}*{scale!r}::DOUBLE)::INT)" for s in "hw"]
    ctes = [_resized("ch", "s", down, *small, "fr")]
    last = "s_out"
    if up:
        ctes.append(
            "s_size AS (SELECT frame_id, nh AS h, nw AS w, h AS fh, w AS fw FROM s_sz)"
        )
        ctes.append(_resized("s_out", "u", up, "fh", "fw", "s_size"))
        last = "u_out"
    wide = WIDE_ALPHA if alpha else sql.WIDE
    return f"""
WITH {sql.PX}, {CH_ALPHA if alpha else sql.CH}, {', '.join(ctes)}, res AS (SELECT * FROM {last})
{wide}"""


def oracles() -> dict[str, str]:
    angled = constants.turned_line(7, 45.0)
    vertical = constants.turned_line(4, 90.0)
    o = {
        "c1_blur_gaussian": _gaussian(1.5, grey=False),
        "c1_blur_gaussian_wide": _gaussian(20.0, grey=True),
        "c2_blur_circular": _disc(4),
        "c3_motion_blur_odd": _box_blur(9, alpha=True),
        "c3_motion_blur_even": _box_blur(6, alpha=False),
        "c4_motion_blur_angled": _stencil(angled, "sum(t.k*s.v)::BIGINT>>16"),
        "c4_motion_blur_vertical_even": _stencil(vertical, "sum(t.k*s.v)::BIGINT>>16", grey=True),
        "c5_chromatic_aberration": _shifted(3, -2, alpha=True),
        "c5_chromatic_sideways": _shifted(-5, 0, alpha=False),
        "c7_stencil": _stencil(BOX3, "sum(t.k*s.v)::BIGINT//16"),
        "r2_nearest": _downscale(0.3, "nearest"),
        "r8_bilinear_point": _downscale(0.37, "bilinear_point"),
        "r8_nearest_floor": _downscale(0.37, "nearest_floor"),
        "r1_downscale_default": _downscale(0.15, "bicubic", "nearest"),
        "r1_downscale_smooth": _downscale(0.4, "lanczos", "bilinear", alpha=True),
    }
    for pattern in stencils.MOSAICS:
        o[f"c6_bayer_{pattern.lower()}"] = _bayer(pattern)
        o[f"c8_bayer_bilinear_{pattern.lower()}"] = _bayer_bilinear(pattern)
    for n, method in enumerate(METHODS, 3):
        o[f"r{n}_{method}"] = _downscale(0.35, method)
    return o
