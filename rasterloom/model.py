"""Raster tables: scanlines (one row per image line) and pixels (one row per pixel).

scanlines  frame_id BIGINT, height INT, width INT, y INT, <band> ARRAY<INT>...
pixels     frame_id BIGINT, height INT, width INT, y INT, x INT, <band> INT...

The bands tell the mode: ``v`` is grey, ``r g b`` colour, plus ``a`` with alpha. Frame size is
carried on every row, so no per-pixel operator needs a join to learn it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions.binding import let

COLOUR = ("r", "g", "b")
KEYS = ("frame_id", "height", "width", "y")

BandFn = Callable[[dict[str, Column]], dict[str, Column]]


def value_bands(df: DataFrame) -> list[str]:
    """Bands that hold picture values, without alpha."""
    if "v" in df.columns:
        return ["v"]
    return [b for b in COLOUR if b in df.columns]


def all_bands(df: DataFrame) -> list[str]:
    return value_bands(df) + (["a"] if "a" in df.columns else [])


def is_grey(df: DataFrame) -> bool:
    return value_bands(df) == ["v"]


def is_scanlines(df: DataFrame) -> bool:
    return isinstance(df.schema[value_bands(df)[0]].dataType, T.ArrayType)


def to_pixels(df: DataFrame) -> DataFrame:
    """Explode scanlines; stays in the scan's own partitions (no shuffle)."""
    if not is_scanlines(df):
        return df
    bands = all_bands(df)
    xs = F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x")
    return df.select(*KEYS, xs, *bands).select(
        *KEYS, "x", *[F.get(F.col(b), F.col("x")).alias(b) for b in bands]
    )


def to_scanlines(df: DataFrame) -> DataFrame:
    """Collect pixel rows into lines. One line is the group, never a frame.

    A pixel travels as one number, ``x`` above its bytes, so that a line is a flat array that is
    combined before the shuffle and put in order by a plain sort.
    """
    if is_scanlines(df):
        return df
    bands = all_bands(df)
    packed = F.shiftleft(F.col("x").cast("long"), 32)
    for place, band in enumerate(bands):
        packed = packed + F.shiftleft(F.col(band).cast("long"), 8 * place)
    line = F.sort_array(F.collect_list(packed)).alias("line")

    def unpacked(place: int) -> Column:
        return F.transform(
            "line", lambda v: F.shiftright(v, 8 * place).bitwiseAND(F.lit(255)).cast("int")
        )

    lines = df.groupBy(*KEYS).agg(line)
    return lines.select(*KEYS, *[unpacked(i).alias(b) for i, b in enumerate(bands)])


def map_pixels(df: DataFrame, fn: BandFn) -> DataFrame:
    """Apply a per-pixel expression; consecutive calls fuse into one code-generated stage.

    The result is a pixel table whatever the input's layout.

    ``fn`` gets the row's columns by name and returns the changed bands.
    """
    px = to_pixels(df)
    changed = fn({c: F.col(c) for c in px.columns})
    return px.select(
        *KEYS, "x", *[changed.get(b, F.col(b)).cast("int").alias(b) for b in all_bands(px)]
    )


def looked_up(values: Column | str, table: Column) -> Column:
    """Each byte of an array replaced by its entry in a 256-entry table."""
    return F.transform(values, lambda v: F.get(table, v))


def map_bands(
    df: DataFrame,
    fn: Callable[[Column, Column], Column],
    given: Callable[[str], Column] = lambda band: F.lit(None),
) -> DataFrame:
    """Apply ``fn(value, given(band))`` to each value, keeping the table's layout.

    ``given`` is what a line contributes. On scanlines it is computed once per line, and so is
    ``fn`` for each of the 256 bytes; values are then looked up.
    """
    bands = value_bands(df)
    if not is_scanlines(df):
        return df.withColumns({b: fn(F.col(b), given(b)).cast("int") for b in bands})

    def line(band: str) -> Column:
        def table(g: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: fn(v, g).cast("int"))

        return let(given(band), lambda g: let(table(g), lambda t: looked_up(band, t)))

    return df.withColumns({b: line(b) for b in bands})


def clip_byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c))


def frames_of(df: DataFrame) -> DataFrame:
    """One row per frame: ``frame_id, height, width``."""
    return df.select("frame_id", "height", "width").distinct()


def check_range(name: str, value, lo, hi) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not lo <= value <= hi:
        raise ValueError(f"{name} must be a number between {lo} and {hi}, got {value!r}")


def check_choice(name: str, value, choices) -> None:
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(map(str, choices))}, got {value!r}")
