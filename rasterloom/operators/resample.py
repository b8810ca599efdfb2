"""Resizing: separable weighted sums over strips of output lines, one shuffle of scanlines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.binding import let
from rasterloom.model import all_bands, check_choice, check_range, to_scanlines
from rasterloom.operators.strips import STRIP_PIXELS, list_column

# Support of each filter, in source pixels at scale 1.
SUPPORT = {"box": 0.5, "bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}
NEAREST = ("nearest", "nearest_floor")
METHODS = ("nearest", "bilinear", "bicubic", "lanczos", "box", "bilinear_point", "nearest_floor")
BITS = 22


def _filter(method: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if method == "box":
        return (x <= 0.5).astype(float)
    if method == "bilinear":
        return np.maximum(0.0, 1.0 - x)
    if method == "bicubic":
        near = (1.5 * x - 2.5) * x * x + 1.0
        return np.where(x < 1.0, near, np.where(x < 2.0, ((-0.5 * x + 2.5) * x - 4.0) * x + 2.0, 0.0))
    a, b = np.pi * np.where(x == 0, 1.0, x), np.pi * np.where(x == 0, 1.0, x) / 3.0
    return np.where(x >= 3.0, 0.0, np.where(x == 0, 1.0, np.sin(a) / a * (np.sin(b) / b)))


def weights(
    source: int, target: int, method: str, first: int = 0, last: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``(index, weight)`` matrices, one row of taps for each of the output positions ``first..last-1``,
    in 22-bit fixed point."""
    i = np.arange(first, target if last is None else last)
    scale = source / target
    if method == "bilinear_point":
        at = (i + 0.5) * source / target - 0.5
        low = np.floor(at).astype(np.int64)
        part = np.rint((at - low) * (1 << BITS)).astype(np.int64)
        taps = np.clip(np.stack([low, low + 1], 1), 0, source - 1)
        return taps, np.stack([(1 << BITS) - part, part], 1)
    wide = max(1.0, scale)
    centre = (i + 0.5) * scale
    reach = SUPPORT[method] * wide
    begin = np.maximum(0, (centre - reach + 0.5).astype(np.int64))
    end = np.minimum(source, (centre + reach + 0.5).astype(np.int64))
    taps = begin[:, None] + np.arange(max(1, int((end - begin).max(initial=1))))
    inside = taps < end[:, None]
    raw = np.where(inside, _filter(method, (taps - centre[:, None] + 0.5) / wide), 0.0)
    value = np.floor(0.5 + raw / raw.sum(1, keepdims=True) * (1 << BITS)).astype(np.int64)
    return np.where(inside, taps, 0), np.where(inside, value, 0)


def _across(plane: np.ndarray, taps: tuple[np.ndarray, np.ndarray], method: str) -> np.ndarray:
    """Resize columns; bytes, or unrounded 22-bit sums for point sampling."""
    index, weight = taps
    target = len(index)
    total = np.zeros((plane.shape[0], target), dtype=np.int64)
    for t in range(index.shape[1]):
        total += weight[:, t] * plane[:, index[:, t]]
    if method == "bilinear_point":
        return total
    return np.clip((total + (1 << (BITS - 1))) >> BITS, 0, 255)


def _down(plane: np.ndarray, place: np.ndarray, weight: np.ndarray, method: str) -> np.ndarray:
    """Resize lines, given the place of each tap among the lines at hand."""
    total = np.zeros((place.shape[0], plane.shape[1]), dtype=np.int64)
    for t in range(place.shape[1]):
        total += weight[:, t, None] * plane[place[:, t]]
    if method == "bilinear_point":
        return np.clip(total >> (2 * BITS), 0, 255)
    return np.clip((total + (1 << (BITS - 1))) >> BITS, 0, 255)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(np.int64)


class _Taps(dict):
    """Weights by ``(source, target)``: of the last few sizes only, however many there are."""

    def __init__(self, method: str):
        super().__init__()
        self.method = method

    def __missing__(self, sides: tuple[int, int]):
        if len(self) >= 4:
            self.clear()
        self[sides] = weights(*sides, self.method)
        return self[sides]


def _narrowed(scan: DataFrame, bands: list[str], method: str) -> DataFrame:
    """Resize columns line by line before the shuffle, so that only short lines travel."""

    def run(batches):
        taps = _Taps(method)
        for batch in batches:
            table = pa.table(batch)
            sides = table.select(["width", "_w"]).group_by(["width", "_w"]).aggregate([])
            for width, target in zip(*(sides.column(c).to_pylist() for c in ("width", "_w"))):
                part = table.filter(
                    pc.and_(pc.equal(table["width"], width), pc.equal(table["_w"], target))
                )
                for b in bands:
                    plane = _matrix(part.column(b), part.num_rows)
                    plane = _across(plane, taps[width, target], method)
                    part = part.set_column(part.schema.get_field_index(b), b, list_column(plane))
                yield from part.to_batches()

    return scan.mapInArrow(run, scan.schema)


def _nearest(
    scan: DataFrame, height: Column, width: Column, floor: bool, carry: list[str]
) -> DataFrame:
    """Copy source lines and columns: no arithmetic and no shuffle."""
    shift = F.lit(0.0 if floor else 0.5)

    def source(i: Column, n: Column, m: Column) -> Column:
        return F.least(n - 1, F.floor((i + shift) * n / m).cast("int"))

    y = F.col("y").cast("double")
    low = F.greatest(F.lit(0), F.floor(y * F.col("_h") / F.col("height")).cast("int") - 1)
    high = F.least(
        F.col("_h") - 1, F.ceil((y + 1) * F.col("_h") / F.col("height")).cast("int") + 1
    )
    lines = F.filter(
        F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")),
        lambda i: source(i, F.col("height"), F.col("_h")) == F.col("y"),
    )
    columns = F.transform(
        F.sequence(F.lit(0), F.col("_w") - 1), lambda i: source(i, F.col("width"), F.col("_w"))
    )

    def gathered(band: str) -> Column:
        return let(band, lambda v: F.transform("_columns", lambda i: F.get(v, i))).alias(band)

    return (
        scan.withColumns({"_h": height, "_w": width})
        .withColumns({"_columns": columns, "_lines": lines})
        .where(F.size("_lines") > 0)
        .select("frame_id", "_h", "_w", *carry, "_lines", *[gathered(b) for b in all_bands(scan)])
        .select(
            "frame_id",
            F.col("_h").alias("height"),
            F.col("_w").alias("width"),
            F.explode("_lines").alias("y"),
            *carry,
            *all_bands(scan),
        )
    )


def resize(
    df: DataFrame,
    height: Column,
    width: Column,
    method: str,
    shrinks: bool = False,
    carry: list[str] | None = None,
) -> DataFrame:
    """Resize every frame to ``height`` x ``width`` (expressions of the current size).

    Columns are resized first, rounded to bytes, then lines. Each source line is sent to the
    strips of output lines whose taps may reach it, and a strip picks the lines it needs. With
    ``shrinks`` the columns are resized before that shuffle. ``carry`` names integer columns
    that are constant within a frame and kept.
    """
    check_choice("method", method, METHODS)
    scan = df if carry else to_scanlines(df)
    carry = carry or []
    height, width = height.cast("int"), width.cast("int")
    if method in NEAREST:
        return _nearest(scan, height, width, method == "nearest_floor", carry)
    bands = all_bands(scan)
    support = 1.0 if method == "bilinear_point" else SUPPORT[method]
    scale = F.col("height") / F.col("_h")
    reach = F.lit(support) * F.greatest(F.lit(1.0), scale) + F.lit(1.5)
    widest = F.col("_w") if shrinks else F.greatest("width", "_w")
    rows = F.greatest(F.lit(4), F.floor(F.lit(STRIP_PIXELS) / widest / scale)).cast("int")
    last = F.floor((F.col("_h") - 1) / F.col("rows")).cast("int")

    def strip_of(line: Column) -> Column:
        inside = F.greatest(F.lit(0), F.least(F.col("_h") - 1, F.floor(line).cast("int")))
        return F.least(last, F.floor(inside / F.col("rows")).cast("int"))

    keys = ["frame_id", "height", "_h", "_w", "rows", "strip", "y"]
    sized = scan.withColumns({"_h": height, "_w": width})
    if shrinks:
        sized = _narrowed(sized.select("frame_id", "height", "width", "y", "_h", "_w", *carry, *bands),
                          bands, method)
    halo = sized.withColumn("rows", rows).withColumn(
        "strip",
        F.explode(
            F.sequence(
                strip_of((F.col("y") + 0.5 - reach) / scale),
                strip_of((F.col("y") + 0.5 + reach) / scale),
            )
        ),
    )
    schema = ", ".join(
        ["frame_id long, height int, width int, y int"]
        + [f"{c} int" for c in carry]
        + [f"{b} array<int>" for b in bands]
    )

    taps = _Taps(method)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        y = table.column("y").to_numpy()
        one = {c: table.column(c)[0].as_py() for c in (*keys, *carry)}
        begin = one["strip"] * one["rows"]
        lines = np.arange(begin, min(begin + one["rows"], one["_h"]))
        index, weight = weights(one["height"], one["_h"], method, begin, begin + len(lines))
        place = np.searchsorted(y, np.where(weight != 0, index, index[:, :1]))
        n = len(lines)
        columns = {
            "frame_id": pa.array(np.full(n, one["frame_id"], dtype=np.int64)),
            "height": pa.array(np.full(n, one["_h"], dtype=np.int32)),
            "width": pa.array(np.full(n, one["_w"], dtype=np.int32)),
            "y": pa.array(lines.astype(np.int32)),
        }
        columns.update({c: pa.array(np.full(n, one[c], dtype=np.int32)) for c in carry})
        for b in bands:
            plane = _matrix(table.column(b), len(y))
            plane = plane if shrinks else _across(plane, taps[plane.shape[1], one["_w"]], method)
            columns[b] = list_column(_down(plane, place, weight, method))
        return pa.table(columns)

    return halo.select(*keys, *carry, *bands).groupBy("frame_id", "strip").applyInArrow(run, schema)


def downscale(
    df: DataFrame,
    scale: float,
    upscale: bool = True,
    downscale_method: str = "bicubic",
    upscale_method: str = "nearest",
) -> DataFrame:
    """Resize to ``max(1, int(side*scale))`` and, by default, back to the original size."""
    check_range("scale", scale, 0.01, 1.0)
    check_choice("downscale_method", downscale_method, METHODS)
    check_choice("upscale_method", upscale_method, METHODS)
    if not isinstance(upscale, bool):
        raise ValueError("upscale must be true or false")

    def smaller(side: str) -> Column:
        return F.greatest(F.lit(1), (F.col(side) * F.lit(float(scale))).cast("int"))

    scan = to_scanlines(df)
    full = {"full_height": F.col("height"), "full_width": F.col("width")}
    carry = list(full) if upscale else None
    small = resize(
        scan.withColumns(full) if upscale else scan,
        smaller("height"), smaller("width"), downscale_method, shrinks=True, carry=carry,
    )
    if not upscale:
        return small
    back = resize(small, F.col("full_height"), F.col("full_width"), upscale_method, carry=carry)
    return back.drop(*full)
