"""Cut frames into strips of lines so that neighbourhood work spreads over tasks.

A strip, not a frame, is the unit of work: its height follows from the image width so that a
strip holds about a million pixels however large the frame is. Lines near a strip's edge are
sent to both strips (the halo), and lines beyond the picture are sent as mirrored copies, so a
strip has all it needs and the whole job is one shuffle of scanlines.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP_PIXELS = 1 << 20
Planes = dict[str, np.ndarray]


class Strip(NamedTuple):
    """A strip's own lines ``first..first+rows-1``; its planes start ``top`` lines earlier."""

    first: int
    rows: int
    top: int
    height: int
    width: int
    frame_id: int = 0


def strip_height(width: Column, halo: int, multiple: int = 1) -> Column:
    """Lines per strip: about STRIP_PIXELS pixels, at least the halo, a multiple of ``multiple``.

    So a line is sent to two strips on average at the very most.
    """
    rows = F.greatest(F.lit(64), F.lit(halo), F.floor(F.lit(STRIP_PIXELS) / width)).cast("int")
    return (F.ceil(rows / F.lit(multiple)) * multiple).cast("int")


def with_halo(
    scan: DataFrame, before: int, after: int, mirror: bool = True, multiple: int = 1
) -> DataFrame:
    """Send each line to every strip that reads it.

    Adds ``strip``, ``rows`` (lines per strip) and ``at``: the line's place in the frame, which
    lies outside ``0..height-1`` for mirrored copies (edge line repeated).
    """
    h, y = F.col("height"), F.col("y")
    rows = strip_height(F.col("width"), before + after, multiple)
    places = F.array(y)
    if mirror and before + after:
        last = h - 1 + after

        def images(first: Column) -> Column:
            """Every mirrored place of a line, one per period of two frame heights."""
            low = (first + F.ceil((F.lit(-before) - first) / (h * 2)) * (h * 2)).cast("int")
            return F.when(low <= last, F.sequence(low, last, h * 2)).otherwise(
                F.array().cast("array<int>")
            )

        places = F.concat(images(y), images(h * 2 - 1 - y))
    last_strip = F.floor((h - 1) / F.col("rows")).cast("int")

    def strips_of(at: Column) -> Column:
        first = F.floor((at - after) / F.col("rows")).cast("int")
        final = F.floor((at + before) / F.col("rows")).cast("int")
        return F.sequence(
            F.least(last_strip, F.greatest(F.lit(0), first)),
            F.least(last_strip, F.greatest(F.lit(0), final)),
        )

    return (
        scan.withColumn("rows", rows)
        .withColumn("at", F.explode(places))
        .withColumn("strip", F.explode(strips_of(F.col("at"))))
    )


def planes_of(table: pa.Table, bands: list[str], order: np.ndarray | slice) -> Planes:
    """Each band's lines as one matrix of 32-bit integers."""
    n = table.num_rows
    return {
        b: table.column(b).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        .reshape(n, -1)[order]
        for b in bands
    }


def list_column(plane: np.ndarray) -> pa.ListArray:
    rows, width = plane.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(plane.astype(np.int32).ravel()))
