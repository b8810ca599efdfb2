"""Image files as scanlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import check_choice
from rasterloom.operators.strips import list_column

# Position of each band in the decoder's byte order, per channel count.
BYTE_ORDER = {1: {"v": 0}, 3: {"b": 0, "g": 1, "r": 2}, 4: {"b": 0, "g": 1, "r": 2, "a": 3}}
BANDS = {"L": ("v",), "RGB": ("r", "g", "b"), "RGBA": ("r", "g", "b", "a")}


def _images(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """The image source's rows and each one's mode; null where a file could not be decoded."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    mode = F.lit(None).cast("string")
    for name, bands in BANDS.items():
        mode = F.when(F.col("image.nChannels") == len(bands), name).otherwise(mode)
    return image, mode


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``: ``frame_id, name, height, width, mode``.

    A file that is no image has no size and no mode.
    """
    image, mode = _images(spark, path)

    def known(c: str) -> Column:
        return F.when(mode.isNotNull(), F.col(c))

    return image.select(
        F.xxhash64("image.origin").alias("frame_id"),
        F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("name"),
        known("image.height").alias("height"),
        known("image.width").alias("width"),
        mode.alias("mode"),
    )


def in_mode(planes: dict[str, np.ndarray], mode: str) -> dict[str, np.ndarray]:
    """Bands of a decoded picture in another mode, as ``convert`` makes them."""
    if mode == "L" and "v" not in planes:
        wide = {b: planes[b].astype(np.int32) for b in "rgb"}
        return {"v": (wide["r"] * 19595 + wide["g"] * 38470 + wide["b"] * 7471 + 32768) >> 16}
    colour = {b: planes["v"] for b in "rgb"} if "v" in planes and mode != "L" else planes
    opaque = np.full_like(next(iter(planes.values())), 255)
    return {b: colour.get(b, opaque) for b in BANDS[mode]}


def read_images(spark: SparkSession, path: str, mode: str = "RGB", broken: str = "error") -> DataFrame:
    """Every image below ``path`` as scanlines of ``mode`` (``L``, ``RGB`` or ``RGBA``).

    Spark's image source decodes each file on an executor; a vectorised step cuts the decoded bytes
    into lines and converts pictures of other modes: grey is repeated, alpha dropped or opaque,
    colour turned to its 601 luma. A file that cannot be decoded is an error that names it, or is
    left out with ``broken="skip"`` (``read_frames`` lists it). ``frame_id`` is a hash of the file's
    address, so it does not depend on what else is in the folder.
    """
    check_choice("mode", mode, tuple(BANDS))
    check_choice("broken", broken, ("error", "skip"))
    image, found = _images(spark, path)
    failed = F.raise_error(F.concat(F.lit("not an image: "), "image.origin")).cast("int")
    channels = F.col("image.nChannels") if broken == "skip" else F.coalesce(F.when(found.isNotNull(), F.col("image.nChannels")), failed)
    source = (image.where(found.isNotNull()) if broken == "skip" else image).select(
        F.xxhash64("image.origin").alias("frame_id"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        channels.alias("channels"),
        F.col("image.data").alias("data"),
    )
    schema = "frame_id long, height int, width int, y int, " + ", ".join(
        f"{b} array<int>" for b in BANDS[mode]
    )

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in pa.table(batch).to_pylist():
                height, width = one["height"], one["width"]
                cube = np.frombuffer(one["data"], dtype=np.uint8).reshape(height, width, -1)
                columns = {
                    "frame_id": pa.array(np.full(height, one["frame_id"], dtype=np.int64)),
                    "height": pa.array(np.full(height, height, dtype=np.int32)),
                    "width": pa.array(np.full(height, width, dtype=np.int32)),
                    "y": pa.array(np.arange(height, dtype=np.int32)),
                }
                planes = {b: cube[:, :, place] for b, place in BYTE_ORDER[one["channels"]].items()}
                columns.update({b: list_column(p) for b, p in in_mode(planes, mode).items()})
                yield from pa.table(columns).to_batches()

    return source.mapInArrow(lines_of, schema)
