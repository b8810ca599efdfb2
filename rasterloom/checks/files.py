"""Queries and SQL checks: image files. The frames are first stored as a folder of PNG files."""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.checks import sql
from rasterloom.checks.pointwise import out
from rasterloom.operators.strips import planes_of
from rasterloom.session import shared_folder
from rasterloom.sources.images import read_frames, read_images
from rasterloom.sources.vectors import scanlines_from_vectors

# Colour type of a PNG file and its bands, by frame number modulo 3.
KINDS = {0: (2, "rgb"), 1: (0, "v"), 2: (6, "rgba")}


def png(planes: dict[str, np.ndarray], kind: int, bands: str) -> bytes:
    cube = np.stack([planes[b] for b in bands], 2).astype(np.uint8)
    height, width, _ = cube.shape
    raw = b"".join(b"\0" + line.tobytes() for line in cube)

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def store_images(scan: DataFrame, folder: str) -> None:
    """Each (small) frame as ``<frame_id>.png`` in colour, grey or with alpha, and one broken file.

    The task that makes a picture writes it, below a name of its own first, so a task that runs again
    puts the same file in its place. Only a count reaches the driver.
    """
    address = re.sub(r"^file:/+", "file:///", folder)

    def put(name: str, data: bytes) -> None:
        files, base = FileSystem.from_uri(address)
        files.create_dir(base, recursive=True)
        made = f"{base}/.{uuid.uuid4().hex}"
        with files.open_output_stream(made) as stream:
            stream.write(data)
        files.move(made, f"{base}/{name}")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        number = table.column("frame_id")[0].as_py()
        planes = planes_of(table, ["r", "g", "b", "a"], slice(None))
        planes["v"] = (planes["r"] * 19595 + planes["g"] * 38470 + planes["b"] * 7471 + 32768) >> 16
        data = png(planes, *KINDS[number % 3])
        put(f"{number}.png", data)
        return pa.table({"number": pa.array([number]), "size": pa.array([len(data)])})

    scan.groupBy("frame_id").applyInArrow(one, "number long, size long").agg(F.sum("size")).collect()
    put("broken.png", b"\x89PNG\r\n\x1a\n no picture")


def _folder(spark: SparkSession, d: str) -> str:
    folder = shared_folder(spark, "images")
    store_images(scanlines_from_vectors(spark, d, alpha=True), folder)
    return folder


def image_files(spark: SparkSession, d: str) -> DataFrame:
    """Pixels read back from files of all modes, by the number in the file's name."""
    folder = _folder(spark, d)
    names = read_frames(spark, folder).select(
        "frame_id", F.regexp_extract("name", r"^(\d*)", 1).try_cast("long").alias("number")
    )
    return out(read_images(spark, folder, "RGBA", broken="skip")).join(names, "frame_id").select(
        F.col("number").alias("frame_id"), "y", "x", "r", "g", "b", "a"
    )


def image_modes(spark: SparkSession, d: str) -> DataFrame:
    """Files by mode and size; the broken one has neither."""
    found = read_frames(spark, _folder(spark, d))
    return found.groupBy(
        F.coalesce("mode", F.lit("broken")).alias("mode"),
        F.coalesce("height", F.lit(-1)).alias("height"),
        F.coalesce("width", F.lit(-1)).alias("width"),
    ).agg(F.count("*").alias("files"))


def queries() -> dict:
    return {"s1_image_files": image_files, "s1_image_modes": image_modes}


def oracles() -> dict[str, str]:
    grey = "((r*19595+g*38470+b*7471+32768)>>16)::INT"
    bands = ", ".join(f"CASE WHEN frame_id%3=1 THEN {grey} ELSE {b} END AS {b}" for b in "rgb")
    return {
        "s1_image_files": f"WITH {sql.PX} SELECT frame_id, y, x, {bands}, CASE WHEN frame_id%3=2 THEN a ELSE 255 END AS a FROM px",
        "s1_image_modes": f"""WITH {sql.PX}
SELECT CASE frame_id%3 WHEN 0 THEN 'RGB' WHEN 1 THEN 'L' ELSE 'RGBA' END AS mode, h AS height, w AS width, count(*) AS files
FROM fr GROUP BY ALL UNION ALL SELECT 'broken', -1, -1, 1""",
    }
