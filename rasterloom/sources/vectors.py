"""Read a table of numeric vectors as scanlines: one vector is one image line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_FRAME = 64


def scanlines_from_vectors(spark: SparkSession, sf_dir: str, alpha: bool = False) -> DataFrame:
    """``embeddings`` as 64-line colour frames; the bands are rotations of the vector by 0, 21, 42."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lines = vectors.agg((F.max("vec_id") + 1).alias("n")).scalar()
    frame_id = F.expr(f"vec_id div {LINES_PER_FRAME}")
    width = F.size("embedding")
    level = F.transform(
        "embedding",
        lambda e: F.greatest(
            F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + F.lit(0.4)) * 320))
        ).cast("int"),
    )

    def rotated(shift: int):
        head = F.slice("level", shift + 1, F.col("width") - shift)
        return F.concat(head, F.slice("level", 1, shift)) if shift else F.col("level")

    scan = vectors.select(
        frame_id.alias("frame_id"),
        F.least(F.lit(LINES_PER_FRAME), lines - frame_id * LINES_PER_FRAME)
        .cast("int")
        .alias("height"),
        width.alias("width"),
        (F.col("vec_id") % LINES_PER_FRAME).cast("int").alias("y"),
        level.alias("level"),
    )
    bands = [rotated(0).alias("r"), rotated(21).alias("g"), rotated(42).alias("b")]
    if alpha:
        bands.append(
            F.transform(
                F.sequence(F.lit(0), F.col("width") - 1),
                lambda x: ((x * 4 + F.col("y")) % 256).cast("int"),
            ).alias("a")
        )
    return scan.select("frame_id", "height", "width", "y", *bands)


def grey(scan: DataFrame) -> DataFrame:
    """The first band as a grey raster."""
    return scan.select("frame_id", "height", "width", "y", F.col("r").alias("v"))
