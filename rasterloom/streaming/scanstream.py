"""Raster work on a stream of scanlines.

Per-pixel, per-line and tile operators keep nothing between rows, so they run on a streaming
table as they are. Operators that gather neighbours run on whole frames: either a batch must hold
whole ones (``run_steps_on_stream``; one that lacks lines of a frame fails with that frame's name), or
lines wait in a table until their frame is whole (``run_steps_on_frames``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.model import KEYS, all_bands, check_range, to_scanlines
from rasterloom.plans.steps import run_steps


def read_scanline_stream(
    spark: SparkSession, folder: str, schema, files_per_batch: int = 64
) -> DataFrame:
    """Scanlines from Parquet files as they arrive."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def write_stateless(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append ``transform(stream)`` to Parquet until the files at hand are done."""
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_steps_on_stream(
    stream: DataFrame, config: dict | list, target: str, checkpoint: str, **options
) -> StreamingQuery:
    """Run the steps on each micro-batch of whole frames, and keep every step.

    A batch's steps go to ``step=<name>`` folders below ``batch=<id>``, each written once and read by
    the next; a batch that is run again after a failure replaces its folders, so results appear
    exactly once.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        run_steps(batch, config, sink=f"{target}/batch={batch_id}", **options)

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _waiting(spark: SparkSession, target: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{target}/waiting/batch={batch_id}") if batch_id >= 0 else None


def _without_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def run_steps_on_frames(
    stream: DataFrame, config: dict | list, target: str, checkpoint: str, most_batches: int = 64, **options
) -> StreamingQuery:
    """Run the steps on a stream whose batches may split frames: a frame is worked on in the batch that brings
    its last line.

    Lines of frames that are not whole yet are state, a table below ``waiting/batch=<id>`` that the next
    batch reads: it grows with the frames under way, not with the stream, and any number of executors
    shares it. A frame whose first line came over ``most_batches`` batches ago is given up:
    ``incomplete/batch=<id>`` has its ``frame_id, height, lines``, and lines that come later start it anew.
    Steps go to ``batch=<id>/step=<name>``, for batches in which a frame became whole. A batch depends on the
    table of the one before only, which stays until the next is done, so one that runs again after a
    failure gives the same results in the same folders. When the stream stops, what waits is kept for its
    next start. A line that comes twice while its frame waits is an error that names the frame.
    """
    check_range("most_batches", most_batches, 0, float("inf"))

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, scan = batch.sparkSession, to_scanlines(batch).persist()
        try:
            lines = scan.select(*KEYS, *all_bands(scan), F.lit(batch_id).cast("long").alias("since"))
            before = _waiting(spark, target, batch_id - 1)
            if before is not None:
                lines = lines.unionByName(before)
            frames = lines.groupBy("frame_id").agg(
                F.max("height").alias("_height"),
                F.count("*").alias("_lines"),
                F.count_distinct("y").alias("_places"),
                F.min("since").alias("_since"),
            )
            twice = F.raise_error(F.concat(F.lit("a line came twice: frame "), F.col("frame_id").cast("string")))
            state = (
                F.when(F.col("_lines") > F.col("_places"), twice.cast("string"))
                .when(F.col("_lines") == F.col("_height"), "whole")
                .when(F.col("_since") < batch_id - most_batches, "given up")
                .otherwise("waits")
            )
            told = frames.withColumn("_state", state).persist()
            try:
                given_up = told.where("_state = 'given up'")
                given_up.select("frame_id", F.col("_height").alias("height"), F.col("_lines").alias("lines")).write.mode(
                    "overwrite"
                ).parquet(f"{target}/incomplete/batch={batch_id}")

                def of(name: str) -> DataFrame:
                    return lines.join(told.where(F.col("_state") == name).select("frame_id"), "frame_id", "left_semi")

                of("waits").write.mode("overwrite").parquet(f"{target}/waiting/batch={batch_id}")
                whole = of("whole").drop("since")
                if not told.where("_state = 'whole'").isEmpty():
                    run_steps(whole, config, sink=f"{target}/batch={batch_id}", **options)
            finally:
                told.unpersist()
        finally:
            scan.unpersist()
        if batch_id > 1:
            _without_folder(spark, f"{target}/waiting/batch={batch_id - 2}")

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
