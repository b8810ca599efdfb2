"""Frames of videos on a stream, resampled to a fixed rate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.model import check_range
from rasterloom.operators.frames import sample_fps

AXIS_START = 1 << 31


def write_sampled(
    frames: DataFrame, fps: float, delay: float, target: str, checkpoint: str, time: str = "pts", tie: str = "frame_no"
) -> StreamingQuery:
    """``sample_fps`` on a stream of frames in any order, appended below ``target/frames/batch=<id>``.

    The latest frame of a slot is a windowed aggregate: it is given out when the watermark, ``delay``
    seconds behind the latest frame of all videos, has passed its slot. A slot without a frame repeats the
    one before it as soon as a later slot is given out; for that the last frame of each video is state, a
    table below ``last/batch=<id>`` that the next batch reads. So the stream's result is the batch result up to the last
    slot that the watermark has passed. Frames behind the watermark are left out and counted
    (``late_frames``); frames without a time are left out. A batch depends on the table of the one before
    only, and replaces its own folders when it runs again.
    """
    check_range("fps", fps, 1e-9, float("inf"))
    check_range("delay", delay, 0, float("inf"))
    rest = [c for c in frames.columns if c not in ("video_id", time, tie)]
    columns = ["video_id", time, tie, *rest]
    # Slots stand a second apart on the watermark's axis, which is exact at any rate, and behind its start.
    slot = F.floor(F.col(time) * F.lit(float(fps)) + F.lit(0.5)).cast("long")
    latest = (
        frames.withColumn("_slot", F.timestamp_seconds(slot + AXIS_START))
        .withWatermark("_slot", f"{math.ceil(delay * fps)} seconds")
        .groupBy("video_id", "_slot")
        .agg(F.max(F.struct(time, tie, *rest)).alias("_f"))
        .select("video_id", "_f.*")
    )

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = known = batch.select(*columns, F.lit(False).alias("_shown")).persist()
        try:
            if batch_id > 0:
                known = known.unionByName(spark.read.parquet(f"{target}/last/batch={batch_id - 1}"))
            shown = sample_fps(known, fps, time=time, tie=tie)
            own = F.floor(F.col(time) * F.lit(float(fps)) + F.lit(0.5)).cast("long")
            fresh = shown.where(~F.col("_shown") | (F.col("slot") != own)).drop("_shown")
            fresh.write.mode("overwrite").parquet(f"{target}/frames/batch={batch_id}")
            last = known.groupBy("video_id").agg(F.max(F.struct(time, tie, *rest)).alias("_f"))
            last.select("video_id", "_f.*", F.lit(True).alias("_shown")).write.mode("overwrite").parquet(
                f"{target}/last/batch={batch_id}"
            )
        finally:
            held.unpersist()

    return (
        latest.writeStream.foreachBatch(one_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_frames(query: StreamingQuery) -> int:
    """Slots' frames that came behind the watermark, over the batches that the query still reports."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
