"""Frame selection and video columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.positions import explode_range, number_within
from rasterloom.model import check_range

DEFAULT_FPS = 30  # fixed value: assumed when a video's own rate is unknown
SLOT_PART = 4096  # output slots handled together when looking for a video's next frame


def segment(frames: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Frames with ``start <= pts < end``, with ``t`` counted from ``start``.

    Without ``start`` the whole video is kept, whatever ``end`` says.
    """
    if start is None:
        return frames.withColumn("t", F.col("pts"))
    check_range("start", start, 0.0, float("inf"))
    kept = frames.where(F.col("pts") >= F.lit(float(start)))
    if end is not None:
        if end <= start:
            raise ValueError("end must be after start")
        kept = kept.where(F.col("pts") < F.lit(float(end)))
    return kept.withColumn("t", F.col("pts") - F.lit(float(start)))


def number_frames(frames: DataFrame, tie: str, part_seconds: float = 600.0) -> DataFrame:
    """Add ``frame_no``: 0-based position within the video by ``pts``, then ``tie``.

    A video is sorted in pieces of ``part_seconds``, so a very long one is spread over tasks.
    """
    part = F.floor(F.col("pts") / F.lit(float(part_seconds))).cast("long")
    return number_within(frames, ["video_id"], ["pts", tie], part, "frame_no")


def sample_nth(frames: DataFrame, n: int) -> DataFrame:
    """Every n-th frame by ``frame_no``: a plain filter."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"frame interval must be a positive integer, got {n!r}")
    return frames.where(F.col("frame_no") % n == 0)


def sample_fps(frames: DataFrame, fps: float, time: str = "pts", tie: str = "frame_no") -> DataFrame:
    """Resample each video to a fixed rate, dropping and repeating frames.

    Slot ``k`` shows the latest frame whose rounded time is at most ``k``. The latest frame per
    slot is an aggregate; the next used slot is looked up within parts of 4 096 slots and, at a
    part's end, from the first slots of the parts. So neither step gathers a whole video.
    """
    check_range("fps", fps, 1e-9, float("inf"))
    slot = F.floor(F.col(time) * F.lit(float(fps)) + F.lit(0.5)).cast("long")
    rest = [c for c in frames.columns if c not in ("video_id", time, tie)]
    latest = (
        frames.withColumn("slot", slot)
        .groupBy("video_id", "slot")
        .agg(F.max(F.struct(time, tie, *rest)).alias("f"))
        .withColumn("_part", F.floor(F.col("slot") / SLOT_PART))
    )
    first = latest.groupBy("video_id", "_part").agg(F.min("slot").alias("_first"))
    following = Window.partitionBy("video_id").orderBy("_part")
    later = first.select(
        "video_id", "_part", F.lead("_first").over(following).alias("_later")
    )
    inside = Window.partitionBy("video_id", "_part").orderBy("slot")
    spans = (
        latest.withColumn("_next", F.lead("slot").over(inside))
        .join(later, ["video_id", "_part"])
        .withColumn("_end", F.coalesce("_next", "_later", F.col("slot") + 1) - 1)
    )
    shown = explode_range(spans, F.col("slot"), F.col("_end"), "shown")
    return shown.select("video_id", F.col("shown").alias("slot"), "f.*")


def sample_every_seconds(frames: DataFrame, interval: float, **kwargs) -> DataFrame:
    """One frame every ``interval`` seconds: a rate of ``1/interval``."""
    check_range("interval", interval, 1e-9, float("inf"))
    return sample_fps(frames, 1.0 / interval, **kwargs)


def sample(
    frames: DataFrame, fps: float | None = None, frame_interval: int | None = None
) -> DataFrame:
    """By rate or by every n-th frame; exactly one must be given."""
    if (fps is None) == (frame_interval is None):
        raise ValueError("give exactly one of fps and frame_interval")
    return sample_fps(frames, fps) if fps is not None else sample_nth(frames, frame_interval)


def estimate_frames(
    videos: DataFrame, fps: float | None = None, frame_interval: int | None = None
) -> DataFrame:
    """Add ``estimated_frames`` for a sampling rate or a frame interval."""
    if (fps is None) == (frame_interval is None):
        raise ValueError("give exactly one of fps and frame_interval")
    if fps is not None:
        estimate = (F.col("duration") * F.lit(float(fps))).cast("long")
    else:
        own = F.coalesce(F.nullif(F.col("fps").cast("double"), F.lit(0.0)), F.lit(float(DEFAULT_FPS)))
        total = (F.col("duration") * own).cast("long")
        estimate = F.floor(total / F.lit(int(frame_interval))).cast("long")
    return videos.withColumn("estimated_frames", estimate)


def expected_frames(segments: DataFrame) -> DataFrame:
    """Add ``expected_frames``: segment length over interval, rounded down."""
    length = (F.col("end") - F.col("start")) / F.col("interval")
    return segments.withColumn("expected_frames", F.floor(length).cast("long"))


def with_resolution(videos: DataFrame) -> DataFrame:
    """Add ``resolution`` as ``WxH``, null unless both sides are known and not zero."""
    known = (F.col("width") != 0) & (F.col("height") != 0)
    return videos.withColumn(
        "resolution", F.when(known, F.concat_ws("x", F.col("width"), F.col("height")))
    )


def with_duration_str(videos: DataFrame) -> DataFrame:
    """Add ``duration_str`` as HH:MM:SS of whole seconds; hours may pass 24."""
    s = F.col("duration").cast("long")
    parts = [F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60]
    return videos.withColumn("duration_str", F.format_string("%02d:%02d:%02d", *parts))


def normalize_videos(raw: DataFrame, default_format: str = "mp4") -> DataFrame:
    """Raw download metadata to the ``videos`` schema; a missing column counts as null."""
    types = {"duration": "double", "width": "int", "height": "int", "fps": "double"}
    types |= {"filesize": "long", "filesize_approx": "long"}

    def field(name: str) -> Column:
        kind = types.get(name, "string")
        return (F.col(name) if name in raw.columns else F.lit(None)).cast(kind)

    return raw.select(
        F.coalesce(field("id"), F.lit("unknown")).alias("video_id"),
        F.coalesce(field("title"), F.lit("Unknown")).alias("title"),
        F.coalesce(field("duration"), F.lit(0.0)).alias("duration"),
        field("width").alias("width"),
        field("height").alias("height"),
        field("fps").alias("fps"),
        F.coalesce(field("ext"), F.lit(default_format)).alias("format"),
        F.coalesce(F.nullif(field("filesize"), F.lit(0).cast("long")), field("filesize_approx"))
        .alias("file_size"),
        field("file_path").alias("file_path"),
        field("thumbnail").alias("thumbnail_url"),
        field("uploader").alias("uploader"),
        field("upload_date").alias("upload_date"),
    )


def pick_format(formats: DataFrame, quality: str = "best", container: str = "mp4") -> DataFrame:
    """The format to download per video: ``best``, ``worst`` or a height such as ``720p``.

    A format that fits the height and the container is preferred, then one that fits the
    height, then any. ``formats`` has ``video_id, format_id, height, ext``; ids are numbers or
    text, ties go to the smaller one, and an unknown height comes last. One aggregate per video,
    combined before the shuffle.
    """
    match = re.fullmatch(r"(\d+)p", quality)
    fits = F.coalesce(F.col("ext") == container, F.lit(False))
    tier = F.when(fits, F.lit(0)).otherwise(F.lit(1))
    if match:
        within = F.coalesce(F.col("height") <= int(match.group(1)), F.lit(False))
        tier = F.when(within & fits, F.lit(0)).when(within, F.lit(1)).otherwise(F.lit(2))
    size = F.col("height").cast("long")
    key = F.struct(
        tier.alias("tier"),
        F.coalesce(size if quality == "worst" else -size, F.lit((1 << 63) - 1)).alias("rank"),
        F.col("format_id"),
        F.col("ext"),
        F.col("height"),
    )
    return formats.groupBy("video_id").agg(F.min(key).alias("k")).select(
        "video_id", "k.format_id", "k.height", "k.ext"
    )
