"""A whole run: choose frames from a segment, run the steps, name the outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.naming import DEFAULT_PATTERN, frame_name, output_name
from rasterloom.model import all_bands
from rasterloom.operators.frames import sample_every_seconds, segment
from rasterloom.plans.steps import Step, parse_segment, parse_steps, run_steps
from rasterloom.sources.raster import read_parts

#: Frames of a list that may reach the driver and be broadcast: some hundred kilobytes.
MOST_LISTED = 16_384


def load_config(path: str) -> dict:
    """Read a run's YAML file and check its segment and steps."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    if not isinstance(config, dict):
        raise ValueError("the config must be a mapping")
    parse_segment(config)
    parse_steps(config)
    return config


def choose_frames(
    frames: DataFrame, start: float, end: float, interval: float, pattern: str = DEFAULT_PATTERN
) -> DataFrame:
    """Frames of the output grid: ``frame_id, source_id, video_id, slot, name, ...``.

    One row per ``interval`` seconds of ``start..end``; a source frame may be shown several times
    or not at all, so output frames get ids of their own. ``frames`` has ``frame_id, video_id,
    frame_no, pts`` and may have more.
    """
    shown = sample_every_seconds(segment(frames, start, end), interval, time="t")
    rest = [c for c in shown.columns if c not in ("frame_id", "name")]
    return shown.select(
        F.xxhash64("video_id", "slot").alias("frame_id"),
        F.col("frame_id").alias("source_id"),
        *rest,
        frame_name("video_id", F.col("slot") + 1, F.col("t"), pattern=pattern).alias("name"),
    )


def _listed(chosen: DataFrame) -> list[tuple[int, int]] | None:
    """``(new, source)`` of all chosen frames if there are at most ``MOST_LISTED``, else None."""
    rows = chosen.select("frame_id", "source_id").limit(MOST_LISTED + 1).collect()
    return None if len(rows) > MOST_LISTED else [tuple(r) for r in rows]


def take_frames(raster: DataFrame, chosen: DataFrame) -> DataFrame:
    """The raster of the chosen frames, under their new ids.

    A list of at most ``MOST_LISTED`` frames is worked out at once: the raster's scan is filtered by its
    ids and its lines meet the list where they are, without a shuffle. A longer one is joined as it
    comes; adaptive execution splits a frame with very many lines.
    """
    listed, ids = _listed(chosen), chosen.select(F.col("frame_id").alias("_new"), F.col("source_id").alias("frame_id"))
    if listed is not None:
        raster = raster.where(F.col("frame_id").isin(sorted({source for _, source in listed})))
        ids = F.broadcast(raster.sparkSession.createDataFrame(listed, ids.schema))
    kept = [c for c in raster.columns if c not in ("frame_id", *all_bands(raster))]
    return raster.join(ids, "frame_id").select(
        F.col("_new").alias("frame_id"), *kept, *all_bands(raster)
    )


def take_stored(spark: SparkSession, folder: str, step: str, chosen: DataFrame) -> DataFrame:
    """``take_frames`` from a store cut by frames (``write_parts``): of a short list's parts alone."""
    listed = _listed(chosen)
    frames = None if listed is None else {source for _, source in listed}
    return take_frames(read_parts(spark, folder, step, frames), chosen)


def run(frames: DataFrame, raster: DataFrame, config: dict, **options) -> dict[str, DataFrame]:
    """Choose the config's segment and run its steps; ``chosen`` in the result lists the frames.

    An ``output`` section of the config says where steps are stored (``run_steps``).
    """
    chosen = choose_frames(frames, *parse_segment(config))
    return {"chosen": chosen} | run_steps(take_frames(raster, chosen), config, **options)


def output_files(frames: DataFrame, config: dict | list) -> DataFrame:
    """Every file a run names: ``step_no, step, folder, frame_id, name``.

    A step's names are built on the previous step's, the last step goes to ``final``, and frames
    are ordered by name within a step.
    """
    steps: list[Step] = parse_steps(config)
    parts = []
    name = F.col("name")
    for number, step in enumerate(steps):
        name = output_name(name, step.name, number)
        last = number == len(steps) - 1
        parts.append(
            frames.select(
                F.lit(number).alias("step_no"),
                F.lit(step.name).alias("step"),
                F.lit("final" if last else f"intermediate/{step.name}").alias("folder"),
                "frame_id",
                name.alias("name"),
            )
        )
    return reduce(DataFrame.unionAll, parts)
