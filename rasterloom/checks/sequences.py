"""Queries and SQL checks: ordered steps, repeats, the step store and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.checks import constants, neighbourhood, pointwise, sql, transform
from rasterloom.checks.pointwise import colour, out
from rasterloom.model import frames_of, to_pixels
from rasterloom.operators import lines, tiles
from rasterloom.plans import presets, runs
from rasterloom.plans.steps import all_steps, run_steps
from rasterloom.session import shared_folder
from rasterloom.sources.raster import read_raster, write_parts, write_step
from rasterloom.streaming import scanstream


def last_of(config, **options):
    """The last step's raster."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        scan = colour(spark, d)
        return out(list(run_steps(scan, config, **options).values())[-1])

    return run


def every_step(spark: SparkSession, d: str) -> DataFrame:
    """All steps of a list, with their names, from one pass."""
    made = all_steps(colour(spark, d), presets.WORN_PRINT)
    tall = to_pixels(made.withColumn("frame_id", F.struct("frame_id", "step")))
    return tall.select("frame_id.frame_id", "y", "x", "r", "g", "b", "frame_id.step")


def stored_steps(spark: SparkSession, d: str) -> DataFrame:
    """Write every step, the last one apart, and read both stores back."""
    folder = shared_folder(spark, "steps")
    places = {"intermediate_dir": f"{folder}/intermediate", "final_dir": f"{folder}/final"}
    run_steps(colour(spark, d), {"steps": presets.DRIFTING_TAPE, "output": places})
    total = [F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v).alias(b) for b in "rgb"]
    parts = [
        read_raster(spark, at).select(F.lit(kind).alias("folder"), "step", "frame_id", "y", *total)
        for kind, at in (("intermediate", places["intermediate_dir"]), ("final", places["final_dir"]))
    ]
    return parts[0].unionAll(parts[1])


def _stream(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str]:
    folder = shared_folder(spark, name)
    write_step(colour(spark, d), folder, "source")
    source = read_raster(spark, folder, "source")
    return scanstream.read_scanline_stream(spark, f"{folder}/step=source", source.schema), folder


def streamed_mask(spark: SparkSession, d: str) -> DataFrame:
    """Scan-line gaps and band swaps on a stream of scanlines."""
    stream, folder = _stream(spark, d, "stream")

    def change(df: DataFrame) -> DataFrame:
        gapped = lines.slc_off(df, gap_width=0.22, scan_period=14)
        return tiles.band_swap(gapped, 15, "BGR", (0.1, 0.5), seed=42)

    scanstream.write_stateless(
        stream, change, f"{folder}/out", f"{folder}/checkpoint"
    ).awaitTermination()
    return out(spark.read.parquet(f"{folder}/out"))


def streamed_lines(spark: SparkSession, d: str) -> DataFrame:
    """A whole list of line steps on the stream itself."""
    stream, folder = _stream(spark, d, "lines")
    scanstream.write_stateless(
        stream,
        lambda df: run_steps(df, presets.LINE_FAULTS)["cells"],
        f"{folder}/out",
        f"{folder}/checkpoint",
    ).awaitTermination()
    return out(spark.read.parquet(f"{folder}/out"))


def streamed_steps(spark: SparkSession, d: str) -> DataFrame:
    """A step list with neighbourhood work on each micro-batch, every step kept."""
    stream, folder = _stream(spark, d, "batches")
    scanstream.run_steps_on_stream(
        stream, presets.DRIFTING_TAPE, f"{folder}/out", f"{folder}/checkpoint"
    ).awaitTermination()
    steps = [s["name"] for s in presets.DRIFTING_TAPE]
    parts = [
        out(spark.read.parquet(f"{folder}/out/batch=*/step={name}")).withColumn("step", F.lit(name))
        for name in steps
    ]
    return reduce(DataFrame.unionAll, parts)


def streamed_frames(spark: SparkSession, d: str) -> DataFrame:
    """The same list on batches that split frames: files hold every fourth line, and a batch is one file."""
    folder = shared_folder(spark, "split")
    scan = colour(spark, d)
    for part in range(4):
        scan.where(F.col("y") % 4 == part).coalesce(1).write.parquet(f"{folder}/source/part={part}")
    stream = scanstream.read_scanline_stream(spark, f"{folder}/source/*", scan.schema, files_per_batch=1)
    scanstream.run_steps_on_frames(stream, presets.DRIFTING_TAPE, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    parts = [
        out(spark.read.parquet(f"{folder}/out/batch=*/step={s['name']}")).withColumn("step", F.lit(s["name"]))
        for s in presets.DRIFTING_TAPE
    ]
    return reduce(DataFrame.unionAll, parts)


def without_seeds(spark: SparkSession, d: str) -> DataFrame:
    """What holds whatever is drawn: pixels masked, pixels changed outside the mask, and whether the
    hits and the striped rows stay within their numbers."""
    scan = colour(spark, d)
    gaps = {"gap_width": 0.3, "scan_period": 7}
    steps = {
        "gaps": ("slc_off", {**gaps, "fill_mode": "mean"}),
        "dust": ("salt_pepper", {"amount": 0.05}),
        "rows": ("corduroy", {"strength": 1.0, "orientation": "horizontal", "density": 0.4}),
    }
    bounds = lines.with_gaps(scan.select("frame_id", "height", "width", "y"), **gaps)
    met = out(scan).join(bounds.select("frame_id", "height", "width", "y", "gap_from", "gap_to"), ["frame_id", "y"])
    for name, (operation, params) in steps.items():
        changed = run_steps(scan, [{"name": name, "operation": operation, "params": params}])[name]
        other = out(changed).select("frame_id", "y", "x", F.struct("r", "g", "b").alias(name))
        met = met.join(other, ["frame_id", "y", "x"])
    own = F.struct("r", "g", "b")
    inside = (F.col("x") >= F.col("gap_from")) & (F.col("x") < F.col("gap_to"))
    noisy = F.col("dust") != own
    extreme = (F.col("dust.r") % 255 == 0) & (F.col("dust.r") == F.col("dust.g")) & (F.col("dust.r") == F.col("dust.b"))

    def count(condition) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    rows = met.groupBy("frame_id", "y", "height", "width").agg(
        count(inside).alias("masked"),
        count(~inside & (F.col("gaps") != own)).alias("strays"),
        count(noisy).alias("hits"),
        count(noisy & ~extreme).alias("odd_hits"),
        F.max(F.when(F.col("rows") != own, 1).otherwise(0)).alias("striped"),
    )
    return rows.groupBy("frame_id").agg(
        F.sum("masked").alias("masked"),
        F.sum("strays").alias("strays"),
        (F.sum("hits") <= (F.max("height") * F.max("width") * F.lit(0.05)).cast("int")).cast("int").alias("few_hits"),
        F.sum("odd_hits").alias("odd_hits"),
        (F.sum("striped") <= (F.max("height") * F.lit(0.4)).cast("int")).cast("int").alias("few_rows"),
    )


SEGMENT_RUN = {
    "segment": {"start": 0.04, "end": 0.4, "interval": 0.02},
    "pipeline": {"steps": [
        {"name": "muted", "operation": "saturation", "params": {"mode": "fixed", "value": -0.5}},
        {"name": "smear", "operation": "motion_blur", "params": {"kernel_size": 5}},
    ]},
}


def film(spark: SparkSession, d: str) -> DataFrame:
    """The raster's frames as two videos of 25 frames per second."""
    number = F.floor(F.col("frame_id") / 2)
    return frames_of(colour(spark, d)).select(
        "frame_id",
        F.concat(F.lit("v"), F.col("frame_id") % 2).alias("video_id"),
        number.alias("frame_no"),
        (number * F.lit(0.04)).alias("pts"),
    )


def segment_run(spark: SparkSession, d: str) -> DataFrame:
    """Half the frame interval shows each frame of the segment twice, then two steps."""
    results = runs.run(film(spark, d), colour(spark, d), SEGMENT_RUN)
    shown = results["chosen"].select("frame_id", "video_id", "slot")
    return out(results["smear"]).join(shown, "frame_id").drop("frame_id")


def segment_of_store(spark: SparkSession, d: str) -> DataFrame:
    """The same run on a store cut by frames: only the parts with frames of the segment are read."""
    folder = shared_folder(spark, "parts")
    write_parts(colour(spark, d), folder, "source", parts=16)
    chosen = runs.choose_frames(film(spark, d), 0.04, 0.4, 0.02)
    results = run_steps(runs.take_stored(spark, folder, "source", chosen), SEGMENT_RUN)
    return out(results["smear"]).join(chosen.select("frame_id", "video_id", "slot"), "frame_id").drop("frame_id")


def steps_together(spark: SparkSession, d: str) -> DataFrame:
    """Steps stored by one job, each read back from its own folder."""
    results = run_steps(colour(spark, d), presets.DRIFTING_TAPE, sink=shared_folder(spark, "together"), together=True)
    return reduce(DataFrame.unionAll, [out(df).withColumn("step", F.lit(n)) for n, df in results.items()])


def segment_files(spark: SparkSession, d: str) -> DataFrame:
    """The file names of that run, step by step."""
    chosen = runs.choose_frames(film(spark, d), 0.04, 0.4, 0.02)
    return runs.output_files(chosen, SEGMENT_RUN).drop("frame_id")


def queries() -> dict:
    return {
        "x1_segment_run": segment_run,
        "s2_segment_of_store": segment_of_store,
        "s4_output_files": segment_files,
        "x1_steps_together": steps_together,
        "x1_glitch_art": last_of(presets.GLITCH_ART),
        "x1_small_sensor": last_of(presets.SMALL_SENSOR),
        "x1_every_step": every_step,
        "x1_jpeg_between": last_of(presets.WORN_PRINT[:2], jpeg_between=95),
        "x2_repeat_compression": last_of(presets.COPIES_OF_COPIES),
        "s2_s3_stored_steps": stored_steps,
        "x1_unseeded_steps": without_seeds,
        "stream_stateless": streamed_mask,
        "stream_line_steps": streamed_lines,
        "stream_micro_batches": streamed_steps,
        "stream_split_frames": streamed_frames,
    }


def chain(*checks: str) -> str:
    """SQL that feeds each check's result to the next one's ``px``, whose frames may be smaller."""
    parts, previous = [f"{sql.PX}"], None
    for i, check in enumerate(checks):
        if previous is not None:
            check = check.replace(
                sql.PX,
                f"""
fr AS MATERIALIZED (SELECT frame_id, (max(y)+1)::INT AS h, (max(x)+1)::INT AS w FROM {previous} GROUP BY frame_id),
px AS MATERIALIZED (SELECT s.frame_id, s.y, s.x, s.r, s.g, s.b, 0 AS a, f.h, f.w
  FROM {previous} s JOIN fr f ON f.frame_id=s.frame_id)""",
            )
        previous = f"step{i}"
        parts.append(f"{previous} AS MATERIALIZED ({check})")
    return f"WITH {', '.join(parts)} SELECT frame_id, y, x, r, g, b FROM {previous}"


def _generation_check(quality: int, cell: tuple[int, int] = (2, 2)) -> str:
    return transform._colour([quality], cell)


def _artifact_check(params: dict) -> str:
    lo, hi = params["tile_size_range"]
    ctes, last = transform.artifact_chain("src", params["tile_count"], params["quality"])
    return f"""
WITH {sql.PX}, {pointwise.tile_cte(params['tile_count'], lo, hi, params['seed'])}, {transform.BASIS},
src AS MATERIALIZED (SELECT frame_id, y, x, r, g, b FROM px), {ctes}
SELECT frame_id, y, x, r, g, b FROM {last}"""


def _motion_check(size: int, angle: float) -> str:
    if angle == 0:
        return neighbourhood._box_blur(size, alpha=False)
    return neighbourhood._stencil(constants.turned_line(size, float(angle)), "sum(t.k*s.v)::BIGINT>>16")


def _noisy(shift: str) -> str:
    return pointwise._px(pointwise._noise(shift, "rgb"))


def oracles() -> dict[str, str]:
    p = [s["params"] for s in presets.GLITCH_ART]
    row = sql.uniform(11, "row", "y", "{i}")
    worn = [
        pointwise._saturation(f"{1.0 + 0.35!r}::DOUBLE"),
        neighbourhood._gaussian(1.5, grey=False),
        _noisy(f"({row}*2.0::DOUBLE-1.0::DOUBLE)*{0.08 * 255.0!r}::DOUBLE"),
    ]
    drifting = [
        neighbourhood._shifted(2, -1, alpha=False),
        _motion_check(6, 120),
        pointwise._stripes("w", "x", 0.4, 0.6, 8),
        _generation_check(45, (1, 2)),
    ]
    named = " UNION ALL ".join(
        f"SELECT *, '{s['name']}' AS step FROM ({chain(*worn[: i + 1])})"
        for i, s in enumerate(presets.WORN_PRINT)
    )
    kept = " UNION ALL ".join(
        f"SELECT *, '{s['name']}' AS step FROM ({chain(*drifting[: i + 1])})"
        for i, s in enumerate(presets.DRIFTING_TAPE)
    )
    stored = (
        "SELECT CASE WHEN step='copy' THEN 'final' ELSE 'intermediate' END AS folder, step, frame_id, y, "
        f"sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM ({kept}) GROUP BY step, frame_id, y"
    )
    shown = """
film AS (SELECT frame_id, 'v'||(frame_id%2) AS video_id, (frame_id//2)*0.04::DOUBLE AS pts FROM fr),
s AS (SELECT *, floor((pts-0.04::DOUBLE)*50.0::DOUBLE+0.5::DOUBLE)::BIGINT AS k FROM film WHERE pts>=0.04 AND pts<0.4),
grid AS (SELECT video_id, unnest(range(lo, hi+1))::BIGINT AS slot FROM
  (SELECT video_id, min(k) AS lo, max(k) AS hi FROM s GROUP BY video_id)),
chosen AS (SELECT g.video_id, g.slot, s.frame_id FROM grid g ASOF JOIN s ON s.video_id=g.video_id AND g.slot>=s.k)"""
    stem = "video_id||'_frame_'||lpad((slot+1)::VARCHAR,6,'0')"
    segment = f"""
WITH {sql.PX}, done AS MATERIALIZED ({chain(pointwise._saturation('0.5::DOUBLE'), _motion_check(5, 0))}), {shown}
SELECT video_id, slot, y, x, r, g, b FROM done JOIN chosen USING (frame_id)"""
    return {
        "x1_segment_run": segment,
        "s2_segment_of_store": segment,
        "x1_steps_together": kept,
        "s4_output_files": f"""
WITH {sql.PX}, {shown}
SELECT 0 AS step_no, 'muted' AS step, 'intermediate/muted' AS folder, 'muted_'||{stem}||'_step00.jpg' AS name FROM chosen
UNION ALL SELECT 1, 'smear', 'final', 'smear_muted_'||{stem}||'_step00_step01.jpg' FROM chosen""",
        "x1_glitch_art": chain(
            pointwise._gap_fill(0.5, 8, "255"),
            pointwise._band_swap(15, 0.1, 0.3, 42, (2, 1, 0)),
            pointwise._shuffle(10, 0.05, 0.25, 100, 1.0),
            pointwise._stripes("h", "y", 0.8, 1.0, 200),
            pointwise._salt_pepper(0.005, 0.5, 300),
            _artifact_check(p[5]),
        ),
        "x1_small_sensor": chain(
            _noisy(pointwise._normal(21, "gaussian") + f"*{0.06 * 255.0!r}::DOUBLE"),
            neighbourhood._downscale(0.5, "box"),
            neighbourhood._bayer("GBRG"),
            _generation_check(35),
        ),
        "x1_every_step": named,
        "x1_jpeg_between": chain(worn[0], _generation_check(95), worn[1], _generation_check(95)),
        "x1_unseeded_steps": f"""
WITH {sql.PX}, {pointwise._gap_ctes(0.3, 7)}
SELECT fr.frame_id, coalesce(sum(gap_to-gap_from) FILTER (gap_from<gap_to),0)::BIGINT AS masked, 0::BIGINT AS strays,
  1::INT AS few_hits, 0::BIGINT AS odd_hits, 1::INT AS few_rows
FROM fr LEFT JOIN mask USING (frame_id) GROUP BY fr.frame_id""",
        "x2_repeat_compression": chain(*[_generation_check(55)] * 10),
        "s2_s3_stored_steps": stored,
        "stream_stateless": chain(
            pointwise._gap_fill(0.22, 14, "0"), pointwise._band_swap(15, 0.1, 0.5, 42, (2, 1, 0))
        ),
        "stream_line_steps": chain(
            pointwise._salt_pepper(0.04, 0.7, 31),
            pointwise._stripes("w", "x", 0.25, 0.9, 32),
            pointwise._stripes("h", "y", 0.5, 0.5, 33),
            pointwise._grid("xor", 9, 0.3, 63, 34),
        ),
        "stream_micro_batches": kept,
        "stream_split_frames": kept,
    }
