"""Ordered steps over a raster: each step's output is the next step's input."""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.naming import step_name
from rasterloom.model import KEYS, all_bands, to_scanlines
from rasterloom.operators import blocks, lines, pixelwise, resample, stencils, tiles
from rasterloom.operators.passes import Kernel, apply, apply_with_taps, bands_after, fits_one_pass
from rasterloom.sources.raster import read_raster, write_step

Operation = Callable[..., DataFrame]
Chain = Callable[..., list[Kernel]]

#: Operations that keep a frame's size, as chains of kernels: neighbours share a pass.
CHAINS: dict[str, Chain] = {
    "band_swap": tiles.band_swap_chain,
    "bayer_filter": stencils.bayer_filter_chain,
    "blur_circular": stencils.blur_circular_chain,
    "blur_gaussian": stencils.blur_gaussian_chain,
    "buffer_corruption": tiles.buffer_corruption_chain,
    "buffer_corruption_grid": tiles.buffer_corruption_grid_chain,
    "chromatic_aberration": stencils.chromatic_aberration_chain,
    "compression": blocks.compression_chain,
    "compression_artifact": blocks.compression_artifact_chain,
    "corduroy": lines.corduroy_chain,
    "motion_blur": stencils.motion_blur_chain,
    "multi_compress": blocks.multi_compress_chain,
    "noise": pixelwise.noise_chain,
    "salt_pepper": pixelwise.salt_pepper_chain,
    "saturation": pixelwise.saturation_chain,
    "slc_off": lines.slc_off_chain,
}
OPERATIONS: dict[str, Operation] = {"downscale": resample.downscale}
MOST_REPEATS = 100
#: Steps that one pass gives out: a task holds its strip's lines of all of them.
MOST_TOGETHER = 8


@dataclass(frozen=True)
class Step:
    name: str
    operation: str
    params: dict[str, Any] = field(default_factory=dict)
    repeat: int = 1


def parse_steps(config: dict | list) -> list[Step]:
    """Check a step list, or a config with ``pipeline: {steps: [...]}``, and return its steps."""
    if isinstance(config, dict):
        inner = config.get("pipeline", config)
        if not isinstance(inner, dict) or "steps" not in inner:
            raise ValueError("the config must contain 'steps'")
        config = inner["steps"]
    if not config:
        raise ValueError("at least one step is needed")
    steps = []
    for entry in config:
        missing = {"name", "operation"} - set(entry)
        if missing:
            raise ValueError(f"a step needs {', '.join(sorted(missing))}")
        repeat = entry.get("repeat", 1)
        if not isinstance(repeat, int) or isinstance(repeat, bool) or not 1 <= repeat <= MOST_REPEATS:
            raise ValueError(f"repeat must be an integer between 1 and {MOST_REPEATS}")
        params = dict(entry.get("params") or {})
        steps.append(Step(step_name(entry["name"]), entry["operation"], params, repeat))
    return steps


def parse_segment(config: dict) -> tuple[float, float, float]:
    """``(start, end, interval)`` of a config's segment, in seconds."""
    part = config.get("segment")
    if not isinstance(part, dict) or not {"start", "end", "interval"} <= set(part):
        raise ValueError("the segment needs start, end and interval")
    start, end, interval = (float(part[k]) for k in ("start", "end", "interval"))
    if start < 0 or end <= start or interval <= 0:
        raise ValueError("a segment needs 0 <= start < end and a positive interval")
    return start, end, interval


def _accepted(operation: Operation | Chain, step: Step) -> dict[str, Any]:
    """The step's parameters that the operation takes; a missing one is a ValueError."""
    takes = dict(list(inspect.signature(operation).parameters.items())[1:])
    missing = [n for n, p in takes.items() if p.default is p.empty and n not in step.params]
    if missing:
        raise ValueError(f"step {step.name!r}: {step.operation} needs {', '.join(missing)}")
    return {n: v for n, v in step.params.items() if n in takes}


class _Fused:
    """A raster and the kernels still to be run on it; kernels join the last pass while it is not
    too wide."""

    def __init__(self, raster: DataFrame):
        self.raster, self.chain = raster, []

    @property
    def bands(self) -> list[str]:
        return bands_after(all_bands(self.raster), self.chain)

    def add(self, more: list[Kernel]) -> None:
        whole = [*self.chain, *more]
        if self.chain and not fits_one_pass(whole):
            self.raster, whole = self.current(), more
        self.chain = whole

    def current(self) -> DataFrame:
        return apply(self.raster, self.chain)


class _Tapped(_Fused):
    """A raster and passes that also give out the steps that end inside them."""

    def __init__(self, raster: DataFrame):
        super().__init__(raster)
        self.ends: dict[int, list[str]] = {}
        self.parts: list[DataFrame] = []

    def add(self, more: list[Kernel]) -> None:
        if self.chain and not fits_one_pass([*self.chain, *more]):
            self.flush()
        self.chain = [*self.chain, *more]
        if not fits_one_pass(self.chain):  # one operation that is too wide for a pass
            self.flush()

    def end(self, name: str) -> None:
        if self.chain:
            self.ends.setdefault(len(self.chain), []).append(name)
            if len(self.ends) == MOST_TOGETHER:
                self.flush()
        else:
            scan = to_scanlines(self.raster)
            self.parts.append(scan.select(F.lit(name).alias("step"), *KEYS, *all_bands(scan)))

    def flush(self) -> None:
        if self.ends:
            tapped = apply_with_taps(self.raster, self.chain, list(self.ends))
            names = F.create_map(
                *[c for place, held in self.ends.items() for c in (F.lit(place), F.array(*map(F.lit, held)))]
            )
            step = F.explode(F.element_at(names, F.col("tap"))).alias("step")
            self.parts.append(tapped.select(step, *[c for c in tapped.columns if c != "tap"]))
        self.raster, self.chain, self.ends = self.current(), [], {}

    def every(self) -> DataFrame:
        self.flush()
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.parts)


class _Record:
    """What tells that a step is stored whole: a small file that appears by one rename behind the last write."""

    def __init__(self, spark: SparkSession, target: str, stored: str, digest: str):
        self.spark, self.digest = spark, digest
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/done/{stored}")
        self.files = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def holds(self) -> bool:
        if not self.files.exists(self.path):
            return False
        found = self.spark.read.text(self.path.toString()).first()
        return found is not None and found["value"] == self.digest

    def drop(self) -> None:
        self.files.delete(self.path, False)

    def make(self) -> None:
        made = self.spark._jvm.org.apache.hadoop.fs.Path(self.path.getParent(), f".{uuid.uuid4().hex}")
        stream = self.files.create(made)
        stream.write(self.digest.encode())
        stream.close()
        self.files.rename(made, self.path)


def _digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=repr).encode()).hexdigest()


def _stored_names(steps: list[Step], targets: list) -> list[str]:
    """Later namesakes in a folder get one of their own, because they may read the earlier one."""
    seen: list[tuple] = []
    names = []
    for step, target in zip(steps, targets, strict=True):
        earlier = seen.count((step.name, target))
        names.append(f"{step.name}_{earlier:02d}" if earlier else step.name)
        seen.append((step.name, target))
    return names


def _targets(config: dict | list, sink: str | dict | None, steps: list[Step]) -> list[str | None]:
    """The folder of each step: all in ``sink``, or by the config's or the sink's
    ``final_dir`` for the last and ``intermediate_dir`` for the others."""
    named = sink if isinstance(sink, dict) else None
    if sink is None and isinstance(config, dict):
        named = config.get("output") or config.get("pipeline", {}).get("output")
    if named is None:
        return [sink] * len(steps)
    if not {"final_dir", "intermediate_dir"} <= set(named):
        raise ValueError("the output needs final_dir and intermediate_dir")
    return [named["intermediate_dir"]] * (len(steps) - 1) + [named["final_dir"]]


class _Plan:
    """Checked steps with the parameters that their operations take."""

    def __init__(self, config: dict | list, jpeg_between: int | None, extra: dict[str, Operation] | None):
        self.steps, self.own, self.jpeg_between = parse_steps(config), extra or {}, jpeg_between
        self.known = CHAINS | OPERATIONS | self.own
        for step in self.steps:
            if step.operation not in self.known:
                raise KeyError(f"unknown operation {step.operation!r}; known: {', '.join(sorted(self.known))}")
        self.params = {
            id(step): step.params if step.operation in self.own else _accepted(self.known[step.operation], step)
            for step in self.steps
        }

    def is_chain(self, step: Step) -> bool:
        return step.operation in CHAINS and step.operation not in self.own

    def advance(self, state: _Fused, step: Step) -> None:
        operation, given = self.known[step.operation], self.params[id(step)]
        for _ in range(step.repeat):
            if self.is_chain(step):
                state.add(operation(state.bands, **given))
            else:
                if isinstance(state, _Tapped):
                    state.flush()
                state.raster, state.chain = operation(state.current(), **given), []
        if self.jpeg_between is not None:
            state.add(blocks.compression_chain(state.bands, quality=self.jpeg_between))


def all_steps(
    raster: DataFrame, config: dict | list, jpeg_between: int | None = None, extra: dict[str, Operation] | None = None
) -> DataFrame:
    """Every step's scanlines with a column ``step``, as ``run_steps`` makes them, from shared passes.

    A pass gives out the lines of up to ``MOST_TOGETHER`` steps that end in it, so steps are not computed
    again for those behind them; only a pass behind another one, and operations that stand between passes,
    compute what is before them once more. Of steps with one name later ones are numbered. A band that
    some steps lack is null there.
    """
    plan, state = _Plan(config, jpeg_between, extra), _Tapped(raster)
    for step, name in zip(plan.steps, _stored_names(plan.steps, [None] * len(plan.steps)), strict=True):
        plan.advance(state, step)
        state.end(name)
    return state.every()


def _write_together(state: _Tapped, target: str) -> None:
    """One job for all steps that ``state`` holds, each in the folder that ``write_step`` would give it."""
    state.every().write.partitionBy("step").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)


def _run_together(raster: DataFrame, plan: _Plan, targets: list[str]) -> dict[str, DataFrame]:
    spark, results, stored = raster.sparkSession, {}, _stored_names(plan.steps, targets)
    number = 0
    while number < len(plan.steps):
        state, first, target = _Tapped(raster), number, targets[number]
        plan.advance(state, plan.steps[number])
        bands = state.bands
        state.end(stored[number])
        number += 1
        while state.chain and number < len(plan.steps) and targets[number] == target and number - first < MOST_TOGETHER:
            if not plan.is_chain(plan.steps[number]):
                break
            ahead = _Fused(state.raster)
            ahead.chain = list(state.chain)
            plan.advance(ahead, plan.steps[number])
            if ahead.raster is not state.raster or not fits_one_pass(ahead.chain) or ahead.bands != bands:
                break
            plan.advance(state, plan.steps[number])
            state.end(stored[number])
            number += 1
        for i in range(first, number):
            _Record(spark, target, stored[i], "").drop()
        _write_together(state, target)
        for i in range(first, number):
            raster = results[plan.steps[i].name] = read_raster(spark, target, stored[i])
    return results


def run_steps(
    raster: DataFrame,
    config: dict | list,
    sink: str | dict | None = None,
    jpeg_between: int | None = None,
    extra: dict[str, Operation] | None = None,
    together: bool = False,
    resume: str | None = None,
) -> dict[str, DataFrame]:
    """Run every step in order; the result maps step names to rasters (a later namesake wins).

    Steps are chains of kernels, and neighbouring ones, repeats too, share a pass: one map over
    batches of lines, or one shuffle into strips as soon as a kernel reads other lines. A downscale
    and operations from outside stand between passes. ``sink`` is a folder, or a mapping with
    ``final_dir`` and ``intermediate_dir``; the config's ``output`` section serves as such a
    mapping. With one each step is written and read back, so no step is computed twice and a lost
    executor costs one step. ``jpeg_between`` adds a lossy generation of that quality after each
    step. ``extra`` adds operations ``fn(raster, **params) -> raster`` by name; parameters that a
    built-in operation does not know are ignored.

    With ``together`` steps that share a pass, a folder and their bands (at most ``MOST_TOGETHER``) are
    written by one job, which reads the raster once for all of them; one of no lines is run step by step.

    ``resume`` is a name for the raster that tells it from others. With it every stored step leaves a record
    of this name, its own parameters and those of all steps before it, and a run takes over the steps whose
    records fit, up to the first that does not: after a lost driver it goes on behind the last whole step.
    An operation from outside is told by its name and parameters only.
    """
    plan = _Plan(config, jpeg_between, extra)
    targets = _targets(config, sink, plan.steps)
    if (together or resume is not None) and targets[0] is None:
        raise ValueError("steps must be stored to be run together or resumed: give a sink")
    if together and resume is not None:
        raise ValueError("steps that are run together have one job and can't be resumed")
    if together and not raster.isEmpty():
        return _run_together(raster, plan, targets)
    spark, results, state = raster.sparkSession, {}, _Fused(raster)
    going_on, digest = resume is not None, _digest(resume, raster.schema.simpleString(), jpeg_between)
    for step, target, stored in zip(plan.steps, targets, _stored_names(plan.steps, targets), strict=True):
        digest = _digest(digest, step.name, step.operation, step.params, step.repeat)
        record = _Record(spark, target, stored, digest) if target is not None else None
        if going_on and record.holds():
            state = _Fused(read_raster(spark, target, stored))
            results[step.name] = state.current()
            continue
        going_on = False
        plan.advance(state, step)
        if record:
            record.drop()
            write_step(state.current(), target, stored)
            if resume is not None:
                record.make()
            state = _Fused(read_raster(spark, target, stored))
        results[step.name] = state.current()
    return results
