"""Runs: frames chosen from a store, steps that share a pass or a job, and going on after a loss."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import strips
from rasterloom.plans import presets
from rasterloom.plans.runs import take_frames, take_stored
from rasterloom.plans.steps import all_steps, run_steps
from rasterloom.sources.raster import read_parts, read_raster, write_parts, write_step


def picture(height, width, seed, bands="rgb"):
    rng = np.random.default_rng(seed)
    return {b: rng.integers(0, 256, (height, width)) for b in bands}


def same(got, want):
    assert got.keys() == want.keys()
    for f in want:
        assert got[f].keys() == want[f].keys()
        assert all((got[f][b] == want[f][b]).all() for b in want[f])


def plan_of(df):
    df = df.select("*")  # a plan that has run before shows no metrics
    df.collect()
    return df._jdf.queryExecution().executedPlan()


def files_read(df):
    """Files that the scans of a plan open, by their own metric."""
    plan, total = plan_of(df), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        found = node.metrics().get("numFiles")
        if found.isDefined():
            total += found.get().value()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return total


def test_parts_hold_ranges_and_a_segment_reads_its_own(raster, planes, spark, tmp_path):
    pictures = {i * 3 - 20: picture(4 + i % 3, 5, i) for i in range(40)}
    pictures[50] = picture(300, 5, 99)  # one frame with most lines
    scan = raster(pictures)
    write_parts(scan, str(tmp_path), "one", parts=12)
    same(planes(read_parts(spark, str(tmp_path), "one")), planes(scan))
    whole = files_read(read_parts(spark, str(tmp_path), "one"))
    few = read_parts(spark, str(tmp_path), "one", [-20, -17, 1000])
    same(planes(few), planes(scan.where("frame_id IN (-20, -17)")))
    assert 0 < files_read(few) <= whole / 4
    assert read_parts(spark, str(tmp_path), "one", []).count() == 0
    chosen = spark.createDataFrame([(7, -20), (8, -20), (9, -17), (10, 5000)], "frame_id long, source_id long")
    taken = take_stored(spark, str(tmp_path), "one", chosen)
    got, held = planes(taken), planes(scan)
    assert got.keys() == {7, 8, 9}
    assert all((got[n][b] == held[s][b]).all() for n, s in ((7, -20), (8, -20), (9, -17)) for b in "rgb")
    assert 0 < files_read(taken) <= whole / 4


@pytest.mark.parametrize("parts", [1, 5])
def test_parts_of_no_and_of_single_frames(raster, planes, spark, tmp_path, parts):
    scan = raster({3: picture(6, 4, 1, "rgba")})
    write_parts(scan, str(tmp_path), "one", parts=parts)
    same(planes(read_parts(spark, str(tmp_path), "one", [3])), planes(scan))
    write_parts(scan.where("false"), str(tmp_path), "none", parts=parts)
    none = read_parts(spark, str(tmp_path), "none")
    assert none.count() == 0 and none.columns == scan.columns
    with pytest.raises(ValueError, match="parts"):
        write_parts(scan, str(tmp_path), "one", parts=0)


def test_chosen_frames_reach_the_scan(raster, planes, spark, tmp_path, monkeypatch):
    scan = raster({i: picture(4, 5, i) for i in range(20)})
    write_step(scan, str(tmp_path), "one")
    source = read_raster(spark, str(tmp_path), "one")
    chosen = spark.createDataFrame([(100, 3), (101, 3), (102, 7)], "frame_id long, source_id long")
    taken = take_frames(source, chosen)
    plan = plan_of(taken).toString()
    assert re.search(r"PushedFilters: \[[^\n]*In\(frame_id, \[3,7\]\)", plan)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr("rasterloom.plans.runs.MOST_LISTED", 2)
    same(planes(take_frames(source, chosen)), planes(taken))
    assert take_frames(source, chosen.where("false")).count() == 0


STEPS = [
    {"name": "muted", "operation": "saturation", "params": {"mode": "fixed", "value": -0.4}},
    {"name": "soft", "operation": "blur_circular", "params": {"radius": 2}, "repeat": 3},
    {"name": "rows", "operation": "corduroy", "params": {"strength": 0.8, "orientation": "horizontal", "density": 0.3, "seed": 4}},
    {"name": "soft", "operation": "motion_blur", "params": {"kernel_size": 5, "angle": 30}},
    {"name": "blocks", "operation": "compression", "params": {"quality": 30}},
    {"name": "small", "operation": "downscale", "params": {"scale": 0.5}},
    {"name": "wide", "operation": "blur_circular", "params": {"radius": 9}, "repeat": 30},
    {"name": "sharp", "operation": "blur_circular", "params": {"radius": 1}},
]


def by_step(planes, df):
    names = [r.step for r in df.select("step").distinct().collect()]
    return {n: planes(df.where(F.col("step") == n).drop("step")) for n in names}


@pytest.mark.parametrize("between", [None, 80])
def test_all_steps_equal_single_ones(raster, planes, spark, tmp_path, monkeypatch, between):
    monkeypatch.setattr(strips, "STRIP_PIXELS", 64 * 24)
    scan = raster({1: picture(150, 24, 1), 2: picture(70, 40, 2)})
    run_steps(scan, STEPS, sink=str(tmp_path / "s"), jpeg_between=between)
    got = by_step(planes, all_steps(scan, STEPS, jpeg_between=between))
    stored = read_raster(spark, str(tmp_path / "s"))
    want = by_step(planes, stored.select("step", "frame_id", "height", "width", "y", "r", "g", "b"))
    assert got.keys() == want.keys() == {"muted", "soft", "soft_01", "rows", "blocks", "small", "wide", "sharp"}
    for name in want:
        same(got[name], want[name])


def test_one_pass_gives_out_its_steps(raster):
    scan = raster({1: picture(20, 12, 1)})
    plan = plan_of(all_steps(scan, presets.WORN_PRINT)).toString()
    assert plan.split("Initial Plan")[0].count("FlatMapGroupsInArrow") == 1


def test_lacking_bands_are_null(raster):
    scan = raster({1: picture(8, 8, 1, "rgba")})
    steps = [{"name": "a", "operation": "blur_circular", "params": {"radius": 1}},
             {"name": "b", "operation": "saturation", "params": {"mode": "fixed", "value": 0.2}}]
    made = all_steps(scan, steps)
    assert made.where("step = 'a' AND a IS NULL").count() == 0 and made.where("step = 'b' AND a IS NOT NULL").count() == 0


def test_steps_of_one_job(raster, planes, spark, tmp_path):
    scan = raster({1: picture(40, 24, 1, "rgba"), 2: picture(30, 20, 2, "rgba")})
    places = {"intermediate_dir": str(tmp_path / "between"), "final_dir": str(tmp_path / "end")}
    apart = run_steps(scan, STEPS, sink=str(tmp_path / "s"))
    for at in (str(tmp_path / "t"), places):
        for _ in range(2):  # the second run replaces the first one's folders
            got = run_steps(scan, STEPS, sink=at, together=True)
            assert got.keys() == apart.keys()
            for name in apart:
                same(planes(got[name]), planes(apart[name]))
    assert [r.step for r in read_raster(spark, places["final_dir"]).select("step").distinct().collect()] == ["sharp"]
    empty = run_steps(scan.where("false"), STEPS, sink=str(tmp_path / "e"), together=True)
    assert empty["sharp"].count() == 0
    with pytest.raises(ValueError, match="sink"):
        run_steps(scan, STEPS, together=True)


def test_a_run_goes_on_behind_the_last_whole_step(raster, planes, tmp_path):
    scan, calls = raster({1: picture(12, 10, 1)}), []
    fails = {"third"}

    def counted(df, name, add=1):
        calls.append(name)
        if name in fails:
            raise RuntimeError("lost")
        return df.withColumn("r", F.transform("r", lambda v: (v + add) % 256))

    def steps(add=1):
        made = [{"name": n, "operation": "counted", "params": {"name": n}} for n in ("first", "second", "third", "fourth")]
        made[1]["params"]["add"] = add
        return made

    def go(sink="s", label="film 1", **how):
        calls.clear()
        return run_steps(scan, steps(**how), sink=str(tmp_path / sink), extra={"counted": counted}, resume=label)

    with pytest.raises(RuntimeError):
        go()
    fails.clear()
    results = go()
    assert calls == ["third", "fourth"]
    lazy = run_steps(scan, steps(), extra={"counted": counted})
    for name in lazy:
        same(planes(results[name]), planes(lazy[name]))
    go()
    assert calls == []
    assert (planes(go(add=5)["fourth"])[1]["r"] == (planes(scan)[1]["r"] + 8) % 256).all()
    assert calls == ["second", "third", "fourth"]  # what is behind a changed step is made again
    go(add=5, label="film 2")
    assert len(calls) == 4  # another raster
    go(add=5, label="film 2")
    run_steps(scan, steps(), sink=str(tmp_path / "s"), extra={"counted": counted})
    go(add=5, label="film 2")
    assert len(calls) == 4  # a run without records leaves none behind
    with pytest.raises(ValueError, match="sink"):
        run_steps(scan, steps(), extra={"counted": counted}, resume="x")
