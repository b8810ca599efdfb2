"""Frames, names, inventories, steps, image files and streams."""

import os
import struct
import subprocess
import sys
import types
import zlib
from datetime import datetime

import numpy as np
import pytest
from conftest import picture
from pyspark.sql import functions as F

from rasterloom.functions import naming
from rasterloom.functions.positions import explode_range, number_within
from rasterloom.operators import frames, inventory, quality, stencils, strips
from rasterloom.session import shared_folder
from rasterloom.plans.steps import parse_segment, parse_steps, run_steps
from rasterloom.sources.images import read_frames, read_images
from rasterloom.sources.raster import read_raster, write_step


def test_positions_of_a_hot_key(spark):
    """A key with most rows is numbered piece by piece, with the same result."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 3).alias("k"), "id"
    )
    got = number_within(rows, ["k"], ["id"], F.floor(F.col("id") / 64).cast("long"), "n").collect()
    for k in {r.k for r in got}:
        ordered = sorted((r.id, r.n) for r in got if r.k == k)
        assert [n for _, n in ordered] == list(range(len(ordered)))


def test_explode_range(spark):
    one = spark.range(1)
    got = explode_range(one, F.lit(3), F.lit(25), "n", chunk=7).select("n").collect()
    assert sorted(r.n for r in got) == list(range(3, 26))
    assert explode_range(one, F.lit(3), F.lit(2), "n").count() == 0


def test_segment_frame_count(spark):
    """Seven seconds of 30 fps at one frame per 0.033333 s are 200 to 220 frames."""
    video = spark.range(3000).select(
        F.lit("v").alias("video_id"), F.col("id").alias("frame_no"), (F.col("id") / 30.0).alias("pts")
    )
    part = frames.segment(video, 74.0, 81.0)
    got = frames.sample_every_seconds(part, 0.033333, time="t")
    assert 200 <= got.count() <= 220


def test_sampling_repeats_and_drops(spark):
    rows = [("v", i, t) for i, t in enumerate([0.0, 0.1, 0.2, 3.0, 3.1])]
    video = spark.createDataFrame(rows, "video_id string, frame_no long, pts double")
    got = sorted((r.slot, r.frame_no) for r in frames.sample(video, fps=1.0).collect())
    assert got == [(0, 2), (1, 2), (2, 2), (3, 4)]
    assert [r.frame_no for r in frames.sample(video, frame_interval=2).collect()] == [0, 2, 4]
    for bad in ({}, {"fps": 1.0, "frame_interval": 2}):
        with pytest.raises(ValueError):
            frames.sample(video, **bad)


def test_video_text(spark):
    rows = [(120.5, 1920, 1080), (3661.9, None, 720), (360000.0, 0, 10)]
    videos = spark.createDataFrame(rows, "duration double, width int, height int")
    got = frames.with_duration_str(frames.with_resolution(videos)).collect()
    assert [r.resolution for r in got] == ["1920x1080", None, None]
    assert [r.duration_str for r in got] == ["00:02:00", "01:01:01", "100:00:00"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("test<file>name", "test_file_name"),
        ('a/b\\c:d"e|f?g*h', "a_b_c_d_e_f_g_h"),
        ("tab\tnew\nline\x7f", "tabnewline"),
        ("a____b", "a_b"),
        (" ..name.. ", "name"),
        ("...", "unnamed"),
        ("", "unnamed"),
        ("x" * 300, "x" * 255),
        ("x" * 300 + ".jpg", "x" * 251 + ".jpg"),
        ("héllo.jpg", "héllo.jpg"),
        ("ab." + "c" * 260, "." + "c" * 260),
    ],
)
def test_sanitize(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "s string").select(naming.sanitize_name("s")).first()[0]
    assert got == want


def test_frame_names(spark):
    row = spark.createDataFrame([("my/video", 7, 12.345)], "v string, i int, t double")
    name = lambda **k: row.select(naming.frame_name("v", "i", **k)).first()[0]
    assert name() == "my_video_frame_000007.jpg"
    assert name(pattern="{index}.{ext}", ext="png") == "7.png"
    assert name(pattern="{index}_{timestamp:.1f}", timestamp="t") == "7_12.3"
    assert name(pattern="{index}_{timestamp:07.2f}", timestamp="t") == "7_" + f"{12.345:07.2f}"
    assert name(pattern="{timestamp}.jpg") == "my_video_frame_000007.jpg"
    assert name(pattern="{nothing}") == "my_video_frame_000007.jpg"
    for bad in ("a/{index}", "..{index}", "a\\{index}"):
        with pytest.raises(Exception, match="invalid frame name"):
            name(pattern=bad)


def test_step_names(spark):
    assert naming.step_name("  my: step/1! ") == "my step1"
    with pytest.raises(ValueError):
        naming.step_name("   ")
    row = spark.createDataFrame([("  my: step/1! ",), ("été_2",)], "s string")
    assert [r[0] for r in row.select(naming.clean_step_name("s")).collect()] == ["my step1", "été_2"]
    blank = spark.createDataFrame([(" \t",)], "s string")
    with pytest.raises(Exception, match="cannot be empty"):
        blank.select(naming.clean_step_name("s")).collect()


def test_output_names_nest(spark):
    row = spark.createDataFrame([("video_frame_000001.jpg",)], "s string")
    name = naming.output_name(naming.output_name("s", "blur", 0), "boost", 1)
    assert row.select(name).first()[0] == "boost_blur_video_frame_000001_step00_step01.jpg"


def test_free_names_by_hand(spark):
    asked = spark.createDataFrame(
        [("a.jpg", 0), ("a.jpg", 1), ("b", 2), ("a.jpg", 3), ("c.png", 4), ("a.jpg", 5)],
        "name string, order_id long",
    )
    there = spark.createDataFrame([("a.jpg",), ("a_000.jpg",), ("a_002.jpg",), ("b_000",)], "name string")
    got = {r.order_id: r.assigned for r in naming.assign_incremental(asked, there).collect()}
    assert got == {0: "a_001.jpg", 1: "a_003.jpg", 2: "b", 3: "a_004.jpg", 4: "c.png", 5: "a_005.jpg"}


def assigned_one_by_one(asked, there, start, directories):
    """Requests take the first free name, one after another."""
    taken, out = set(there), {}
    for name, at in sorted(asked, key=lambda r: r[1]):
        given, index = name, start
        stem, dot, ending = (name, "", "") if directories else name.rpartition(".")
        if not stem or not ending:
            stem, dot, ending = name, "", ""
        while given in taken:
            given, index = f"{stem}_{index:03d}{dot}{ending}", index + 1
        taken.add(given)
        out[at] = given
    return out


@pytest.mark.parametrize("start, directories", [(0, False), (1, False), (0, True)])
def test_names_are_given_in_request_order(spark, start, directories):
    rng = np.random.default_rng(11 + start)
    stems = ["a", "b.c", "d_000"]
    names = [f"{s}{n}{e}" for s in stems for n in ("", "_000", "_001", "_002", "_000_000", "_000_001", "_001_000", "_0001", "_1000") for e in (".jpg", "")]
    for size in (6, 40, 300):
        asked = [(str(rng.choice(names)), int(at)) for at in rng.permutation(3 * size)[:size] * 40_000]
        there = [str(n) for n in rng.choice(names, 8, replace=False)]
        df = spark.createDataFrame(asked, "name string, order_id long").withColumn("assigned_to", F.lit("x"))
        got = naming.assign_incremental(
            df, spark.createDataFrame([(n,) for n in there], "name string"), start_index=start, directories=directories
        )
        assert {r["order_id"]: r["assigned"] for r in got.collect()} == assigned_one_by_one(asked, there, start, directories)
        assert got.columns == ["name", "order_id", "assigned_to", "assigned"]


def test_inventory(spark):
    rows = [("/a", datetime(2024, 1, 1), 3 << 30), ("/b", datetime(2024, 1, 9), 1 << 30)]
    files = spark.createDataFrame(rows, "path string, modificationTime timestamp, length long")
    assert inventory.inventory_size(files).first().size_gb == 4.0
    assert inventory.check_size(files, 5.0).first().within_limit == 1
    with pytest.raises(Exception, match="exceeds its limit"):
        inventory.check_size(files, 3.0).collect()
    keep, expire = inventory.split_retention(files, datetime(2024, 1, 10), 7)
    assert [r.path for r in keep.collect()] == ["/b"] and [r.path for r in expire.collect()] == ["/a"]
    now = datetime(2024, 1, 10)
    left = {
        (p, ph): inventory.apply_policy(files, p, ph, now).count()
        for p in inventory.POLICIES for ph in ("start", "end")
    }
    assert left == {("on_start", "start"): 0, ("on_start", "end"): 1, ("on_exit", "start"): 2,
                    ("on_exit", "end"): 0, ("manual", "start"): 2, ("manual", "end"): 1,
                    ("never", "start"): 2, ("never", "end"): 1}


def test_compare_by_hand(raster):
    a, b = picture(9, 7, 1), picture(9, 7, 2)
    got = quality.compare(raster({1: a}), raster({1: b})).first()
    d = np.abs(np.stack([a[c] - b[c] for c in "rgb"]))
    assert got.max_diff == d.max() and got.samples == d.size
    for name, want in (("mean_diff", d.mean()), ("std_diff", d.std()), ("median_diff", np.median(d)),
                       ("p95_diff", np.percentile(d, 95)), ("p99_diff", np.percentile(d, 99))):
        assert abs(got[name] - want) < 1e-9
    same = quality.compare(raster({1: a}), raster({1: a})).first()
    assert same.psnr is None and same.changed_pixels == 0


def test_times_do_not_depend_on_the_session_zone(spark):
    """Tables without a time zone give the same answers wherever the session is."""
    from conftest import SF

    from rasterloom.checks import tables

    def answers():
        frame = tables.frame_table(spark, SF).agg(F.sum("pts"), F.max("pts")).first()
        return tuple(frame), tables.retention(spark, SF).where("state = 'keep'").count()

    before = answers()
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = answers()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs(before[0][0] - after[0][0]) < 1e-3 and before[0][1] == after[0][1]
    assert before[1] == after[1]


def test_step_lists():
    config = {"pipeline": {"steps": [{"name": "a!", "operation": "noise", "params": {"x": 1}}]}}
    assert parse_steps(config)[0].name == "a"
    for bad in ({}, {"pipeline": {"steps": []}}, [{"name": "a"}],
                [{"name": "a", "operation": "noise", "repeat": 0}],
                [{"name": "a", "operation": "noise", "repeat": 101}], [{"name": " ", "operation": "noise"}]):
        with pytest.raises(ValueError):
            parse_steps(bad)
    assert parse_segment({"segment": {"start": 1, "end": 2, "interval": 0.5}}) == (1.0, 2.0, 0.5)
    for bad in ((2, 1, 1), (-1, 1, 1), (0, 1, 0)):
        with pytest.raises(ValueError):
            parse_segment({"segment": dict(zip(("start", "end", "interval"), bad))})


def test_steps_run(raster, planes):
    scan = raster({1: picture(16, 16, 1)})
    with pytest.raises(KeyError, match="known"):
        run_steps(scan, [{"name": "a", "operation": "sharpen"}])
    with pytest.raises(ValueError, match="needs amount"):
        run_steps(scan, [{"name": "a", "operation": "noise", "params": {"mode": "row"}}])
    spare = {"mode": "fixed", "value": 0.0, "unknown": 1}
    run_steps(scan, [{"name": "a", "operation": "saturation", "params": spare}])
    inverted = lambda df, by: df.withColumns(
        {b: F.transform(b, lambda v: F.lit(by) - v) for b in "rgb"}
    )
    steps = [{"name": "flip", "operation": "own", "params": {"by": 255}, "repeat": 2},
             {"name": "small", "operation": "downscale", "params": {"scale": 0.5, "upscale": False}},
             {"name": "dots", "operation": "salt_pepper", "params": {"amount": 1.0, "seed": 1}}]
    got = run_steps(scan, steps, extra={"own": inverted})
    assert list(got) == ["flip", "small", "dots"]
    assert (planes(got["flip"])[1]["r"] == planes(scan)[1]["r"]).all()
    assert planes(got["dots"])[1]["r"].shape == (8, 8)


def test_config_file(tmp_path):
    from rasterloom.plans.runs import load_config

    path = tmp_path / "run.yaml"
    path.write_text(
        "segment: {start: 1, end: 2, interval: 0.5}\n"
        "pipeline:\n  steps:\n    - {name: a, operation: noise, params: {mode: row, amount: 0.1}}\n"
    )
    assert parse_steps(load_config(str(path)))[0].params == {"mode": "row", "amount": 0.1}
    path.write_text("segment: {start: 1, end: 2, interval: 0.5}\npipeline: {steps: []}\n")
    with pytest.raises(ValueError):
        load_config(str(path))


def test_many_repeats_are_one_pass(raster, planes):
    scan = raster({1: picture(12, 12, 1, "v")})
    step = {"name": "again", "operation": "blur_circular", "params": {"radius": 1}, "repeat": 100}
    again = run_steps(scan, [step])["again"]
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = planes(again)[1]["v"]
    assert got.std() < planes(scan)[1]["v"].std() / 10
    one = scan
    for _ in range(3):
        one = stencils.blur_circular(one, 1)
    few = run_steps(scan, [step | {"repeat": 3}])["again"]
    assert (planes(one)[1]["v"] == planes(few)[1]["v"]).all()


def test_steps_share_passes(raster, planes, monkeypatch):
    """A fused list over many small strips equals its operations one by one."""
    scan = raster({1: picture(150, 11, 1, "rgba"), 2: picture(40, 23, 2, "rgba")})
    steps = [
        {"name": "a", "operation": "motion_blur", "params": {"kernel_size": 6, "angle": 100}},
        {"name": "b", "operation": "corduroy",
         "params": {"strength": 1, "orientation": "horizontal", "density": 0.5, "seed": 1}},
        {"name": "c", "operation": "compression", "params": {"quality": 20}, "repeat": 2},
        {"name": "d", "operation": "chromatic_aberration", "params": {"shift_x": 1, "shift_y": 3}},
        {"name": "e", "operation": "compression_artifact",
         "params": {"tile_count": 2, "quality": 5, "tile_size_range": [0.3, 0.6], "seed": 2}},
        {"name": "f", "operation": "blur_gaussian", "params": {"sigma": 1.2}},
    ]
    single, current = {}, scan
    for step in steps:
        for _ in range(step.get("repeat", 1)):
            current = run_steps(current, [step | {"repeat": 1}])[step["name"]]
        single[step["name"]] = planes(current)
    monkeypatch.setattr(strips, "STRIP_PIXELS", 1)
    fused = run_steps(scan, steps)
    assert fused["f"]._jdf.queryExecution().executedPlan().toString().count("applyInArrow") <= 1
    for name, want in single.items():
        got = planes(fused[name])
        assert all((got[f][b] == want[f][b]).all() for f in want for b in want[f]), name


def test_output_folders(raster, planes, spark, tmp_path):
    scan = raster({1: picture(8, 8, 1)})
    steps = [{"name": n, "operation": "blur_circular", "params": {"radius": 1}} for n in ("one", "two")]
    places = {"intermediate_dir": str(tmp_path / "between"), "final_dir": str(tmp_path / "end")}
    run_steps(scan, {"steps": steps, "output": places})
    assert [r.step for r in read_raster(spark, places["intermediate_dir"]).select("step").distinct().collect()] == ["one"]
    assert [r.step for r in read_raster(spark, places["final_dir"]).select("step").distinct().collect()] == ["two"]
    with pytest.raises(ValueError, match="final_dir"):
        run_steps(scan, {"steps": steps, "output": {"final_dir": "x"}})


def test_store(raster, planes, spark, tmp_path):
    scan = raster({1: picture(6, 5, 1)})
    for name in ("one", "two"):
        write_step(scan, str(tmp_path), name)
        write_step(scan, str(tmp_path), name)
    assert read_raster(spark, str(tmp_path)).count() == 12
    assert (planes(read_raster(spark, str(tmp_path), "one"))[1]["g"] == planes(scan)[1]["g"]).all()


def test_store_of_namesakes(raster, planes, spark, tmp_path):
    """Steps of one name read each other's result, and the name maps to the last."""
    scan = raster({1: picture(9, 9, 1)})
    blur = {"name": "soft blur", "operation": "blur_circular", "params": {"radius": 1}}
    lazy = planes(run_steps(scan, [blur, blur, blur])["soft blur"])[1]
    stored = run_steps(scan, [blur, blur, blur], sink=str(tmp_path / "s"))["soft blur"]
    assert all((planes(stored)[1][b] == lazy[b]).all() for b in "rgb")
    assert read_raster(spark, str(tmp_path / "s")).select("step").distinct().count() == 3


def test_store_of_changing_bands(raster, planes, spark, tmp_path):
    """A step that drops alpha is not given it back by the steps beside it."""
    scan = raster({1: picture(9, 9, 1, "rgba")})
    steps = [{"name": "a", "operation": "blur_circular", "params": {"radius": 1}},
             {"name": "b", "operation": "saturation", "params": {"mode": "fixed", "value": 0.2}},
             {"name": "c", "operation": "blur_circular", "params": {"radius": 1}}]
    got = run_steps(scan, steps, sink=str(tmp_path / "s"))
    assert "a" in got["a"].columns and "a" not in got["b"].columns
    assert planes(got["c"])[1].keys() == {"r", "g", "b"}
    every = read_raster(spark, str(tmp_path / "s"))
    assert every.where("a is null").count() == 18 and every.count() == 27


def png(path, array):
    height, width = array.shape[:2]
    kind = {2: 0, 3: 2}[array.ndim] if array.ndim == 2 or array.shape[2] == 3 else 6
    raw = b"".join(b"\0" + array[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_image_files(spark, planes, tmp_path):
    rng = np.random.default_rng(1)
    colour, grey, clear = rng.integers(0, 256, (5, 7, 3)), rng.integers(0, 256, (4, 4)), rng.integers(0, 256, (3, 2, 4))
    for name, array in (("a", colour), ("b", grey), ("c", clear)):
        png(tmp_path / f"{name}.png", array)
    listed = {r.name: r for r in read_frames(spark, str(tmp_path)).collect()}
    assert {n: (r.height, r.width, r.mode) for n, r in listed.items()} == {
        "a.png": (5, 7, "RGB"), "b.png": (4, 4, "L"), "c.png": (3, 2, "RGBA")
    }
    got = planes(read_images(spark, str(tmp_path)))
    for name, want in (("a", colour), ("b", np.repeat(grey[:, :, None], 3, 2)), ("c", clear[:, :, :3])):
        bands = got[listed[f"{name}.png"].frame_id]
        assert all((bands[b] == want[:, :, i]).all() for i, b in enumerate("rgb"))
    luma = planes(read_images(spark, str(tmp_path), "L"))
    assert (luma[listed["b.png"].frame_id]["v"] == grey).all()
    red, green, blue = (colour[:, :, i] for i in range(3))
    assert (luma[listed["a.png"].frame_id]["v"] == (red * 19595 + green * 38470 + blue * 7471 + 32768) >> 16).all()
    with_alpha = planes(read_images(spark, str(tmp_path), "RGBA"))
    assert (with_alpha[listed["c.png"].frame_id]["a"] == clear[:, :, 3]).all()
    (tmp_path / "d.png").write_bytes(b"no picture")
    broken = {r.name: r for r in read_frames(spark, str(tmp_path)).collect()}["d.png"]
    assert (broken.height, broken.width, broken.mode) == (None, None, None)
    with pytest.raises(Exception, match="not an image"):
        read_images(spark, str(tmp_path)).collect()
    assert len(planes(read_images(spark, str(tmp_path), broken="skip"))) == 3


def test_file_listing(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"12345")
    assert inventory.inventory_size(inventory.list_files(spark, str(tmp_path))).first().bytes == 5


def test_raster_queries_without_the_libraries_of_others():
    """A failed import of the training-data operators leaves the raster queries."""
    code = (
        "import sys; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True).stdout.split()
    assert int(said[0]) >= 113 and said[1] == "False"


def test_a_cluster_needs_a_shared_folder():
    class Settings(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    def session(master, **settings):
        context = types.SimpleNamespace(master=master)
        return types.SimpleNamespace(sparkContext=context, conf=Settings({"spark.sql.warehouse.dir": "/w", **settings}))

    assert shared_folder(session("local[2]"), "x").startswith("/w/")
    assert shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs://c/"}), "x").startswith("hdfs://c/rasterloom-x-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(session(master), "x")
