"""Streams whose batches split frames."""

import numpy as np
import pytest

from rasterloom.operators.frames import sample_fps
from rasterloom.plans.steps import run_steps
from rasterloom.streaming import framestream, scanstream

STEPS = [
    {"name": "soft", "operation": "blur_circular", "params": {"radius": 2}},
    {"name": "blocks", "operation": "compression", "params": {"quality": 30}},
]


def picture(height, width, seed):
    rng = np.random.default_rng(seed)
    return {b: rng.integers(0, 256, (height, width)) for b in "rgb"}


class Feed:
    """A folder of which each file is a batch, and runs of the stream over what is there."""

    def __init__(self, spark, scan, base):
        self.spark, self.scan, self.base, self.files = spark, scan, base, 0

    def put(self, where):
        self.scan.where(where).coalesce(1).write.parquet(f"{self.base}/in/file={self.files:03d}")
        self.files += 1

    def run(self, **how):
        stream = scanstream.read_scanline_stream(self.spark, f"{self.base}/in/*", self.scan.schema, files_per_batch=1)
        scanstream.run_steps_on_frames(stream, STEPS, f"{self.base}/out", f"{self.base}/check", **how).awaitTermination()

    def results(self, name):
        return self.spark.read.parquet(f"{self.base}/out/batch=*/step={name}").select(*self.scan.columns)

    def incomplete(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.base}/out/incomplete/batch=*").collect()))


def test_frames_are_whole_whatever_batch_their_lines_come_in(raster, planes, spark, tmp_path):
    scan = raster({1: picture(30, 12, 1), 2: picture(17, 9, 2), 3: picture(5, 5, 3), 4: picture(20, 8, 4)})
    feed = Feed(spark, scan, str(tmp_path))
    feed.put("frame_id < 4 AND y % 3 = 0")
    feed.put("frame_id = 3 AND y % 3 > 0 OR frame_id = 1 AND y % 3 = 2 OR frame_id = 4 AND y < 7")
    feed.run()
    assert {r.frame_id for r in feed.results("soft").select("frame_id").distinct().collect()} == {3}
    feed.put("frame_id = 2 AND y % 3 > 0")
    feed.put("frame_id = 1 AND y % 3 = 1")
    feed.run()  # goes on with what waits
    want = run_steps(scan.where("frame_id < 4"), STEPS)
    for name in ("soft", "blocks"):
        got, held = planes(feed.results(name)), planes(want[name])
        assert got.keys() == held.keys() == {1, 2, 3}
        assert all((got[f][b] == held[f][b]).all() for f in held for b in "rgb")
    assert feed.incomplete() == []
    kept = [p.name for p in (tmp_path / "out" / "waiting").iterdir() if p.name.startswith("batch")]
    assert sorted(kept) == ["batch=2", "batch=3"]
    assert spark.read.parquet(f"{feed.base}/out/waiting/batch=3").count() == 7


def test_frames_that_never_become_whole_are_given_up(raster, planes, spark, tmp_path):
    scan = raster({1: picture(10, 6, 1), 2: picture(8, 6, 2), 3: picture(4, 6, 3)})
    feed = Feed(spark, scan, str(tmp_path))
    feed.put("frame_id = 1 AND y < 4 OR frame_id = 2 AND y < 3")
    feed.put("frame_id = 2 AND y >= 3")
    feed.put("frame_id = 3")
    feed.put("frame_id = 1 AND y >= 4 AND y < 6")
    feed.run(most_batches=1)
    assert feed.incomplete() == [(1, 10, 4)]
    assert planes(feed.results("soft")).keys() == {2, 3}
    assert {r.y for r in spark.read.parquet(f"{feed.base}/out/waiting/batch=3").collect()} == {4, 5}


def test_a_line_that_comes_twice_is_named(raster, spark, tmp_path):
    feed = Feed(spark, raster({5: picture(6, 6, 1)}), str(tmp_path))
    feed.put("y < 4")
    feed.put("y = 2")
    with pytest.raises(Exception, match="a line came twice: frame 5"):
        feed.run()
    with pytest.raises(ValueError, match="most_batches"):
        feed.run(most_batches=-1)


def test_sampling_a_stream_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for video, n in (("a", 200), ("b", 60), ("c", 1)):
        times = np.sort(rng.uniform(0, 12, n)).round(2)
        rows += [(i, video, i // 2 * 2, float(t)) for i, t in enumerate(times)]
    schema = "frame_id long, video_id string, frame_no long, pts double"
    rows.sort(key=lambda r: r[3] + rng.uniform(0, 1.5))  # up to 1.5 seconds late
    late = [(900, "a", 900, 1.0), (901, "b", 901, 0.5)]
    batches = [rows[i : i + 50] for i in range(0, len(rows), 50)] + [late, [(999, "z", 0, 1000.0)], [(998, "z", 0, 1001.0)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/file={i:03d}")
    stream = scanstream.read_scanline_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, 1)
    query = framestream.write_sampled(stream, 5.0, 2.0, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/frames/batch=*").where("video_id < 'z'")
    want = sample_fps(spark.createDataFrame(rows, schema), 5.0)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert framestream.late_frames(query) == 2
