import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import audio, shards


def test_payload_is_padded_and_read_back(spark):
    held = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 40), (4, "é" * 40), (5, "long " * 9000)]
    df = spark.createDataFrame(held, "doc_id long, text string").withColumn("media", F.lit("clash"))
    stored = audio.store(df.select("doc_id", audio.payload(F.col("text")).alias("payload")), ["doc_id"])
    rows = audio.features(stored, ["doc_id"]).collect()
    assert len(rows) == len(held)
    for r in rows:
        text = (dict(held)[r["doc_id"]] or "").encode()
        assert bytes(r["payload"]) == text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        table = audio.read_tensors(bytes(r["tensors"]))
        assert table.schema.field("mel").type.shape == [audio.FRAMES, audio.MELS]
        assert sum(table["frames"].to_pylist()) == r["n_frames"] > 0
        assert table["end_ms"].to_pylist()[-1] > table["start_ms"].to_pylist()[-1]
    twice = [r for r in rows if r["doc_id"] == 4]
    assert twice[0] == twice[1]
    assert audio.features(stored.limit(0), ["doc_id"]).count() == 0


def test_wav_round_trip():
    for n in (0, 1, 7, 64):
        samples = bytes(range(n))
        back, rate = audio.read_wav(audio.wav(samples))
        assert back.tobytes() == samples and rate == audio.RATE
    with pytest.raises(ValueError):
        audio.read_wav(audio.wav(bytes(64))[:-5])


def test_resampling_is_a_filter_at_each_output_time():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, 501).astype(np.uint8)
    got, taps = audio.resample(samples), audio._phases()
    wave = (samples.astype(float) - 128) / 128
    for j in range(0, len(got), 7):
        base, phase = divmod(j * audio.DOWN, audio.UP)
        want = sum(
            taps[phase][k] * wave[base + d]
            for k, d in enumerate(range(-audio.TAPS + 1, audio.TAPS + 1))
            if 0 <= base + d < len(wave)
        )
        assert abs(got[j] - want) < 1e-4
    tone = np.sin(2 * np.pi * 500 * np.arange(16000) / 16000)
    out = audio.resample(np.round(tone * 100 + 128).astype(np.uint8))
    assert abs(np.abs(np.fft.rfft(out)).argmax() * 12000 / len(out) - 500) < 2


def test_mel_of_a_tone_peaks_in_its_band():
    rate = 12000
    mel, _ = audio.log_mel(np.sin(2 * np.pi * 1500 * np.arange(6000) / rate).astype(np.float32), rate)
    bank = audio.mel_bank(rate)
    assert (mel.argmax(1)[1:-2] == bank[1500 * audio.SIZE // rate].argmax()).all()


def test_segments_by_hysteresis():
    rng = np.random.default_rng(1)
    for _ in range(50):
        energy = rng.uniform(-20, 0, 40)
        loud, want, on = [], [], False
        for e in energy:
            on = e >= -8 or (on and e >= -12)
            loud.append(on)
        for i, now in enumerate(loud):
            if now and (not i or not loud[i - 1]):
                want.append([i, i])
            if now:
                want[-1][1] = i + 1
        assert audio.segments(energy, -8, -12) == [tuple(w) for w in want]


def placed(df, n, **how):
    found = shards.kd_shards(df, {"a": F.col("a"), "b": F.col("b")}, F.col("w"), F.col("tie"), **(how or {"shards": n}))
    return shards.with_slots(found, "doc_id", rows_in_piece=50).toPandas()


def test_shards_are_even_and_groups_stay_whole(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        g = int(rng.integers(0, 1500)) if i % 3 else 0  # one group holds a third of the rows
        w = zlib.crc32(f"w{g}".encode()) % 50 + 1 if g else 1
        rows.append((i, float(g % 37) if g % 11 else None, int(g % 5) ** 3, w, zlib.crc32(str(g).encode()), g))
    df = spark.createDataFrame(rows, "doc_id long, a double, b long, w long, tie long, g long")
    found = placed(df, 8)
    assert sorted(found["shard"].unique()) == list(range(8)) and len(found) == 4000
    sums = found.groupby("shard")["w"].sum()
    assert sums.max() <= 1.25 * sums.min()
    assert found.groupby("g")["shard"].nunique().max() == 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def tree_by_hand(at, weight, shards):
    """Shard of each row by a plain k-d tree: cut the widest dimension where its share of the weight is nearest."""
    shard, numbered = np.full(len(at), -1), 0

    def down(rows, k):
        nonlocal numbered
        if not len(rows):
            return
        wide = at[rows].max(0) - at[rows].min(0)
        dim = int(wide.argmax())
        if k == 1 or wide[dim] == 0:
            shard[rows], numbered = numbered, numbered + 1
            return
        goal, total = weight[rows].sum() * (k // 2) / k, 0
        for c in np.unique(at[rows, dim]):
            before, total = total, total + weight[rows][at[rows, dim] == c].sum()
            if total >= goal:
                break
        left = at[rows, dim] < c if goal - before <= total - goal and before > 0 else at[rows, dim] <= c
        down(rows[left], k // 2)
        down(rows[~left], k - k // 2)

    down(np.arange(len(at)), shards)
    return shard


@pytest.mark.parametrize("k", [2, 3, 8])
def test_cuts_equal_a_plain_tree(spark, k):
    rng = np.random.default_rng(k)
    group = np.where(rng.random(900) < 1 / 3, 0, rng.integers(0, 250, 900))
    a, b = rng.integers(0, 40, 250)[group], (rng.pareto(1, 250) * 10).round(2)[group]
    tie, w = rng.integers(0, 1 << 40, 250)[group], rng.integers(0, 30, 250)[group]
    rows = [(i, float(a[i]), float(b[i]), int(w[i]), int(tie[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, w long, tie long").repartition(5)
    found = shards.kd_shards(df, {"a": F.col("a"), "b": F.col("b")}, F.col("w"), F.col("tie"), shards=k, tolerance=0)
    got = found.toPandas().set_index("doc_id")["shard"].sort_index().to_numpy()
    at = []
    for d in (a.astype(float), b):
        share = (d - d.min()) / (d.max() - d.min())
        at.append(np.floor(share * shards.SCALE).astype(np.int64) * (shards.SCALE + 1) + (tie & shards.SCALE))
    assert (got == tree_by_hand(np.stack(at, 1), w, k)).all()


def test_clashing_columns_nulls_and_repeated_rows(spark):
    rows = [(i % 30 if i % 7 else None, float(i % 9) if i % 5 else None, i % 4 or None, i % 13 or None, "s", i, i, i) for i in range(200)]
    names = "doc_id long, a double, w long, tie long, `shard` string, _node long, _at long, _weight long"
    df = spark.createDataFrame(rows, names).withColumns({"slot": F.lit("x"), "_hash": F.lit(1), "_part": F.lit(2), "_row": F.lit(3)})
    found = shards.with_slots(shards.kd_shards(df, {"a": F.col("a")}, F.col("w"), F.col("tie"), shards=4), "doc_id", 20)
    assert sorted(found.columns) == sorted(df.columns)
    got = found.toPandas()
    assert sorted(got["_at"]) == list(range(200)) and (got["_hash"] == 1).all() and (got["_row"] == 3).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got.assign(key=got["_at"].map(lambda i: (rows[i][1], rows[i][3] or 0))).groupby("key")["shard"].nunique().max() == 1


def test_rows_are_read_once_and_joined_by_key(spark):
    df = spark.range(300).selectExpr("id doc_id", "id % 100 a", "1L w", "xxhash64(id) tie")
    found = shards.kd_shards(df, {"a": F.col("a")}, F.col("w"), F.col("tie"), shards=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Range" not in plan


def test_leaves_reach_the_target(spark):
    df = spark.range(3000).selectExpr("id doc_id", "id % 100 a", "id * id % 97 b", "1L w", "xxhash64(id) tie")
    found = placed(df, 0, target=400)
    assert found["shard"].nunique() == 8 and found.groupby("shard").size().max() <= 400


def test_one_point_and_no_rows(spark):
    df = spark.range(20).selectExpr("id doc_id", "1 a", "2 b", "1L w", "5L tie")
    assert set(placed(df, 8)["shard"]) == {0}
    assert len(placed(df.limit(0), 8)) == 0
    whole = spark.range(1).selectExpr("id doc_id", "cast(null as int) a", "cast(null as int) b", "1L w", "5L tie")
    assert placed(whole, 8)["slot"].tolist() == [0]


def test_same_text_same_feature_wherever_it_stands(spark):
    df = spark.range(40).selectExpr("id doc_id", "repeat('ab c', cast(id % 4 as int) * 500 + 1) text").repartition(7)
    stored = audio.store(df.select("doc_id", "text", audio.payload(F.col("text")).alias("payload")), ["doc_id", "text"])
    rows = audio.features(stored, ["text"]).collect()
    assert len({(r["text"], hashlib.sha256(r["tensors"]).hexdigest()) for r in rows}) == 4
