"""Per-pixel, line and tile operators: properties, limits and brute force."""

import numpy as np
import pytest
from conftest import picture
from pyspark.sql import functions as F

from rasterloom.functions import draws
from rasterloom.model import to_pixels, to_scanlines
from rasterloom.operators import lines, pixelwise, stencils, tiles


def test_draws_agree_with_python(spark):
    keys = spark.range(200).select((F.col("id") * 7919).alias("k"))
    got = keys.select(
        "k",
        draws.state(42, "x", "k", 3).alias("s"),
        draws.uniform(42, "x", "k", 3).alias("u"),
        draws.finish(draws.prefix(42, "x", "k"), F.lit(3)).alias("v"),
        draws.uniform_int(42, "x", -5, 6, "k", 3).alias("n"),
    ).collect()
    for row in got:
        assert row.s == draws.state_value(42, "x", row.k, 3)
        assert row.u == row.v == draws.uniform_value(42, "x", row.k, 3)
        assert -5 <= row.n <= 5


def test_draws_are_spread():
    u = np.array([[draws.uniform_value(7, "spread", y, x) for x in range(200)] for y in range(200)])
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12**-0.5) < 0.01
    for a, b in ((u[:, 1:], u[:, :-1]), (u[1:], u[:-1])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.02


def test_layouts_round_trip(raster, planes):
    frames = {1: picture(5, 9, 1, "rgba"), -4: picture(7, 3, 2, "rgba")}
    got = planes(to_scanlines(to_pixels(raster(frames)).repartition(5)))
    assert all((got[f][b] == frames[f][b]).all() for f in frames for b in "rgba")


def test_saturation_by_hand(raster, planes):
    frame = {"r": np.array([[200, 0, 90]]), "g": np.array([[100, 0, 90]]), "b": np.array([[50, 0, 90]])}
    scan = raster({1: frame})
    grey = planes(pixelwise.saturation(scan, "fixed", -1.0))[1]
    assert all(grey[b].tolist() == [[200, 0, 90]] for b in "rgb")
    same = planes(pixelwise.saturation(scan, "fixed", 0.0))[1]
    assert all((same[b] == frame[b]).all() for b in "rgb")
    full = planes(pixelwise.saturation(scan, "fixed", 9.0))[1]
    assert [full[b][0, 0] for b in "rgb"] == [200, 66, 0]


@pytest.mark.parametrize(
    "op, params",
    [
        (pixelwise.noise, dict(mode="gaussian", amount=0.2)),
        (pixelwise.noise, dict(mode="row", amount=0.2)),
        (pixelwise.noise, dict(mode="column", amount=0.2)),
        (pixelwise.salt_pepper, dict(amount=0.2)),
        (lines.corduroy, dict(strength=1.0, orientation="vertical", density=0.5)),
        (lines.corduroy, dict(strength=1.0, orientation="horizontal", density=0.5)),
        (lines.slc_off, dict(gap_width=0.4, scan_period=5, fill_mode="mean")),
        (tiles.band_swap, dict(tile_count=5, permutation="BRG")),
        (tiles.buffer_corruption, dict(tile_count=5, corruption_type="xor", severity=0.7)),
        (tiles.buffer_corruption, dict(tile_count=5, corruption_type="invert", severity=0.7)),
        (tiles.buffer_corruption, dict(tile_count=9, corruption_type="channel_shuffle", severity=1.0)),
    ],
)
def test_seeds(raster, planes, op, params):
    """Equal frames change alike under a seed and differently without; alpha is kept."""
    frame = picture(40, 30, 3, "rgba")
    scan = raster({1: frame, 2: frame})
    a, b = (planes(op(d, seed=5, **params)) for d in (scan, scan.repartition(1)))
    c = planes(op(to_pixels(scan), seed=5, **params))
    for band in "rgba":
        assert (a[1][band] == a[2][band]).all()
        assert (a[1][band] == b[1][band]).all() and (a[1][band] == c[1][band]).all()
    assert (a[1]["a"] == frame["a"]).all()
    assert any((a[1][band] != frame[band]).any() for band in "rgb")
    other = planes(op(scan, seed=6, **params))
    assert any((a[1][band] != other[1][band]).any() for band in "rgb")
    free = planes(op(scan, seed=None, **params))
    assert any((free[1][band] != free[2][band]).any() for band in "rgb")


def test_salt_pepper_counts(raster, planes):
    flat = {"v": np.full((60, 50), 128)}
    scan = raster({1: flat})
    got = planes(pixelwise.salt_pepper(scan, 0.1, 0.5, seed=1))[1]["v"]
    changed = int((got != 128).sum())
    assert 0.8 * 300 < changed <= 300 and set(np.unique(got)) == {0, 128, 255}
    assert set(np.unique(planes(pixelwise.salt_pepper(scan, 0.1, 1.0, seed=1))[1]["v"])) == {128, 255}
    assert (planes(pixelwise.salt_pepper(scan, 0.0, 0.5))[1]["v"] == 128).all()


def test_corduroy_line_count(raster, planes):
    flat = {"v": np.full((40, 50), 100)}
    got = planes(lines.corduroy(raster({1: flat}), 1.0, "vertical", 0.3, seed=4))[1]["v"]
    assert (got == got[0]).all()
    assert 10 <= int((got[0] != 100).sum()) <= 15


@pytest.mark.parametrize(
    "height, width, gap, period", [(100, 100, 0.22, 14), (64, 64, 0.5, 8), (61, 37, 0.3, 7), (9, 5, 0.5, 2), (200, 300, 0.01, 3)]
)
def test_gap_bounds_by_listing(spark, height, width, gap, period):
    """The closed form equals walking down the bands."""
    centre = height // 2
    reach = [abs(y - centre) / (height / 2) * gap * width for y in range(height)]
    want, shown = {}, 0
    for start in range(0, height, period):
        if int(reach[start]) == 0:
            continue
        lean = 1 if shown % 2 == 0 else -1
        shown += 1
        for y in range(start, min(start + period, height)):
            middle = width // 2 + int(0.3 * (y - start) * lean)
            lo, hi = max(0, middle - int(reach[y]) // 2), min(width, middle + int(reach[y]) // 2)
            if lo < hi:
                want[y] = (lo, hi)
    rows = spark.range(height).select(
        F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("id").cast("int").alias("y")
    )
    got = {
        r.y: (r.gap_from, r.gap_to)
        for r in lines.with_gaps(rows, gap, period).collect()
        if r.gap_from < r.gap_to
    }
    assert got == want


def test_band_swap_exact(raster, planes):
    tiny = {"r": np.full((1, 3), 100), "g": np.full((1, 3), 150), "b": np.full((1, 3), 200)}
    for name, want in (("GRB", (150, 100, 200)), ("BGR", (200, 150, 100)), ("RBG", (100, 200, 150)),
                       ("BRG", (200, 100, 150)), ("GBR", (150, 200, 100))):
        got = planes(tiles.band_swap(raster({1: tiny}), 1, name, (1.0, 1.0), seed=1))[1]
        assert tuple(got[b][0, 0] for b in "rgb") == want


def test_full_invert(raster, planes):
    flat = {"r": np.full((10, 10), 100), "g": np.full((10, 10), 150), "b": np.full((10, 10), 200)}
    got = planes(tiles.buffer_corruption(raster({1: flat}), 1, "invert", 1.0, (1.0, 1.0), seed=1))[1]
    assert [got[b][0, 0] for b in "rgb"] == [155, 105, 55]


def test_tiles_agree_with_python(raster):
    scan = raster({1: picture(70, 33, 1), 2: picture(20, 90, 2)})
    got = {
        (r.height, r.width, r.i): (r.y0, r.x0, r.th, r.tw)
        for r in tiles.tile_table(scan, 20, (0.05, 0.5), seed=9).collect()
    }
    for height, width in ((70, 33), (20, 90)):
        for i, tile in enumerate(tiles.tile_geometry(height, width, 20, 0.05, 0.5, 9)):
            assert got[height, width, i] == tile


def test_grid_count(raster, planes):
    flat = {b: np.zeros((64, 96), dtype=int) for b in "rgb"}
    got = planes(tiles.buffer_corruption_grid(raster({1: flat}), 16, 0.5, corruption_type="invert"))[1]
    cells = got["r"].reshape(4, 16, 6, 16).transpose(0, 2, 1, 3).reshape(24, -1)
    assert ((cells == 255).all(axis=1) | (cells == 0).all(axis=1)).all()
    assert int((cells[:, 0] == 255).sum()) == 12


@pytest.mark.parametrize(
    "op",
    [
        lambda d: lines.corduroy(d, 1.0, "vertical", 0.5, seed=1),
        lambda d: lines.corduroy(d, 1.0, "horizontal", 0.5, seed=1),
        lambda d: tiles.buffer_corruption_grid(d, 64, 0.5),
        lambda d: pixelwise.salt_pepper(d, 0.2, seed=1),
    ],
)
def test_very_wide_frames(raster, planes, op):
    frame = {b: np.full((3, 70_000), 100) for b in "rgb"}
    got = planes(op(raster({1: frame})))[1]
    assert got["r"].shape == (3, 70_000) and (got["r"] != 100).any() and (got["r"] == 100).any()


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize(
    "op",
    [
        lambda d: pixelwise.saturation(d, "fixed", 0.5),
        lambda d: pixelwise.noise(d, "gaussian", 0.1, seed=1),
        lambda d: pixelwise.noise(d, "column", 0.1, seed=1),
        lambda d: pixelwise.salt_pepper(d, 0.1),
        lambda d: lines.corduroy(d, 1.0, "vertical", 0.5),
        lambda d: tiles.buffer_corruption_grid(d, 8, 0.5),
        lambda d: tiles.band_swap(d, 5, "BGR"),
    ],
)
def test_line_work_costs_no_shuffle(raster, op):
    """Neither before a sink nor on the way to a neighbourhood step, which has one of its own."""
    scan = raster({1: picture(20, 20, 1)})
    assert shuffles(to_scanlines(op(scan))) == 0
    assert shuffles(stencils.blur_gaussian(op(scan), 1.0)) == 1


def test_grid_cutoff_in_chunks(monkeypatch):
    whole = tiles.grid_cutoff(37, 29, 400, 5)
    monkeypatch.setattr(tiles, "CELLS", 100)
    assert tiles.grid_cutoff(37, 29, 400, 5) == whole
    cell = np.arange(37 * 29)
    drawn = draws.state_array(5, "grid_pick", cell // 29, cell % 29)
    assert ((drawn < whole[0]) | ((drawn == whole[0]) & (cell <= whole[1]))).sum() == 400


def test_hits_of_lines_are_those_of_the_frame(raster, planes, monkeypatch):
    """Few hits are kept for the next lines, many are drawn again for each batch."""
    scan = raster({1: picture(60, 50, 1), 2: picture(33, 20, 2)})
    kept = planes(pixelwise.salt_pepper(scan, 0.3, seed=2))
    monkeypatch.setattr(pixelwise, "HELD_DRAWS", 0)
    monkeypatch.setattr(pixelwise, "DRAWS", 64)
    again = planes(pixelwise.salt_pepper(scan.repartition(9), 0.3, seed=2))
    assert all((kept[f][b] == again[f][b]).all() for f in kept for b in "rgb")


def test_draws_of_arrays_agree_with_columns():
    keys = np.arange(50)
    assert draws.state_array(3, "n", keys, 7).tolist() == [draws.state_value(3, "n", k, 7) for k in range(50)]
    ids = np.array([-5, 0, 1 << 40])
    low, high = draws.key_arrays(None, ids)
    assert low.tolist() == [i & 2147483647 for i in ids.tolist()]
    assert high.tolist() == [((i % (1 << 64)) >> 31) % draws.P2 for i in ids.tolist()]


def test_grey_rules(raster, planes):
    scan = raster({1: picture(8, 8, 1, "v")})
    with pytest.raises(ValueError):
        tiles.band_swap(scan, 1, "BGR")
    assert stencils.bayer_filter(scan) is scan
    assert stencils.chromatic_aberration(scan, 3, 3) is scan
    assert tiles.buffer_corruption(scan, 1, "channel_shuffle", 1.0) is scan
    assert planes(pixelwise.saturation(scan, "fixed", 0.5))[1].keys() == {"r", "g", "b"}


@pytest.mark.parametrize(
    "call",
    [
        lambda d: pixelwise.saturation(d, "loud", 1),
        lambda d: pixelwise.saturation(d, "fixed"),
        lambda d: pixelwise.saturation(d, "fixed", -1.5),
        lambda d: pixelwise.saturation(d, "random", range=[0.5, 0.5]),
        lambda d: pixelwise.saturation(d, "random", range=[-2, 0.5]),
        lambda d: pixelwise.noise(d, "diagonal", 0.1),
        lambda d: pixelwise.noise(d, "row", 1.1),
        lambda d: pixelwise.salt_pepper(d, -0.1),
        lambda d: pixelwise.salt_pepper(d, 0.1, 1.5),
        lambda d: pixelwise.gamma_map(d, 0),
        lambda d: lines.corduroy(d, 2, "vertical", 0.1),
        lambda d: lines.corduroy(d, 0.5, "sideways", 0.1),
        lambda d: lines.slc_off(d, 0.6, 14),
        lambda d: lines.slc_off(d, 0.2, 1),
        lambda d: lines.slc_off(d, 0.2, 14, "red"),
        lambda d: tiles.band_swap(d, 0, "BGR"),
        lambda d: tiles.band_swap(d, 51, "BGR"),
        lambda d: tiles.band_swap(d, 5, "RGB"),
        lambda d: tiles.band_swap(d, 5, "BGR", (0.3, 0.2)),
        lambda d: tiles.buffer_corruption(d, 21, "xor", 0.5),
        lambda d: tiles.buffer_corruption(d, 5, "melt", 0.5),
        lambda d: tiles.buffer_corruption(d, 5, "xor", 1.5),
    ],
)
def test_bad_parameters(raster, call):
    with pytest.raises(ValueError):
        call(raster({1: picture(4, 4)}))
