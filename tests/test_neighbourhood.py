"""Neighbourhood operators against small brute-force versions, over many strips."""

import math

import numpy as np
import pytest
from conftest import picture

from rasterloom.functions import kernels
from rasterloom.operators import blocks, passes, resample, stencils, strips
from rasterloom.model import to_pixels


@pytest.fixture
def small_strips(monkeypatch):
    """Strips of 64 lines, so that a 300-line frame is cut into five."""
    monkeypatch.setattr(strips, "STRIP_PIXELS", 1)
    monkeypatch.setattr(resample, "STRIP_PIXELS", 1)


def fold(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def brute(plane, taps):
    height, width = plane.shape
    total = np.zeros((height, width), dtype=np.int64)
    for dy, dx, w in taps:
        ys = [fold(y + dy, height) for y in range(height)]
        xs = [fold(x + dx, width) for x in range(width)]
        total += w * plane[np.ix_(ys, xs)]
    return total


TAPS = [(-3, 2, 5), (-1, -4, 2), (0, 0, 1), (0, 1, 1), (2, 0, 3), (4, -1, 4)]


def test_stencil_over_strips(raster, planes, small_strips):
    frames = {1: picture(300, 17, 1), 2: picture(65, 9, 2), 3: picture(3, 4, 3), 9: picture(1, 1, 4)}
    got = planes(stencils.stencil(raster(frames), TAPS, 16))
    for f, bands in frames.items():
        for b, plane in bands.items():
            assert (got[f][b] == brute(plane, TAPS) // 16).all()


@pytest.mark.parametrize("dy", [-90, 90])
def test_one_sided_stencil(raster, planes, small_strips, dy):
    """Mirrored lines at the last, short strip are at hand whichever way a stencil reads."""
    frames = {1: picture(150, 5, 1, "v"), 2: picture(40, 5, 2, "v")}
    taps = [(dy, 0, 1), (0, 1, 2)]
    got = planes(stencils.stencil(raster(frames), taps, 3))
    for f, bands in frames.items():
        assert (got[f]["v"] == brute(bands["v"], taps) // 3).all()


def test_tiles_send_few_lines(raster, monkeypatch):
    """A strip gets its own lines and parts of 16-line bands, not 16 lines for each tile."""
    monkeypatch.setattr(strips, "STRIP_PIXELS", 1)
    chain = blocks.compression_artifact_chain(["r", "g", "b"], 20, 5, (0.08, 0.25), seed=400)
    sent = sum(
        hi - lo
        for first in range(0, 2160, 64)
        for lo, hi in [passes.ranges_of(chain, first, min(first + 64, 2160), 2160, 3840)[0]]
    )
    assert 2160 <= sent < 2160 + 34 * 2 * 64


def test_stencil_wider_than_frame(raster, planes):
    """The mirror image repeats when a kernel reaches past it."""
    frames = {5: picture(4, 3, 7, "v")}
    got = planes(stencils.blur_circular(raster(frames), 11))
    taps = kernels.disc(11)
    assert (got[5]["v"] == brute(frames[5]["v"], taps) // len(taps)).all()


@pytest.mark.parametrize("sigma", [0.6, 2.0, 9.0])
def test_gaussian(raster, planes, small_strips, sigma):
    frames = {1: picture(140, 15, 1), 2: picture(10, 30, 2)}
    got = planes(stencils.blur_gaussian(raster(frames), sigma))
    w = kernels.gaussian(sigma)
    r = len(w) // 2
    assert sum(w) == kernels.ONE
    exact = np.array([math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)])
    assert np.abs(np.array(w) / kernels.ONE - exact / exact.sum()).max() < 5e-4
    for f, bands in frames.items():
        for b, plane in bands.items():
            down = brute(plane, [(k - r, 0, v) for k, v in enumerate(w)])
            want = brute(down, [(0, k - r, v) for k, v in enumerate(w)]) >> 32
            assert (got[f][b] == want).all()


def test_constant_image_stays(raster, planes):
    flat = {"r": np.full((20, 20), 128), "g": np.full((20, 20), 7), "b": np.full((20, 20), 255)}
    scan = raster({1: flat})
    for op in (
        lambda d: stencils.blur_gaussian(d, 2.5),
        lambda d: stencils.blur_circular(d, 3),
        lambda d: stencils.motion_blur(d, 7),
        lambda d: stencils.motion_blur(d, 8, 30.0),
        lambda d: resample.downscale(d, 0.4, True, "lanczos", "bicubic"),
    ):
        got = planes(op(scan))[1]
        for b in "rgb":
            assert (got[b] == flat[b]).all()


def test_motion_kernel_against_sampling():
    """The line kernel sampled bilinearly at rotated places, nothing outside it."""
    for size, angle in ((5, 45.0), (6, 30.0), (9, 120.0), (4, 90.0)):
        line = np.zeros((size + 2, size + 2))
        line[(size - 1) // 2 + 1, 1:-1] = 1.0
        middle = (size - 1) / 2
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        want = np.zeros((size, size))
        for y in range(size):
            for x in range(size):
                sx = round(c * (x - middle) - s * (y - middle) + middle, 9)
                sy = round(s * (x - middle) + c * (y - middle) + middle, 9)
                if not (-1 <= sx < size and -1 <= sy < size):
                    continue
                x0, y0 = math.floor(sx), math.floor(sy)
                fx, fy = sx - x0, sy - y0
                cell = line[y0 + 1 : y0 + 3, x0 + 1 : x0 + 3]
                weight = np.outer([1 - fy, fy], [1 - fx, fx])[: cell.shape[0], : cell.shape[1]]
                want[y, x] = (cell * weight).sum()
        want /= want.sum()
        got = np.zeros((size, size))
        for dy, dx, w in kernels.motion(size, angle):
            got[size // 2 - dy, size // 2 - dx] = w / kernels.ONE
        assert np.abs(got - want).max() < 1e-3


def test_even_motion_blur_offsets():
    assert kernels.motion(4, 0) == [(1, 2, 1), (1, 1, 1), (1, 0, 1), (1, -1, 1)]
    assert kernels.motion(3, 0) == [(0, 1, 1), (0, 0, 1), (0, -1, 1)]


def test_chromatic_aberration(raster, planes):
    frame = picture(12, 10, 3)
    got = planes(stencils.chromatic_aberration(raster({1: frame}), 2, 15))[1]
    assert (got["r"] == 0).all() and (got["b"] == 0).all() and (got["g"] == frame["g"]).all()
    got = planes(stencils.chromatic_aberration(raster({1: frame}), -3, 1))[1]
    want = np.zeros((12, 10), dtype=int)
    want[1:, :7] = frame["r"][:-1, 3:]
    assert (got["r"] == want).all()
    want = np.zeros((12, 10), dtype=int)
    want[:-1, 3:] = frame["b"][1:, :7]
    assert (got["b"] == want).all()


def test_mosaic_over_strips(raster, planes, small_strips):
    """Cutting into strips changes nothing, and sampled cells keep their value."""
    frame = picture(200, 11, 5)
    for method in ("linear", "bilinear"):
        got = planes(stencils.bayer_filter(raster({1: frame}), "GRBG", method))[1]
        assert (got["r"][0::2, 1::2] == frame["r"][0::2, 1::2]).all()
        assert (got["b"][1::2, 0::2] == frame["b"][1::2, 0::2]).all()
        assert (got["g"][0::2, 0::2] == frame["g"][0::2, 0::2]).all()


def test_mosaic_strips_equal_whole(raster, planes, monkeypatch):
    scan = raster({1: picture(200, 11, 5), 2: picture(131, 6, 6)})
    whole = {m: planes(stencils.bayer_filter(scan, "BGGR", m)) for m in ("linear", "bilinear")}
    monkeypatch.setattr(strips, "STRIP_PIXELS", 1)
    for m, want in whole.items():
        got = planes(stencils.bayer_filter(scan, "BGGR", m))
        assert all((got[f][b] == want[f][b]).all() for f in want for b in "rgb")


@pytest.mark.parametrize("method", ["box", "bilinear", "bicubic", "lanczos", "bilinear_point"])
def test_resize_strips_equal_whole(raster, planes, monkeypatch, method):
    scan = raster({1: picture(211, 13, 5), 2: picture(64, 40, 6)})
    whole = planes(resample.downscale(scan, 0.37, True, method, method))
    monkeypatch.setattr(resample, "STRIP_PIXELS", 1)
    got = planes(resample.downscale(scan, 0.37, True, method, method))
    assert all((got[f][b] == whole[f][b]).all() for f in whole for b in "rgb")
    assert whole[1]["r"].shape == (211, 13)


def test_resize_sizes(raster, planes):
    got = planes(resample.downscale(raster({1: picture(30, 7, 1)}), 0.01, False, "box"))
    assert got[1]["r"].shape == (1, 1)


def test_codec_strips_equal_whole(raster, planes, monkeypatch):
    scan = raster({1: picture(203, 21, 5), 2: picture(64, 40, 6)})
    whole = planes(blocks.multi_compress(scan, 3, 50, 10, "linear"))
    monkeypatch.setattr(strips, "STRIP_PIXELS", 1)
    got = planes(blocks.multi_compress(scan, 3, 50, 10, "linear"))
    assert all((got[f][b] == whole[f][b]).all() for f in whole for b in "rgb")


@pytest.mark.parametrize("partial", ["pad", "skip"])
def test_tile_codec_strips_equal_whole(raster, planes, monkeypatch, partial):
    """Overlapping compressed tiles come out the same however the frame is cut."""
    scan = raster({1: picture(900, 40, 5), 2: picture(64, 40, 6)})
    args = dict(tile_count=3, quality=5, tile_size_range=(0.3, 0.8), seed=3, partial=partial)
    whole = planes(blocks.compression_artifact(scan, **args))
    monkeypatch.setattr(strips, "STRIP_PIXELS", 1)
    got = planes(blocks.compression_artifact(scan, **args))
    assert all((got[f][b] == whole[f][b]).all() for f in whole for b in "rgb")


def test_high_quality_is_near(raster, planes):
    """Smooth pictures survive a high quality nearly unchanged, and lose more at a low one."""
    y, x = np.mgrid[0:48, 0:48]
    frame = {"r": 2 * y + 60, "g": 2 * x + 60, "b": y + x + 60}
    scan = raster({1: frame})
    worst = {
        q: max(np.abs(planes(blocks.compression(scan, q, 0))[1][b] - frame[b]).max() for b in "rgb")
        for q in (100, 5)
    }
    assert worst[100] <= 3 < worst[5]


def test_block_round_trip(raster, planes):
    """Without quantisation the transform gives the picture back."""
    frames = {1: picture(21, 19, 2, "v"), 2: picture(8, 8, 3, "v")}
    rebuilt = blocks.from_blocks(blocks.block_idct(blocks.block_dct(blocks.to_blocks(raster(frames)))))
    got = planes(rebuilt)
    assert all((got[f]["v"] == frames[f]["v"]).all() for f in frames)


def test_skip_keeps_partial_blocks(raster):
    made = blocks.to_blocks(raster({1: picture(21, 19, 2, "v")}), partial="skip")
    assert sorted((r.by, len(r.v)) for r in made.collect()) == [(0, 128), (1, 128)]


def test_block_work_shuffles_once(raster):
    scan = raster({1: picture(21, 19, 2, "v")})
    rebuilt = blocks.from_blocks(blocks.block_idct(blocks.quantize(blocks.block_dct(blocks.to_blocks(scan)), 20)))
    colour = blocks.to_ycbcr(raster({1: picture(21, 19, 2)}))
    for df, most in ((rebuilt, 1), (blocks.subsample_chroma(colour, 2), 1), (blocks.subsample_chroma(colour, 1), 0)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == most


def test_quality_schedule():
    assert blocks.quality_schedule(1, 60, 20, "linear") == [60]
    assert blocks.quality_schedule(3, 60, 20, "linear") == [60, 40, 20]
    assert blocks.quality_schedule(4, 50) == [50] * 4
    assert blocks.quality_schedule(5, 13, 4, "exponential")[-1] == 3
    with pytest.raises(ValueError):
        blocks.quality_schedule(3, 20, 20, "linear")
    with pytest.raises(ValueError):
        blocks.quality_schedule(3, 20, None, "linear")


def test_missing_line_is_an_error(raster):
    scan = raster({1: picture(10, 8, 1)}).where("y <> 4")
    with pytest.raises(Exception, match="exactly once"):
        stencils.blur_circular(scan, 2).collect()
    for lost in ("y > 0", "y < 9"):
        part = raster({7: picture(10, 8, 1)}).where(lost)
        for op in (lambda d: stencils.blur_circular(d, 2), lambda d: blocks.compression(d, 50)):
            with pytest.raises(Exception, match="exactly once: frame 7"):
                op(part).collect()


def test_pixel_and_line_input_agree(raster, planes):
    scan = raster({1: picture(20, 16, 1, "rgba")})
    a = planes(stencils.motion_blur(scan, 5, 20.0))
    b = planes(stencils.motion_blur(to_pixels(scan).repartition(7), 5, 20.0))
    assert all((a[1][c] == b[1][c]).all() for c in "rgba")


def by_hand_enlarged(plane, tall, broad):
    """Each pixel takes three parts of its chroma cell and one of the nearer neighbour, each way."""
    rows, columns = plane.shape
    out = np.zeros((rows * tall, columns * broad), np.int64)
    for y in range(rows * tall):
        i = y // tall
        i2 = min(max(i + (1 if y % 2 else -1), 0), rows - 1)
        for x in range(columns * broad):
            j = x // broad
            j2 = min(max(j + (1 if x % 2 else -1), 0), columns - 1)
            if columns <= 2:
                out[y, x] = plane[i, j]
            elif tall == 2:
                near, far = (3 * plane[i, k] + plane[i2, k] for k in (j, j2))
                out[y, x] = (3 * near + far + (7 if x % 2 else 8)) >> 4
            else:
                out[y, x] = (3 * plane[i, j] + plane[i, j2] + (2 if x % 2 else 1)) >> 2
    return out


@pytest.mark.parametrize("shape", [(1, 1), (5, 2), (1, 7), (6, 3), (9, 12)])
def test_enlarged_chroma(shape):
    plane = np.random.default_rng(1).integers(0, 256, shape)
    for tall, broad in ((2, 2), (1, 2)):
        assert (blocks.smooth_chroma(plane, tall, broad) == by_hand_enlarged(plane, tall, broad)).all()
    assert (blocks.smooth_chroma(plane, 1, 1) == plane).all()


def test_smooth_chroma_does_not_depend_on_strips(raster, planes, monkeypatch):
    """Bands read their neighbours' chroma across strips and generations."""
    frames = {1: picture(333, 37, 5), 2: picture(18, 41, 6)}
    scan = raster(frames)
    tiled = dict(tile_count=4, quality=5, tile_size_range=(0.3, 0.8), seed=3, smooth=True)
    whole = planes(blocks.compression_artifact(scan, **tiled))
    monkeypatch.setattr(strips, "STRIP_PIXELS", 1)
    got = planes(blocks.compression_artifact(scan, **tiled))
    assert all((got[f][b] == whole[f][b]).all() for f in whole for b in "rgb")
    for generations, subsampling in ((1, 2), (3, 2), (40, 2), (3, 1), (2, 0)):  # 40 are several passes
        got = planes(blocks.multi_compress(scan, generations, 30, subsampling=subsampling, smooth=True))
        for f, held in frames.items():
            work = [held[b].astype(np.int64) for b in "rgb"]
            for _ in range(generations):
                work = blocks.codec_round_trip(work, 30, subsampling, smooth=True)
            assert all((got[f][b] == w).all() for b, w in zip("rgb", work)), (f, generations, subsampling)
    with pytest.raises(ValueError, match="smooth"):
        blocks.compression(scan, 10, partial="skip", smooth=True)
