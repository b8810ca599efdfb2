import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rasterloom.model import all_bands, to_scanlines  # noqa: E402
from rasterloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def raster(spark):
    """Make scanlines from ``{frame_id: {band: 2-d array}}``."""

    def make(frames):
        rows, bands = [], None
        for frame_id, planes in frames.items():
            bands = list(planes)
            height, width = planes[bands[0]].shape
            for y in range(height):
                rows.append((frame_id, height, width, y, *[planes[b][y].tolist() for b in bands]))
        schema = "frame_id long, height int, width int, y int, " + ", ".join(
            f"{b} array<int>" for b in bands
        )
        return spark.createDataFrame(rows, schema).repartition(4)

    return make


@pytest.fixture
def planes():
    """Collect a raster back to ``{frame_id: {band: 2-d array}}``."""

    def get(df):
        scan = to_scanlines(df)
        bands = all_bands(scan)
        found = {}
        for row in sorted(scan.collect(), key=lambda r: (r.frame_id, r.y)):
            found.setdefault(row.frame_id, []).append(row)
        return {
            f: {b: np.array([r[b] for r in rows]) for b in bands} for f, rows in found.items()
        }

    return get


def picture(height, width, seed=0, bands="rgb"):
    rng = np.random.default_rng(seed)
    return {b: rng.integers(0, 256, (height, width)) for b in bands}
