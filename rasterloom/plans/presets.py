"""Ready step lists."""

from __future__ import annotations

# The list behind the baseline's timing.
GLITCH_ART = [
    {"name": "gaps", "operation": "slc_off",
     "params": {"gap_width": 0.5, "scan_period": 8, "fill_mode": "white"}},
    {"name": "colour", "operation": "band_swap",
     "params": {"tile_count": 15, "permutation": "BGR", "tile_size_range": [0.10, 0.30], "seed": 42}},
    {"name": "buffer", "operation": "buffer_corruption",
     "params": {"tile_count": 10, "corruption_type": "channel_shuffle", "severity": 1.0,
                "tile_size_range": [0.05, 0.25], "seed": 100}},
    {"name": "banding", "operation": "corduroy",
     "params": {"strength": 1.0, "orientation": "horizontal", "density": 0.8, "seed": 200}},
    {"name": "static", "operation": "salt_pepper",
     "params": {"amount": 0.005, "salt_vs_pepper": 0.5, "seed": 300}},
    {"name": "blocks", "operation": "compression_artifact",
     "params": {"tile_count": 20, "quality": 1, "tile_size_range": [0.08, 0.25], "seed": 400}},
]

# A per-pixel step before a blur, and a line step behind it.
WORN_PRINT = [
    {"name": "warm", "operation": "saturation", "params": {"mode": "fixed", "value": 0.35}},
    {"name": "soft", "operation": "blur_gaussian", "params": {"sigma": 1.5}},
    {"name": "banded", "operation": "noise", "params": {"mode": "row", "amount": 0.08, "seed": 11}},
]

# Frames get smaller and stay small; what follows works on the new size.
SMALL_SENSOR = [
    {"name": "grain", "operation": "noise", "params": {"mode": "gaussian", "amount": 0.06, "seed": 21}},
    {"name": "shrunk", "operation": "downscale",
     "params": {"scale": 0.5, "upscale": False, "downscale_method": "box"}},
    {"name": "mosaic", "operation": "bayer_filter", "params": {"pattern": "GBRG"}},
    {"name": "stored", "operation": "compression", "params": {"quality": 35}},
]

# Four steps with neighbours of different reach, for stores and streams.
DRIFTING_TAPE = [
    {"name": "fringe", "operation": "chromatic_aberration", "params": {"shift_x": 2, "shift_y": -1}},
    {"name": "drag", "operation": "motion_blur", "params": {"kernel_size": 6, "angle": 120}},
    {"name": "ribs", "operation": "corduroy",
     "params": {"strength": 0.6, "orientation": "vertical", "density": 0.4, "seed": 8}},
    {"name": "copy", "operation": "compression", "params": {"quality": 45, "subsampling": 1}},
]

# A step repeated more often than a lazy plan would stand as separate passes.
COPIES_OF_COPIES = [
    {"name": "copies", "operation": "compression", "repeat": 10, "params": {"quality": 55}},
]

# Only line work, so it runs on a stream as it is.
LINE_FAULTS = [
    {"name": "dust", "operation": "salt_pepper", "params": {"amount": 0.04, "salt_vs_pepper": 0.7, "seed": 31}},
    {"name": "ribs", "operation": "corduroy",
     "params": {"strength": 0.9, "orientation": "vertical", "density": 0.25, "seed": 32}},
    {"name": "rows", "operation": "corduroy",
     "params": {"strength": 0.5, "orientation": "horizontal", "density": 0.5, "seed": 33}},
    {"name": "cells", "operation": "buffer_corruption_grid",
     "params": {"tile_size": 9, "severity": 0.3, "magnitude": 63, "corruption_type": "xor", "seed": 34}},
]
