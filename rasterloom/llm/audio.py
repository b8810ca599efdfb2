"""Audio features: polyphase resampling, log-mel filterbanks and energy segments.

Audio is stored as mono 8-bit WAV bytes. Features of one recording are an Arrow stream in a binary
column: blocks of ``FRAMES`` frames as fixed-shape tensors, each with its time span.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.tables import schema_of

RATE = 16_000
UP, DOWN = 3, 4
WINDOW, HOP, SIZE, MELS = 300, 120, 512, 24
FRAMES = 64
TAPS = 8
BLOCK = 1 << 18
HEADER = "<4sI4s4sIHHIIHH4sI"


def payload(text: Column, unit: int = 64) -> Column:
    """The UTF-8 bytes of a text (null: none), with bytes 0 up to a positive multiple of ``unit``."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(data)
    padded = F.greatest(F.lit(unit), F.ceil(size / unit) * unit)
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (padded - size).cast("int"))))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples. An odd number of samples gets the usual pad byte."""
    n = len(samples)
    head = struct.pack(HEADER, b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a file made by ``wav``; an error for any other kind."""
    riff, _, wave, fmt, _, kind, channels, rate, _, _, bits, mark, n = struct.unpack_from(HEADER, data)
    if (riff, wave, fmt, mark, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8):
        raise ValueError("not a mono 8-bit WAV file")
    if len(data) < struct.calcsize(HEADER) + n:
        raise ValueError("a cut WAV file")
    return np.frombuffer(data, np.uint8, n, struct.calcsize(HEADER)), rate


def _phases() -> np.ndarray:
    """Low-pass taps of each output phase, ``2 * TAPS`` inputs each; each phase sums to 1."""
    inputs = np.arange(-TAPS + 1, TAPS + 1)
    cut = min(1.0, UP / DOWN)
    found = []
    for phase in range(UP):
        at = inputs - phase / UP
        taps = cut * np.sinc(cut * at) * (0.5 + 0.5 * np.cos(np.pi * np.clip(at / TAPS, -1, 1)))
        found.append(taps / taps.sum())
    return np.array(found)


def resample(samples: np.ndarray) -> np.ndarray:
    """``UP / DOWN`` as many samples, by polyphase filters; beyond its ends a recording is silent."""
    wave = (samples.astype(np.float32) - 128) / 128
    n = len(wave) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS, np.float32), wave, np.zeros(TAPS + 1, np.float32)])
    out = np.empty(n, np.float32)
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * TAPS)
    for residue, taps in enumerate(_phases()[np.arange(UP) * DOWN % UP]):
        first = residue * DOWN // UP
        count = len(out[residue::UP])
        out[residue::UP] = views[first + 1 :: DOWN][:count] @ taps.astype(np.float32)
    return out


def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, over the bins of a spectrum."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(SIZE // 2 + 1) * rate / SIZE
    low, middle, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((bins - low) / (middle - low), (high - bins) / (high - middle)), 0, None).T.astype(np.float32)


def log_mel(wave: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows of overlapping frames, and each frame's energy in decibels. At least one frame."""
    frames = max(1, 1 + -(-(len(wave) - WINDOW) // HOP)) if len(wave) else 1
    padded = np.zeros((frames - 1) * HOP + WINDOW, np.float32)
    padded[: len(wave)] = wave[: len(padded)]
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    shape, bank = np.hanning(WINDOW).astype(np.float32), mel_bank(rate)
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for i in range(0, frames, BLOCK // SIZE):
        part = views[i : i + BLOCK // SIZE]
        spectrum = np.fft.rfft(part * shape, SIZE)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[i : i + len(part)] = np.log(power @ bank + 1e-6)
        energy[i : i + len(part)] = 10 * np.log10((part**2).mean(1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Spans of frames that begin at ``high`` or above and last until energy falls below ``low``."""
    state = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    loud = np.where(known >= 0, state[known], 0) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], loud, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensor_stream(mel: np.ndarray, rate: float) -> bytes:
    """An Arrow stream of fixed-shape ``FRAMES x MELS`` tensors with spans in milliseconds.

    The last block is filled up with its lowest value; ``frames`` tells how many rows are real.
    """
    rows = -(-len(mel) // FRAMES)
    full = np.full((rows * FRAMES, MELS), mel.min() if len(mel) else 0, np.float32)
    full[: len(mel)] = mel
    held = np.minimum(FRAMES, len(mel) - np.arange(rows) * FRAMES)
    begin = np.arange(rows) * FRAMES * HOP * 1000 / rate
    batch = pa.RecordBatch.from_pydict(
        {
            "start_ms": begin,
            "end_ms": begin + ((held - 1) * HOP + WINDOW) * 1000 / rate,
            "frames": held.astype(np.int32),
            "mel": pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(rows, FRAMES, MELS)),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small batches, so that what is made from one is small too."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def store(df: DataFrame, keep: list[str], rate: int = RATE) -> DataFrame:
    """Columns ``keep`` with ``media``: the bytes of ``payload`` as the samples of a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            files = [wav(p.as_py() or b"", rate) for p in batch.column("payload")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"media": pa.array(files, pa.binary())})

    kept = schema_of(df, keep)
    return df.select(*keep, "payload").mapInArrow(run, f"{kept}, media binary")


def features(df: DataFrame, keep: list[str], high: float = -9.0, low: float = -12.0) -> DataFrame:
    """Columns ``keep`` with the features of the WAV file in ``media``.

    Adds ``payload`` (the samples read back), ``tensors`` (``tensor_stream``), ``segments`` (array
    of ``start_ms, end_ms``), and ``n_frames``. Equal files give equal features wherever they run.
    A recording without samples has one silent frame; a null or broken file is an error. Memory
    follows the longest recording, not the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            back, tensors, spans, frames = [], [], [], []
            for file in batch.column("media"):
                samples, rate = read_wav(file.as_py())
                out_rate = rate * UP / DOWN
                mel, energy = log_mel(resample(samples), out_rate)
                back.append(samples.tobytes())
                tensors.append(tensor_stream(mel, out_rate))
                step = HOP * 1000 / out_rate
                found = segments(energy, high, low)
                spans.append([{"start_ms": a * step, "end_ms": b * step} for a, b in found])
                frames.append(len(mel))
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in keep}
                | {
                    "payload": pa.array(back, pa.binary()),
                    "tensors": pa.array(tensors, pa.binary()),
                    "segments": pa.array(spans, pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))),
                    "n_frames": pa.array(frames, pa.int64()),
                }
            )

    kept = schema_of(df, keep)
    schema = f"{kept}, payload binary, tensors binary, segments array<struct<start_ms: double, end_ms: double>>, n_frames long"
    return df.select(*keep, "media").mapInArrow(run, schema)


def read_tensors(stream: bytes) -> pa.Table:
    """The table of a tensor stream."""
    return pa.ipc.open_stream(stream).read_all()
