"""Media columns: texts stored as 8-bit sound, and features of the sound."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, forget, small_batches

UNIT, RATE = 576, 20_000
#: Resampling by UP / DOWN to 8 kHz; frames of FRAME samples, one each HOP; BANDS mel bands; segments of STEPS x BANDS.
UP, DOWN, TAPS, FRAME, HOP, BANDS, STEPS = 2, 5, 48, 256, 128, 24, 8


def pad(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples as a RIFF file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a RIFF file, chunk by chunk; ValueError if it isn't one of 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _filter(up: int, down: int) -> np.ndarray:
    """Low-pass filter, one row a phase: row p weighs the TAPS samples around output positions of phase p."""
    n = np.arange(TAPS * up) - (TAPS * up - 1) / 2
    cutoff = min(1 / up, 1 / down) * 0.9
    taps = cutoff * np.sinc(cutoff * n) * np.kaiser(len(n), 8.0) * up
    return taps.reshape(TAPS, up).T[:, ::-1].copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` at up / down of its rate: each output takes only the taps of its phase, so no zero is multiplied."""
    phases = _filter(up, down)
    padded = np.concatenate([np.zeros(TAPS // 2 - 1), x, np.zeros(TAPS)])
    n = -(-len(x) * up // down)
    out = np.empty(n)
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    for first in range(up):
        place = np.arange(first, n, up) * down
        out[first::up] = windows[place[0] // up :: down][: len(place)] @ phases[place[0] % up] if len(place) else 0
    return out


@cache
def _mel() -> np.ndarray:
    """Triangular bands on the mel scale, for power spectra of FRAME samples."""
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + rate / 2 / 700), BANDS + 2) / 2595) - 1)
    frequency = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (frequency - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - frequency) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x BANDS: logarithms of band energies in overlapped Hann windows; a short sound is padded to one frame."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x))])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), BANDS))
    for at in range(0, len(frames), 4096):  # long sounds in parts
        out[at : at + 4096] = np.log(np.abs(np.fft.rfft(frames[at : at + 4096] * np.hanning(FRAME), axis=1)) ** 2 @ _mel() + 1e-8)
    return out


def segments(energy: np.ndarray, up: float = 0.3, down: float = 0.1) -> list[tuple[int, int]]:
    """Spans of frames by hysteresis: one starts where the energy rises over the median by ``up``, and ends where it
    falls to less than ``down`` over it. A sound without any is one span."""
    level = np.median(energy)
    mark = np.where(energy > level + up, 1, np.where(energy < level + down, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[last] == 1), [False]])
    change = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True)) or [(0, len(energy))]


def features(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment its time span (start and end in seconds) and its log-mel energies, averaged to STEPS x BANDS."""
    rate, data = samples_of(media)
    sound = resample(np.frombuffer(data, np.uint8) / 128 - 1)
    mel = log_mel(sound)
    spans = np.array(segments(mel.mean(axis=1)))
    sums = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mel, axis=0)])
    steps = spans[:, :1] + np.arange(STEPS + 1) * (spans[:, 1:] - spans[:, :1]) / STEPS
    lows = np.minimum(np.floor(steps[:, :-1]).astype(int), spans[:, 1:] - 1)
    highs = np.maximum(np.ceil(steps[:, 1:]).astype(int), lows + 1)
    tensors = (sums[highs] - sums[lows]) / (highs - lows)[:, :, None]
    seconds = spans * HOP / (rate * UP / DOWN)
    return seconds, np.round(tensors, 3).astype(np.float32)


TENSOR = pa.fixed_shape_tensor(pa.float32(), [STEPS, BANDS])
#: A stored table of segments: a span in seconds, and a tensor of fixed shape.
SEGMENTS = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("energies", TENSOR)])


def stored_segments(seconds: np.ndarray, tensors: np.ndarray) -> bytes:
    """Spans and tensors as an Arrow stream of SEGMENTS, one row a segment."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(tensors).ravel()), STEPS * BANDS)
    batch = pa.record_batch([pa.array(seconds[:, 0]), pa.array(seconds[:, 1]), pa.ExtensionArray.from_storage(TENSOR, flat)], schema=SEGMENTS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SEGMENTS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_segments(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spans (start and end in seconds) and tensors (segments x STEPS x BANDS) of an Arrow stream of SEGMENTS."""
    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    energies = table.column("energies").chunk(0).to_numpy_ndarray() if table.num_rows else np.zeros((0, STEPS, BANDS), np.float32)
    return np.stack([table.column(c).to_numpy() for c in ("start", "end")], axis=1), energies


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, segments binary, feature string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches_of(batches, 256):
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode()
            media = wav(pad(data))
            stream = stored_segments(*features(media))
            back = samples_of(media)[1]
            spans, energies = read_segments(stream)
            feature = f"{len(spans)}:{spans[-1, 1]:.6f}:{hashlib.sha256(np.ascontiguousarray(energies, '<f4').tobytes()).hexdigest()}"
            rows.append((doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), media, stream, feature))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "segments", "feature"])


def media_features(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media, segments, feature.

    The text's UTF-8 (null: empty), padded with bytes 255 to a positive multiple of 576, is stored as 8-bit samples in a
    WAV file. What is read back from the file is hashed, and gives the features: it is resampled to 8 kHz, log-mel
    energies of overlapped frames are segmented by hysteresis, and each segment has a span in seconds and a tensor of
    8 x 24. ``segments`` stores them as an Arrow stream whose tensors have Arrow's fixed-shape type (``read_segments``);
    ``feature`` names the number of segments, the last one's end, and the hash of the tensors as read back.
    Equal texts have equal rows but for doc_id; repeated rows are rows of their own; long texts are kept whole. Columns
    other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_run, _SCHEMA)
