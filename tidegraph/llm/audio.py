"""Media columns: audio.  8-bit WAV in and out, polyphase resampling, log-mel tensors, energy segments.

:func:`store` wraps payload bytes as unsigned 8-bit mono samples in WAV files, the media column of a Parquet table in
the shared folder; :func:`describe` reads such files back and gives, for each, the payload, fixed-shape log-mel tensors
with their time spans (an Arrow IPC stream whose tensor column has the fixed-shape tensor type) and the spans of its
loud segments.

Everything is computed for one file at a time in blocks of fixed size from its start, so equal files give equal
bytes.  A frame begins at every hop within the file, the last ones filled up with zeros, so every sample counts.
Defined results: a null payload is an empty file with no frames; repeated rows give repeated results, and equal files
equal features (ties don't arise); an empty table gives an empty result; a file may be of any length, one at a time is
in memory with its features; a column named like one that is made raises ValueError, all others are carried along.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import no_clash, stage

HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class AudioSpec:
    """Parameters of the features."""

    rate: int = 16_000  # of the stored samples
    up: int = 1
    down: int = 2
    taps: int = 16  # of each phase of the resampling filter
    frame: int = 256  # samples at the new rate; frames overlap by frame - hop
    hop: int = 128
    mels: int = 32
    patch: int = 32  # frames in a tensor
    rise_db: float = 0.3  # a segment begins this far above the median energy ...
    fall_db: float = -0.3  # ... and ends this far above it
    block: int = 4096  # frames computed at once
    phases: np.ndarray = field(init=False, repr=False, compare=False)
    bank: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "phases", polyphase(self.up, self.down, self.taps))
        object.__setattr__(self, "bank", mel_bank(self.mels, self.frame, self.rate * self.up / self.down))

    @property
    def new_rate(self) -> float:
        return self.rate * self.up / self.down


def wav(payload: bytes, rate: int) -> bytes:
    """A WAV file of unsigned 8-bit mono samples; an odd payload gets the format's pad byte."""
    n = len(payload)
    return HEAD.pack(b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\0" * (n % 2)


def samples(media: bytes) -> bytes:
    """The payload of a file made by :func:`wav`; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def polyphase(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass filter split into ``up`` phases of ``taps`` coefficients, each of sum 1."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n)
    phases = h.reshape(taps, up).T
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """``x`` at ``up / down`` times its rate: each output sample uses one phase of the filter."""
    n = -(-len(x) * spec.up // spec.down)
    half = spec.taps // 2
    padded = np.concatenate([np.zeros(half - 1, np.float32), x, np.zeros(spec.taps, np.float32)])
    windows = sliding_window_view(padded, spec.taps)
    out = np.empty(n, np.float32)
    for first in range(min(spec.up, n)):
        start, phase = divmod(first * spec.down, spec.up)
        rows = windows[start :: spec.down][: len(range(first, n, spec.up))]
        kernel = spec.phases[phase][::-1]
        part = np.zeros(len(rows), np.float32)
        for k in range(spec.taps):
            part += rows[:, k] * kernel[k]
        out[first :: spec.up] = part
    return out


def mel_bank(mels: int, frame: int, rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as a (bins, mels) matrix."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(0.0), to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up = (bins[:, None] - low) / (mid - low)
    down = (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies, frame energies in dB); zeros follow the end, so that the last frame begins within ``y``."""
    n = -(-len(y) // spec.hop)
    mel, energy = np.empty((n, spec.mels), np.float32), np.empty(n, np.float32)
    if not n:
        return mel, energy
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * spec.hop + spec.frame - len(y)), np.float32)])
    windows = sliding_window_view(y, spec.frame)[:: spec.hop]
    # no near-zero ends: the first hop lies in one frame only, and its samples must not be lost in rounding
    taper = np.hamming(spec.frame).astype(np.float32)
    for at in range(0, n, spec.block):
        f = windows[at : at + spec.block] * taper
        spectrum = np.fft.rfft(f)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + spec.block] = np.log(power @ spec.bank + 1e-6)
        energy[at : at + spec.block] = 10 * np.log10((f * f).mean(axis=1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """(first frame, frame after the last) of each loud segment, with hysteresis: between the thresholds the state stays."""
    if not len(energy):
        return np.empty((0, 2), np.int64)
    level = np.median(energy)
    event = np.where(energy >= level + spec.rise_db, 1, np.where(energy < level + spec.fall_db, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[np.maximum(last, 0)] > 0)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def tensors(mel: np.ndarray, length: int, spec: AudioSpec) -> bytes:
    """An Arrow IPC stream: start_us, end_us, log_mel (fixed-shape tensor ``patch`` x ``mels``; the last is padded with its least value).

    Spans end with the ``length`` samples at the latest.
    """
    n = len(mel)
    count = -(-n // spec.patch)
    grid = np.full((count * spec.patch, spec.mels), mel.min() if n else 0, np.float32)
    grid[:n] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [spec.patch, spec.mels])
    body = pa.FixedSizeListArray.from_arrays(pa.array(grid.reshape(-1)), spec.patch * spec.mels)
    first = np.arange(count, dtype=np.int64) * spec.patch
    last = np.minimum(first + spec.patch, n) - 1
    us = lambda s: (s * 1_000_000 / spec.new_rate).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(us(first * spec.hop)), pa.array(us(np.minimum(last * spec.hop + spec.frame, length))), pa.ExtensionArray.from_storage(kind, body)], names=["start_us", "end_us", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features(payload: bytes, spec: AudioSpec) -> tuple[int, list[dict], bytes]:
    """(frames, loud segments in microseconds, tensors) of 8-bit samples."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x, spec)
    mel, energy = log_mel(y, spec)
    spans = segments(energy, spec)
    us = 1_000_000 / spec.new_rate
    loud = [{"start_us": int(a * spec.hop * us), "end_us": int(min((b - 1) * spec.hop + spec.frame, len(y)) * us)} for a, b in spans.tolist()]
    return len(mel), loud, tensors(mel, len(y), spec)


def store(rows: DataFrame, *, payload: str = "payload", spec: AudioSpec | None = None) -> DataFrame:
    """The stored table: all columns of ``rows`` but the payload, then media."""
    spec = spec or AudioSpec()
    carry = [f for f in rows.schema.fields if f.name != payload]
    no_clash([f.name for f in carry], ["media"])
    names = [*[f.name for f in carry], "media"]

    def write(batches):
        for batch in batches:
            media = [wav(x.as_py() or b"", spec.rate) for x in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(media, pa.binary())], names=names)

    made = rows.select(*[F.col(f"`{f.name}`") for f in carry], F.col(f"`{payload}`")).mapInArrow(write, T.StructType([*carry, T.StructField("media", T.BinaryType())]))
    return stage(made, "audio")


def describe(stored: DataFrame, *, spec: AudioSpec | None = None, bytes_per_batch: int = 8 << 20) -> DataFrame:
    """All columns of ``stored``, then payload (read back from media), n_frames, segments, tensors."""
    spec = spec or AudioSpec()
    span = T.StructType([T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType())])
    own = [T.StructField("payload", T.BinaryType()), T.StructField("n_frames", T.LongType()), T.StructField("segments", T.ArrayType(span)), T.StructField("tensors", T.BinaryType())]
    no_clash(stored.columns, [f.name for f in own])
    arrow_spans = pa.list_(pa.struct([("start_us", pa.int64()), ("end_us", pa.int64())]))
    names, at_media = [*stored.columns, *[f.name for f in own]], stored.columns.index("media")

    def read(batches):
        for batch in batches:
            files = batch.column(at_media)
            at = 0
            while at < len(files):
                start, size, made = at, 0, []
                while at < len(files) and size < bytes_per_batch:
                    media = files[at].as_py()
                    back = samples(media)
                    made.append((back, *features(back, spec)))
                    size += 3 * len(media)
                    at += 1
                back, frames, loud, body = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([*[c.slice(start, at - start) for c in batch.columns], pa.array(back, pa.binary()), pa.array(frames, pa.int64()), pa.array(loud, arrow_spans), pa.array(body, pa.binary())], names=names)

    return stored.mapInArrow(read, T.StructType([*stored.schema.fields, *own]))


def store_and_describe(rows: DataFrame, *, payload: str = "payload", spec: AudioSpec | None = None, bytes_per_batch: int = 8 << 20) -> DataFrame:
    """All columns of ``rows`` but the payload, then media, payload (read back from media), n_frames, segments, tensors."""
    no_clash([c for c in rows.columns if c != payload], ["payload", "n_frames", "segments", "tensors"])
    return describe(store(rows, payload=payload, spec=spec), spec=spec, bytes_per_batch=bytes_per_batch)
