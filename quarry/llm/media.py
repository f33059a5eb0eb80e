"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload of 8-bit samples is stored as a mono WAV file and read back with the wave module. Frames of ``FRAME`` samples at
every ``HOP`` are windowed and transformed; in each frame the strongest of ``BANDS`` frequency bands' peaks that stand over
the frame's mean are kept, and each peak is paired with the peaks of the next ``FAN`` frames. A pair is (time in frames,
code), its code holding both bins and the frames between: arrays ``times`` and ``codes`` in order of time.

Cases: null and empty texts are one frame of padding; a constant payload has no peaks and empty arrays; equal texts have
equal values; long texts are transformed in pieces, so memory is bounded by the payload; repeated rows are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

UNIT, RATE = 576, 8000
FRAME, HOP, BANDS, KEEP, FAN = 576, 288, 6, 3, 3
#: Frames that are transformed at once.
PIECE = 2048


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not a mono file of 8-bit samples")
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, by frame and then bin."""
    x = np.frombuffer(samples, np.uint8)
    n = max(0, (len(x) - FRAME) // HOP + 1)
    bounds = np.geomspace(4, FRAME // 2 + 1, BANDS + 1).astype(int)
    window, found = np.hanning(FRAME).astype(np.float32), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i in range(0, n, PIECE):
        k = min(PIECE, n - i)
        frames = np.lib.stride_tricks.sliding_window_view(x[i * HOP : (i + k - 1) * HOP + FRAME], FRAME)[::HOP]
        power = np.abs(np.fft.rfft((frames.astype(np.float32) - 128) * window)).astype(np.float32)
        tops = np.stack([power[:, a:b].argmax(1) + a for a, b in zip(bounds, bounds[1:])], 1)
        heights = np.take_along_axis(power, tops, 1)
        bar = np.maximum(2 * power[:, bounds[0] :].mean(1), 1.0)
        least = np.sort(heights, 1)[:, -KEEP]
        at, band = np.nonzero((heights > bar[:, None]) & (heights >= least[:, None]))
        found.append((at + i, tops[at, band]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints: ``times`` (frame of the first peak) and ``codes`` (first bin, second bin, frames between)."""
    at, bin_ = peaks(samples)
    times, codes = [], []
    for ahead in range(1, KEEP * (FAN + 1)):
        gap = at[ahead:] - at[:-ahead]
        ok = (gap >= 1) & (gap <= FAN)
        times.append(at[:-ahead][ok])
        codes.append((bin_[:-ahead][ok] << 14) | (bin_[ahead:][ok] << 3) | gap[ok])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def media(docs: DataFrame) -> DataFrame:
    """The stored form and its features: doc_id, n_bytes, wav, times, codes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # a result batch holds few files
                part, out = batch.slice(i, 64), []
                for value in part.column(1):
                    raw = (value.as_py() or "").encode()
                    stored = to_wav(raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw)))
                    out.append((len(raw), stored, *pairs(from_wav(stored))))
                n, wav, times, codes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(wav, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "wav", "times", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_bytes long, wav binary, times array<int>, codes array<int>")


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from the stored form, and a printed form of its fingerprint arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wav, times, codes in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                stored, t, c = wav.as_py(), times.values.to_numpy(), codes.values.to_numpy()
                back = from_wav(stored)
                first = ",".join(f"{a}@{b}" for a, b in zip(c[:4].tolist(), t[:4].tolist(), strict=True))
                feature = f"{len(t)}:{zlib.crc32(t.tobytes() + c.tobytes()):08x}:{first}"
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(each, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media(table(spark, sf_dir, "documents")))
