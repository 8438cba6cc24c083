"""Media columns: texts stored as 8-bit WAV, short-time Fourier transforms, and spectral-peak pair fingerprints.

`encode_wav` stores every payload as one mono WAV of 8-bit samples in a binary column; `fingerprints` reads such a column
with the wave module and returns the facts of the stored bytes and the landmarks. A landmark joins an anchor peak with one
of the next peaks: its time is the anchor's frame, its code packs both frequency bins and the distance in frames.

Null text is the empty text. The empty text is one unit of padding, so every row has at least one frame. Rows are never
merged: repeated rows and equal texts give equal values, null ids stay null. An empty table gives an empty table. Columns
other than the two named ones are ignored, whatever their names. Long texts are transformed in blocks of frames.
"""
from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import crc, list_array

UNIT = 192          # bytes to which a payload is padded; also the frame length
HOP = UNIT // 2
RATE = 8000
BANDS = (1, 8, 20, 44, HOP + 1)   # borders of the frequency bands, in bins
REACH, FAN = 48, 4  # farthest frame and number of following peaks that an anchor is paired with
_BLOCK = 4096       # frames transformed at once

WAV_SCHEMA = "doc_id bigint, n_bytes bigint, media binary"
SCHEMA = ("doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
          "media_sha256 string, feature string, times array<int>, codes array<int>")


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_payload(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def encode_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT, as a WAV."""
    def run(batches):
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            media = [wav_bytes(x + b" " * (-len(x) % UNIT if x else UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, WAV_SCHEMA)


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its rounded magnitude, per frame at every hop and per band; the last hop has no frame."""
    hops = len(samples) // HOP
    n = hops - 1
    window = np.hanning(UNIT + 1)[:UNIT]
    bins = np.zeros((hops, len(BANDS) - 1), np.int32)
    size = np.full((hops, len(BANDS) - 1), -1, np.int64)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        x = samples[a * HOP:(b + 1) * HOP].reshape(-1, HOP).astype(np.float64) - 128.0
        spectrum = np.abs(np.fft.rfft(np.hstack([x[:-1], x[1:]]) * window, axis=1))
        level = np.rint(spectrum * 64).astype(np.int64)
        for k, (lo, hi) in enumerate(zip(BANDS, BANDS[1:])):
            best = level[:, lo:hi].argmax(1)
            bins[a:b, k] = best + lo
            size[a:b, k] = np.take_along_axis(level[:, lo:hi], best[:, None], 1)[:, 0]
    return bins, size


def landmarks(samples: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count per row, times, codes) of the rows that `offsets` marks in the joined samples."""
    n_rows = len(offsets) - 1
    bins, size = band_peaks(samples)
    hop_of = offsets // HOP
    size[hop_of[1:] - 1] = -1                     # frames that would reach into the next row
    earlier = np.vstack([np.full((1, size.shape[1]), -1), size[:-1]])
    later = np.vstack([size[1:], np.full((1, size.shape[1]), -1)])
    frame, band = np.nonzero((size > 0) & (size > earlier) & (size >= later))
    pitch = bins[frame, band].astype(np.int64)
    row = np.searchsorted(hop_of, frame, side="right") - 1
    anchors, times, codes = [], [], []
    for k in range(1, FAN + 1):
        gap = frame[k:] - frame[:-k]
        at = np.flatnonzero((row[k:] == row[:-k]) & (gap >= 1) & (gap <= REACH))
        anchors.append(at)
        times.append(frame[at] - hop_of[row[at]])
        codes.append(pitch[at] << 14 | pitch[at + k] << 7 | gap[at])
    anchor = np.concatenate(anchors)
    order = np.argsort(anchor, kind="stable")
    at = anchor[order]
    return np.bincount(row[at], minlength=n_rows), np.concatenate(times)[order].astype(np.int32), np.concatenate(codes)[order].astype(np.int32)


def fingerprints(media: DataFrame) -> DataFrame:
    """Facts and landmarks of the stored bytes of `encode_wav`."""
    def run(batches):
        for b in batches:
            stored = [x.as_py() for x in b.column(2)]
            pcm = [wav_payload(x) for x in stored]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in pcm], dtype=np.int64)]).astype(np.int64)
            if not pcm:
                continue
            count, times, codes = landmarks(np.frombuffer(b"".join(pcm), np.uint8), offsets)
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
            feature = [f"{c}:{hashlib.sha256(times[i:i + c].tobytes() + codes[i:i + c].tobytes()).hexdigest()}" for i, c in zip(ends.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in pcm], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in pcm]),
                 pa.array([crc(x[-16:]) for x in pcm], pa.int64()), pa.array([len(x) for x in stored], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in stored]), pa.array(feature), list_array(ends, pa.array(times, pa.int32())), list_array(ends, pa.array(codes, pa.int32()))],
                [f.split()[0] for f in SCHEMA.split(", ")])

    return media.mapInArrow(run, SCHEMA)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return fingerprints(encode_wav(docs, id_col, text_col))
