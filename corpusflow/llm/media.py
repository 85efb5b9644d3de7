"""Media columns: documents stored as WAV, and spectral-peak fingerprints of what is stored."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
RATE, FRAME, HOP = 8000, 256, 128
#: Edges of the frequency bands; the loudest bin of each is a peak if it stands out of its frame.
BANDS = (1, 17, 49, 129)
#: A peak is paired with the peaks of its band so many frames later.
AHEAD = (1, 2)
ROWS = 400


def payload_of(text: bytes | None) -> bytes:
    """The bytes, then zeros up to a positive multiple of BLOCK."""
    data = text or b""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples, one a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of the short-time Fourier transform: a row per frame, silence after the end."""
    signal = (samples.astype(np.float32) - 128) / 128
    n = max(1, -(-(len(signal) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(signal)] = signal
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1))


def fingerprint(samples: np.ndarray, block: int = 8192) -> np.ndarray:
    """Pairs of peaks as integers, by time: frame, band, frequencies of both peaks, frames between.

    Long signals are transformed `block` frames at a time; frames do not depend on the blocks.
    """
    peaks, loud = [], []
    step = block * HOP
    for at in range(0, max(1, len(samples) - (FRAME - HOP)), step):
        mags = spectrum(samples[at : at + step + FRAME - HOP])[:block]
        level = 1.5 * mags.mean(axis=1)
        for_bands = [mags[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)]
        peaks.append(np.stack(for_bands, axis=1))
        loud.append(np.take_along_axis(mags, peaks[-1], axis=1) > level[:, None])
    f, on = np.concatenate(peaks).astype(np.int64), np.concatenate(loud)
    bands = np.arange(f.shape[1])
    pairs = []
    for d in AHEAD:
        both = on[:-d] & on[d:]
        time = np.arange(len(both))[:, None]
        codes = time << 24 | bands[None, :] << 20 | f[:-d] << 12 | f[d:] << 4 | d
        pairs.append(codes[both])
    return np.sort(np.concatenate(pairs))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_bytes, media (the WAV file).

    The samples are the text's UTF-8 bytes, padded with zeros to a positive multiple of 64; a null
    text counts as empty. Equal texts give equal files. An empty table gives an empty result. No
    other columns are read.
    """

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()),
                        "media": pa.array([to_wav(payload_of(t)) for t in texts], pa.binary()),
                    }
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(store, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds what is read back from the files: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and fingerprint (array<long>, see `fingerprint`). The file itself is dropped."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                files = part.column(media_col).to_pylist()
                payloads = [from_wav(m) for m in files]
                columns = {n: part.column(n) for n in part.schema.names if n != media_col}
                columns |= {
                    "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    "tail_crc32": pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                    "media_bytes": pa.array([len(m) for m in files], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in files]),
                    "fingerprint": pa.array([fingerprint(np.frombuffer(p, np.uint8)) for p in payloads], pa.list_(pa.int64())),
                }
                yield pa.record_batch(columns)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != media_col)
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"
    return stored.mapInArrow(read, f"{kept}, {added}")
