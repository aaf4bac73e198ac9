"""Operator 3: media columns. WAV written and read by the wave module, short-time Fourier transforms, peak pairs.

A text's UTF-8 bytes, zero-filled to a positive multiple of 64, are kept losslessly as 8-bit mono samples. From the
samples read back come spectral peaks (local maxima of the magnitudes, the strongest few of each frame) and pairs
of an anchor peak with the peaks that follow it: ``times[i]`` is the anchor's frame and ``codes[i]`` packs both
frequencies and the distance in frames.

Defined results: a null text is an empty text (64 zero bytes, no peaks); repeated rows give repeated results; an
empty table gives an empty table; other columns of the input are ignored, whatever their names. One text is in
memory at a time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

FRAME, HOP, RATE, PEAKS, FAN, REACH = 256, 128, 8000, 3, 4, 16
_WINDOW = np.hanning(FRAME).astype(np.float64)
SCHEMA = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<long>, wav binary"


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor frames and codes of the peak pairs of 8-bit samples; in blocks of frames, as texts can be very long."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    padded = np.full((n - 1) * HOP + FRAME, 128.0)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    at, frequency = [], []
    block = 2048
    for i in range(0, n, block):
        low, high = max(0, i - 1), min(n, i + block + 1)  # one frame more on either side for the comparison in time
        s = np.abs(np.fft.rfft((frames[low:high] - 128.0) * _WINDOW, axis=1))
        s = np.round(s, 6)
        peak = np.zeros_like(s, dtype=bool)
        peak[:, 1:-1] = (s[:, 1:-1] > s[:, :-2]) & (s[:, 1:-1] >= s[:, 2:]) & (s[:, 1:-1] > 1.0)
        peak[1:] &= s[1:] >= s[:-1]
        peak[:-1] &= s[:-1] > s[1:]
        own = slice(i - low, min(n, i + block) - low)
        s, peak = s[own], peak[own]
        strongest = np.argsort(np.where(peak, -s, 0.0), axis=1, kind="stable")[:, :PEAKS]
        row, col = np.nonzero(np.take_along_axis(peak, strongest, axis=1))
        at.append(row + i)
        frequency.append(strongest[row, col])
    t, f = np.concatenate(at), np.concatenate(frequency)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    times, codes = [], []
    for k in range(1, FAN + 1):
        step = t[k:] - t[:-k]
        pair = np.flatnonzero((step >= 1) & (step <= REACH))
        times.append(t[pair])
        codes.append((f[pair] << 16) | (f[pair + k] << 8) | step[pair])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the stored media (``wav``), what was read back from it, and the fingerprint."""

    def convert(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                stored = to_wav(raw + bytes(-len(raw) % 64 or (64 if not raw else 0)))
                read = from_wav(stored)
                times, codes = fingerprint(np.frombuffer(read, dtype=np.uint8))
                rows.append((key, len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), times.astype(np.int32), codes.astype(np.int64), stored))
                if len(rows) == 500:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    bounded_batches(docs.sparkSession)
    # Ids pass pandas as strings: a null would make numbers of them that lose digits.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tidy(convert), SCHEMA)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def fingerprints(media: DataFrame, id_col: str = "doc_id", wav_col: str = "wav") -> DataFrame:
    """doc_id, times, codes of a column of 8-bit mono WAV files; null for a null or for what is no such file."""

    def convert(batches):
        import pandas as pd

        for batch in batches:
            for key, stored in zip(batch["doc_id"], batch["wav"], strict=True):
                try:
                    times, codes = fingerprint(np.frombuffer(from_wav(stored), dtype=np.uint8))
                except (TypeError, ValueError, EOFError, wave.Error):
                    times = codes = None
                yield pd.DataFrame({"doc_id": [key], "times": [times], "codes": [codes]})

    bounded_batches(media.sparkSession)
    rows = media.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(wav_col).alias("wav")).mapInPandas(tidy(convert), "doc_id string, times array<int>, codes array<long>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    out = media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pairs = F.arrays_zip("times", "codes")
    feature = F.concat(F.size("codes").cast("string"), F.lit(":"), F.md5(F.to_json(pairs)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.size("codes").cast("long").alias("n_codes"))
