"""Media columns: lossless WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import by_bytes, columns, free_names, others, table

RATE = 8000
UNIT = 64
WINDOW, HOP = 256, 128
#: The strongest bin of each band is a frame's peak there; bin 0, the mean, is left out.
BANDS = ((1, 33), (33, 129))
REACH = 2
FRAMES_AT_ONCE = 4096
BATCH_BYTES = 4 << 20


def write_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples, a sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(payload: bytes) -> np.ndarray:
    """For each frame and band the strongest bin, -1 in silence. Frames of WINDOW samples start every HOP.

    The last frame is filled up with silence. Long signals go block by block, so memory doesn't grow with them.
    """
    samples = np.frombuffer(payload, np.uint8)
    n = max(1, -(-max(0, len(samples) - WINDOW) // HOP) + 1)
    hann = np.hanning(WINDOW).astype(np.float32)
    peaks = np.full((n, len(BANDS)), -1, np.int32)
    for first in range(0, n, FRAMES_AT_ONCE):
        last = min(n, first + FRAMES_AT_ONCE)
        block = np.full((last - first - 1) * HOP + WINDOW, 128, np.uint8)
        part = samples[first * HOP : first * HOP + len(block)]
        block[: len(part)] = part
        frames = np.lib.stride_tricks.sliding_window_view(block.astype(np.float32) - 128, WINDOW)[::HOP]
        spectrum = np.fft.rfft(frames * hann, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(BANDS):
            bins = power[:, low:high]
            strongest = bins.argmax(axis=1)
            heard = bins[np.arange(len(bins)), strongest] > 1e-3
            peaks[first:last, b] = np.where(heard, strongest + low, -1)
    return peaks


def peak_pairs(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of pairs of peaks of one band, up to REACH frames apart; code = bin << 16 | later bin << 8 | distance."""
    times, codes = [], []
    for b in range(peaks.shape[1]):
        for ahead in range(1, min(REACH, len(peaks) - 1) + 1):
            here, there = peaks[:-ahead, b], peaks[ahead:, b]
            at = np.flatnonzero((here >= 0) & (there >= 0))
            times.append(at)
            codes.append((here[at] << 16) | (there[at] << 8) | ahead)
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    time, code = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((code, time))
    return time[order], code[order]


def encode_media(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep + n_bytes, media: the text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as a WAV file.

    Null and empty texts become 64 zeros. Texts of any length are stored whole. Repeated rows give repeated
    rows, an empty table an empty one; columns other than `keep` and `text` are not read. Those of `keep` may have any
    names without dots, but one named as a result is replaced by it.
    """
    keep = others(keep, "n_bytes", "media")
    read = free_names(keep, "__text")[0]
    rows = docs.select(*columns(keep), F.col(text).alias(read))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, read, BATCH_BYTES):
                texts = [t or b"" for t in part.column(read).cast(pa.binary()).to_pylist()]
                media = [write_wav(t + b"\0" * (-len(t) % UNIT or (0 if t else UNIT))) for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return rows.mapInArrow(run, schema)


def media_features(stored: DataFrame, media: str = "media", keep: Sequence[str] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep + the media column + what its stored bytes say: payload_bytes, payload_sha256, tail_crc32, fp_time and fp_code.

    fp_time and fp_code are arrays of equal length, ordered by time. A null media gives nulls; bytes that aren't such a file are an
    error. Repeated rows give repeated rows, an empty table an empty one; a column of `keep` named as a result is replaced by it.
    """
    found = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("fp_time", T.ArrayType(T.IntegerType())), ("fp_code", T.ArrayType(T.IntegerType()))]
    keep = others(keep, "media", *(n for n, _ in found))
    rows = stored.select(*columns(keep), F.col(media).alias("media"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(*f) for f in found)])

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5
        payload = read_wav(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *peak_pairs(spectral_peaks(payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            for part in by_bytes(batch, "media", BATCH_BYTES):
                out = list(zip(*map(features, part.column("media").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=[*part.schema.names, *(n for n, _ in found)])

    return rows.mapInArrow(run, schema)


def op10_media_columns(spark, sf_dir):
    """doc_id, the contract's columns and the fingerprint's arrays of every document; see encode_media and media_features for all cases."""
    found = media_features(encode_media(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fp_code"), F.hex(F.xxhash64("fp_time", "fp_code"))).alias("feature"),
        "fp_time",
        "fp_code",
    )
