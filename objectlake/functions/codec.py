"""Byte codecs and hashed text embeddings, as Arrow functions: what Spark's own functions can't express."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 128
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[[9, 10, 12, 13, 32, *range(33, 127)]] = True
STATS = T.StructType([T.StructField("algo", T.StringType()), T.StructField("original", T.LongType()), T.StructField("compressed", T.LongType()), T.StructField("ratio", T.DoubleType())])
VECTOR = T.ArrayType(T.DoubleType())


def choose(data: bytes) -> str:
    """none under 64 bytes; rle where runs in the first KiB are long; delta where neighbours are close; dict for text; else fast (LZ4)."""
    if len(data) < 64:
        return "none"
    raw = np.frombuffer(data, np.uint8)
    head = raw[:1024].astype(np.int16)
    steps = np.abs(np.diff(head))
    if len(head) / (1 + np.count_nonzero(steps)) > 4:
        return "rle"
    if (steps < 4).mean() > 0.8:
        return "delta"
    return "dict" if _PRINTABLE[raw].mean() > 0.9 else "fast"


def rle(data: bytes) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    start = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]])
    size = np.diff(np.r_[start, len(raw)])
    full = size // 255 + (size % 255 > 0)
    value = np.repeat(raw[start], full)
    count = np.full(len(value), 255, np.uint8)
    count[np.cumsum(full) - 1] = ((size - 1) % 255 + 1).astype(np.uint8)
    return np.stack([value, count], axis=1).tobytes()


def unrle(data: bytes) -> bytes:
    pairs = np.frombuffer(data, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 0], pairs[:, 1]).tobytes()


def delta(data: bytes) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    return np.diff(raw, prepend=np.uint8(0)).astype(np.uint8).tobytes()


def undelta(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


def compress(data: bytes, algo: str) -> bytes:
    if algo == "rle":
        return rle(data)
    if algo == "delta":
        return delta(data)
    if algo == "dict":
        return b"\x03" + len(data).to_bytes(4, "little") + data
    if algo == "fast":
        return b"\x04" + len(data).to_bytes(4, "little") + pa.compress(data, codec="lz4_raw", asbytes=True)
    return data


def decompress(data: bytes, algo: str) -> bytes:
    if algo == "rle":
        return unrle(data)
    if algo == "delta":
        return undelta(data)
    if algo == "dict":
        return data[5:]
    return pa.decompress(data[5:], decompressed_size=int.from_bytes(data[1:5], "little"), codec="lz4_raw", asbytes=True) if algo == "fast" else data


@F.arrow_udf(STATS)
def codec_stats(data: pa.Array) -> pa.Array:
    """The codec that suits a value, and what it makes of it. One value of the batch at a time leaves Arrow."""
    out = []
    for x in data:
        d = x.as_py() or b""
        algo = choose(d)
        size = len(compress(d, algo))
        out.append((algo, len(d), size, round(size / len(d), 6) if d else 1.0))
    columns = zip(*out) if out else [()] * 4
    kinds = pa.string(), pa.int64(), pa.int64(), pa.float64()
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], STATS.names)


def unit_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A pseudo-random unit vector seeded by the hash of a string."""
    state = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little") or 1
    out = np.empty(dimensions)
    for i in range(dimensions):
        state ^= state << 13 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 7
        state ^= state << 17 & 0xFFFFFFFFFFFFFFFF
        out[i] = state / 2**64 * 2 - 1
    return out / np.linalg.norm(out)


def unit_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """unit_vector of each, to the last bit."""
    state = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little") or 1 for t in texts], np.uint64)
    out = np.empty((len(texts), dimensions))
    for i in range(dimensions):
        state ^= state << np.uint64(13)
        state ^= state >> np.uint64(7)
        state ^= state << np.uint64(17)
        out[:, i] = state / 2.0**64 * 2 - 1
    return out / np.sqrt([row @ row for row in out])[:, None] if texts else out


class _Units:
    """The unit vectors of trigrams, each given as a number; no more than KEPT are kept, which are 1 KB each."""

    KEPT = 16_384

    def __init__(self, dimensions: int):
        self.dimensions, self.row, self.kept = dimensions, {}, np.empty((0, dimensions))

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A row for each of up to KEPT different grams."""
        new = [g for g in grams.tolist() if g not in self.row]
        if len(self.row) + len(new) > self.KEPT:
            self.row, new = {}, grams.tolist()
        if new:
            if not len(self.kept):
                self.kept = np.empty((self.KEPT, self.dimensions))
            first = len(self.row)
            self.kept[first : first + len(new)] = unit_vectors([chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in new], self.dimensions)
            self.row.update(zip(new, range(first, first + len(new))))
        return self.kept[[self.row[g] for g in grams.tolist()]]


_units = lru_cache(4)(_Units)


def embed(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """The normalised mean of the unit vectors of the text's character trigrams; zeros under three characters."""
    return _embedded(text, dimensions).tolist()


def _embedded(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    low = (text or "").lower()
    if len(low) < 3 or not dimensions:
        return np.zeros(dimensions)
    points = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.int64)
    grams, counts = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
    units, total = _units(dimensions), np.zeros(dimensions)
    for at in range(0, len(grams), _Units.KEPT // 2):
        part = slice(at, at + _Units.KEPT // 2)
        total += counts[part] @ units.of(grams[part])
    total /= counts.sum()
    size = np.linalg.norm(total)
    return total / size if size else total


def _lists(vectors: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1], vectors.ravel())


@F.arrow_udf(VECTOR)
def text_embedding(text: pa.Array) -> pa.Array:
    """embed; one text of the batch at a time leaves Arrow, and vectors go back as they are."""
    out = np.empty((len(text), DIMENSIONS))
    for n, t in enumerate(text):
        out[n] = _embedded(t.as_py())
    return _lists(out)


@F.arrow_udf(VECTOR)
def hashed_vector(text: pa.Array) -> pa.Array:
    """unit_vector of each text, for 1,024 of them at a time."""
    parts = (unit_vectors([t or "" for t in text.slice(at, 1024).to_pylist()]) for at in range(0, len(text), 1024))
    return _lists(np.concatenate([np.empty((0, DIMENSIONS)), *parts]))
