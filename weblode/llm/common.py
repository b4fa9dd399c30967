"""Shared pieces: reading documents, tables in the shared folder, hashing words of a block of texts."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the word class ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, only a local master gets one of its own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="weblode-llm-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: cuts lineage, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


# --- hashing in blocks of texts (numpy, inside tasks) ---

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of BASE modulo 2^64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one mapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2^64: entry i covers the first i codes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), equal for equal content wherever it stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def binary_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string array; NULL is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch of texts into runs of whole texts of about ``most`` bytes: (first, end, bytes, offsets)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that compression finds the empty high bytes."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: Words of up to so many bytes are hashed in blocks, eight bytes at a time.
LANES = 8


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end]: each eight bytes are mixed in turn, so no linear relation between words lasts."""
    size = (end - start).astype(np.uint64)
    out = mix(size * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    step = np.arange(8)
    own = np.flatnonzero(size <= 8 * LANES)
    for lane in range(LANES):
        own = own[size[own] > 8 * lane]
        if not len(own):
            break
        at = start[own] + 8 * lane
        eight = padded[at[:, None] + step]
        eight[step >= (end[own] - at)[:, None]] = 0
        out[own] = mix((out[own] ^ eight.view("<u8").ravel()) * np.uint64(0xD1342543DE82EF95) + np.uint64(lane))
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        raw = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(raw, "little")
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block of texts: hash, text number, start and end byte. A text's end also ends a word."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return word_hashes(data, start, end), np.searchsorted(offsets, start, "right") - 1, start, end
