"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if its smallest s-mer stands at its first or last place.  That depends on the
k-mer alone, so an unchanged passage selects the same anchors wherever it stands, and every run of k - s + 1
k-mers holds one.  A fingerprint is a fixed-size sketch of a text's anchors: those with the smallest hashes, each with the
place of its first occurrence.  Two fingerprints are compared by position: anchors both hold count when they can be
matched in the same order (longest increasing run), over all anchors in the joint sketch.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hash

K, S, KEEP = 16, 5, 48
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Closed syncmers of a text: 64-bit hashes and places. A text without one is a single anchor; an empty text has none."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prefix = prefix_hash(mix(codes + np.uint64(1)))
    back = powers(n + 1)[1]
    if n >= k:
        inner = (prefix[s:] - prefix[:-s]) * back[: n - s + 1]
        inner = (inner ^ (inner >> np.uint64(32))) * _SPREAD
        w = k - s + 1
        least, width = inner, 1
        while width < w:
            step = min(width, w - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[w - 1 :]))
        if len(at):
            return mix((prefix[at + k] - prefix[at]) * back[at]), at
    return mix(prefix[-1:] + np.uint64(n)), np.zeros(1, np.int64)


def sketch(text: str, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` smallest distinct anchor hashes (32 bits) in order, and the first place of each."""
    hashes, at = anchors(text)
    low, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    return low[:keep], at[first[:keep]]


def as_text(one: tuple[np.ndarray, np.ndarray]) -> str:
    """Eight hex digits of hash and eight of place per anchor."""
    return np.stack([one[0].astype(">u4"), one[1].astype(">u4")], 1).tobytes().hex() if len(one[0]) else ""


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], keep: int = KEEP) -> float:
    """Share of the joint sketch that both hold in the same order; 1 for two empty fingerprints."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    joint = np.union1d(a[0], b[0])[:keep]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = both <= joint[-1]
    places = b[1][j[inside]][np.argsort(a[1][i[inside]], kind="stable")]
    ends: list[int] = []
    for p in places.tolist():
        at = bisect_left(ends, p)
        ends[at : at + 1] = [p]
    return len(ends) / len(joint)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _deal(bounds: np.ndarray, heads: np.ndarray, before: np.ndarray):
    """Give each row its range; the first row of a range goes to the range before it too, as what follows there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ord").to_numpy()
            bucket = (len(bounds) - np.searchsorted(bounds, ids, "right")).astype(np.int32)
            at = np.minimum(np.searchsorted(heads, ids), len(heads) - 1)
            extra = np.flatnonzero(heads[at] == ids)
            rows = np.concatenate([np.arange(len(ids)), extra])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    *taken.columns,
                    pa.array(np.concatenate([bucket, before[at[extra]]]).astype(np.int32)),
                    pa.array(np.arange(len(rows)) >= len(ids)),
                ],
                names=[*batch.schema.names, "bucket", "extra"],
            )

    return task


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each waits for the one that follows it."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # (bucket, doc_id, text, sketch) without its follower yet
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for doc_id, text, bucket, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "extra")), strict=True):
            if extra and (held is None or held[0] != bucket):
                continue
            now = (bucket, doc_id, text, sketch(text))
            if held is not None and held[0] == bucket:
                changed = edited(held[2], text)
                other = held[3] if changed == held[2] else sketch(changed)
                out.append((
                    held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), as_text(held[3]), as_text(other),
                    likeness(held[3], other), likeness(held[3], now[3]),
                ))
                if len(out) >= 1000:
                    yield flush()
            held = None if extra else now
    if out:
        yield flush()


def fingerprint_documents(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's text and edited text, and how near they and the next row's are.

    Rows follow one another by descending identifier (NULL last, repeated identifiers by text); the last is followed by
    the first.  NULL text is empty.  Rows are dealt out in ranges of the identifier, so texts cross the network once and a task
    holds two of them at a time.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(row_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(row_id).cast("long"), F.lit(-(1 << 63))).alias("ord"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # as many bounds as ranges; the identifiers at the head of each range, of which there are as many
    cuts = rows.approxQuantile("ord", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
    ids = rows.select("ord").mapInArrow(_largest(bounds), "bucket int, head long")
    tops = ids.groupBy("bucket").agg(F.max("head").alias("head")).collect()
    if not tops:
        return spark.createDataFrame([], RESULT)
    order = sorted((r.bucket, r.head) for r in tops)
    pairs = sorted((head, order[i - 1][0]) for i, (_, head) in enumerate(order))
    heads = np.array([p[0] for p in pairs], np.int64)
    before = np.array([p[1] for p in pairs], np.int32)
    dealt = rows.mapInArrow(_deal(bounds, heads, before), "doc_id long, ord long, text string, bucket int, extra boolean")
    return (
        dealt.repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", "extra", F.desc("ord"), F.desc("text"))
        .mapInArrow(_walk, RESULT)
    )


def _largest(bounds: np.ndarray):
    """The largest identifier of each range in a batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(batch.column("ord").to_numpy())
            bucket = len(bounds) - np.searchsorted(bounds, ids, "right")
            last = np.flatnonzero(np.diff(bucket, append=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[last].astype(np.int32)), pa.array(ids[last])], names=["bucket", "head"]
            )

    return task
