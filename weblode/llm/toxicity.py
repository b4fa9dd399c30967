"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: stems (the first 3 to 9 bytes and the whole of each word, case and common letter swaps
undone) are hashed into a table of fixed size, and the log-odds of toxic against clean documents that hold a stem is its
weight.  A document's features are the densities of lexicon words at several strengths, how near second-person words stand
to them, capitals, punctuation and obfuscated words.  Lexicon, trees and calibration are fitted on three separate parts of a
bounded sample of labelled rows, so none of them sees its own training rows as new evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, blocks, byte_codes, mix, powers, prefix_hash, stored, words_of

BINS = 1 << 20
STEMS = range(3, 10)
STRENGTHS = (1.0, 2.0, 3.5)
WINDOW = 5
#: Second-person words of the four languages of the test tables.
SECOND_PERSON = "you your yours yourself du dich dir dein deine euch ihr tu te toi vous votre vos ton tes usted ustedes ti tus".split()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _digit, _letter in zip(b"013457@$", b"oieastas", strict=True):
    _FOLD[_digit] = _letter
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?'\"-()")] = True
_LOUD = np.zeros(256, bool)
_LOUD[list(b"!?")] = True

FEATURES = 6 + 2 * len(STRENGTHS) + 2


def _folded(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    out[accent] += 32
    return out


def _stem_bins(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bins of each word's stems, one column per stem length and one for the whole word; -1 where the word is shorter."""
    prefix = prefix_hash(byte_codes(data))
    back = powers(len(prefix))[1]
    out = np.full((len(start), len(STEMS) + 1), -1, np.int64)
    for k, n in enumerate((*STEMS, None)):
        has = np.ones(len(start), bool) if n is None else end - start >= n
        s = start[has]
        e = end[has] if n is None else s + n
        value = mix((prefix[e] - prefix[s]) * back[s] + np.uint64(0 if n is None else n))
        out[has, k] = (value >> np.uint64(44)).astype(np.int64)
    return out


def _words(text: pa.Array) -> Iterator[tuple]:
    data, offsets = binary_parts(text)
    for first, end, part, off in blocks(data, offsets):
        folded = _folded(part) if len(part) else part
        yield first, end, part, off, folded, *words_of(folded, off)


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a stem, summed in the task: (bin, toxic, clean)."""
    counts = np.zeros((2, BINS), np.int32)
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for first, _, _, _, folded, _, doc, start, end in _words(batch.column("text")):
            bins = _stem_bins(folded, start, end)
            at = np.repeat(doc, bins.shape[1])[bins.ravel() >= 0]
            both = np.unique(at * BINS + bins.ravel()[bins.ravel() >= 0])
            toxic = label[first + both // BINS] == 1
            for k, side in enumerate((toxic, ~toxic)):
                counts[k] += np.bincount(both[side] % BINS, minlength=BINS).astype(np.int32)
    for lot in np.array_split(np.flatnonzero(counts.any(0)), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array(lot), pa.array(counts[0, lot].astype(np.int64)), pa.array(counts[1, lot].astype(np.int64))],
            names=["bin", "toxic", "clean"],
        )


def _features(weights: np.ndarray, second: np.ndarray, text: pa.Array) -> np.ndarray:
    out = np.zeros((len(text), FEATURES), np.float32)
    for first, last, part, off, folded, hashes, doc, start, end in _words(text):
        n = last - first
        rows = out[first:last]
        size = np.maximum(np.diff(off), 1)
        words = np.bincount(doc, minlength=n)
        some = np.maximum(words, 1)
        share = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.float64), off[:-1])[:n] * (np.diff(off) > 0) / size
        if not len(part):
            continue
        rows[:, 0] = np.log1p(words)
        rows[:, 1] = share(_UPPER[part])
        rows[:, 2] = share(_STOP[part])
        rows[:, 3] = share(_LOUD[part])
        letters = np.concatenate([[0], np.cumsum(_ALPHA[part])])
        inner = np.concatenate([[0], np.cumsum(~_ALPHA[part] & ~_STOP[part])])
        caps = np.concatenate([[0], np.cumsum(_UPPER[part])])
        odd = (letters[end] > letters[start]) & (inner[end] > inner[start])
        rows[:, 4] = np.bincount(doc, odd, n) / some
        rows[:, 5] = np.bincount(doc, (end - start > 2) & (caps[end] - caps[start] == end - start), n) / some
        if not len(start):
            continue
        bins = _stem_bins(folded, start, end)
        strength = np.where(bins >= 0, weights[bins], 0).max(1)
        you = np.isin(hashes, second)
        near = np.concatenate([np.zeros(1, np.int64), np.cumsum(you)])
        at = np.arange(len(start))
        close = near[np.minimum(at + WINDOW + 1, len(at))] > near[np.maximum(at - WINDOW, 0)]
        for k, least in enumerate(STRENGTHS):
            hits = np.bincount(doc, strength >= least, n)
            rows[:, 6 + 2 * k] = hits / some
            rows[:, 7 + 2 * k] = np.log1p(hits)
        rows[:, -2] = np.bincount(doc, (strength >= STRENGTHS[0]) & close, n) / some
        rows[:, -1] = np.bincount(doc, strength, n) / some
    return out


def _second_person() -> np.ndarray:
    data, off = binary_parts(pa.array([" ".join(SECOND_PERSON)]))
    return words_of(data, off)[0]


def featured(rows: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns and the feature array of each row's ``text``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # BINS floats: 4 MB whatever the corpus
    second = _second_person()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _features(shared.value, second, batch.column("text"))
            flat = pa.array(values.ravel().astype(np.float64))
            offsets = pa.array(np.arange(0, values.size + 1, FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(offsets, flat)], names=[*keep, "x"]
            )

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "text").mapInArrow(task, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "x array<double>"]))


def lexicon(sample: DataFrame, least: int = 4) -> np.ndarray:
    """Weight of each stem bin: log-odds of toxic against clean, 0 for bins that few toxic documents hold."""
    counts = sample.select("text", "toxic").mapInArrow(_count_stems, "bin long, toxic long, clean long").groupBy("bin").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    totals = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, n = totals.t or 0, totals.n
    weights = np.zeros(BINS, np.float32)
    kept = counts.filter(F.col("toxic") >= least).toPandas()  # at most BINS rows
    odds = np.log((kept["toxic"] + 0.1) / (toxic + 0.2)) - np.log((kept["clean"] + 0.5) / (n - toxic + 1.0))
    weights[kept["bin"].to_numpy()] = np.maximum(odds, 0)
    return weights


def score_toxicity(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with doc_id, held_out, score and predicted.

    Training uses at most ``max_labelled`` labelled rows, those with the smallest hash of the identifier, and only rows whose
    crc32 of the identifier as text is not divisible by 5 (those are held out).  Rows with NULL identifier or NULL label train
    nothing and count as not held out.  NULL text is empty; empty texts are scored like others.  Without toxic or without
    clean rows to learn from, every score is the share of toxic rows (0 if none).  Repeated rows are scored alike.
    """
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    chosen = (
        labels.select(F.col(row_id).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder != 0))
        .withColumn("order", F.xxhash64(F.lit("toxicity"), "doc_id")).orderBy("order", "toxic").limit(max_labelled)
        .withColumn("part", F.pmod("order", F.lit(20)))
    )
    rows = docs.select(F.col(row_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most max_labelled rows of an identifier, a hash and two small numbers
    sample = stored(rows.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    held = F.coalesce(remainder == 0, F.lit(False)).alias("held_out")
    counts = {(r.third, r.toxic): r["count"] for r in sample.groupBy(F.expr("case when part < 10 then 0 when part < 16 then 1 else 2 end").alias("third"), "toxic").count().collect()}
    if any(counts.get((third, toxic), 0) == 0 for third in range(3) for toxic in (0, 1)):
        good, bad = (sum(v for (_, t), v in counts.items() if t == toxic) for toxic in (0, 1))
        share = float(bad) / (good + bad) if good + bad else 0.0
        return rows.select("doc_id", held, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    weights = lexicon(sample.filter("part < 10"))
    fitting = stored(featured(sample.filter("part >= 10"), weights, ["doc_id", "toxic", "part"]), "toxicity-features")
    vectors = fitting.select(F.col("toxic").cast("double").alias("label"), array_to_vector("x").alias("features"), "part")
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=8, maxBins=64).fit(vectors.filter("part < 16").coalesce(8))
    raw = lambda df: df.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    line = IsotonicRegression(featuresCol="p", predictionCol="score").fit(
        raw(trees.transform(vectors.filter("part >= 16"))).select("label", "p")
    )
    scored = raw(trees.transform(featured(rows, weights, ["doc_id"]).select("doc_id", array_to_vector("x").alias("features"))))
    return line.transform(scored).select(
        "doc_id", held, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"),
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
