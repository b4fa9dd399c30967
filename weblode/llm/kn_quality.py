"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Training counts n-grams of all trusted documents that may train, shard by shard: trigrams, and from them the continuation
counts of bigrams and words; contexts' totals and their types seen once, twice and more often.  Words that trusted text
holds once or never are one of three unknown classes by their
shape (letters, with digits, with other signs), and a word that repeats the one before it is a class of its own that is not
learned, so repetition stays surprising; the vocabulary is closed.

The model is never gathered: a trigram lies in the shard of its middle word, with its context and its bigram, so a shard tells a
word's probability alone; a common middle word is dealt over several shards by the word before, and its bigrams are sent to
each.  Only the vocabulary and a number for each of its words are sent whole to the tasks.  Scoring takes texts in lots; a lot
sends each shard its n-grams there, packed, and shards return a document's sums, in whole numbers, so their order changes
nothing.  A document's
perplexity, drawn toward the usual one where it has few words, is compared with a quantile of the perplexity, in its language, of
trusted documents that the model may not train on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WORD, binary_parts, blocks, mix, packed, stored, unpacked, whole_text, word_count, words_of

START = np.uint64(1)
#: Ids of unknown words; those of the vocabulary follow, common words first, so an id takes less than 32 bits and mostly few.
UNKNOWN = np.array([2, 3, 4, 5], np.uint64)  # letters only, with digits, with other signs; the word before once more
#: Words of usual perplexity that a document's own are averaged with.
DRAWN = 10
#: Bytes of text per shard of the model, about; words of a lot, about.
SHARD, LOT = 16 << 20, 1_500_000
#: Losses are added up in parts of a nat.
PARTS = 1 << 24
#: What a shard reads, in this order: rows that pass it by, bigrams of common words, its trigrams, questions of lots.
PAST, COMMON, COUNTS, ASKED = range(4)
MESSAGE = "shard int, kind int, lot long, ba binary, c binary, n binary, doc binary"
_MESSAGE = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in MESSAGE.split(", ")])
_LOW = np.uint64(0xFFFFFFFF)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.ones(256, bool)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:!?'\"()-"]] = False


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _M1 + (b ^ _M2))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ids in one number."""
    return (a << np.uint64(32)) | b


def shapes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """0 for words of letters only, 1 with digits, 2 with other signs."""
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    return np.where(signs[stop] > signs[start], 2, np.where(digits[stop] > digits[start], 1, 0))


class Vocabulary(NamedTuple):
    """Sorted hashes of known words, and their ids."""

    words: np.ndarray
    ids: np.ndarray


def tokens(text: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple]:
    """Blocks of texts as word ids: (first, end, id, document), rare words replaced by their class."""
    data, offsets = binary_parts(text)
    for first, end, part, off in blocks(data, offsets):
        hashes, doc, start, stop = words_of(part, off, lower=True)
        shape = shapes(part, start, stop)
        has, at = found(vocabulary.words, hashes)
        ids = UNKNOWN[shape]
        ids[has] = vocabulary.ids[at[has]]
        ids[before(hashes, doc, 1) == hashes] = UNKNOWN[3]
        yield first, end, ids, doc


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values stand in the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def before(ids: np.ndarray, doc: np.ndarray, steps: int) -> np.ndarray:
    """The id ``steps`` places earlier in the same document, START before its first word."""
    out = np.full(len(ids), START, np.uint64)
    if len(ids) > steps:
        same = doc[steps:] == doc[:-steps]
        out[steps:][same] = ids[:-steps][same]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of blocks with their number, their shape and how often they repeat the word before."""
    for batch in batches:
        data, offsets = binary_parts(batch.column("text"))
        for _, _, part, off in blocks(data, offsets):
            hashes, doc, start, stop = words_of(part, off, lower=True)
            word, at, where, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            again = np.bincount(where, before(hashes, doc, 1) == hashes, len(word)).astype(np.int64)
            shape = shapes(part, start[at], stop[at])
            yield pa.RecordBatch.from_arrays([_signed(word), pa.array(n), pa.array(shape.astype(np.int32)), pa.array(again)], names=["word", "n", "shape", "again"])


class Shards:
    """Which shard holds a trigram: that of the middle word, and of the word before where the middle word is common."""

    def __init__(self, n: int, salts: np.ndarray):
        self.n, self.salts = n, salts  # salts by id

    def of(self, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix(b * _M1 + salt + np.uint64(1)) % np.uint64(self.n)).astype(np.int32)

    def of_trigram(self, ba: np.ndarray) -> np.ndarray:
        b = ba >> np.uint64(32)
        return self.of(b, mix(ba & _LOW) % self.salts[b])

    def deal(self, held: dict[int, list], ba: np.ndarray, c: np.ndarray, doc: np.ndarray | None = None) -> None:
        """Add the n-grams of a block to those held for each shard, in 12 bytes each, or 16 with their document."""
        shard = self.of_trigram(ba)
        order = np.argsort(shard, kind="stable")
        shard, columns = shard[order], [ba[order], *(x[order].astype(np.uint32) for x in (c, doc) if x is not None)]
        cuts = [*_runs(shard).tolist(), len(shard)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            held.setdefault(int(shard[i]), []).append(tuple(x[i:j] for x in columns))

    def messages(self, kind: int, lot: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        """A lot's n-grams, counted (per document where it is held), a row for each shard; what is held is handed on shard by shard."""
        for shard in sorted(held):
            ba, c, *doc = map(np.concatenate, zip(*held.pop(shard), strict=True))
            c_doc = c.astype(np.uint64) << np.uint64(32)
            if doc:
                c_doc |= doc[0]
            order = np.lexsort((c_doc, ba))
            ba, c_doc = ba[order], c_doc[order]
            first = _runs(ba, c_doc)
            n = np.diff(np.append(first, len(ba))).astype(np.uint32)
            ba, c_doc = ba[first], c_doc[first]
            whose = _pressed((c_doc & _LOW).astype(np.uint32)) if doc else None
            yield _row(shard, kind, lot, _steps(ba), _pressed((c_doc >> np.uint64(32)).astype(np.uint32)), _pressed(n), whose)


def _pressed(values: np.ndarray) -> bytes:
    raw = packed(values) if len(values) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return unpacked(pa.decompress(data[8:], size, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def _steps(ordered: np.ndarray) -> bytes:
    return _pressed(np.diff(ordered, prepend=np.uint64(0)))


def _unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(_opened(data, np.uint64), dtype=np.uint64)


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _MESSAGE.types, strict=True)], schema=_MESSAGE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(column[i].as_py() for column in batch.columns)


def _asked(vocabulary, shards, keep: list[str] | None, text: str):
    """Messages of texts; with ``keep``, counted per document, and these columns with each text's words are sent past the shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 32
        held, kept, words = {}, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            yield from shards.value.messages(COUNTS if keep is None else ASKED, lot, held)
            if keep is not None:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept[0].schema) as out:
                    for part in kept:
                        out.write_batch(part)
                yield _row((lot ^ lot >> 32) % shards.value.n, PAST, lot, sink.getvalue().to_pybytes(), None, None, None)

        rows = 0
        for batch in batches:
            for first, end, ids, doc in tokens(batch.column(text), vocabulary.value):
                ba = joined(before(ids, doc, 1), before(ids, doc, 2))
                if keep is None:
                    learned = ids != UNKNOWN[3]  # repetition is never learned as usual
                    shards.value.deal(held, ba[learned], ids[learned])
                else:
                    shards.value.deal(held, ba, ids, doc + rows)
                    # copies, as a slice would hold the whole batch, its texts included
                    own = pa.array(np.arange(first, end))
                    kept.append(pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in keep), pa.array(np.bincount(doc, minlength=end - first))], names=[*keep, "words"]))
                rows, words = rows + end - first, words + len(ids)
                if words >= LOT:
                    yield from sent()
                    lot, held, kept, words, rows = lot + 1, {}, [], 0, 0
        if rows:
            yield from sent()

    return task


def _together(df: DataFrame, *order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(n, F.pmod("shard", F.lit(n))).sortWithinPartitions("shard", *order)


def _counted(shards):
    """Trigrams of each shard added up; bigrams of common words and, per word, bigrams of others that end in it; numbers of n-grams by count."""

    def told(shard: int, ba: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _row(shard, COUNTS, 0, _steps(ba), _pressed(c.astype(np.uint32)), _pressed(n.astype(np.uint32)), None)
        common = shards.value.salts[ba >> np.uint64(32)] > 1
        bc = joined(ba >> np.uint64(32), c)
        some, of_common = np.unique(bc[common], return_counts=True)
        if len(some):
            yield _row(shard, COMMON, 0, _steps(some), None, _pressed(of_common.astype(np.uint32)), None)
        some, n2 = np.unique(bc[~common], return_counts=True)
        last, n1 = np.unique(some & _LOW, return_counts=True)
        seen = [[(x == k).sum() for k in (1, 2, 3, 4)] for x in (n, n2)]
        yield _row(shard, PAST, 0, _steps(last), _pressed(np.array(seen, np.uint64).ravel()), _pressed(n1.astype(np.uint32)), None)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ba, c, n, parts, waiting = None, *_none(), [], 0

        def merged(*arrays):
            ba, c, n = map(np.concatenate, zip(*arrays, strict=True))
            order = np.lexsort((c, ba))
            ba, c, n = ba[order], c[order], n[order]
            first = _runs(ba, c)
            return ba[first], c[first], _sums(n, first)

        for shard, _, _, *columns, _ in _rows(batches):
            if shard != at:
                if at is not None:
                    yield from told(at, *merged((ba, c, n), *parts))
                at, (ba, c, n), parts, waiting = shard, _none(), [], 0
            parts.append((_unstepped(columns[0]), _opened(columns[1], np.uint32).astype(np.uint64), _opened(columns[2], np.uint32).astype(np.int64)))
            waiting += len(parts[-1][0])
            if waiting > max(LOT, len(ba)):
                (ba, c, n), parts, waiting = merged((ba, c, n), *parts), [], 0
        if at is not None:
            yield from told(at, *merged((ba, c, n), *parts))

    return task


def _none() -> tuple[np.ndarray, ...]:
    return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _pairs(key: str):
    """Packed numbers and counts as rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([_signed(_unstepped(row[3])), pa.array(_opened(row[5], np.uint32).astype(np.int64))], names=[key, "n"])

    return task


def trusted(labels: DataFrame, part: int) -> DataFrame:
    """Identifiers labelled good, split by hash: part 0 may train the model, part 1 sets the bounds."""
    return (
        labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
        .withColumn("order", F.xxhash64(F.lit("trusted"), "doc_id")).filter(F.pmod("order", F.lit(2)) == part)
    )


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All texts that may train."""
    return docs.select("doc_id", whole_text().alias("text")).join(trusted(labels, 0), "doc_id", "left_semi").select("text")


def trusted_sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_words: int) -> DataFrame:
    """Trusted texts to train on: labelled good, by hash of the identifier, at most so many documents and words.

    A document that does not fit is passed over; if none fits, the shortest trains.  Texts without words take no place.
    Languages take turns: what counts is the hash times the number of trusted documents in the language, which is about a
    document's rank in it, so a rare language is not crowded out by common ones.
    """
    spoken = F.concat(F.lit("l"), F.coalesce("lang", F.lit("")))
    known = stored(
        docs.filter(whole_text().rlike(WORD)).select(F.col("doc_id").alias("id"), spoken.alias("l")).join(trusted(labels, 0).withColumnRenamed("doc_id", "id").hint("merge"), "id")
        .groupBy("id", "order").agg(F.min("l").alias("l")),
        "trusted-ids",
    )
    sizes = stored(known.groupBy("l").agg(F.count(F.lit(1)).alias("of_language")), "trusted-sizes")  # a row per language
    rank = (F.col("order").cast("double") / 2.0**64 + 0.5) * F.col("of_language")
    chosen = known.join(sizes, "l").select("id", rank.alias("order")).orderBy("order", "id").limit(max_docs)
    # at most max_docs rows of two numbers
    rows = stored(
        docs.select(F.col("doc_id").alias("id"), whole_text().alias("text")).join(F.broadcast(chosen), "id")
        .withColumn("words", word_count(F.col("text"))),
        "trusted",
    )
    # at most max_docs rows of numbers
    sizes = rows.groupBy("id", "order").agg(F.sum("words").alias("words")).filter("words > 0").orderBy("order", "id").collect()
    inside, so_far = [], 0
    for r in sizes:
        if so_far + r.words <= max_words:
            inside.append(r.id)
            so_far += r.words
    if not inside:
        inside = [r.id for r in sorted(sizes, key=lambda r: r.words)[:1]]
    ids = rows.sparkSession.createDataFrame([(i,) for i in inside], rows.select("id").schema)
    return rows.join(F.broadcast(ids), "id").select("text")


def discounts(seen: np.ndarray) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and more, from how many n-grams were seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    each = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in enumerate(each, 1))


def _cut(n: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


class Fitted:
    """What the tasks share: vocabulary, shards, discounts and the probability of each word by its id."""

    def __init__(self, vocabulary, shards, d3, d2, p1):
        self.vocabulary, self.shards, self.d3, self.d2, self.p1 = vocabulary, shards, d3, d2, p1


class Model:
    """Sorted arrays of one shard of the model, or of all, from its trigrams (``ba``, ``c`` in order, ``n``) and bigrams of common words."""

    def __init__(self, fitted: Fitted, ba: np.ndarray, c: np.ndarray, n: np.ndarray, common: tuple[np.ndarray, np.ndarray]):
        self.vocabulary, self.low = fitted.vocabulary, np.log(fitted.p1)
        bc = joined(ba >> np.uint64(32), c)
        pairs, n2 = np.unique(bc[fitted.shards.salts[ba >> np.uint64(32)] <= 1], return_counts=True)
        pairs, n2 = np.concatenate([pairs, common[0]]), np.concatenate([n2, common[1]])
        order = np.argsort(pairs)
        pairs, n2 = pairs[order], n2[order]

        def smoothed(context, n, d, below):
            first = _runs(context)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
            total, cut = _sums(n, first), _cut(n, d)
            freed = _sums(cut, first) / total
            return context[first], freed, (n - cut) / total[run] + freed[run] * below

        words, of_word, p2 = smoothed(pairs >> np.uint64(32), n2, fitted.d2, fitted.p1[pairs & _LOW])
        contexts, of_context, p3 = smoothed(ba, n, fitted.d3, p2[np.searchsorted(pairs, bc)])
        keys = pair(ba, c)
        order = np.argsort(keys)
        self.trigrams, self.contexts = (keys[order], np.log(p3)[order]), (contexts, np.log(of_context))
        self.bigrams, self.words_of_contexts = (pairs, np.log(p2)), (words, np.log(of_word))

    def log_of(self, ba: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural log of the interpolated probability of ``c`` after two words."""

        def told(held, wanted, otherwise):
            has, at = found(held[0], wanted)
            return np.where(has, held[1][at], otherwise) if len(held[0]) else np.broadcast_to(otherwise, len(wanted))

        b = ba >> np.uint64(32)
        low = self.low[c] + told(self.words_of_contexts, b, 0.0)
        low = told(self.bigrams, joined(b, c), low) + told(self.contexts, ba, 0.0)
        return told(self.trigrams, pair(ba, c), low)

    def log_probability(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Natural log of each word's interpolated probability after the two before it."""
        return self.log_of(joined(before(ids, doc, 1), before(ids, doc, 2)), ids)


def learn(texts: DataFrame, n_shards: int) -> tuple[Fitted, DataFrame, DataFrame] | None:
    """Fit on all texts (column ``text``): what is shared, trigrams by shard, and common bigrams for each shard that needs them."""
    spark = texts.sparkSession
    words = stored(
        texts.mapInArrow(_word_rows, "word long, n long, shape int, again long").groupBy("word").agg(F.sum("n").alias("n"), F.first("shape").alias("shape"), F.sum("again").alias("again")),
        "kn-words",
    )
    known = words.filter("n >= 2").select("word", F.col("n") - F.col("again")).toArrow()
    hashes, often = known.column(0).to_numpy().view(np.uint64), known.column(1).to_numpy()
    order = np.lexsort((hashes, -often))
    hashes = hashes[order]
    by_hash = np.argsort(hashes)
    vocabulary = Vocabulary(hashes[by_hash], by_hash.astype(np.uint64) + UNKNOWN[-1] + np.uint64(1))
    # how often each id is a middle word; by it a common one is dealt over shards
    often = np.concatenate([np.zeros(len(UNKNOWN) + 2, np.int64), often[order]])
    for r in words.filter("n = 1").groupBy("shape").agg(F.sum("n").alias("n")).collect():
        often[UNKNOWN[r["shape"]]] = r["n"]
    often[UNKNOWN[3]] = words.agg(F.sum("again")).first()[0] or 0
    if not often.sum():
        return None
    shards = Shards(n_shards, np.maximum(1, -(-often * n_shards // often.sum())).astype(np.uint64))
    held, dealt = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(shards)
    sent = texts.mapInArrow(_asked(held, dealt, None, "text"), MESSAGE)
    counts = stored(_together(sent).mapInArrow(_counted(dealt), MESSAGE), "kn-trigrams")
    common = stored(counts.filter(F.col("kind") == COMMON).mapInArrow(_pairs("bc"), "bc long, n long").groupBy("bc").agg(F.sum("n").alias("n")), "kn-common")
    ends = counts.filter(F.col("kind") == PAST).mapInArrow(_pairs("c"), "c long, n long")
    ends = ends.unionByName(common.select(F.col("bc").bitwiseAND(F.lit(0xFFFFFFFF)).alias("c"), F.lit(1).cast("long").alias("n")))
    uni = ends.groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # a row per word of the vocabulary
    n1 = np.zeros(len(often), np.int64)
    n1[uni.column(0).to_numpy()] = uni.column(1).to_numpy()
    total = n1.sum()
    if not total:
        return None
    seen = np.zeros((2, 4), np.uint64)
    for r in counts.filter(F.col("kind") == PAST).select("c").toLocalIterator():  # eight numbers a shard
        seen += _opened(bytes(r["c"]), np.uint64).reshape(2, 4)
    more = common.agg(*(F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4))).first()
    d3, d2, d1 = discounts(seen[0]), discounts(seen[1] + np.array(more, np.uint64)), discounts([(n1 == k).sum() for k in (1, 2, 3, 4)])
    freed = _cut(n1, d1).sum() / total
    p1 = ((n1 - _cut(n1, d1)) / total + freed / (len(hashes) + len(UNKNOWN))).astype(np.float64)

    def spread(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            bc, n = batch.column("bc").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            order = np.argsort(bc)
            bc, n = bc[order], n[order]
            cuts = [*_runs(bc >> np.uint64(32)).tolist(), len(bc)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                b = bc[i] >> np.uint64(32)
                salts = np.arange(dealt.value.salts[b], dtype=np.uint64)
                for shard in np.unique(dealt.value.of(np.full(len(salts), b), salts)).tolist():
                    yield _row(shard, COMMON, 0, _steps(bc[i:j]), None, _pressed(n[i:j].astype(np.uint32)), None)

    fitted = Fitted(vocabulary, shards, d3, d2, p1)
    return fitted, counts.filter(F.col("kind") == COUNTS), common.mapInArrow(spread, MESSAGE)


def train(texts: DataFrame) -> Model | None:
    """The model of a small table of texts (column ``text``) in one place; None where it holds no word."""
    learnt = learn(texts, 1)
    if learnt is None:
        return None
    rows = [(_unstepped(r.ba), _opened(r.c, np.uint32).astype(np.uint64), _opened(r.n, np.uint32).astype(np.int64)) for r in learnt[1].collect()]
    return Model(learnt[0], *rows[0], (np.zeros(0, np.uint64), np.zeros(0, np.int64)))


def _told(fitted):
    """Of each lot the losses that a shard knows, summed by document; other rows pass."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model, common, counts = None, None, [], _none()
        for shard, kind, lot, ba, c, n, doc in _rows(batches):
            if shard != at:
                at, model, common, counts = shard, None, [], _none()
            if kind == PAST:
                yield _row(shard, kind, lot, ba, None, None, None)
            elif kind == COMMON:
                common.append((_unstepped(ba), _opened(n, np.uint32).astype(np.int64)))
            elif kind == COUNTS:
                counts = _unstepped(ba), _opened(c, np.uint32).astype(np.uint64), _opened(n, np.uint32).astype(np.int64)
            else:
                if model is None:
                    model = Model(fitted.value, *counts, tuple(map(np.concatenate, zip(_none()[::2], *common, strict=True))))
                    common, counts = [], _none()
                loss = np.rint(-PARTS * model.log_of(_unstepped(ba), _opened(c, np.uint32).astype(np.uint64)))
                of = np.bincount(_opened(doc, np.uint32).astype(np.int64), loss * _opened(n, np.uint32))
                some = np.flatnonzero(of)
                yield _row(shard, kind, lot, None, None, _pressed(of[some].astype(np.uint64)), _steps(some.astype(np.uint64)))

    return task


def _summed(schema: pa.Schema):
    """A lot's rows with words and log perplexity, from what shards returned."""

    def task(lot: pa.Table) -> pa.Table:
        head = lot.filter(pa.compute.equal(lot.column("kind"), PAST)).column("ba")[0].as_py()
        rows = pa.ipc.open_stream(head).read_all()
        words, loss = rows.column("words").to_numpy(), np.zeros(len(rows), np.int64)
        for kind, n, doc in zip(*(lot.column(c).to_pylist() for c in ("kind", "n", "doc")), strict=True):
            if kind == ASKED:
                loss[_unstepped(doc).astype(np.int64)] += _opened(n, np.uint64).astype(np.int64)
        value = pa.array(loss / PARTS / np.maximum(words, 1), mask=words == 0)
        return pa.table([*rows.columns, value], names=schema.names).cast(schema)

    return task


def perplexities(rows: DataFrame, learnt: tuple[Fitted, DataFrame, DataFrame] | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with the words and log perplexity per word of the column ``text`` (NULL without words or without a model)."""
    if learnt is None:
        return rows.select(*keep, word_count(F.col("text")).alias("words"), F.lit(None).cast("double").alias("log_perplexity"))
    kinds = dict(rows.dtypes)
    result = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "words long, log_perplexity double"])
    fitted, counts, common = learnt
    context = rows.sparkSession.sparkContext
    shared, held, dealt = (context.broadcast(x) for x in (fitted, fitted.vocabulary, fitted.shards))
    asked = rows.select(*keep, "text").mapInArrow(_asked(held, dealt, keep, "text"), MESSAGE)
    told = _together(asked.unionByName(counts).unionByName(common), "kind").mapInArrow(_told(shared), MESSAGE)
    return told.groupBy("lot").applyInArrow(_summed(to_arrow_schema(StructType.fromDDL(result))), result)


def drawn(usual) -> object:
    """Log perplexity with ``DRAWN`` words of usual perplexity added."""
    return (F.col("log_perplexity") * F.col("words") + usual * DRAWN) / (F.col("words") + DRAWN)


def bounds_by_language(scored: DataFrame, labels: DataFrame, high: float) -> DataFrame:
    """Usual log perplexity and bound per language, from scores (doc_id, lang, words, log_perplexity): (l, usual, bound).

    The row without a language (``l`` NULL) is over all languages; a NULL language is ``z``, others begin with ``a``.
    """
    code = F.coalesce(F.concat(F.lit("a"), F.col("lang")), F.lit("z"))
    good = scored.filter("log_perplexity is not null").join(trusted(labels, 1), "doc_id").select("words", "log_perplexity", code.alias("l"))
    good = good.unionByName(good.withColumn("l", F.lit(None).cast("string")))
    usual = good.groupBy("l").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("usual"))
    # a row per language: a small side, left to the planner
    return stored(
        good.join(stored(usual, "kn-usual").withColumnRenamed("l", "u"), F.col("l").eqNullSafe(F.col("u")))
        .groupBy("l").agg(F.first("usual").alias("usual"), F.percentile_approx(drawn(F.col("usual")), high, 10_000).alias("bound")),
        "kn-bounds",
    )


def judged(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scores with perplexity, bound and accepted."""
    every = bounds.filter("l is null").first()
    over_all = [F.lit(x).cast("double") for x in ((every.usual, every.bound) if every else (None, None))]
    usual, bound = (F.coalesce(c, x) for c, x in zip((F.col("usual"), F.col("bound")), over_all, strict=True))
    return (
        scored.withColumn("l", F.coalesce(F.concat(F.lit("a"), F.col("lang")), F.lit("z")))
        .join(bounds.filter("l is not null"), "l", "left")
        .withColumn("accepted", (F.col("words") > 0) & F.coalesce(drawn(usual) <= bound, F.lit(True)))
        .withColumn("bound", F.exp(bound)).withColumn("perplexity", F.exp("log_perplexity")).drop("l", "usual", "log_perplexity")
    )


def fit(docs: DataFrame, labels: DataFrame, *, keep: dict | None = None, max_train_docs: float = math.inf, max_train_words: float = math.inf, high: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """The scores of all rows (doc_id, lang, columns of ``keep``, words, log_perplexity) and the bounds.

    The model trains on half of the trusted documents, all of them unless a caller bounds their number or words; the other half
    sets the bounds.
    """
    whole = max_train_docs == math.inf and max_train_words == math.inf
    no_end = (1 << 31) - 1  # beyond it Spark's limit cannot count
    texts = stored(trusted_texts(docs, labels), "trusted") if whole else trusted_sample(docs, labels, int(min(max_train_docs, no_end)), max_train_words)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    learnt = learn(texts, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD)))
    rows = docs.select("doc_id", "lang", *(c.alias(k) for k, c in (keep or {}).items()), whole_text().alias("text"))
    scored = stored(perplexities(rows, learnt, ["doc_id", "lang", *(keep or {})]), "kn-scores")
    return scored, bounds_by_language(scored, labels, high)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every row with doc_id, lang, words, perplexity, the bound of its language, and accepted.

    A document is rejected if its perplexity lies above the quantile ``high`` of held-out trusted documents in its language.
    NULL language is a language of its own; languages without such documents use the bound over all of them.  Texts without
    words, NULL among them, are rejected.  Without any trusted text no bound exists, and every text with words is
    accepted.  Repeated rows are judged alike.  An empty table gives no rows.
    """
    return judged(*fit(docs, labels, **options)).select("doc_id", "lang", "words", "perplexity", "bound", "accepted")


def accepted_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, all columns kept; text and language, which decide, are told by digest."""

    def digest(text: str, lang: str) -> Column:
        return F.sha2(F.concat(F.coalesce(F.concat(F.lit("a"), F.col(lang)), F.lit("z")), F.lit("\0"), whole_text(text)).cast("binary"), 256)

    dropped = judged(*fit(docs, labels, keep={"digest": digest("text", "lang")}, **options)).filter("not accepted").select(F.col("digest").alias("__digest")).distinct()
    rows = docs.withColumn("__digest", digest("text", "lang"))
    return rows.join(stored(dropped, "kn-dropped"), "__digest", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
