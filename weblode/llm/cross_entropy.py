"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both models are matched: bigrams smoothed toward words by the same rule, over one shared vocabulary, every word of the
corpus.  Words and bigrams are counted exactly, told apart by 64-bit hashes; the background counts every word of every document,
the target every word of its members.  A document is judged by the others: its own counts are taken out of the background, and
out of the target where it is a member, so a score tells how like the target a text is, not whether it was in it.

Documents and the members' identifiers are dealt into lots of bounded size, once, and kept as a bucketed table.  A task sums a
lot's n-grams and sends each shard of the hash range its part; a shard adds up what all lots sent and answers each lot with the
totals of that lot's own n-grams, in the order sent.  Then each lot meets its answers without another shuffle of texts and is
scored, so no model is ever gathered in one place, and a common word costs a lot one entry.  A document's score is the mean over
its words of the target's loss less the background's: the lower, the more it is like the target.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import binary_parts, blocks, packed, shared_folder, stored, unpacked, whole_text, words_of
from .kn_quality import START, before, pair

#: The word model spreads its floor over 2^18 words, or over the vocabulary where that is larger.
WORD_BITS = 18
#: Weight of the word model in a bigram's probability, in pseudo-counts; of the uniform model in a word's.
PRIOR, FLOOR = 8.0, 0.5
#: Bytes of text in a lot, about.
LOT = 8 << 20
#: Lots among which rows of one identifier are spread; a member's identifier is sent to each.
SALTS = 8
#: Blocks (of about a megabyte) whose n-grams are held before they are added up.
MERGED = 3
RESULT = {"words": "long", "target_loss": "double", "background_loss": "double", "score": "double"}
PAIRS, WORDS = 0, 1
MESSAGE = "shard int, lot int, kind int, keys binary, n binary, back binary"
ANSWER = "lot int, kind int, shard int, n binary, back binary, total double, target_total double, distinct long"


def slots(text: pa.Array) -> Iterator[tuple]:
    """Blocks of texts as hashes: (first, end, document, word, the word before, bigram)."""
    data, offsets = binary_parts(text)
    for first, end, part, off in blocks(data, offsets):
        words, doc, _, _ = words_of(part, off, lower=True)
        back = before(words, doc, 1)
        yield first, end, doc, words, back, pair(back, words)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each one's sum of every count."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


class Counts:
    """N-grams of texts: sorted bigrams, and sorted words as a word and as the word before, with counts in all and in members."""

    def __init__(self):
        none, no = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.pairs, self.words, self.parts = (none, no, no), (none, *[no] * 4), []

    def add(self, text: pa.Array, member: np.ndarray) -> None:
        for first, end, doc, word, back, both in slots(text):
            of = member[first:end][doc].astype(np.uint32)
            one, no = np.ones(len(word), np.uint32), np.zeros(len(word), np.uint32)
            alone = summed(np.concatenate([word, back]), *map(np.concatenate, ((one, no), (of, no), (no, one), (no, of))))
            self.parts.append((summed(both, one, of), alone))
            if len(self.parts) >= MERGED:
                self.total()

    def total(self) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Adds up what blocks left, so that no more than a few blocks are held beside the distinct n-grams."""
        for i in range(2):
            some = [(self.pairs, self.words)[i], *(p[i] for p in self.parts)]
            merged = summed(*map(np.concatenate, zip(*some, strict=True)))
            if i == PAIRS:
                self.pairs = merged
            else:
                self.words = merged
        self.parts = []
        return self.pairs, self.words

    def messages(self, lot: int, shards: int) -> pa.Table:
        rows = []
        for kind, (keys, *counts) in enumerate(self.total()):
            # shards are ranges of the upper half of the hash
            of = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(of, np.arange(shards + 1))
            for shard in np.flatnonzero(np.diff(cut)).tolist():
                at = slice(cut[shard], cut[shard + 1])
                steps = np.diff(keys[at], prepend=np.uint64(0))
                n = [packed(np.concatenate([c[at] for c in counts[k : k + 2]]).astype(np.uint32)) for k in range(0, len(counts), 2)]
                rows.append((shard, lot, kind, packed(steps), n[0], n[1] if kind == WORDS else None))
        types = [pa.int32()] * 3 + [pa.binary()] * 3
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in MESSAGE.split(", ")])


def _opened(lot: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Documents of a lot, and which of them are members; the lot's rows without text are members' identifiers."""
    asks = lot.column("text").is_null()
    docs = lot.filter(pc.invert(asks)).combine_chunks()
    members = lot.filter(asks).column("id").combine_chunks()
    return docs, pc.is_in(docs.column("id"), value_set=members, skip_nulls=True).to_numpy().astype(bool)


def _parts(docs: pa.Table, member: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Runs of documents of bounded number: (first row, texts, members)."""
    texts = docs.column("text")
    for a in range(0, len(texts), 256):
        yield a, texts.slice(a, 256), member[a : a + 256]


def _ask(shards: int):
    """Messages of a lot."""

    def task(lot: pa.Table) -> pa.Table:
        held = Counts()
        for _, part, of in _parts(*_opened(lot)):
            held.add(part, of)
        return held.messages(lot.column("lot")[0].as_py(), shards)

    return task


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a shard for each lot that asked; rows come ordered by kind and shard."""
    names, types = [f.split()[0] for f in ANSWER.split(", ")], [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.float64()] * 2 + [pa.int64()]

    def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        shard, _, kind = rows[0][:3]
        keys = [np.cumsum(unpacked(r[3], np.uint64), dtype=np.uint64) for r in rows]
        sums = []  # counts in all and in members, of words then of words before
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        for column in (4, 5)[: kind + 1]:
            for n in map(np.concatenate, zip(*(unpacked(r[column], np.uint32).reshape(2, -1) for r in rows), strict=True)):
                sums.append(np.bincount(place, n, len(distinct)).astype(np.int64))
        out = [(-1, kind, shard, None, None, float(sums[0].sum()), float(sums[1].sum()), len(distinct) - int(kind == WORDS and START in distinct))]
        ends = np.cumsum([0, *map(len, keys)])
        for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
            at = place[a:b]
            two = [packed(np.concatenate([sums[k][at], sums[k + 1][at]])) for k in range(0, len(sums), 2)]
            out.append((r[1], kind, shard, two[0], two[1] if kind == WORDS else None, None, None, None))
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64], strict=True), types, strict=True)], names=names)

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(f.split()[0]).to_pylist() for f in MESSAGE.split(", ")), strict=True):
            if rows and (rows[0][0], rows[0][2]) != (row[0], row[2]):
                yield from told(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from told(rows)


def _own(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each entry's place stands in its own document."""
    _, at, n = np.unique(doc.astype(np.int64) << 32 | place, return_inverse=True, return_counts=True)
    return n[at]


class Bigrams:
    """Totals of one model for the n-grams of a lot; ``loss`` is the negative natural log of each word's probability."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray, backs: np.ndarray, total: float, size: int):
        self.pairs, self.words, self.backs, self.total, self.size = pairs, words, backs, total, size

    def loss(self, at: tuple[np.ndarray, ...], less: tuple[np.ndarray, ...]) -> np.ndarray:
        """Of places of (word, word before, bigram); ``less`` is what to take out for each, and of all words."""
        (word, back, both), (own_word, own_back, own_both, own_all) = at, less
        alone = (self.words[word] - own_word + FLOOR) / (self.total - own_all + FLOOR * self.size)
        return -np.log((self.pairs[both] - own_both + PRIOR * alone) / (self.backs[back] - own_back + PRIOR))


def _score(keep: int, totals: tuple[float, float], size: int, schema: pa.Schema):
    """A lot and its answers to scored rows."""

    def task(lot: pa.Table, answers: pa.Table) -> pa.Table:
        docs, member = _opened(lot)
        counts = Counts()
        for _, part, of in _parts(docs, member):
            counts.add(part, of)
        (pairs, *_), (words, *_) = counts.total()
        del counts
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "n", "back")), strict=True), key=lambda a: a[:2])
        found = []
        for kind, column, wanted in ((PAIRS, 2, pairs), (WORDS, 2, words), (WORDS, 3, words)):
            halves = [unpacked(a[column], np.int64).reshape(2, -1) for a in told if a[0] == kind]
            found.append(np.concatenate(halves, 1) if halves else np.zeros((2, 0), np.int64))
            if found[-1].shape[1] != len(wanted):
                raise RuntimeError("a lot's n-grams differ from those it asked for")
        background, target = (Bigrams(*(x[k] for x in found), totals[k], size) for k in (0, 1))
        n, losses = np.zeros(len(docs), np.int64), np.zeros((2, len(docs)))
        for a, part, of in _parts(docs, member):
            for first, end, doc, word, back, both in slots(part):
                of_doc = np.bincount(doc, minlength=end - first)
                n[a + first : a + end] = of_doc
                at = np.searchsorted(words, word), np.searchsorted(words, back), np.searchsorted(pairs, both)
                own = *(_own(doc, x) for x in at), of_doc[doc]
                inside = of[first:end][doc].astype(np.int64)
                for k, loss in enumerate((target.loss(at, tuple(x * inside for x in own)), background.loss(at, own))):
                    losses[k, a + first : a + end] = np.bincount(doc, loss, end - first)
        mean = losses / np.maximum(n, 1)
        columns = [*(docs.column(f"k{i}") for i in range(keep)), pa.array(n), *(pa.array(x, mask=n == 0) for x in (*mean, mean[0] - mean[1]))]
        return pa.table(columns, names=schema.names).cast(schema)

    return task


def _dealt(docs: DataFrame, members: DataFrame, key: str, keep: tuple[str, ...], lots: int, n: int) -> DataFrame:
    """Rows ``lot, id, k0.., text`` and members' identifiers (text NULL), bucketed by lot in the shared folder."""
    ids = dict(docs.dtypes)[key]
    lot_of = lambda salt: F.pmod(F.xxhash64("id", salt), F.lit(lots)).cast("int")
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(key).alias("id"), *named, whole_text().alias("text"))
    # rows without an identifier are no members, and spread by their text
    spread = F.xxhash64("text", *(F.col(f"k{i}").cast("string") for i in range(len(keep))))
    salt = F.when(F.col("id").isNull(), spread).otherwise(F.pmod(spread, F.lit(SALTS)))
    named_members = members.select(F.col(key).cast(ids).alias("id")).filter("id is not null").distinct()
    flags = named_members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    both = rows.withColumn("lot", lot_of(salt)).unionByName(flags.withColumn("lot", lot_of(F.col("salt"))).drop("salt"), allowMissingColumns=True)
    name = f"cross_entropy_{uuid.uuid4().hex}"
    writer = both.repartition(n, "lot").write.format("parquet").option("compression", "zstd").bucketBy(n, "lot").sortBy("lot")
    writer.option("path", shared_folder(docs.sparkSession, name)).saveAsTable(name)
    return docs.sparkSession.table(name)


def score(docs: DataFrame, members: DataFrame, *, key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with ``keep``, words, target_loss, background_loss and score (their difference), per word in nats.

    ``members`` is a table whose column ``key`` names the rows of ``docs`` that make up the target (repeated, NULL and unknown
    identifiers change nothing); the background is all of ``docs``.  A document's own words count in neither model when it is
    scored; those of equal texts in other rows do.  NULL text has no words; texts without words have NULL losses and score.  An empty
    target predicts every word alike.  Repeated rows count each and score alike.  Rows of one identifier lie in at most ``SALTS``
    lots.  A column of ``keep`` named as a column of the result is an error.
    """
    clash = sorted(set(keep) & set(RESULT))
    if clash:
        raise ValueError(f"rename {clash} before scoring")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(docs.dtypes)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = max(n, -(-size // LOT))
    rows = _dealt(docs, members, key, keep, lots, n)
    asked = rows.groupBy("lot").applyInArrow(_ask(lots), MESSAGE)
    answers = stored(asked.repartitionById(n, F.pmod("shard", F.lit(n))).sortWithinPartitions("kind", "shard").mapInArrow(_answer, ANSWER), "cross-entropy-answers")
    sums = answers.filter(f"lot = -1 and kind = {WORDS}").agg(F.sum("total"), F.sum("target_total"), F.sum("distinct")).first()
    vocabulary = max(1 << WORD_BITS, sums[2] or 0)
    result = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} {t}" for c, t in RESULT.items())])
    told = answers.filter("lot >= 0").select("lot", "kind", "shard", "n", "back")
    schema = to_arrow_schema(StructType.fromDDL(result))
    scored = _score(len(keep), (sums[0] or 0.0, sums[1] or 0.0), vocabulary, schema)
    return rows.groupBy("lot").cogroup(told.groupBy("lot")).applyInArrow(scored, result)
