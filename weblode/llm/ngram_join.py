"""N-gram Jaccard self-join by prefixes of token combinations, and the groups that its links connect.

A document is its set of distinct word shingles.  Shingles are ordered by frequency class and hash; two sets with Jaccard
of at least t share tokens in their prefixes.  Of rare tokens one shared token makes a candidate.  Frequent tokens select
too little one by one, so where a prefix reaches them it is extended by b tokens: then two similar sets share b + 1 tokens of
their prefixes.  Frequent tokens are dealt into b parts by hash, so if no shared token is rare, some part has two of them, and
pairs of frequent tokens of a part are the index keys.  Candidates are verified on the full sets.

Equal sets are one node.  A key with many nodes is not expanded into all pairs: nodes are compared with the first node of the key
and the few before them, in one of a few orders of all nodes, so that keys of the same nodes give the same pairs.  Only where a
key then still spans several components are pairs of nodes of different components compared, block by block, by counts per range
of hashes, then by signatures, then by their sets.  That loses no link between components, so the components are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, blocks, mix, stored, whole_text, words_of
from .components import components

SLOT_BITS = 22
INVOLVED_BITS = 24
NEIGHBOURS = 1
#: Orders in which the nodes of a key stand; each key has one of them.
ORDERS = 4
#: Ranges of hashes whose counts tell which pairs of a key may be similar, and coarser ones that are compared first.
RANGES, COARSE = 256, 32
#: Shingles of a block of sets that are compared with one another in one task.
BLOCK = 1 << 20
#: A token is frequent if its slot counts more than the mean by so many standard deviations of a random slot, plus 2.
FREQUENT = 4
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(text: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and its sorted distinct shingle hashes; fewer words than ``width`` make one shingle."""
    data, offsets = binary_parts(text)
    for first, end, part, off in blocks(data, offsets):
        words, doc, _, _ = words_of(part, off, lower=True)
        bounds = np.searchsorted(doc, np.arange(end - first + 1))
        steps = np.resize(_STEPS, width) + np.arange(width, dtype=np.uint64) * np.uint64(2)
        whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            whole = mix(whole + words[k : k + len(whole)] * steps[k])
        for i in range(end - first):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield first + i, np.unique(whole[a : b - width + 1])
            elif b > a:
                value = np.zeros(1, np.uint64)
                for k in range(b - a):
                    value = mix(value + words[a + k] * steps[k])
                yield first + i, mix(value + np.uint64(b - a))
            else:
                yield first + i, whole[:0]


def node_of(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def spare(n: int, percent: int) -> int:
    """How many shingles of a set of n may be missing from a similar set."""
    return n - (percent * n + 99) // 100


def parts_of(n: int, percent: int) -> int:
    """Number of parts into which frequent tokens of a set of n are dealt."""
    return 1 << max(0, (spare(n, percent) + 1).bit_length() - 3)


def index_keys(shingles: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: rare tokens of its prefix and pairs of frequent ones. Similar sets that differ share a key."""
    n = len(shingles)
    least = next(m for m in range(1, 1000) if 100 * m >= percent * (m + 1))  # smaller sets are similar to equal ones only
    if n < least:
        return shingles[:0]
    order = np.lexsort((shingles, frequency))
    d = spare(n, percent)
    if frequency[order[d]] == 0:
        return mix(shingles[order[: d + 1]])
    keys = []
    for b in {parts_of(n, percent), parts_of((percent * n + 99) // 100, percent)}:
        taken = order[: d + b + 1]
        keys.append(mix(shingles[taken[frequency[taken] == 0]]))
        often = shingles[taken[frequency[taken] > 0]]
        part = mix(often + np.uint64(b)) % np.uint64(b)
        by = np.argsort(part, kind="stable")
        often, part = often[by], part[by]
        for step in range(1, len(often)):
            same = part[step:] == part[:-step]
            if not same.any():
                break
            low = np.minimum(often[step:], often[:-step])[same]
            high = np.maximum(often[step:], often[:-step])[same]
            keys.append(mix(mix(low + np.uint64(b)) * _STEPS[1] + high))
    return np.unique(np.concatenate(keys))


def signature(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each range of hashes, at most 255: ``RANGES`` of them, or more with 8 to 16 on average."""
    bits = max(RANGES.bit_length() - 1, (len(shingles) // 8).bit_length() - 1)
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def ranges(signature: bytes) -> bytes:
    """A signature's counts in ``RANGES`` ranges, in 8 bits each or, where one needs more, 32; empty if the signature is full."""
    if 255 in signature:
        return b""
    counts = np.frombuffer(signature, np.uint8).reshape(RANGES, -1).sum(1, dtype=np.int32)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def counts_of(raw: list[bytes]) -> np.ndarray:
    """Rows of counts per range; where they are unknown, more than any other row has."""
    unknown = np.full(RANGES, 1 << 30, np.int32)
    wide = any(len(r) != RANGES for r in raw)
    rows = [unknown if not r else np.frombuffer(r, np.uint8 if len(r) == RANGES else np.int32) for r in raw]
    return np.stack(rows).astype(np.int32 if wide else np.uint8)


def may_be_similar(a: bytes, na: int, b: bytes, nb: int, percent: int) -> bool:
    """Whether two sets can be similar by their signatures: they share no more than the smaller count of each range."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    both = min(na, nb)
    if 255 not in a and 255 not in b:
        few = min(len(x), len(y))
        both = int(np.minimum(x.reshape(few, -1).sum(1), y.reshape(few, -1).sum(1)).sum())
    return 100 * both >= percent * (na + nb - both)


def _members(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), node_of(s), signature(s)) for _, s in shingle_sets(batch.column("text"), width)]
            columns = list(zip(*sets, strict=True)) or [()] * 3
            types = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_shingles", "node", "signature"],
            )

    return task


def _slots(width: int, slot_bits: int):
    """Shingles that fall into each slot, of the documents of a task: a row per lot of slots, as 32-bit counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << slot_bits, np.uint32)
        for batch in batches:
            for _, s in shingle_sets(batch.column("text"), width):
                # shingles of one text that fall into one slot count once: slots only order the shingles
                counts[(s >> np.uint64(64 - slot_bits)).astype(np.int64)] += 1
        for lot, part in enumerate(np.split(counts, max(1, len(counts) >> 16))):
            if part.any():
                wide = np.uint8 if part.max() < 256 else np.uint32
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot], pa.int32()), pa.array([part.astype(wide).tobytes()])], names=["lot", "counts"]
                )

    return task


def _sum_slots(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lot, raw in zip(batch.column("lot").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint8 if len(raw) == size else np.uint32)
                sums[lot] = sums[lot] + part if lot in sums else part.astype(np.int64)
        for lot, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lot], pa.int32()), pa.array([np.minimum(part, (1 << 32) - 1).astype(np.uint32).tobytes()])], names=["lot", "counts"]
            )

    return task


def frequency_classes(rows: DataFrame, width: int, slot_bits: int, frequent: float) -> np.ndarray:
    """Class of each slot: 0 for usual counts, then the higher the more shingles fall into it. One byte per slot."""
    size = min(1 << slot_bits, 1 << 16)
    lots = rows.select("text").mapInArrow(_slots(width, slot_bits), "lot int, counts binary").repartition("lot")
    counts = np.zeros(1 << slot_bits, np.uint32)
    for row in lots.mapInArrow(_sum_slots(size), "lot int, counts binary").toLocalIterator():
        counts[row.lot * size : (row.lot + 1) * size] = np.frombuffer(row.counts, np.uint32)
    mean = counts.sum(dtype=np.float64) / len(counts)
    usual = mean + frequent * mean**0.5 + 2
    classes = np.zeros(len(counts), np.uint8)
    over = np.flatnonzero(counts > usual)
    classes[over] = 1 + np.floor(np.log2(counts[over] / usual)).astype(np.uint8)
    return classes


def _keys(width: int, percent: int, classes, slot_bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies in one task are indexed once
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for _, s in shingle_sets(batch.column("text"), width):
                node = node_of(s)
                if not len(s) or node in done:
                    continue
                done.add(node)
                own = index_keys(s, classes.value[(s >> np.uint64(64 - slot_bits)).astype(np.int64)], percent)
                keys.append(own)
                nodes.append(np.full(len(own), node, np.int64))
                sizes.append(np.full(len(own), len(s), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))],
                    names=["key", "node", "n"],
                )

    return task


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node, those whose key has another node; repeated rows once. One row waits for its follower."""
    held = None  # last row of the batch before: key, node, n, and whether its key came before it
    names = ["key", "node", "n"]
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        before = np.zeros(0, bool)
        if held is not None:
            cols = [np.concatenate([[h], c]) for h, c in zip(held[0], cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        cols = [c[new] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        before = np.concatenate([[held is not None and held[1]], same])
        keep = before.copy()
        keep[:-1] |= same
        held = ([c[-1] for c in cols], bool(before[-1]))
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(c.dtype)) for c in (cols[0], cols[1])] + [pa.array(cols[2][keep].astype(np.int32))], names=names)
    if held is not None and held[1]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int64()), pa.array([held[0][2]], pa.int32())], names=names)


def _near_pairs(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key: each node with the first of its key and with the few before it."""
        tail = [np.zeros(0, np.int64)] * 3
        head = None  # key, node and n of the first row of the key that the batch begins with
        for batch in batches:
            own = [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "n")]
            if not len(own[0]):
                continue
            key, node, n = (np.concatenate([t, c]) for t, c in zip(tail, own, strict=True))
            fresh = len(tail[0])
            left, right = [], []
            for step in range(1, NEIGHBOURS + 1):
                at = np.arange(max(fresh, step), len(key))
                at = at[key[at] == key[at - step]]
                left.append(at - step)
                right.append(at)
            pairs = [np.stack([node[a], n[a], node[b], n[b]]) for a, b in zip(left, right, strict=True)]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], own[0][1:] != own[0][:-1]]), np.arange(len(own[0])), 0))
            hub_node, hub_n = own[1][first], own[2][first]
            if head is not None:
                carried = own[0] == head[0]
                hub_node, hub_n = np.where(carried, head[1], hub_node), np.where(carried, head[2], hub_n)
            last = len(own[0]) - 1
            head = (own[0][last], hub_node[last], hub_n[last])
            pairs.append(np.stack([hub_node, hub_n, own[1], own[2]]))
            tail = [x[-NEIGHBOURS:] for x in (key, node, n)]
            a, na, b, nb = np.concatenate(pairs, 1)
            fits = (a != b) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            both = np.unique(np.stack([np.minimum(a, b)[fits], np.maximum(a, b)[fits]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return task


def _sets(width: int, involved):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = involved.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            nodes, docs, sets = [], [], []
            for i, s in shingle_sets(batch.column("text"), width):
                node = node_of(s)
                at = slot_of_involved(node, ids[i]) if ids[i] is not None else 0
                if len(s) and bits[at >> 3] >> (at & 7) & 1:
                    nodes.append(node)
                    docs.append(ids[i])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(docs, pa.int64()), pa.array(sets, pa.binary())], names=["node", "doc_id", "shingles"]
            )

    return task


def slot_of_involved(node: int, doc_id: int) -> int:
    return (node ^ (doc_id * 0x9E3779B1)) & ((1 << INVOLVED_BITS) - 1)


def _verify(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return task


def _plausible(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("ga", "na", "gb", "nb"))
            mask = pa.array([may_be_similar(*row, percent) for row in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return task


def sets_of(wanted: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Sets (node, shingles) of the wanted nodes (node, doc_id), made again from the texts of ``rows``.

    A bit per slot of (node, doc_id) tells the tasks which texts to return; what passes in vain is joined away.
    """
    spark = rows.sparkSession
    wanted = stored(wanted.select("node", "doc_id").distinct(), "join-wanted")
    mask = F.lit((1 << INVOLVED_BITS) - 1)
    slot = F.col("node").bitwiseXOR(F.col("doc_id") * F.lit(0x9E3779B1)).bitwiseAND(mask).cast("int")
    used = wanted.select(slot.alias("at")).distinct().toArrow()
    bits = np.zeros(1 << (INVOLVED_BITS - 3), np.uint8)  # 2 MB
    at = used.column(0).to_numpy()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    involved = spark.sparkContext.broadcast(bits)
    found = rows.mapInArrow(_sets(width, involved), "node long, doc_id long, shingles binary")
    return stored(found.join(wanted, ["node", "doc_id"], "left_semi").select("node", "shingles"), "join-sets")


def links_of(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets are similar: first by signature, then by the sets themselves.

    ``nodes`` has node, doc_id, n_shingles and signature, ``rows`` doc_id and text.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"g{x}"), F.col("n_shingles").alias(f"n{x}"))
    close = stored(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ga", "na", "gb", "nb").mapInArrow(_plausible(percent), "a long, b long"),
        "join-close",
    )
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
    sets = sets_of(wanted, rows, width)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    verified = close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long")
    return stored(verified, "join-links")


UNIT = ("key", "low", "high")


def _units(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """Columns of each run of rows with the same key and pair of blocks."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*UNIT, *columns)), strict=True):
            if rows and rows[-1][:3] != row[:3]:
                yield [list(c) for c in zip(*rows, strict=True)]
                rows = []
            rows.append(row)
    if rows:
        yield [list(c) for c in zip(*rows, strict=True)]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ranges(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "ranges"])


def _candidates(
    i: int, root: np.ndarray, sides: np.ndarray, size: np.ndarray, levels: list[np.ndarray], percent: int
) -> np.ndarray:
    """Rows before row i in other components that may be similar to it, by their sizes and counts per range of hashes, coarse ones first."""
    open_ = (root[:i] != root[i]) & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i]))
    if sides.min() != sides.max():
        open_ &= sides[:i] != sides[i]
    at = np.flatnonzero(open_)
    for counts in levels:
        if len(at):
            most = np.minimum(counts[at], counts[i]).sum(1, dtype=np.int64)
            at = at[100 * most >= percent * (size[at] + size[i] - most)]
    return at


def _may_cross(percent: int):
    """Pairs of nodes of a unit that are not connected yet and may be similar."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, "node", "component", "side", "n", "ranges"):
            nodes, root, sides, size = (np.array(c, np.int64) for c in unit[3:7])
            counts = counts_of(unit[7])
            coarse = np.add.reduceat(counts, np.arange(0, RANGES, RANGES // COARSE), 1, dtype=np.int64)
            for i in range(1, len(nodes)):
                near = nodes[_candidates(i, root, sides, size, [coarse, counts], percent)]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, nodes[i])), pa.array(np.maximum(near, nodes[i]))], names=["a", "b"])

    return task


def cross_links(open_rows: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between components of the same key, from rows (key, node, n, component).

    Counts per range of hashes tell which pairs of a key may be similar; those go on to the finer signatures and the sets.  Rows of a
    key are dealt into blocks of about ``block`` shingles, and each pair of blocks is one unit of work, so no task holds more
    than two blocks however many nodes have a key.
    """

    def dealt(df: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("weight") / block).cast("int")
        return (
            df.join(df.groupBy("key").agg(F.sum("n").alias("weight")), "key").withColumn("blocks", blocks)
            .withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "component", "side", "n")
        )

    counts = nodes.join(open_rows.select("node").distinct(), "node").select("node", "signature").mapInArrow(_ranges, "node long, ranges binary")
    counted = dealt(open_rows).join(counts, "node").repartition(*UNIT).sortWithinPartitions(*UNIT)
    pairs = counted.select(*UNIT, "node", "component", "side", "n", "ranges").mapInArrow(_may_cross(percent), "a long, b long").distinct()
    return links_of(stored(pairs, "join-cross"), nodes, rows, width, percent)


def similar_groups(docs: DataFrame, *, width: int = 4, percent: int = 85, slot_bits: int = SLOT_BITS, frequent: float = FREQUENT, block: int = BLOCK, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with doc_id, n_shingles and component_id, the smallest identifier reachable by links, itself included.

    Two rows link when ``100 * intersection >= percent * union`` of their shingle sets.  Texts without words, NULL among them,
    link with nothing.  A NULL identifier links to equal texts only and is never the smallest; a row whose equals all
    have NULL identifiers has a NULL component.  Repeated rows have equal sets and link.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    members = stored(rows.mapInArrow(_members(width), "doc_id long, n_shingles long, node long, signature binary"), "join-members")
    nodes = stored(
        members.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ),
        "join-nodes",
    )
    members = members.drop("signature")
    classes = spark.sparkContext.broadcast(frequency_classes(rows, width, slot_bits, frequent))  # one byte per slot
    named = rows.filter("doc_id is not null").select("text")
    keyed = named.mapInArrow(_keys(width, percent, classes, slot_bits), "key long, node long, n int")
    shared = stored(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, n int"), "join-keys")
    # keys have one of a few orders: a node meets others over its keys, and keys that many nodes share repeat their pairs
    shuffled = shared.withColumn("order", F.xxhash64(F.pmod("key", F.lit(ORDERS)), "node")).repartition("key").sortWithinPartitions("key", "order")
    pairs = stored(
        shuffled.select("key", "node", "n").mapInArrow(_near_pairs(percent), "a long, b long").distinct(),
        "join-pairs",
    )
    links = links_of(pairs, nodes, rows, width, percent)
    found = components(links)
    placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = placed.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m")
    ).filter((F.col("x") != F.col("y")) & (F.col("m") > NEIGHBOURS + 2)).select("key")
    still = stored(placed.join(open_keys, "key"), "join-open")
    if not still.isEmpty():
        found = components(links.unionByName(cross_links(still, nodes, rows, width, percent, block)))
    worded = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).filter("n_shingles > 0")
    least = stored(worded.groupBy("component").agg(F.min("doc_id").alias("component_id")), "join-names")
    alone = members.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of their component, all columns kept.

    Rows that repeat that identifier stay too, and so do rows of components without an identifier, as nothing tells those apart.
    """
    dropped = (
        similar_groups(docs, **options).filter("doc_id != component_id or (doc_id is null and component_id is not null)")
        .select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__component")).distinct()
    )
    keyed = docs.select(F.struct(*docs.columns).alias("__all"), F.col("doc_id").cast("long").alias("__id"))
    return keyed.join(dropped.select("__id"), keyed["__id"].eqNullSafe(dropped["__id"]), "left_anti").select("__all.*")
