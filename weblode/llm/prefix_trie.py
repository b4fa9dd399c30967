"""Prefix trie of conversations with subtree totals, rolled up by depth bands.

Turns are numbered by a range partition, so one conversation may hold any share of the rows.  A node is named by a 128-bit hash of
four running sums of digests of (depth, role, text), taken block by block of turns; a common prefix is summed in the map
tasks.  No text goes beyond the first step.

Totals over subtrees come from a depth-band rollup.  A node hands its value only to its ancestors within its band of
``HEIGHT`` depths, so nothing is multiplied by more than that.  The first nodes of the bands form a trie of their own, lower by
that factor, which is rolled up in the same way; the completed totals of band tops are then handed to the nodes of the band above.
Rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import number_rows
from .common import stored

HEIGHT = 8
#: Turns of a conversation whose digests one task sums in a row.
BLOCK = 256
LANES = 4
KEY = ["a", "b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, digest, bytes) of every turn of a conversation with an identifier."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        # the length of the role keeps ("ab", "c") and ("a", "bc") apart
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("bytes")]
    return stored(number_rows(turns, ["conv_id"], order, "position").drop("turn"), "trie-turns")


def plain_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, depth, digest, bytes) and the conversations (conv_id, n_turns)."""
    return turns.withColumnRenamed("position", "depth"), turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def rebuilt_turns(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation c - c % group in place of their own, h = crc32(c) % most."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    first = turns.filter(F.col("position") < most)
    held = first.groupBy(F.col("conv_id").alias("base")).agg(F.max("position").alias("held"))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = stored(
        own.withColumn("h", shared.cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % F.lit(group))
        .join(held, "base", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
        .withColumn("n_turns", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
        .select("conv_id", "base", "h", "taken", "n_turns"),
        "trie-conversations",
    )
    head = convs.join(first.withColumnRenamed("conv_id", "base"), "base").filter("position <= taken")
    tail = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("position > h")
    rows = head.select("conv_id", F.col("position").alias("depth"), "digest", "bytes").unionByName(
        tail.select("conv_id", (F.col("taken") + F.col("position") - F.col("h")).alias("depth"), "digest", "bytes")
    )
    return rows, convs.select("conv_id", "n_turns")


def _named(sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(i), *sums).alias(name) for i, name in enumerate(KEY)]


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, bytes, a, b, pa, pb): the name of each conversation's prefix of each depth and of the one before it."""
    lanes = [f"s{i}" for i in range(LANES)]
    # 40 bits each, summed modulo 2^40
    lane = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(i), F.col("depth").cast("long"), "digest"), 24)
    cut = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "bytes", *(lane(i).alias(f"v{i}") for i in range(LANES))).withColumn("block", F.expr(f"(depth - 1) div {block}"))
    cut = stored(cut, "trie-digests")
    wrap = F.lit((1 << 40) - 1)
    sums = cut.groupBy("conv_id", "block").agg(*(F.sum(f"v{i}").bitwiseAND(wrap).alias(f"t{i}") for i in range(LANES)))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # most conversations have one block, and nothing before it
    shifts = sums.select("conv_id", "block", *(F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"t{i}") for i in range(LANES))).filter("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.select("*", *(F.sum(f"v{i}").over(within).alias(lanes[i]) for i in range(LANES))).join(shifts, ["conv_id", "block"], "left")
    run = run.select(
        "conv_id", "depth", "bytes", *(F.col(f"v{i}") for i in range(LANES)),
        *((F.col(lanes[i]) + F.coalesce(f"t{i}", F.lit(0))).alias(lanes[i]) for i in range(LANES)),
    )
    now = [F.col(s).bitwiseAND(wrap) for s in lanes]
    last = [(F.col(s) - F.col(f"v{i}")).bitwiseAND(wrap) for i, s in enumerate(lanes)]
    parent = [x.alias(f"p{name}") for x, name in zip(_named([F.col("depth") - 1, *last]), KEY, strict=True)]
    return run.select("conv_id", "depth", "bytes", *_named([F.col("depth"), *now]), *parent)


def root_name() -> list[Column]:
    return _named([F.lit(0).cast("long")] * (LANES + 1))


def rollup(path: DataFrame, values: DataFrame, sums: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """(a, b, *sums): totals of ``sums`` over the subtree of each node.

    ``path`` has (conv_id, depth, a, b) of every prefix of the conversations that name a node, from depth 0 on, ``values`` one row
    (conv_id, depth, *sums) for each node, under the conversation that names it.
    """
    band = F.expr(f"depth div {height}")
    place = F.struct("depth", *KEY)
    # a node's ancestors within its band stand on the path of the conversation that names it
    both = path.select("conv_id", band.alias("band"), place.alias("place"), *(F.lit(None).cast("long").alias(s) for s in sums), F.lit(None).cast("long").alias("at"))

    def handed(given: DataFrame) -> DataFrame:
        """Given values (conv_id, band, at, *sums), summed into each place of the band down to depth ``at``."""
        rows = both.unionByName(given, allowMissingColumns=True).groupBy("conv_id", "band").agg(
            F.collect_list("place").alias("places"),
            F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", *sums))).alias("given"),
        )
        below = lambda p, s: F.aggregate(
            F.filter("given", lambda g: g["at"] >= p["depth"]), F.lit(0).cast("long"), lambda acc, g: acc + g[s]
        )
        reached = F.filter("places", lambda p: p["depth"] <= F.array_max(F.transform("given", lambda g: g["at"])))
        each = F.explode(F.transform(reached, lambda p: F.struct(*(p[k].alias(k) for k in KEY), *(below(p, s).alias(s) for s in sums))))
        return rows.filter(F.size("given") > 0).select(each.alias("x")).select("x.*").groupBy(*KEY).agg(*(F.sum(s).alias(s) for s in sums))

    given = values.select("conv_id", band.alias("band"), F.col("depth").alias("at"), *sums)
    within = handed(given)
    if deepest < height:
        return within
    within = stored(within, "trie-within")
    tops = path.filter(f"depth % {height} = 0").withColumn("depth", band)
    named = values.filter(f"depth % {height} = 0").select("conv_id", band.alias("depth")).join(tops, ["conv_id", "depth"]).join(within, KEY)
    named = stored(named.select("conv_id", "depth", *KEY, *sums), "trie-tops")
    whole = rollup(tops, named.select("conv_id", "depth", *sums), sums, deepest // height, height)
    carried = named.filter("depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), *KEY).join(whole, KEY)
    carried = carried.select("conv_id", "band", (F.col("band") * height + height - 1).alias("at"), *sums)
    below = handed(carried).select(*KEY, *(F.col(s).alias(f"more_{s}") for s in sums))
    return within.join(below, KEY, "left").select(*KEY, *((F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers of each run of one node, in order, as one string per node and task."""
    held, ids = None, []
    for batch in batches:
        rows = []
        for a, b, conv_id, part in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id", "part")), strict=True):
            if held != (a, b, part):
                if held is not None:
                    rows.append((*held, ",".join(ids)))
                held, ids = (a, b, part), []
            ids.append(str(conv_id))
        yield _chunks(rows)
    if held is not None:
        yield _chunks([(*held, ",".join(ids))])


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*KEY, "part", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, fed one after another."""
    held, digest = None, None
    names = [*KEY, "ends_sha256"]
    types = [pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if held != (a, b):
                if held is not None:
                    rows.append((*held, digest.hexdigest()))
                held, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*held, digest.hexdigest()), types, strict=True)], names=names)


def ends(members: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes at which conversations end, from (a, b, conv_id).

    Identifiers are joined task by task of a range partition, so of a node with very many ends only a string per task is
    gathered, and its task feeds these to the hash one by one.
    """
    spread = members.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").withColumn("part", F.spark_partition_id())
    chunks = stored(spread.mapInArrow(_joined, "a long, b long, part int, ids string"), "trie-ends")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, *, height: int = HEIGHT, block: int = BLOCK) -> DataFrame:
    """One row per node of the prefix trie of ``rows`` (conv_id, depth from 1, digest, bytes), members ``convs`` (conv_id, n_turns).

    Returns conv_id (smallest member), depth, parent_conv_id (NULL at the root), n_convs, n_children, n_leaves, saved_tokens (over
    the subtree, the bytes of each node's last text for every member but one) and ends_sha256.  Conversations without turns
    belong to the root.  Without conversations there is no node.
    """
    path = stored(prefixes(rows, block), "trie-path")
    nodes = path.groupBy(*KEY).agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    )
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        *root_name(), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"),
        *(F.lit(None).cast("long").alias(c) for c in ("pa", "pb")),
    )
    nodes = stored(nodes.unionByName(root), "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    children = nodes.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(
        nodes.join(children, KEY, "left").join(parents, ["pa", "pb"], "left").select(
            *KEY, "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        ),
        "trie-family",
    )
    naming = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"))
    own = path.select("conv_id", "depth", *KEY).unionByName(nodes.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("depth"), *root_name()))
    # of each conversation that names nodes, the prefixes of their bands and of the band tops above
    used = own.join(naming, "conv_id").filter(f"depth div {height} >= since div {height} - 1 or depth % {height} = 0").select("conv_id", "depth", *KEY)
    values = nodes.select("conv_id", "depth", "saved_tokens", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"))
    totals = rollup(stored(used, "trie-used"), values, ["saved_tokens", "n_leaves"], deepest, height)
    last = convs.join(path.select("conv_id", F.col("depth").alias("n_turns"), *KEY), ["conv_id", "n_turns"]).select(*KEY, "conv_id")
    turnless = convs.filter("n_turns = 0").select(*root_name(), "conv_id")
    return (
        nodes.drop("saved_tokens").join(totals, KEY).join(ends(last.unionByName(turnless)), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, *, rebuild: bool = False, height: int = HEIGHT, block: int = BLOCK) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), as they are or rebuilt from the first turns of a neighbour.

    Turns are ordered by ``turn``, NULL first; ties, repeated rows among them, by the digest of role and text.  A NULL role or text is
    empty; rows without an identifier belong to no conversation and take no part.  Other columns are ignored; an empty table gives no rows.
    """
    turns = numbered_turns(conversations)
    rows, convs = rebuilt_turns(turns) if rebuild else plain_turns(turns)
    return trie(rows, convs, height=height, block=block)
