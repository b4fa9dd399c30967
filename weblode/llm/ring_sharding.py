"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each key hashes to one of 2^slot_bits ring slots and each shard owns ``vnodes`` points of the ring.  A slot belongs to the
shard whose point comes next clockwise.  A shard above ``mean * (1 + epsilon)`` hands on as much as it has too much, in few
slots: largest first, each at most half of what is still too much.  What is handed on continues clockwise to the next shard
with room, largest first, and the smallest slots of every shard come last and even out the rest, at home if there is room; a
slot that fits nowhere goes to the least loaded shard, so the bound is passed by less than that slot.

A shard's own slots are never pushed out by another's, so only the excess moves when the number of shards changes.  The
only sequential part is a fold over the slots handed on, at most 2^slot_bits whatever the corpus holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import number_rows
from .common import shared_folder, whole_text

CHUNK = 256
#: Points looked at clockwise, in turns of the shard count; shards not met by then follow by number.
TURNS = 8
#: Part of a shard's bound that its smallest slots make up, which are dealt last (to itself, if it has room) and even out the rest.
FILL = 0.03
#: A slot is handed on if it is at most one part in so many of what its shard still has too much.
SHARE = 2


def ring_points(spark, shards: int, vnodes: int, slot_bits: int) -> DataFrame:
    """The ring's points: (at, id, shard).  shards * vnodes rows, made of the parameters alone."""
    shard, turn = F.col("id") % shards, F.floor(F.col("id") / shards)
    return spark.range(shards * vnodes).select(
        F.shiftrightunsigned(F.xxhash64(F.lit("point"), shard, turn), 64 - slot_bits).cast("int").alias("at"),
        "id",
        shard.cast("int").alias("shard"),
    )


def ring_owners(points: DataFrame, slot_bits: int) -> DataFrame:
    """The next point clockwise of each slot: (ring_slot, point, shard); 2^slot_bits rows."""
    row = points.agg(F.sort_array(F.collect_list(F.struct("at", "id", "shard"))).alias("p"))
    walked = row.select(
        F.posexplode(
            F.expr("transform(p, (x, i) -> named_struct('low', if(i = 0, -1, p[i - 1].at), 'at', x.at, 'shard', x.shard))")
        ).alias("point", "x")
    ).select("point", "x.*")
    own = walked.filter("at > low").select(
        F.explode(F.sequence(F.col("low") + 1, F.col("at"))).alias("ring_slot"), "point", "shard"
    )
    last = walked.agg(
        F.max("at").alias("last"), F.min("point").alias("point"), F.min_by("shard", "point").alias("shard")
    ).filter(F.col("last") < (1 << slot_bits) - 1)
    wrapped = last.select(
        F.explode(F.sequence(F.col("last") + 1, F.lit((1 << slot_bits) - 1))).alias("ring_slot"), "point", "shard"
    )
    return own.unionByName(wrapped)


def place(loads: DataFrame, shards: int, vnodes: int, slot_bits: int, epsilon: float) -> DataFrame:
    """Shard of every ring slot from the slots' sizes (ring_slot, load): (ring_slot, shard), 2^slot_bits rows."""
    points = ring_points(loads.sparkSession, shards, vnodes, slot_bits)
    owners = ring_owners(points, slot_bits)
    owned = (
        loads.join(owners, "ring_slot")
        .groupBy("shard")
        .agg(
            F.sort_array(F.collect_list(F.struct((-F.col("load")).alias("less"), "ring_slot", "point"))).alias("own"),
            F.sum("load").alias("load"),
        )
        .withColumn("bound", F.floor(F.sum("load").over(Window.partitionBy()) / shards * (1 + epsilon)))  # a row per shard
    )
    small = (
        f"aggregate(reverse(own), named_struct('left', bound * {FILL}D, 'n', 0), "
        "(a, x) -> named_struct('left', a.left + x.less, 'n', if(a.left + x.less >= 0, a.n + 1, a.n)), a -> a.n)"
    )
    handed = owned.withColumn("small", F.expr(small)).withColumn(
        "on",
        F.expr(
            "aggregate(slice(own, 1, size(own) - small), named_struct('over', load - bound, 'on', slice(own, size(own) - small + 1, small)), "
            f"(a, x) -> if(-{SHARE} * x.less <= a.over, named_struct('over', a.over + x.less, 'on', concat(a.on, array(x))), a), a -> a.on)"
        ),
    )
    part = F.struct(
        "shard", F.expr("load + aggregate(on, 0L, (a, x) -> a + x.less)").alias("load"), "bound", "on"
    ).alias("part")
    both = points.select(F.struct("at", "id", "shard").alias("point")).unionByName(handed.select(part), allowMissingColumns=True)
    row = both.agg(
        F.sort_array(F.collect_list("point")).alias("p"), F.collect_list("part").alias("parts")
    ).select(
        F.expr("transform(p, x -> x.shard)").alias("p"),
        F.expr("array_sort(flatten(transform(parts, x -> x.on)))").alias("s"),
        F.expr("array_max(transform(parts, x -> x.bound))").alias("bound"),
        F.expr("map_from_entries(transform(parts, x -> struct(x.shard, x.load)))").alias("kept"),
    )
    first = f"transform(sequence(0, {shards} - 1), k -> coalesce(try_element_at(kept, k), 0L))"
    ahead = min(TURNS * shards, shards * vnodes)
    clockwise = (
        f"array_distinct(concat(slice(p, x.point + 1, {ahead}), "
        f"slice(p, 1, greatest(0, x.point + {ahead} - {shards * vnodes})), sequence(0, {shards} - 1)))"
    )
    least = "cast(array_position(a.load, array_min(a.load)) - 1 as int)"
    step = (
        f"transform(array(coalesce(get(filter({clockwise}, k -> a.load[k] - x.less <= bound), 0), {least})), c -> named_struct("
        "'load', transform(a.load, (l, i) -> if(i = c, l - x.less, l)), 'out', concat(a.out, array(c))))[0]"
    )
    moved = row.select(
        "s",
        F.expr(
            f"aggregate(sequence(0, cast((size(s) - 1) div {CHUNK} as int)), "
            f"named_struct('load', {first}, 'out', cast(array() as array<array<int>>)), "
            f"(b, n) -> transform(array(aggregate(slice(s, n * {CHUNK} + 1, {CHUNK}), "
            f"named_struct('load', b.load, 'out', cast(array() as array<int>)), (a, x) -> {step})), "
            f"d -> named_struct('load', d.load, 'out', concat(b.out, array(d.out))))[0], "
            "b -> flatten(b.out))"
        ).alias("shard_of"),
    ).select(F.explode(F.arrays_zip(F.col("s.ring_slot").alias("ring_slot"), F.col("shard_of").alias("moved"))).alias("z"))
    return owners.join(moved.select("z.ring_slot", "z.moved"), "ring_slot", "left").select(
        "ring_slot", F.coalesce("moved", "shard").alias("shard")
    )


def shard_documents(docs: DataFrame, shards: int = 40, *, vnodes: int = 1024, slot_bits: int = 16, epsilon: float = 0.0005, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and position of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16 (NULL: no bytes).  The law that holds is ``bytes``: the shards' sizes are near
    equal.  ``slot`` numbers a shard's rows from 0 without gaps.  Equal keys share a ring slot; a NULL key is a key of
    its own.  Equal texts are spread by their keys.  An empty table gives no rows; other columns are not read.
    """
    shared_folder(docs.sparkSession, "ring")  # numbering needs a checkpoint folder
    body = whole_text(text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("key"), F.col(key)).alias("hash"),
    ).withColumn("ring_slot", F.shiftrightunsigned("hash", 64 - slot_bits).cast("int"))
    loads = rows.groupBy("ring_slot").agg(F.sum("size").alias("load"))
    placed = place(loads, shards, vnodes, slot_bits, epsilon)
    # at most 2^slot_bits rows of two integers: 1 MB for 2^16 slots
    sharded = rows.join(F.broadcast(placed), "ring_slot").drop("ring_slot")
    numbered = number_rows(sharded, ["shard"], ["hash", "doc_id", "text_crc32", "size"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
