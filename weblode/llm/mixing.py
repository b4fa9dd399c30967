"""Mix sources to target weights: subset-sum budget fitting by exact document length.

Targets: each source has a weight; a budget (a share of all words) is divided by weight, a source stops at ``most`` times
its own words, and the excess goes to the others by weight until no target is above its stop.

Fitting: a source's target is whole passes over all its documents plus a remaining budget smaller than one pass.  For that
rest only counts of documents by exact length matter.  Every length gives the same share of its documents, rounded
down; longer documents then fill up until the rest is within the width of the table; a bounded-knapsack dynamic
program over that rest finds the sum next to the budget.  Which documents of a length are taken is decided by a seeded
hash of the identifier, so reruns agree.

The fit of one source sees (length, count) rows only.  Distinct lengths adding to W words are fewer than sqrt(2 W) + 1, so
the group is bounded whatever share of the documents a source holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rows import number_rows
from .common import shared_folder, stored, whole_text, word_count


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is as near ``budget`` as it can be (the lower of two equally near).

    Sums up to budget plus the largest length are reached as bits of an integer; each new sum remembers the piece that
    reached it, and a sum's pieces are all different because they were added one after another.
    """
    if budget <= 0 or not lengths:
        return [0] * len(lengths)
    width = budget + max(lengths)
    mask = (1 << (width + 1)) - 1
    reached, by = 1, {}
    pieces = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        size, left = 1, min(count, width // length)
        while left > 0:
            take = min(size, left)
            pieces.append((i, take, take * length))
            new = ((reached << (take * length)) & mask) & ~reached
            reached |= new
            while new:
                low = new & -new
                by[low.bit_length() - 1] = len(pieces) - 1
                new ^= low
            left -= take
            size *= 2
        if reached >> budget & 1:
            break
    below = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reached >> (budget + 1)
    over = budget + 1 + (above & -above).bit_length() - 1 if above else None
    at = over if over is not None and over - budget < budget - below else below
    taken = [0] * len(lengths)
    while at:
        i, take, size = pieces[by[at]]
        taken[i] += take
        at -= size
    return taken


def fit(lengths: list[int], counts: list[int], budget: int, width: int) -> list[int]:
    """Documents to take of each length (all > 0) for ``budget`` words in all, each document at most once."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    taken = [c * budget // total if total else 0 for c in counts]
    rest = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= width:
            break
        more = min(counts[i] - taken[i], (rest - width // 2) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    short = [i for i in range(len(lengths)) if taken[i] < counts[i] and lengths[i] <= 2 * rest]
    for i, more in zip(short, knapsack([lengths[i] for i in short], [counts[i] - taken[i] for i in short], rest), strict=True):
        taken[i] += more
    return taken


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source key: source_size, weight, target.  Weights repeat over the sources in code-point order, NULL last."""
    spark = sizes.sparkSession
    shared_folder(spark, "mix")
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(totals, [], ["source_key"], "rank")
    listed = F.array(*map(F.lit, weights))
    stop = F.col("source_size") * F.lit(float(most))
    table = stored(ranked.withColumn("weight", listed[((F.col("rank") - 1) % len(weights)).cast("int")]), "mix-sources")
    words = table.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0  # words per unit of weight; each round stops more sources, until none is above
    while True:
        capped = stop <= F.col("weight") * level
        left, heavy = table.agg(
            F.lit(float(words) * share) - F.coalesce(F.sum(F.when(capped, stop)), F.lit(0.0)),
            F.sum(F.when(~capped, F.col("weight"))),
        ).first()
        new = left / heavy if heavy else level
        if new <= level or not heavy:
            break
        level = new
    return table.select("source_key", "source_size", F.least(stop, F.col("weight") * F.lit(float(level))).alias("target"))


def mix(docs: DataFrame, *, size: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 20, width: int = 1 << 16, row_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every row with its part in the mix: doc_id, source_key, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document (0 to ``most``), ``taken`` its words times copies.  NULL text has no
    words; documents without words are never repeated or missed (their words are 0 either way).  NULL source is a source
    of its own, last in order.  Repeated rows count and are taken each for itself.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    sizes = stored(
        docs.select(
            F.col(row_id).alias("doc_id"),
            F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("z")).alias("source_key"),
            (word_count(whole_text(text)) if size is None else size).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(row_id)).alias("hash"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, share, most)
    # rows of one source and length in seeded order, range-partitioned so that a hot length is spread over tasks
    order = ["source_key", "size", "hash", "doc_id"]
    rows = stored(
        sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)),
        "mix-order",
    )
    runs = rows.groupBy("source_key", "size", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    lengths = runs.groupBy("source_key", "size").agg(F.sum("n").alias("n"))

    def fit_source(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        total, target = int(group["source_size"].iloc[0]), round(float(group["target"].iloc[0]))
        passes, rest = divmod(target, total) if total else (0, 0)
        worded = group[group["size"] > 0]
        taken = fit(worded["size"].tolist(), worded["n"].tolist(), rest, width)
        out = group[["source_key", "size"]].assign(passes=passes, more=0)
        out.loc[worded.index, "more"] = taken
        return out

    plan = lengths.join(targets, "source_key").groupBy("source_key").applyInPandas(
        fit_source, "source_key string, size long, passes long, more long"
    )
    before = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (
        runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(plan, ["source_key", "size"])
        .select("source_key", "size", "part", "passes", (F.col("first") + F.col("more") - F.col("before")).alias("until"))
        .join(targets, "source_key")
    )
    copies = F.col("passes") + (F.col("at") < F.col("until")).cast("int")
    return (
        rows.join(bounds, ["source_key", "size", "part"])
        .withColumn("copies", copies)
        .select("doc_id", "source_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept; rows without words stay once.

    Rows that repeat identifier, source and size are kept alike, as often as the most taken of them.
    """
    keys = {
        "__id": F.col("doc_id"),
        "__source": F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("z")),
        "__size": word_count(whole_text()),
    }
    keyed = docs.select(F.struct(*docs.columns).alias("__all"), *(c.alias(k) for k, c in keys.items()))
    times = (
        mix(docs, **options).filter("copies > 0 or size = 0")
        .groupBy(F.col("doc_id").alias("id"), F.col("source_key").alias("source"), F.col("size").alias("words"))
        .agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")).alias("times"))
    )
    joined = keyed.join(
        times,
        F.col("__id").eqNullSafe(F.col("id")) & (F.col("__source") == F.col("source")) & (F.col("__size") == F.col("words")),
    )
    return joined.select("__all", F.explode(F.sequence(F.lit(1), F.col("times")))).select("__all.*")
