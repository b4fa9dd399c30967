"""Skew-safe row selection shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int = 1,
    rank_name: str | None = None,
) -> DataFrame:
    """First ``n`` rows per key.

    For small ``n`` Spark prunes to ``n`` rows per key in every map task before the shuffle, so
    a key that owns a third of the table sends only ``n`` rows per task.  Beyond Spark's pruning
    threshold the same is done by hand in two steps, first within salted parts of each key.
    """
    name = rank_name or "_rank"
    threshold = int(
        df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if n > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_columns(df)), F.lit(64)))
        window = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_part_rank", F.row_number().over(window))
            .filter(F.col("_part_rank") <= n)
            .drop("_salt", "_part_rank")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if rank_name else out.drop(name)


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rank_name: str, n: int | None = None
) -> DataFrame:
    """Rows with their rank per key: the first ``n``, or all of them where no bound is set."""
    if n is None:
        return number_rows(df, keys, order, rank_name)
    return first_rows(df, keys, [F.col(c) if isinstance(c, str) else c for c in order], n=n, rank_name=rank_name)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Number all rows of each key from 1 in ``order``, however many a key has.

    Rows are range-partitioned by key and order, so a hot key is spread over many tasks; each
    part is numbered on its own and shifted by the sizes of the parts before it.  The
    partitioning is stored first, because both steps must see the same one.
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = (
        df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in (*keys, *order)])
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        parts.withColumn(name, F.row_number().over(within))
        .join(offsets, [*keys, "_part"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_part", "_offset")
    )


def unnest(df: DataFrame, keep: Sequence[Column | str], array: Column, present: str) -> DataFrame:
    """One row per struct of ``array``; ``present`` names a field that is never NULL.

    The outer form is used on purpose: for the inner form the optimizer adds a filter on the
    array's size and pushes it below the projection, so an array mined from html would be mined
    again just to test that it is not empty.
    """
    named = df.select(*keep, array.alias("_rows"))
    kept = [name for name in named.columns if name != "_rows"]
    return named.select(*kept, F.inline_outer("_rows")).filter(F.col(present).isNotNull())


def order_columns(df: DataFrame) -> list[Column]:
    """Columns fit for hashing rows apart (maps and variants cannot be hashed)."""
    plain = [f for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return [F.col(f.name) for f in plain]
