"""Captures in, only-new endpoints out.

Coverage is a table, not operator state: it grows with the endpoints of the sites and never
expires.  It is a snapshot table keyed by site: a micro-batch reads only the pieces in which its own
sites may be and adds a piece, and pieces are compacted, so a batch costs the same after any history.
A batch that is retried after a lost driver replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.coverage import uncovered
from ..session import staged
from ..sources.snapshots import Snapshot

COVERAGE_SCHEMA = "site string, sig string, capture_id string, payload string, batch_id bigint"


def coverage_table(spark: SparkSession, path: str, **options: int) -> Snapshot:
    """Endpoints found so far, with the capture and batch that brought them; ``read()`` gives the rows."""
    return Snapshot(spark, path, COVERAGE_SCHEMA, ["site"], **options)


def discover_batch(material: DataFrame, batch_id: int, table: Snapshot | str) -> None:
    """Write the endpoints of one batch that no earlier batch has seen.

    ``material`` has ``site, sig, source_rank, pos, capture_id, payload``.
    """
    if isinstance(table, str):
        table = coverage_table(material.sparkSession, table)
    # one row per endpoint of the batch, stored because the pieces to read are chosen by its sites
    nothing = table.spark.createDataFrame([], "site string, kind string, value string")
    first = staged(uncovered(material, nothing), None, "batch")
    known = table.known(first, batch_id).select("site", F.lit("sig").alias("kind"), F.col("sig").alias("value"))
    fresh = uncovered(first, known).select(
        "site",
        "sig",
        F.col("capture_id").cast("string").alias("capture_id"),
        F.col("payload").cast("string").alias("payload"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
    )
    table.commit(fresh, batch_id)


def stream_discovery(
    captures: DataFrame,
    to_material: Callable[[DataFrame], DataFrame],
    coverage_path: str,
    checkpoint: str,
    **options: int,
) -> StreamingQuery:
    """Run discovery over a streaming capture table until it is drained."""

    def each(batch: DataFrame, batch_id: int) -> None:
        discover_batch(to_material(batch), batch_id, coverage_table(batch.sparkSession, coverage_path, **options))

    return (
        captures.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
