"""Page drift: html changed since the last capture of the same url.

The newest hash of each url is a snapshot table keyed by url, so a micro-batch reads only the pieces in
which its own urls may be, however long the history.  What a batch found is a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rows import first_rows
from ..session import staged
from ..sources.snapshots import Snapshot

LATEST_SCHEMA = "url string, dom_hash string, captured_at timestamp, batch_id bigint"


def latest_table(spark: SparkSession, path: str, **options: int) -> Snapshot:
    """Newest hash of each url; kept beside the batches' results, in a folder that their readers skip."""
    return Snapshot(spark, f"{path}/_latest", LATEST_SCHEMA, ["url"], **options)


def _newest(rows: DataFrame) -> DataFrame:
    """The row of each url with the latest capture; of equal times the later batch, then the smaller hash."""
    order = [F.desc_nulls_last("captured_at"), F.desc("batch_id"), F.col("dom_hash")]
    return first_rows(rows, ["url"], order)


def drift_batch(batch: DataFrame, batch_id: int, path: str, **options: int) -> None:
    """Compare the newest capture of each url with the newest hash of earlier batches.

    Writes (url, dom_hash, captured_at, drifted) to ``path/batch_id=...``.  A late capture is compared, too, but never replaces a newer one.
    """
    spark = batch.sparkSession
    table = latest_table(spark, path, **options)
    named = batch.select("url", "dom_hash", "captured_at", F.lit(batch_id).cast("bigint").alias("batch_id"))
    newest = staged(_newest(named), None, "batch")
    before = _newest(table.known(newest, batch_id)).select(
        "url", F.col("dom_hash").alias("_hash"), F.col("captured_at").alias("_at"), F.lit(True).alias("_seen")
    )
    met = staged(newest.join(before, "url", "left"), None, "met")
    met.select(
        "url",
        "dom_hash",
        "captured_at",
        (F.col("_seen").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("dom_hash"))).alias("drifted"),
    ).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    newer = F.col("_seen").isNull() | (F.col("_at").isNull() | (F.col("captured_at") >= F.col("_at")))
    table.commit(met.filter(newer).select("url", "dom_hash", "captured_at", "batch_id"), batch_id, merged=_newest)


def stream_drift(captures: DataFrame, hash_path: str, checkpoint: str, **options: int) -> StreamingQuery:
    """Run drift detection over a streaming capture table until it is drained."""
    return (
        captures.writeStream.foreachBatch(lambda df, i: drift_batch(df, i, hash_path, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drift_jobs(hashes: DataFrame) -> DataFrame:
    """Regenerate requests for drifted pages."""
    return hashes.filter("drifted").select(
        F.lit("regenerate").alias("kind"), "url", F.lit("large_drift").alias("reason")
    )
