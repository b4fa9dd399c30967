"""Exact deduplication as a stateful stream: disk-backed keyed state without expiry.

The files of a Parquet table arrive as a stream.  Per digest of the text the state (RocksDB, checkpointed to the
shared folder, never expired) keeps the number of rows seen, the stable identifier of the row that stays and its content
locator (file and row in the file), so no text is held in state.  When a later call finds new files, the same state goes
on from its checkpoint.  Digests met more than once are hits: their bytes are fetched by locator and compared in
full, and rows whose bytes differ from the kept row's form groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, whole_text

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # otherwise each partition's log takes 4 MB of disk before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(df: DataFrame, digest, text: str, row_id: str) -> DataFrame:
    """Digest, identifier, locator and text of each row; ``_metadata`` names the file and the row in it."""
    body = whole_text(text)
    return df.select(
        digest(body).alias("digest"),
        F.col(row_id).cast("long").alias("row_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        body.alias("body"),
    )


def absorb(spark: SparkSession, path: str, state: str, *, digest=sha256_of, text: str = "text", row_id: str = "doc_id", files_per_batch: int = 10_000) -> DataFrame:
    """Let the stream take in what is new under ``path``; returns the state as rows (digest, keep, seen).

    Runs until nothing is left to read and stops.  ``state`` is the folder of the stream's checkpoint.
    """
    session = spark.newSession()  # the stream's settings hold for it alone
    for key, value in STREAM_SETTINGS.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, because a stream's plain path has to be a folder
    # files of any age are taken in, also old ones that arrive after newer ones
    reader = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d")
    source = reader.parquet(pattern)
    keyed = _located(source, digest, text, row_id)
    counted = keyed.groupBy("digest").agg(
        F.max(F.struct("row_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("seen")
    )
    query = (
        counted.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
        .option("checkpointLocation", state).start()
    )
    query.awaitTermination()
    held = spark.read.format("statestore").load(state)
    fields = held.schema["value"].dataType.fields
    keep = next(f.name for f in fields if f.dataType.typeName() == "struct")
    seen = next(f.name for f in fields if f.dataType.typeName() == "long")
    return held.select("key.digest", F.col(f"value.{keep}").alias("keep"), F.col(f"value.{seen}").alias("seen"))


def deduplicate(spark: SparkSession, path: str, *, digest=sha256_of, text: str = "text", row_id: str = "doc_id", state: str | None = None) -> DataFrame:
    """One row per row of the Parquet table ``path``: row_id, keep_id, group_size, kept, digest, file, row.

    Texts are equal when identical byte for byte; NULL counts as empty.  The row with the largest identifier stays (NULL
    is smallest); among repeated identifiers the last by file and row, so exactly one row of a group is kept.  An empty
    table gives no rows.  Other columns are not read.
    """
    state = state or shared_folder(spark, "exact-dedup")
    groups = stored(absorb(spark, path, state, digest=digest, text=text, row_id=row_id), "exact-groups")
    rows = _located(spark.read.parquet(path), digest, text, row_id)
    members = rows.drop("body").join(groups, "digest")
    # bytes are compared in full: each task sends one row per digest and body, however many copies it has, and no body is stored
    hits = rows.join(groups.filter("seen > 1").select("digest", "keep"), "digest")
    bodies = hits.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    split = stored(bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("bodies")).filter("bodies > 1").select("digest"), "exact-split")
    # rows meet the few such digests first, so that other bodies are not shuffled once more
    unlike = rows.join(split, "digest").join(groups.select("digest", "keep"), "digest")
    kept_bodies = unlike.filter(F.struct("row_id", "file", "row").eqNullSafe(F.col("keep"))).select("digest", F.col("body").alias("keep_body"))
    other = stored(
        unlike.join(kept_bodies, "digest").filter(F.col("body") != F.col("keep_body")).select("digest", "row_id", "file", "row", "body"),
        "exact-other",
    )
    if not other.isEmpty():  # digests that met without equal bytes
        regrouped = other.groupBy("digest", "body").agg(
            F.max(F.struct("row_id", "file", "row")).alias("own_keep"), F.count(F.lit(1)).alias("own_seen")
        )
        own = other.join(regrouped, ["digest", "body"]).select("file", "row", "own_keep", "own_seen")
        fewer = other.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
        members = members.join(own, ["file", "row"], "left").join(fewer, "digest", "left").select(
            "digest", "row_id", "file", "row",
            F.coalesce("own_keep", "keep").alias("keep"),
            F.coalesce("own_seen", F.col("seen") - F.coalesce("fewer", F.lit(0))).alias("seen"),
        )
    return members.select(
        "row_id",
        F.col("keep.row_id").alias("keep_id"),
        F.col("seen").alias("group_size"),
        F.struct("row_id", "file", "row").eqNullSafe(F.col("keep")).alias("kept"),
        "digest", "file", "row",
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: docs are written to the shared folder and streamed."""
    path = shared_folder(spark, "exact-input")
    docs.write.parquet(path)
    kept = deduplicate(spark, path).filter("kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    source = spark.read.schema(docs.schema).parquet(path)
    located = source.select(F.struct(*source.columns).alias("__all"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return located.join(kept, ["__file", "__row"], "left_semi").select("__all.*")
