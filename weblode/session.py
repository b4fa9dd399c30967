"""Session settings suited to wide html rows and skewed hosts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # html rows are large: small splits keep a task's batch in memory
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "weblode", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; set a folder only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="weblode-ckpt-", dir=os.environ.get("TMPDIR")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def staged(df: DataFrame, workdir: str | None, name: str) -> DataFrame:
    """Materialise a stage that several later steps read, and cut its lineage.

    With ``workdir`` the stage is a table there; otherwise it is a reliable checkpoint in the
    shared folder, so a lost executor costs a re-read and never a recomputation.
    """
    if workdir is None:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    path = f"{workdir}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
