"""Tables the jobs write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import cut
from ..operators.pages import all_search_actions, canonical_href, headings_of, kinds_column, page_facts
from ..operators.registry import current_versions, next_versions
from ..schema import WHOLE, Limits
from .snapshots import Snapshot


def registry_problem() -> Column:
    """First registry rule an entry breaks, or NULL."""
    checks = [
        (F.col("url").isNull() | ~F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:\S+$"), "url"),
        (F.col("title").isNull(), "title"),
        (~F.coalesce(F.col("tier").isin(fv.SERVER_TIERS), F.lit(False)), "tier"),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
        (F.coalesce(F.col("install_count") < 0, F.lit(True)), "install_count"),
        (~F.coalesce(F.col("status").isin(fv.SERVER_STATUSES), F.lit(False)), "status"),
        (F.coalesce(F.col("version") < 1, F.lit(True)), "version"),
    ]
    out = F.when(F.lit(False), "")
    for test, name in checks:
        out = out.when(test, name)
    return out


def split_registry(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, refused rows with their reason)."""
    checked = entries.withColumn("problem", registry_problem())
    return (
        checked.filter(F.col("problem").isNull()).drop("problem"),
        checked.filter(F.col("problem").isNotNull()),
    )


def registry_table(spark: SparkSession, path: str, schema: str | StructType, **options: int) -> Snapshot:
    """The registry at ``path``, keyed by url; ``schema`` is that of its entries and their site."""
    return Snapshot(spark, path, schema, ["url"], **options)


def append_registry(
    entries: DataFrame, path: str, reject_path: str, batch_id: int | None = None, **options: int
) -> Snapshot:
    """Append one row per (url, version) with its site; refused rows go to their own table.

    History is never rewritten, so a bad batch cannot damage earlier rows.  A batch that is written again under its ``batch_id`` replaces
    what it wrote, so a retry leaves one copy; without one the batch comes after all others.  The number of folders follows the number of
    rows, not that of sites.
    """
    sound, refused = split_registry(entries)
    sited = sound.withColumn("site", urls.registrable_domain(urls.parts_of("url")["host"]))
    table = registry_table(entries.sparkSession, path, sited.schema, **options)
    if batch_id is None:
        batch_id = max(table.batches(), default=-1) + 1
    table.commit(sited, batch_id)
    refused.write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
    return table


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one with ``schema`` when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_versions(tools: DataFrame, path: str) -> None:
    """Append tool rows of new versions.

    "Current" is the view of the highest version, so publishing is this one write and a version
    can never be stored without going live.
    """
    tools.write.mode("append").partitionBy("version").parquet(path)


def live_tools(versions: DataFrame, server: str = "server_id") -> DataFrame:
    """Tools of the current version of every server."""
    newest = versions.groupBy(server).agg(F.max("version").alias("version"))
    return versions.join(newest, [server, "version"], "left_semi")


def payload_table(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Per capture, everything a proposer needs as one JSON text.

    All of it comes from the capture's own row, so nothing is joined or regrouped.  The DOM
    sample is what the proposer is shown; the analysis beside it covers the whole page.
    """
    facts = page_facts(
        captures, "site", "linked_data", "sample", "forms", "links", "buttons", limits=limits
    )
    html = cut(F.col("html"), limits.dom_sample)
    analysis = F.struct(
        F.coalesce("title", text.title_of(F.col("html"), limits.title)).alias("title"),
        text.meta_description(F.col("html"), limits.description).alias("description"),
        canonical_href().alias("canonical_url"),
        headings_of(F.col("html"), limits.headings).alias("headings"),
        F.col("page.appState").alias("app_state"),
        "links",
        "forms",
        "buttons",
        F.col("linked_data.types").alias("types"),
        all_search_actions(limits).alias("search_actions"),
        kinds_column(limits).alias("kinds"),
        F.col("sample").alias("text_sample"),
    )
    listed = [F.col("selectors").alias("selectors_of_interest")] if "selectors" in captures.columns else []
    return facts.select(
        "capture_id",
        "url",
        F.to_json(
            F.struct("url", analysis.alias("page_analysis"), html.alias("dom_sample"), *listed, "network")
        ).alias("payload"),
    )


__all__ = [
    "append_registry",
    "current_versions",
    "live_tools",
    "next_versions",
    "payload_table",
    "read_table",
    "registry_table",
    "split_registry",
    "write_versions",
]
