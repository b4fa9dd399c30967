"""Confidence, healing, versions and status of published tool sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import first_rows, number_rows
from .dedupe import contract_problem


def aggregate_confidence(tools: DataFrame, captures: DataFrame | None = None, key: str = "capture_id") -> DataFrame:
    """Mean of the clamped confidences; 0 for a capture without tools."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    means = tools.groupBy(key).agg(F.avg(clamped).alias("confidence"))
    if captures is None:
        return means
    return (
        captures.select(key)
        .distinct()
        .join(means, key, "left")
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    )


def heal(tools: DataFrame, heals: DataFrame, server: str = "server_id") -> DataFrame:
    """Replace exactly the failing tools, carrying the others over unchanged.

    ``heals`` holds ``server, failing_name`` and the columns of the proposed tool.  A proposal
    that breaks the contract or renames the tool is ignored.  ``healed`` marks replaced rows.
    """
    columns = [c for c in tools.columns if c not in (server, "name")]
    sound = heals.filter(contract_problem().isNull() & (F.col("name") == F.col("failing_name")))
    proposals = first_rows(
        sound.select(server, "name", F.struct(*columns).alias("_new")), [server, "name"], [F.col("_new.confidence").desc()]
    ) if "ord" not in heals.columns else first_rows(
        sound.select(server, "name", "ord", F.struct(*columns).alias("_new")), [server, "name"], [F.col("ord")]
    ).drop("ord")
    joined = tools.join(proposals, [server, "name"], "left")
    healed = F.col("_new").isNotNull()
    return joined.select(
        server,
        "name",
        *[F.when(healed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        healed.alias("healed"),
    )


def heal_outcomes(heals: DataFrame, healed: DataFrame, versions: DataFrame, server: str = "server_id") -> DataFrame:
    """Per heal request: whether it took, the version that results, and the server's status."""
    took = healed.filter("healed").select(server, F.col("name").alias("failing_name"), F.lit(True).alias("_took"))
    return (
        heals.select(server, "failing_name")
        .distinct()
        .join(took, [server, "failing_name"], "left")
        .join(versions.select(server, "version"), server, "left")
        .select(
            server,
            "failing_name",
            F.coalesce("_took", F.lit(False)).alias("healed"),
            (F.coalesce("version", F.lit(0)) + F.when(F.col("_took"), 1).otherwise(0)).alias("version"),
            F.when(F.col("_took"), "active").otherwise("degraded").alias("status"),
        )
    )


def next_versions(
    entries: DataFrame, registry: DataFrame, order: tuple[str, ...] = ("server_id",)
) -> DataFrame:
    """Give each new entry the next version of its exact url.

    Entries of one url in one batch are numbered in ``order``; a url with very many entries is
    numbered by several tasks.
    """
    known = registry.groupBy("url").agg(F.max("version").alias("_known"))
    return (
        number_rows(entries, ["url"], order, "_place")
        .join(known, "url", "left")
        .withColumn("version", (F.coalesce("_known", F.lit(0)) + F.col("_place")).cast("int"))
        .drop("_place", "_known")
    )


def current_versions(versions: DataFrame, server: str = "server_id") -> DataFrame:
    """The live version of each server: the highest one written, so no pointer can be lost."""
    return first_rows(versions, [server], [F.desc("version")])


def registry_status(captures: DataFrame, tools: DataFrame) -> DataFrame:
    """Registry row per capture: broken only without tools on a page that is not interactive."""
    counts = tools.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("tool_count"),
        F.bool_or(F.col("kind") == "browser").alias("_browser"),
        F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))).alias("confidence"),
    )
    interactive = (
        F.coalesce("rendered_with_js", F.lit(False))
        | (F.coalesce(F.size("page.actions"), F.lit(0)) > 0)
        | (F.coalesce(F.size("page.forms"), F.lit(0)) > 0)
        | F.coalesce("_browser", F.lit(False))
    )
    none = F.coalesce("tool_count", F.lit(0)) == 0
    return captures.join(counts, "capture_id", "left").select(
        "capture_id",
        "url",
        F.coalesce("title", "url").alias("title"),
        F.lit("auto_gen").alias("tier"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.lit(0).alias("install_count"),
        F.coalesce("tool_count", F.lit(0)).alias("tool_count"),
        F.when(none & ~interactive, "broken").otherwise("active").alias("status"),
    )


def failures_of_tools(failures: DataFrame, tools: DataFrame, server: str = "server_id") -> DataFrame:
    """Failures that concern a known tool; others are no-ops."""
    known = tools.select(server, F.col("name").alias("tool_name")).distinct()
    return failures.join(known, [server, "tool_name"], "left_semi")
