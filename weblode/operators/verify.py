"""Verification of endpoints against a table of probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import urls
from ..functions.expr import any_contains, cut
from ..functions.rows import first_rows
from ..schema import WHOLE, Limits


def probe_class(found: Column, status: Column, body: Column, limits: Limits = WHOLE) -> Column:
    """Struct ``status, reason`` for one probe; ``found`` is NULL when nothing answered."""
    hay = F.lower(cut(body, limits.probe_window))
    empty = (F.trim(F.regexp_replace(body, fv.WS, " ")) == "") & (status != 204)

    def result(state: str, reason: Column | None) -> Column:
        return F.struct(
            F.lit(state).alias("status"),
            (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
        )

    return (
        F.when(found.isNull(), result("dead", F.lit("network error / timeout")))
        .when(
            (status >= 400) | (status == 0),
            result("dead", F.concat(F.lit("HTTP "), status.cast("string"))),
        )
        .when(any_contains(hay, fv.PROBE_WALL), result("blocked", F.lit("anti-bot challenge in response")))
        .when(empty, result("dead", F.lit("empty body")))
        .otherwise(result("verified", None))
    )


def verification_targets(tools: DataFrame, fresh_values: DataFrame | None = None) -> DataFrame:
    """Tools with ``target``, ``fresh_target`` and ``skip`` (why a tool cannot be verified).

    ``fresh_values`` has ``param, value``: values never captured, used to test a template.
    """
    method = F.upper("method")
    param = F.get(F.filter("params", lambda p: p["place"] == "path"), F.lit(0))["name"]
    skip = (
        F.when(F.col("kind") != "http", F.lit("browser tool (no HTTP target)"))
        .when(
            ~method.isin("GET", "HEAD"),
            F.concat(F.lit("non-idempotent method "), method, F.lit(" (never replayed live)")),
        )
        .when(
            F.col("raw_url").rlike(fv.PLACEHOLDER_TARGET),
            F.lit("placeholder target (no captured value to verify)"),
        )
    )
    out = (
        tools.withColumn("skip", skip)
        .withColumn("target", F.when(F.col("skip").isNull(), F.col("raw_url")))
        .withColumn("param", F.when(F.col("skip").isNull(), param))
    )
    if fresh_values is None:
        return out.withColumn("fresh_value", F.lit(None).cast("string")).withColumn(
            "fresh_target", F.lit(None).cast("string")
        )
    values = fresh_values.groupBy("param").agg(F.min("value").alias("fresh_value"))
    placeholder = F.concat(F.lit("{"), F.col("param"), F.lit("}"))
    filled = F.regexp_replace(
        F.col("url_pattern"),
        F.concat(F.lit("^(.*?)\\{"), F.col("param"), F.lit("\\}")),
        F.concat(F.lit("$1"), urls.encode_component(F.col("fresh_value"))),
    )
    origin = urls.parts_of("raw_url")["origin"]
    fresh = F.when(
        F.contains("url_pattern", placeholder) & (F.col("fresh_value") != ""),
        F.concat(origin, filled),
    )
    return out.join(values, "param", "left").withColumn("fresh_target", fresh)


def verify_tools(
    tools: DataFrame,
    probes: DataFrame,
    fresh_values: DataFrame | None = None,
    limits: Limits = WHOLE,
) -> DataFrame:
    """Tools with ``status, reason, http_status, generalized``.

    ``probes`` is classified once before it is joined, so bodies never travel with the tools.  Should it hold
    several rows of a ``(url, method)``, in any case of letters, the newest (``observed_at``) or else the first
    by status counts; a tool is never multiplied.
    """
    targets = verification_targets(tools, fresh_values)
    wanted = (
        targets.select(F.col("target").alias("url"), F.upper("method").alias("method"))
        .unionByName(targets.select(F.col("fresh_target").alias("url"), F.lit("GET").alias("method")))
        .filter(F.col("url").isNotNull())
        .distinct()
    )
    observed = F.col("observed_at") if "observed_at" in probes.columns else F.lit(None).cast("timestamp")
    classed = first_rows(
        probes.withColumn("method", F.upper(F.coalesce("method", F.lit("GET"))))
        .join(wanted, ["url", "method"], "left_semi")
        .select(
            "url",
            "method",
            "status",
            probe_class(F.lit(True), F.col("status"), F.col("body"), limits).alias("probe"),
            observed.alias("_observed"),
        ),
        ["url", "method"],
        [F.desc_nulls_last("_observed"), F.col("status"), F.col("probe.status"), F.col("probe.reason")],
    )
    captured = classed.select(
        F.col("url").alias("target"),
        F.col("method").alias("_verb"),
        F.col("status").alias("http_status"),
        F.col("probe").alias("_captured"),
    )
    fresh = classed.filter(F.col("method") == "GET").select(
        F.col("url").alias("fresh_target"), F.col("probe").alias("_fresh")
    )
    joined = (
        targets.withColumn("_verb", F.upper("method"))
        .join(captured, ["target", "_verb"], "left")
        .join(fresh, "fresh_target", "left")
    )
    status = F.when(F.col("skip").isNotNull(), "not_verifiable").otherwise(
        F.coalesce(F.col("_captured.status"), F.lit("dead"))
    )
    fresh_status = F.coalesce(F.col("_fresh.status"), F.lit("dead"))
    fresh_reason = F.coalesce(
        F.when(F.col("_fresh").isNull(), F.lit("network error / timeout")),
        F.col("_fresh.reason"),
        fresh_status,
    )
    reason = (
        F.when(F.col("skip").isNotNull(), F.col("skip"))
        .when(F.col("_captured").isNull(), F.lit("network error / timeout"))
        .when(
            F.col("generalized") == F.lit(False),
            F.concat(
                F.lit("captured ok but fresh value '"), F.col("fresh_value"), F.lit("' -> "), fresh_reason
            ),
        )
        .otherwise(F.col("_captured.reason"))
    )
    return (
        joined.withColumn("status", status)
        .withColumn(
            "generalized",
            F.when(
                (F.col("status") == "verified") & F.col("fresh_target").isNotNull(),
                fresh_status == "verified",
            ),
        )
        .withColumn("reason", reason)
        .select(*tools.columns, "status", "reason", "http_status", "target", "generalized")
    )


def annotated_confidence() -> Column:
    """Confidence after verification; unverified tools keep theirs."""
    col = F.col
    floor = F.when(F.coalesce(col("generalized"), F.lit(False)), fv.GENERALIZED_FLOOR).otherwise(
        fv.VERIFIED_FLOOR
    )
    return (
        F.when(col("status") == "verified", F.greatest(col("confidence"), floor))
        .when(col("status").isin("dead", "blocked"), F.least(col("confidence"), F.lit(fv.DAMPED_CEILING)))
        .otherwise(col("confidence"))
    )


def annotate(tools: DataFrame, verifications: DataFrame, key: str = "tool_id") -> DataFrame:
    """Tools with the confidence their verification earns; tools without one are untouched."""
    found = verifications.select(key, "status", "generalized")
    return (
        tools.join(found, key, "left")
        .withColumn("confidence", annotated_confidence())
        .drop("status", "generalized")
    )


def keep_live(verified: DataFrame, server: str = "server_id", drop_blocked: bool = False) -> DataFrame:
    """Tools that are not dead; a server whose tools all died keeps them all."""
    bad = ["dead", "blocked"] if drop_blocked else ["dead"]
    alive = verified.filter(~F.col("status").isin(bad))
    lost = (
        verified.groupBy(server)
        .agg(F.count_if(~F.col("status").isin(bad)).alias("_alive"))
        .filter(F.col("_alive") == 0)
        .select(server)
    )
    return alive.unionByName(verified.join(lost, server, "left_semi"))


def verify_report(verifications: DataFrame, *keys: str) -> DataFrame:
    """Counts per outcome, overall or per key."""
    state = F.col("status")
    return verifications.groupBy(*keys).agg(
        F.count_if(state == "verified").alias("verified"),
        F.count_if(state == "dead").alias("dead"),
        F.count_if(state == "blocked").alias("blocked"),
        F.count_if(state == "not_verifiable").alias("not_verifiable"),
        F.count_if(F.coalesce("generalized", F.lit(False))).alias("generalized"),
    )
