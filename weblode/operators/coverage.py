"""What a tool set already covers, and what a new capture adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import head
from ..functions.rows import first_rows, unnest
from ..schema import WHOLE, Limits
from .pages import all_search_actions, page_facts
from .templates import all_query_patterns, detail_templates


def tool_signature() -> Column:
    """Endpoint a tool targets: verb and path, or the first page a browser tool opens."""
    opened = F.get(F.filter("steps", lambda s: s["action"] == "navigate"), F.lit(0))["value"]
    return F.when(
        F.col("kind") == "http", urls.endpoint_signature(F.col("method"), F.col("url_pattern"))
    ).otherwise(F.when(opened != "", urls.endpoint_signature(F.lit("GET"), opened)))


def coverage_of(tools: DataFrame, key: str = "site") -> DataFrame:
    """Distinct ``(key, kind, value)`` rows: names and endpoint signatures."""
    pairs = F.array(
        F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")),
        F.struct(F.lit("sig").alias("kind"), tool_signature().alias("value")),
    )
    known = F.filter(pairs, lambda p: p["value"].isNotNull())
    return unnest(tools, [key], known, "value").distinct()


def uncovered(material: DataFrame, coverage: DataFrame, key: str = "site") -> DataFrame:
    """First row per new signature: not covered yet, and not repeated within the material.

    ``material`` has ``key, sig, source_rank, pos``.  Rows are cut to one per signature before
    the anti-join, so a hot site only sends its distinct endpoints.
    """
    known = coverage.filter(F.col("kind") == "sig").select(key, F.col("value").alias("sig"))
    order = [F.col("source_rank"), F.col("pos")]
    if "capture_id" in material.columns:
        order.append(F.col("capture_id"))
    return first_rows(material, [key, "sig"], order).join(known, [key, "sig"], "left_anti")


DELTA_RANK = {"network": 0, "detail": 1, "query": 2, "search": 3, "form": 4, "appstate": 5}


def new_material(captures: DataFrame, calls: DataFrame | None, limits: Limits = WHOLE) -> DataFrame:
    """Everything in captures that could be a new endpoint, with its signature, in delta order.

    Forms and app state are those the capture's page snapshot reports.
    """
    facts = page_facts(captures, "site", "linked_data", limits=limits)
    site = facts.select("capture_id", "site")

    def rows(df: DataFrame, source: str, method: Column, pattern: Column, pos: Column, payload: Column) -> DataFrame:
        return df.select(
            "capture_id",
            F.lit(source).alias("source"),
            F.lit(DELTA_RANK[source]).alias("source_rank"),
            pos.cast("bigint").alias("pos"),
            urls.endpoint_signature(method, pattern).alias("sig"),
            payload.alias("payload"),
        )

    get = F.lit("GET")
    detail = detail_templates(captures, limits=limits)
    query = all_query_patterns(captures, limits)
    actions = unnest(
        page_facts(captures, "here", "linked_data", limits=limits),
        ["capture_id"],
        F.transform(all_search_actions(limits), lambda a, i: F.struct(i.alias("pos"), a.alias("a"))),
        "pos",
    )
    forms = unnest(
        captures,
        ["capture_id", "url"],
        F.transform("page.forms", lambda f, i: F.struct(i.alias("pos"), f.alias("f"))),
        "pos",
    )
    states = unnest(
        captures,
        ["capture_id"],
        head(F.transform("page.appState", lambda s, i: F.struct(i.alias("pos"), s.alias("s"))), limits.app_states),
        "pos",
    )
    parts = [
        rows(detail, "detail", get, F.col("url_pattern"), F.col("rank"), F.col("name")),
        rows(query, "query", get, F.col("url_pattern"), F.col("rank"), F.col("name")),
        rows(actions, "search", get, F.col("a.url_pattern"), F.col("pos"), F.col("a.query_param")),
        rows(
            forms,
            "form",
            F.coalesce("f.method", get),
            F.coalesce("f.action", "url"),
            F.col("pos"),
            F.col("f.purpose"),
        ),
        rows(states, "appstate", F.lit("APPSTATE"), F.col("s.source"), F.col("pos"), F.col("s.source")),
    ]
    if calls is not None:
        parts.insert(
            0, rows(calls, "network", F.col("method"), F.col("url_pattern"), F.col("pos"), F.col("raw_url"))
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.join(site, "capture_id")


def new_actions(captures: DataFrame, coverage: DataFrame, key: str = "site", top: int | None = None) -> DataFrame:
    """Page controls whose tool name is not covered yet."""
    label = F.lower(F.col("a.label"))
    name = F.when(F.lit(False), "")
    for tool in fv.ACTION_DELTA_ORDER:
        name = name.when(label.rlike(text.ascii_words(fv.ACTION_CONTROLS[tool][0])), tool)
    listed = unnest(
        page_facts(captures, "site"),
        ["capture_id", "site"],
        F.transform("page.actions", lambda a, i: F.struct(i.alias("pos"), a.alias("a"))),
        "pos",
    ).withColumn("name", name)
    known = coverage.filter(F.col("kind") == "name").select(key, F.col("value").alias("name"))
    fresh = listed.filter(F.col("name").isNotNull()).join(known, [key, "name"], "left_anti")
    if top is not None:
        fresh = first_rows(fresh, ["capture_id"], [F.col("pos")], n=top)
    return fresh.select(
        "capture_id", "site", "pos", "name", "a.*"
    )


def discovery_delta(
    captures: DataFrame, calls: DataFrame | None, coverage: DataFrame, limits: Limits = WHOLE
) -> tuple[DataFrame, DataFrame]:
    """New material per capture, and per capture whether it holds anything that counts as new.

    Within a capture an endpoint counts once, at its first source; app state alone is not new.
    """
    material = new_material(captures, calls, limits)
    known = coverage.filter(F.col("kind") == "sig").select("site", F.col("value").alias("sig"))
    delta = first_rows(
        material, ["capture_id", "sig"], [F.col("source_rank"), F.col("pos")]
    ).join(known, ["site", "sig"], "left_anti")
    actions = new_actions(captures, coverage, top=limits.new_actions).groupBy("capture_id").agg(F.count(F.lit(1)).alias("actions"))
    counted = delta.groupBy("capture_id").agg(
        F.count_if(F.col("source") != "appstate").alias("endpoints")
    )
    flags = (
        captures.select("capture_id")
        .join(counted, "capture_id", "left")
        .join(actions, "capture_id", "left")
        .select(
            "capture_id",
            (F.coalesce("endpoints", F.lit(0)) + F.coalesce("actions", F.lit(0)) > 0).alias("has_new"),
        )
    )
    return delta, flags


def merge_new_tools(existing: DataFrame, extra: DataFrame, key: str = "site") -> DataFrame:
    """Existing tools plus the extra ones whose name and endpoint are both new."""
    from .dedupe import validate_candidates

    coverage = coverage_of(existing, key)
    names = coverage.filter(F.col("kind") == "name").select(key, F.col("value").alias("name"))
    sigs = coverage.filter(F.col("kind") == "sig").select(
        key, F.col("value").alias("_target"), F.lit(True).alias("_covered")
    )
    marked = extra.withColumn("_target", tool_signature()).join(sigs, [key, "_target"], "left")
    checked = validate_candidates(marked, [key], names, barred=F.col("_covered"))
    added = checked.filter(F.col("status") == "kept").select(*existing.columns)
    return existing.unionByName(added)
