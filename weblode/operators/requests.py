"""Planned requests: what a tool would send for given arguments.  Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import let
from ..functions.json_help import fill_body, select_paths
from .calls import clean_query


def write_flag() -> Column:
    """Whether an http tool changes something: by verb, or for POST by how it is described."""
    verb = F.upper("method")
    mutation = text.ascii_words(fv.MUTATION_VERBS)
    described = F.col("name").rlike(mutation) | F.coalesce(
        F.col("description").rlike(mutation), F.lit(False)
    )
    return F.coalesce(
        (F.col("kind") == "http")
        & (verb.isin("PUT", "PATCH", "DELETE") | ((verb == "POST") & described)),
        F.lit(False),
    )


def write_flags(tools: DataFrame) -> DataFrame:
    return tools.withColumn("is_write", write_flag())


def write_share(tools: DataFrame, key: str = "site") -> DataFrame:
    """Share of a site's tools that write."""
    return (
        write_flags(tools)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("tools"), F.count_if("is_write").alias("writes"))
        .withColumn("write_share", F.col("writes") / F.col("tools"))
    )


def url_template() -> Column:
    """Full address of a tool: origin, pattern and the fixed query, without secrets."""
    query_of = lambda t: F.regexp_extract(t, r"(?s)^[^?#]*(\?[^#]*)", 1)

    def with_clean_query(t: Column) -> Column:
        bare = F.regexp_replace(t, r"(?s)[?#].*$", "")
        fragment = F.regexp_extract(t, r"(?s)(#.*)$", 1)
        return F.concat(bare, clean_query(query_of(t)), fragment)

    pattern = F.when(
        F.contains("url_pattern", F.lit("?")), with_clean_query(F.col("url_pattern"))
    ).otherwise(F.col("url_pattern"))

    def build(u: Column) -> Column:
        fixed = F.when(F.contains(pattern, F.lit("?")), F.lit("")).otherwise(clean_query(u["query"]))
        return F.coalesce(F.concat(u["origin"], pattern, fixed), pattern)

    return let(urls.parts_of("raw_url"), build)


_PAIR = "array<struct<name:string,value:string>>"


def request_plan(tools: DataFrame, args: DataFrame, allow_writes: bool = False, keys: tuple[str, ...] = ("tool_id",)) -> DataFrame:
    """One planned request per row of ``args``.

    ``args`` has ``call_id``, the tool keys, ``args map<string,string>`` with JSON values, and
    optionally ``dry_run``.  The result has ``method, url, headers, body, missing, allowed``.
    """
    call = args if "dry_run" in args.columns else args.withColumn("dry_run", F.lit(False))
    joined = call.join(
        write_flags(tools).withColumn("template", url_template()), list(keys)
    )
    given = F.filter(F.col("params"), lambda p: F.map_contains_key("args", p["name"]))
    supplied = F.transform(
        F.filter(F.col("_given"), lambda p: F.try_element_at("args", p["name"]).isNotNull()),
        lambda p: F.struct(
            p["place"].alias("place"),
            p["key"].alias("name"),
            F.try_element_at("args", p["name"]).alias("json"),
        ),
    )

    def plain(json: Column) -> Column:
        """Text of a JSON scalar as a URL shows it."""
        return F.coalesce(
            F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"], json
        )

    def place(name: str) -> Column:
        return F.transform(
            F.filter(F.col("_supplied"), lambda p: p["place"] == name),
            lambda p: F.struct(p["name"].alias("name"), plain(p["json"]).alias("value")),
        )

    bare = F.regexp_replace("template", r"(?s)\?.*$", "")
    path = F.aggregate(
        F.col("_path"),
        bare,
        lambda url, p: F.replace(
            F.replace(
                url, F.concat(F.lit("{{"), p["name"], F.lit("}}")), urls.encode_component(p["value"])
            ),
            F.concat(F.lit("{"), p["name"], F.lit("}")),
            urls.encode_component(p["value"]),
        ),
    )
    captured = urls.query_pairs(
        F.regexp_extract("template", r"(?s)^[^?#]*\?([^#]*)", 1)
    )
    # a supplied value takes the place of the captured one; other values follow in order
    overridden = F.transform(
        F.col("_captured"),
        lambda c: F.struct(
            c["name"].alias("name"),
            F.coalesce(
                F.get(F.filter(F.col("_query"), lambda q: q["name"] == c["name"]), F.lit(0))["value"],
                c["value"],
            ).alias("value"),
        ),
    )
    added = F.filter(
        F.col("_query"), lambda q: ~F.exists(F.col("_captured"), lambda c: c["name"] == q["name"])
    )
    body_keys = F.transform(F.filter("_supplied", lambda p: p["place"] == "body"), lambda p: p["name"])
    body_values = F.transform(F.filter("_supplied", lambda p: p["place"] == "body"), lambda p: p["json"])
    base_body = F.col("body") if "body" in tools.columns else F.lit(None).cast("string")
    headers = F.map_from_entries(
        F.transform(place("header"), lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")))
    )
    missing = F.filter(
        F.regexp_extract_all("url", F.lit(r"\{\{?(\w+)\}\}?"), F.lit(1)), lambda n: n != ""
    )
    planned = (
        joined.withColumn("_given", given)
        .withColumn("_supplied", supplied)
        .withColumn("_path", place("path"))
        .withColumn("_query", place("query"))
        .withColumn("_captured", captured)
        .withColumn("_pairs", F.concat(overridden, added))
        .withColumn(
            "url",
            F.concat(
                path,
                F.when(
                    F.size("_pairs") > 0, F.concat(F.lit("?"), urls.encode_query(F.col("_pairs")))
                ).otherwise(""),
            ),
        )
        .withColumn("missing", missing)
        .withColumn("plan_body", fill_body(base_body, body_keys, body_values))
        .withColumn("headers", headers)
    )
    return planned.select(
        "call_id",
        *keys,
        F.upper("method").alias("method"),
        "url",
        "headers",
        F.col("plan_body").alias("body"),
        "missing",
        "is_write",
        F.coalesce("dry_run", F.lit(False)).alias("dry_run"),
        (
            (F.size("missing") == 0)
            & ~F.coalesce("dry_run", F.lit(False))
            & (~F.col("is_write") | F.lit(allow_writes))
        ).alias("allowed"),
    )


def json_select(responses: DataFrame, select: Column, body: str = "body") -> DataFrame:
    """Responses with ``selected``: the JSON document projected to comma-separated dot paths."""
    return responses.withColumn("selected", select_paths(F.col(body), select))
