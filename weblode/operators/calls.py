"""Jobs over captured calls.

A call row has ``capture_id, page_url, pos, method, raw_url, url_pattern, headers, body,
body_schema, response_schema, status, content_type``; jobs use only the columns they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import urls
from ..functions.expr import built_once, let
from ..functions.json_help import SECRET_FIELD_RLIKE, body_shape, scrub_body
from ..functions.rows import first_rows, ranked, unnest
from ..schema import WHOLE, Limits
from ..sources.captures import secret_name


@built_once
def actionable() -> Column:
    """Whether a call is worth keeping; a malformed address passes."""
    u = urls.parts_of("raw_url")
    noise = let(
        u,
        lambda p: F.coalesce(
            p["host"].rlike(fv.NOISY_HOST)
            | p["path"].rlike(fv.NOISY_PATH)
            | p["path"].rlike(fv.STATIC_ASSET),
            F.lit(False),
        ),
    )
    return (
        (F.upper(F.coalesce(F.col("method"), F.lit(""))) != "HEAD")
        & ~F.coalesce(F.col("content_type"), F.lit("")).rlike(fv.NOISY_CONTENT_TYPE)
        & ~noise
    )


def actionable_calls(calls: DataFrame) -> DataFrame:
    return calls.filter(actionable())


@built_once
def _templated_path() -> Column:
    return let(
        F.coalesce(urls.parts_of("raw_url")["path"], F.lit("/")), urls.template_path
    )


def with_templates(calls: DataFrame) -> DataFrame:
    return calls.withColumn("url_pattern", _templated_path())


def dedupe_calls(calls: DataFrame, scope: str = "capture_id") -> DataFrame:
    """First call per (scope, method, templated path); map tasks keep one row per key."""
    templated = calls if "url_pattern" in calls.columns else with_templates(calls)
    return first_rows(templated, [scope, "method", "url_pattern"], [F.col("pos")])


def rank_calls(
    calls: DataFrame, max_cross_site: int | None = None, max_calls: int | None = None
) -> DataFrame:
    """Same-site calls first, then cross-site ones, per capture; both lists can be bounded."""
    page_site = urls.registrable_domain(urls.parts_of("page_url")["host"])
    call_site = urls.registrable_domain(urls.parts_of("raw_url")["host"])
    marked = calls.withColumn(
        "cross_site", ~F.coalesce(page_site == call_site, F.lit(False))
    )
    if max_cross_site is not None:
        # either part alone can fill the list, so each is first cut to what it may contribute
        marked = ranked(marked, ["capture_id", "cross_site"], ["pos"], "part_rank", max_calls).filter(
            ~F.col("cross_site") | (F.col("part_rank") <= max_cross_site)
        ).drop("part_rank")
    return ranked(marked, ["capture_id"], ["cross_site", "pos"], "rank", max_calls)


def query_params(calls: DataFrame) -> DataFrame:
    """Distinct query parameters of each call, tracking keys marked."""
    keys = F.transform(
        urls.query_keys(F.coalesce(urls.parts_of("raw_url")["query"], F.lit(""))),
        lambda k, i: F.struct(
            i.cast("long").alias("key_pos"),
            k.alias("key"),
            (k.rlike(fv.TRACKING_PARAM) | (k == "_")).alias("tracking"),
        ),
    )
    return unnest(calls, ["capture_id", "pos"], keys, "key_pos")


def merge_site_network(
    calls: DataFrame, primary: Column, max_calls: int | None = None
) -> DataFrame:
    """Calls of all captures of a site behind those of its primary capture.

    ``calls`` carries ``site``; ``primary`` is true for rows of the primary capture.  Only rows
    from other captures are deduplicated against what comes before them.
    """
    ordered = calls.withColumn("secondary", ~primary)
    key = ["site", "method", "url_pattern"]
    order = [F.col("secondary"), F.col("capture_id"), F.col("pos")]
    own = ordered.filter(~F.col("secondary"))
    others = first_rows(ordered.filter("secondary"), key, order).join(
        own.select(*key).distinct(), key, "left_anti"
    )
    merged = own.unionByName(others)
    if max_calls is None:
        return merged
    # a primary capture holds at most max_calls itself; the rest fill the room it leaves
    return first_rows(merged, ["site"], order, n=max_calls)


def scrub_headers(headers: Column, limits: Limits = WHOLE) -> Column:
    """Header map without secrets, clamped to the limits in map order."""
    kept = F.map_filter(headers, lambda k, v: ~secret_name(k))
    entries = F.filter(F.map_entries(kept), lambda e: (F.length(e["key"]) > 0) & (F.length(e["key"]) <= 256))
    if limits.headers is not None:
        entries = F.slice(entries, 1, limits.headers)
    if limits.header_value is not None:
        entries = F.transform(
            entries,
            lambda e: F.struct(
                e["key"].alias("key"),
                F.substring(F.coalesce(e["value"], F.lit("")), 1, limits.header_value).alias("value"),
            ),
        )
    return F.map_from_entries(entries)


def scrub_calls(calls: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Calls without secrets: headers filtered, bodies typed and made safe to send again."""
    body = F.when(
        F.coalesce(F.col("body_type"), F.lit("application/json")).rlike("(?i)json"), F.col("body")
    )
    scrubbed = scrub_body(body)
    replay = F.col("_scrubbed.replay")
    if limits.request_body is not None:
        replay = F.when(F.length(replay) <= limits.request_body, replay)
    base = calls if "body_type" in calls.columns else calls.withColumn("body_type", F.lit(None).cast("string"))
    return (
        base.withColumn("_scrubbed", scrubbed)
        .withColumn("dropped_headers", F.filter(F.map_keys("headers"), secret_name))
        .withColumn("dropped_fields", F.coalesce(F.col("_scrubbed.dropped"), F.array().cast("array<string>")))
        .withColumn("headers", scrub_headers(F.col("headers"), limits))
        .withColumn("body_schema", F.col("_scrubbed.shape"))
        .withColumn("body", replay)
        .drop("_scrubbed", "body_type")
    )


def scrub_audit(scrubbed: DataFrame) -> DataFrame:
    """How often each secret key was dropped."""
    def marked(keys: str, place: str) -> Column:
        return F.transform(
            F.col(keys), lambda k: F.struct(F.lit(place).alias("place"), F.lower(k).alias("key"))
        )

    both = F.concat(marked("dropped_headers", "header"), marked("dropped_fields", "body"))
    return unnest(scrubbed, [], both, "key").groupBy("place", "key").agg(
        F.count(F.lit(1)).alias("calls")
    )


def secret_query_key(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(fv.SECRET_QUERY_NAMES) | name.rlike(SECRET_FIELD_RLIKE)


def clean_query(query: Column) -> Column:
    """Query without secret parameters, with its ``?``, or '' when nothing is left."""
    return let(
        urls.encode_query(F.filter(urls.query_pairs(query), lambda p: ~secret_query_key(p["name"]))),
        lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def strip_secret_query(calls: DataFrame) -> DataFrame:
    """Calls with ``clean_url`` and the list of dropped parameter names."""
    return (
        calls.withColumn("_u", urls.parts_of("raw_url"))
        .withColumn("_q", F.coalesce(F.col("_u.query"), F.lit("")))
        .withColumn(
            "clean_url", F.concat(F.col("_u.origin"), F.col("_u.path"), clean_query(F.col("_q")))
        )
        .withColumn("dropped_keys", F.filter(urls.query_keys(F.col("_q")), secret_query_key))
        .drop("_u", "_q")
    )


def dropped_query_keys(calls: DataFrame) -> DataFrame:
    """How often each secret parameter was dropped, per call site."""
    stripped = strip_secret_query(calls)
    site = urls.registrable_domain(urls.parts_of("raw_url")["host"])
    keys = F.transform(F.col("dropped_keys"), lambda k: F.struct(F.lower(k).alias("key")))
    return unnest(stripped, [site.alias("site")], keys, "key").groupBy("site", "key").agg(
        F.count(F.lit(1)).alias("calls")
    )


_JSON_TYPES = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
}


def call_schemas(calls: DataFrame, body: str = "body", keep: tuple[str, ...] = ("capture_id", "pos")) -> DataFrame:
    """Top-level keys and types of JSON object bodies, one row per key."""
    parsed = calls.select(F.struct(*keep).alias("_row"), F.try_parse_json(F.col(body)).alias("_v")).filter(
        F.schema_of_variant("_v").startswith("OBJECT")
    )
    exploded = calls.sparkSession.tvf.variant_explode(F.col("_v").outer())
    rows = parsed.lateralJoin(exploded).select(
        "_row.*", "key", F.schema_of_variant("value").alias("raw_type")
    )
    head = F.regexp_extract("raw_type", "^[A-Z]+", 0)
    named = F.when(F.lit(False), "")
    for variant_type, json_type in _JSON_TYPES.items():
        named = named.when(head == variant_type, json_type)
    return rows.select(*keep, "key", named.otherwise("number").alias("type"))


def endpoint_schemas(calls: DataFrame, body: str = "body") -> DataFrame:
    """Types seen per endpoint and key; the type set has at most six members."""
    typed = call_schemas(calls, body, ("method", "url_pattern"))
    return typed.groupBy("method", "url_pattern", "key").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.count(F.lit(1)).alias("calls")
    )


def body_schemas(calls: DataFrame, body: str = "body") -> DataFrame:
    """Schema text of each body, keys in document order."""
    return calls.withColumn("body_schema", body_shape(F.col(body)))


def best_capture(captures: DataFrame, score: Column, keys: list[str] | None = None) -> DataFrame:
    """The highest-scoring capture of each page."""
    return first_rows(captures.withColumn("score", score), keys or ["url"], [F.desc("score"), F.col("capture_id")])
