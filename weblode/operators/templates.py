"""Endpoint templates mined by grouping links and URL inventories.

Every grouping pre-aggregates in the map tasks and groups on the template, never on the page
or host alone, so a host with a third of all URLs spreads over its templates; nothing larger
than a report's few rows per key is ever collected.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import urls
from ..functions.expr import built_once, let
from ..functions.rows import first_rows, ranked, unnest
from ..schema import WHOLE, Limits
from .pages import current_page_query, is_search_name, page_facts, product_segment


def _replace_at(segs: Column, at: Column, param: Column) -> Column:
    filled = F.transform(
        segs, lambda s, i: F.when(i == at, F.concat(F.lit("{"), param, F.lit("}"))).otherwise(s)
    )
    return F.concat(F.lit("/"), F.array_join(filled, "/"))


def _template(name: Column, pattern: Column, param: Column, confidence: float) -> Column:
    return F.struct(
        name.alias("name"),
        pattern.alias("url_pattern"),
        param.alias("param_name"),
        F.lit(confidence).alias("confidence"),
    )


def _product_template(segs: Column) -> Column:
    def build(at: Column) -> Column:
        segment = F.lower(F.get(segs, at))
        param = F.when(segment == "dp", "asin").otherwise("id")
        name = F.when(
            (segment == "dp") | F.contains(segment, F.lit("product")), "get_product_page"
        ).otherwise("get_item_page")
        return F.when(at.isNotNull(), _template(name, _replace_at(segs, at + 1, param), param, 0.58))

    return let(product_segment(segs), build)


def _slug_template(segs: Column) -> Column:
    places = F.filter(
        F.transform(segs, lambda s, i: F.when(s.rlike(fv.SLUG_ID_SEGMENT), i)),
        lambda i: i.isNotNull(),
    )
    in_category = F.exists(segs, lambda s: F.lower(s) == "category")
    return let(
        F.array_min(places),
        lambda at: F.when(
            at.isNotNull() & ~in_category,
            _template(
                F.lit("get_product_page"), _replace_at(segs, at, F.lit("id")), F.lit("id"), 0.55
            ),
        ),
    )


def _entity_template(segs: Column) -> Column:
    places = F.filter(
        F.transform(
            segs,
            lambda s, i: F.when(
                F.lower(s).isin(list(fv.ENTITY_SEGMENTS)) & (i < F.size(segs) - 1), i
            ),
        ),
        lambda i: i.isNotNull(),
    )

    def build(at: Column) -> Column:
        segment = F.lower(F.get(segs, at))
        name, param = F.when(F.lit(False), ""), F.when(F.lit(False), "")
        for entity, (tool, key) in fv.ENTITY_SEGMENTS.items():
            name, param = name.when(segment == entity, tool), param.when(segment == entity, key)
        # a package name may itself hold slashes, so it takes the rest of the path
        used = F.when(segment == "package", F.slice(segs, F.lit(1), at + 2)).otherwise(segs)
        return F.when(at.isNotNull(), _template(name, _replace_at(used, at + 1, param), param, 0.56))

    return let(F.array_min(places), build)


@built_once
def detail_template() -> Column:
    """Template struct of the link in column ``href``: product, else slug id, else entity."""
    return let(
        urls.segments(urls.path_of(F.col("href"))),
        lambda segs: F.when(
            F.size(segs) > 0,
            F.coalesce(_product_template(segs), _slug_template(segs), _entity_template(segs)),
        ),
    )


def local_links(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Links that stay on the origin they are resolved against."""
    facts = page_facts(captures, "site", "links", limits=limits)
    origin = F.col("base.origin")
    kept = F.filter(F.col("links"), lambda a: origin.isNull() | (urls.origin_of(a["href"]) == origin))
    return unnest(
        facts, ["capture_id", "site", origin.alias("origin")], kept, "pos"
    )


def _scope(scope: str) -> list[str]:
    if scope not in ("capture", "site"):
        raise ValueError("scope is 'capture' or 'site'")
    return ["capture_id"] if scope == "capture" else ["site"]


def _seen(df: DataFrame, keys: list[str], pos: str, at: str) -> Column:
    """Order of a parameter's sightings as one number, which hash aggregation keeps the smallest of.

    Within a capture the two places fill a long; across captures an integer identifier goes before them.
    """
    places = F.shiftleft(F.col(pos).cast("long"), 31) + F.col(at)
    if "capture_id" in keys:
        return places
    if df.schema["capture_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return F.struct("capture_id", places.alias("places"))
    return F.col("capture_id").cast("decimal(19,0)") * F.lit(Decimal(1 << 62)) + places.cast("decimal(19,0)")


def detail_templates(
    captures: DataFrame,
    scope: str = "capture",
    min_links: int = 3,
    top: int | None = None,
    limits: Limits = WHOLE,
) -> DataFrame:
    """Repeated detail-page templates, strongest first."""
    keys = _scope(scope)
    typed = unnest(
        local_links(captures, limits),
        ["capture_id", "site", "pos", "href", "origin"],
        F.array_compact(F.array(detail_template())),
        "url_pattern",
    )
    seen = F.struct("capture_id", "pos")
    grouped = (
        typed.groupBy(*keys, "origin", "url_pattern", "param_name")
        .agg(
            F.count(F.lit(1)).alias("links"),
            F.min(seen).alias("first_seen"),
            F.min_by(F.struct("name", "confidence", "href"), seen).alias("first"),
        )
        .filter(F.col("links") >= min_links)
    )
    top = limits.detail_templates if top is None else top
    best = ranked(grouped, keys, [F.desc("links"), F.col("first_seen")], "rank", top)
    return best.select(
        *keys,
        "rank",
        F.col("first.name").alias("name"),
        "url_pattern",
        F.col("first.href").alias("raw_url"),
        "param_name",
        "links",
        F.col("first.confidence").alias("confidence"),
    )


def query_templates(
    captures: DataFrame,
    scope: str = "capture",
    top: int | None = None,
    max_params: int | None = None,
    limits: Limits = WHOLE,
) -> DataFrame:
    """Link groups on one path whose query parameters vary.

    "At least two distinct values" is tested as ``min < max`` of two 64-bit hashes, so no value set is kept and the
    sightings are added up by hash aggregation.  Pages are read once.
    """
    keys = _scope(scope)
    top = limits.query_groups if top is None else top
    max_params = limits.query_params if max_params is None else max_params
    links = local_links(captures, limits).filter(F.contains("href", F.lit("?")))
    params = F.transform(
        urls.first_values(urls.query_of(F.col("href"))),
        lambda p, i: F.struct(i.alias("at"), p["name"].alias("name"), p["value"].alias("value")),
    )
    path_key = F.concat(urls.origin_of(F.col("href")), urls.path_of(F.col("href")))
    exploded = unnest(
        links,
        ["capture_id", "site", "pos", path_key.alias("raw_url")],
        params,
        "at",
    )
    value = F.nullif(F.col("value"), F.lit(""))
    digests = [F.xxhash64(value), F.xxhash64(F.lit("b"), value)]
    varies = [F.min(F.when(value.isNotNull(), d)) < F.max(F.when(value.isNotNull(), d)) for d in digests]
    per_param = exploded.groupBy(*keys, "raw_url", "name").agg(
        F.min(_seen(exploded, keys, "pos", "at")).alias("seen"),
        (varies[0] | varies[1]).alias("varies"),
    )
    named = (
        per_param.withColumn("varies", F.coalesce("varies", F.lit(False)))
        .withColumn("is_search", is_search_name(F.col("name")))
        .withColumn("is_page", F.col("name").rlike(fv.PAGE_FIELD))
    )
    listed = F.col("varies") | F.col("is_search") | F.col("is_page")
    if max_params is not None:
        in_order = Window.partitionBy(*keys, "raw_url").orderBy(F.desc("listed"), "seen")
        named = named.withColumn("listed", listed).withColumn("place", F.row_number().over(in_order))
        listed = F.col("listed") & (F.col("place") <= max_params)
    # parameter names of one path: as many as its links spell out
    groups = (
        named.groupBy(*keys, "raw_url")
        .agg(
            F.min("seen").alias("first_seen"),
            F.bool_or("varies").alias("any_varies"),
            F.bool_or("is_search").alias("has_search"),
            F.bool_or("is_page").alias("has_page"),
            F.collect_list(F.when(listed, F.struct("seen", "name", "is_search"))).alias("params"),
        )
        .filter("any_varies")
        .withColumn(
            "params",
            F.transform(
                F.array_sort("params"),
                lambda p: F.struct(p["name"].alias("name"), p["is_search"].alias("required")),
            ),
        )
    )
    return ranked(groups, keys, ["first_seen"], "rank", top).select(
        *keys,
        "rank",
        F.when(F.col("has_search"), "search")
        .when(F.col("has_page"), "paginate_results")
        .otherwise("browse_listing")
        .alias("name"),
        urls.path_of(F.col("raw_url")).alias("url_pattern"),
        "raw_url",
        "params",
        F.when(F.col("has_search"), 0.62)
        .when(F.col("has_page"), 0.56)
        .otherwise(0.54)
        .alias("confidence"),
    )


def all_query_patterns(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Per capture: the pattern of the page's own address, then the mined groups."""
    own = current_page_query(captures, limits).select(
        "capture_id",
        F.lit(0).alias("rank"),
        "name",
        "url_pattern",
        "raw_url",
        "params",
        "confidence",
    )
    return own.unionByName(query_templates(captures, "capture", limits=limits))


@built_once
def _wildcards() -> Column:
    """Every position after the first as a parameter, when a word precedes it.

    A template is named by 128 bits of hashes, so that a long path does not leave the row once per position.
    """
    segs, origin = F.col("segs"), F.col("origin")

    def named(i: Column) -> Column:
        return let(
            F.array_join(F.transform(segs, lambda s, j: F.when(j == i, F.lit("*")).otherwise(s)), "/"),
            lambda text: F.struct(
                i.alias("at"),
                F.xxhash64(origin, i, text).alias("key_a"),
                F.xxhash64(F.lit("b"), text, i, origin).alias("key_b"),
                F.get(segs, i).alias("value"),
            ),
        )

    places = F.filter(
        F.sequence(F.lit(1), F.size(segs) - 1), lambda i: F.get(segs, i - 1).rlike("(?i)^[a-z]")
    )
    return F.when(F.size(segs) >= 2, F.transform(places, named))


def url_template_clusters(
    inventory: DataFrame,
    min_members: int = 8,
    max_templates: int | None = None,
    max_urls: int | None = None,
    scope: str = "origin",
) -> DataFrame:
    """Detail-page templates of a URL inventory ``(ord, url)``, per origin or per site.

    A position is a parameter when at least ``min_members`` distinct values occur there.  ``ord`` is never NULL.
    What is shuffled per URL is one value and two hashes a position; the address of a template's first member is
    fetched by a join, of surviving templates only.
    """
    def addresses(rows: DataFrame, *keep: str) -> DataFrame:
        # no filter on the parsed address: it would be pushed down and parse every URL again
        return rows.select("ord", *keep, urls.parts_of("url").alias("u")).select(
            "ord",
            *keep,
            (
                urls.registrable_domain(F.col("u.host")) if scope == "site" else F.col("u.origin")
            ).alias("origin"),
            F.col("u.origin").alias("raw_origin"),
            urls.segments(F.col("u.path")).alias("segs"),
        )

    parsed = addresses(inventory)
    if max_urls is not None:
        parsed = first_rows(parsed, ["origin"], [F.col("ord")], n=max_urls)
    wild = unnest(parsed, ["ord", "origin", "segs"], _wildcards(), "at").select("ord", "at", "key_a", "key_b", "value")
    key = ["key_a", "key_b"]
    # distinct values with the place each was first seen: partial aggregation, spread by value
    values = wild.groupBy(*key, "at", "value").agg(F.min("ord").alias("ord"))
    groups = (
        values.groupBy(*key, "at")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min(F.struct("ord", "value")).alias("first"),
            F.avg(F.when(urls.looks_like_id(F.col("value")), 1.0).otherwise(0.0)).alias("id_share"),
        )
        .filter(F.col("members") >= min_members)
        .select(*key, "at", "members", "id_share", "first.ord", F.col("first.value").alias("value"))
    )
    sampled = addresses(
        inventory.select("ord", "url").join(groups, "ord"), *key, "at", "members", "id_share", "value"
    )
    # an address may be listed twice under one place
    groups = sampled.filter(F.get("segs", F.col("at")) == F.col("value")).dropDuplicates(key).withColumn(
        "sample", F.struct("ord", F.get("segs", F.col("at") - 1).alias("entity"), "segs", "raw_origin", "value")
    )
    entity, example = F.col("sample.entity"), F.col("sample.value")
    noun = urls.snake_name(urls.singular(entity))
    named = (
        groups.filter((F.col("id_share") >= 0.5) | entity.rlike("(?i)^[a-z][a-z-]+s?$"))
        .withColumn("name", F.concat(F.lit("get_"), noun, F.lit("_page")))
        .withColumn(
            "param_name",
            F.when(urls.looks_like_id(example) | (noun == ""), "id").otherwise(noun),
        )
    )
    order = [F.desc("members"), F.col("sample.ord"), F.col("at")]
    best = first_rows(named, ["origin", "name"], order)
    top = ranked(best, ["origin"], order, "rank", max_templates)
    segs = F.col("sample.segs")
    return top.select(
        "origin",
        "rank",
        "name",
        _replace_at(segs, F.col("at"), F.col("param_name")).alias("url_pattern"),
        F.concat(F.col("sample.raw_origin"), F.lit("/"), F.array_join(segs, "/")).alias("raw_url"),
        "param_name",
        example.alias("example"),
        "members",
    )
