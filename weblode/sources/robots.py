"""Robots rules and sitemaps, from tables of fetched bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import let
from ..functions.rows import first_rows, unnest


def _directive(block: Column, name: str) -> Column:
    return F.regexp_extract_all(block, F.lit(rf"(?im)^[^\S\n]*{name}[^\S\n]*:[^\S\n]*(\S+)"), F.lit(1))


def disallow_rules(body: Column) -> Column:
    """Distinct ``Disallow`` values that apply to every agent, in order.

    The body is cut at its ``User-agent`` lines; a block counts when the line that opens it
    names ``*``.  One robots file is one row, so no window over lines is needed.
    """
    lines = F.regexp_replace(F.regexp_replace(body, r"\r?\n", "\n"), r"(?m)#.*$", "")
    blocks = F.split(lines, r"(?im)^[^\S\n]*user-agent[^\S\n]*:(?=[^\S\n]*\S)", -1)

    def rules(block: Column) -> Column:
        agent = text.trim_ws(F.substring_index(block, "\n", 1))
        return F.when(agent == "*", _directive(block, "disallow")).otherwise(
            F.array().cast("array<string>")
        )

    started = let(blocks, lambda b: F.slice(b, F.lit(2), F.size(b)))
    return F.array_distinct(F.flatten(F.transform(started, rules)))


def sitemap_lines(body: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(body, r"\r?\n", "\n"), r"(?m)#.*$", "")
    return F.array_distinct(_directive(lines, "sitemap"))


def _numbered(values: Column, name: str) -> Column:
    return F.transform(
        values, lambda v, i: F.struct(i.cast("long").alias("pos"), v.alias(name))
    )


def read_robots(robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(origin, body)`` to (rules ``origin, pos, rule``; sitemaps ``origin, pos, sitemap_url``)."""
    rules = unnest(robots, ["origin"], _numbered(disallow_rules(F.col("body")), "rule"), "pos")
    maps = unnest(robots, ["origin"], _numbered(sitemap_lines(F.col("body")), "sitemap_url"), "pos")
    return rules, maps


def robots_policy(word: object) -> str | None:
    """Policy named by a loose word, or None when the word says nothing."""
    said = str("" if word is None else word).strip().lower()
    for policy, words in fv.ROBOTS_POLICY_WORDS.items():
        if said in words:
            return policy
    return None


def matching_rule(path: Column, rules: Column) -> Column:
    """First rule whose prefix covers ``path``; a rule that is only ``*`` covers nothing."""

    def covers(rule: Column) -> Column:
        return let(
            F.regexp_replace(rule, r"\*+$", ""), lambda p: (p != "") & F.startswith(path, p)
        )

    return F.get(F.filter(rules, covers), F.lit(0))


def robots_gate(
    targets: DataFrame, robots: DataFrame, url: str = "url", with_query: bool = True, policy: str = "respect"
) -> DataFrame:
    """Targets with ``robots_allowed`` and the rule that blocks them.

    Rules join as one row per origin, so each target meets one row and is never multiplied by
    the number of rules; a hot origin is only a skewed equi-join, which adaptive execution
    splits.  An origin without robots is allowed.
    """
    per_origin = first_rows(
        robots.select("origin", disallow_rules(F.col("body")).alias("_rules")),
        ["origin"],
        [F.col("_rules")],
    )
    u = urls.parts_of(url)
    placed = targets.withColumn("_u", u).withColumn("origin", F.col("_u.origin"))
    path = F.concat(F.col("_u.path"), F.col("_u.query")) if with_query else F.col("_u.path")
    joined = placed.join(per_origin, "origin", "left")
    rule = matching_rule(path, F.col("_rules"))
    if policy == "full":
        rule = F.lit(None).cast("string")
    return (
        joined.withColumn("disallow_rule", rule)
        .withColumn("robots_allowed", F.col("disallow_rule").isNull())
        .drop("_u", "_rules")
    )


def sitemap_locations(xml: Column) -> Column:
    """``<loc>`` values of a sitemap, CDATA and entities resolved."""
    found = F.regexp_extract_all(
        xml,
        F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"),
        F.lit(1),
    )
    decoded = F.transform(
        found, lambda loc: text.decode_entities(text.trim_ws(loc), skip=("&nbsp;",))
    )
    return F.filter(decoded, lambda loc: loc != "")


def read_sitemaps(
    sitemaps: DataFrame,
    max_sitemaps: int | None = None,
    max_urls: int | None = None,
) -> DataFrame:
    """``(origin, sitemap_url, xml)`` to page URLs; an index is expanded one level.

    The two bounds are the fetch budget of a live crawl and are off by default: over a table of
    bodies there is nothing to fetch.
    """
    located = unnest(
        sitemaps.withColumn("is_index", F.col("xml").rlike(r"(?i)<sitemapindex[\s>]")),
        ["origin", "sitemap_url", "is_index"],
        _numbered(sitemap_locations(F.col("xml")), "loc"),
        "pos",
    )
    children = located.filter("is_index")
    if max_sitemaps is not None:
        children = first_rows(
            children, ["origin"], [F.col("sitemap_url"), F.col("pos")], n=max_sitemaps
        )
    named = children.select("origin", F.col("loc").alias("sitemap_url")).distinct()
    listed = located.filter(~F.col("is_index"))
    indexed = named.withColumn("via_index", F.lit(True))
    out = listed.join(indexed, ["origin", "sitemap_url"], "left").select(
        "origin",
        "sitemap_url",
        F.coalesce("via_index", F.lit(False)).alias("via_index"),
        "pos",
        F.col("loc").alias("url"),
    )
    if max_urls is not None:
        out = first_rows(out, ["origin"], [F.col("sitemap_url"), F.col("pos")], n=max_urls)
    return out
