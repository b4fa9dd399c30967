"""Crawl frontier and address safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import built_once, head, keep_first, let
from ..functions.rows import first_rows, unnest
from ..sources.robots import robots_gate
from .pages import page_facts


@built_once
def _frontier_links(max_links: int | None) -> Column:
    """Clean same-origin addresses on the page in columns ``html`` and ``here``, in order."""
    root = F.concat(F.col("here.origin"), F.lit("/"))
    root_parts = urls.parts(root)

    def link(tag: Column, pos: Column) -> Column:
        raw = text.trim_ws(F.regexp_replace(tag, fv.FRONTIER_HREF + "$", "$1"))
        followed = (raw != "") & ~F.startswith(raw, F.lit("#")) & ~raw.rlike(fv.FRONTIER_SKIP_SCHEME)

        def clean(p: Column) -> Column:
            kept = (
                (p["origin"] == F.col("here.origin"))
                & ~p["path"].rlike(fv.FRONTIER_ASSET)
                & ~p["path"].rlike(text.ascii_words(fv.FRONTIER_AUTH))
            )
            return F.when(
                kept,
                F.struct(
                    page_key(p).alias("key"),
                    pos.cast("bigint").alias("pos"),
                    F.concat(p["origin"], p["path"]).alias("link"),
                ),
            )

        return let(F.when(followed, urls.resolve_parts(raw, root_parts)), clean)

    tags = F.regexp_extract_all("html", F.lit(fv.FRONTIER_HREF), F.lit(0))
    own = page_key(F.col("here"))
    fresh = F.filter(
        F.transform(tags, link), lambda x: x.isNotNull() & (x["key"] != root) & (x["key"] != own)
    )
    return head(keep_first(fresh), max_links)


def page_key(p: Column) -> Column:
    """Origin and path without trailing slash, so variants of one page collapse."""
    path = F.regexp_replace(p["path"], "/+$", "")
    return F.concat(p["origin"], F.when(path == "", F.lit("/")).otherwise(path))


def crawl_frontier(
    captures: DataFrame, known: DataFrame | None = None, max_links: int | None = None
) -> DataFrame:
    """Same-origin pages to visit next, per capture, in document order.

    ``known`` (``key``) holds pages already captured.
    """
    facts = page_facts(captures, "here")
    rows = unnest(
        facts, ["capture_id", F.col("here.origin").alias("origin")], _frontier_links(max_links), "pos"
    )
    if known is not None:
        rows = rows.join(known.select("key").distinct(), "key", "left_anti")
    return rows.select("capture_id", "origin", "pos", "key", F.col("link").alias("url"))


def crawl_plan(
    captures: DataFrame, robots: DataFrame | None = None, max_pages: int = 4
) -> DataFrame:
    """Pages of a crawl per capture: site root, the given page, then the frontier within budget."""
    if max_pages < 1:
        raise ValueError("a crawl visits at least one page")
    budget = max_pages
    here = page_facts(captures.select("capture_id", "url"), "here")
    start = here.select(
        "capture_id",
        F.inline_outer(
            F.array(
                F.struct(F.lit(0).alias("stage"), F.concat("here.origin", F.lit("/")).alias("page")),
                F.struct(F.lit(1).alias("stage"), F.col("url").alias("page")),
            )
        ),
        page_key(F.col("here")).alias("own_key"),
        F.concat("here.origin", F.lit("/")).alias("root_key"),
    )
    start = start.filter(
        F.col("page").isNotNull() & ((F.col("stage") == 0) | (F.col("own_key") != F.col("root_key")))
    ).select("capture_id", "stage", F.lit(0).cast("bigint").alias("pos"), F.col("page").alias("url"))
    # a capture can use at most `budget` frontier pages that robots allow
    found = crawl_frontier(captures).select("capture_id", F.lit(2).alias("stage"), "pos", "url")
    if robots is not None:
        found = robots_gate(found, robots).filter("robots_allowed").select(*start.columns)
    return first_rows(
        start.unionByName(found), ["capture_id"], [F.col("stage"), F.col("pos")], n=budget, rank_name="visit"
    )


def _ipv4_number(host: Column) -> Column:
    octets = F.split(host, r"\.")
    n = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.try_cast("bigint"))
    valid = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(octets, lambda o: o.try_cast("int") > 255)
    return F.when(valid, n)


def _in_private_range(number: Column) -> Column:
    def within(n: Column) -> Column:
        out = F.lit(False)
        for base, bits in fv.PRIVATE_IPV4:
            low = sum(int(octet) << shift for octet, shift in zip(base.split("."), (24, 16, 8, 0)))
            out = out | n.between(low, low + 2 ** (32 - bits) - 1)
        return out

    return let(number, within)


def private_address(host: Column) -> Column:
    """Whether a literal address is private, loopback or reserved; names are not."""

    def check(h: Column) -> Column:
        six = F.contains(h, F.lit(":"))
        mapped = F.regexp_extract(h, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
        hexed = F.regexp_extract_all(h, F.lit(r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"), F.lit(0))
        high = F.conv(F.regexp_extract(h, r"^::ffff:([0-9a-f]{1,4}):", 1), 16, 10).cast("bigint")
        low = F.conv(F.regexp_extract(h, r":([0-9a-f]{1,4})$", 1), 16, 10).cast("bigint")
        embedded = F.when(F.size(hexed) > 0, high * 65536 + low).otherwise(_ipv4_number(mapped))
        prefixed = F.lit(False)
        for prefix in fv.PRIVATE_IPV6_PREFIXES:
            prefixed = prefixed | F.startswith(h, F.lit(prefix))
        v6 = h.isin("::", "::1") | prefixed | F.coalesce(_in_private_range(embedded), F.lit(False))
        v4 = F.coalesce(_in_private_range(_ipv4_number(h)), F.lit(False))
        return F.when(six, v6).otherwise(v4)

    return let(F.lower(F.regexp_replace(host, r"^\[|\]$", "")), check)


@built_once
def public_target(column: str) -> Column:
    """Whether the URL in ``column`` is http(s) and not obviously private."""

    def check(p: Column) -> Column:
        host = p["host"]
        return (
            p.isNotNull()
            & (host != "localhost")
            & ~F.endswith(host, F.lit(".localhost"))
            & ~private_address(host)
        )

    return F.coalesce(let(urls.parts_of(column), check), F.lit(False))


def public_targets(df: DataFrame, column: str, resolved: DataFrame | None = None) -> DataFrame:
    """Rows whose URL is public.

    The address ranges are constants in the filter, so no join is needed for them.  ``resolved``
    (``host, address``) optionally adds looked-up addresses: a host with any private one is
    refused, and so is a host without an address.
    """
    kept = df.filter(public_target(column))
    if resolved is None:
        return kept
    safe = (
        resolved.groupBy("host")
        .agg(F.bool_or(private_address(F.col("address"))).alias("_private"))
        .filter(~F.col("_private"))
        .select(F.col("host").alias("_host"))
    )
    hosted = kept.withColumn("_host", urls.parts_of(column)["host"])
    return hosted.join(safe, "_host", "left_semi").drop("_host")
