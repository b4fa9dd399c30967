"""Registered queries and their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions import fixed_values as fv
from weblode.functions import urls
from weblode.operators import (
    calls as calls_ops,
    candidates as cand,
    coverage,
    dedupe,
    frontier,
    health,
    pages,
    records,
    registry,
    requests,
    templates,
    verify,
)
from weblode.sources import candidates as cand_src
from weblode.sources import captures as cap_src
from weblode.sources import robots, sinks, specs
from weblode.schema import Limits
from weblode.sources.calls import read_network_log
from weblode.session import ensure_checkpoint_dir
from weblode.streaming import discovery, drift, failures

from . import inputs as inp
from . import sqltext as sq

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# ------------------------------------------------------------------ html pages: SQL twins
PAGE_PARTS = f"""
page_parts as (
  select page_id as capture_id, url, html, {sq.rendered('html')} as markup,
    regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin,
    regexp_extract(url, '^https?://([^/?#]+)', 1) as host
  from pages),
anchor_lists as (
  select *, regexp_extract_all(markup, '(?is)<a\\b[^>]*>.*?</a>') as l from page_parts),
anchors as (
  select capture_id, url, origin, host, i as pos, l[i + 1] as a
  from anchor_lists, unnest(range(len(l))) as t(i)),
hrefs as (
  select *, origin || {sq.encoded_path(sq.decode("regexp_extract(a, '(?is)^<a[^>]*?href=\"([^\"]*)\"', 1)"))} as href,
    {sq.clean("a")} as full_text
  from anchors),
links as (
  select capture_id, url, {sq.last_two('host')} as site, pos, href,
    full_text as text
  from hrefs where full_text <> ''
  qualify row_number() over (partition by capture_id, href order by pos) = 1)
"""


@query("page_profile", f"""
select page_id as capture_id, url,
  {sq.trim("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
  length(html) as html_length, length({sq.stripped('html')}) as text_length,
  sha256(html) as dom_hash, count(*) over (partition by html) as copies
from pages""")
def page_profile(spark, sf):
    return pages.page_profile(inp.page_captures(spark, sf)).select(
        "capture_id", "url", F.coalesce("title", F.lit("")).alias("title"), "html_length", "text_length",
        "dom_hash", "copies",
    )


@query("page_text_len", f"""
select page_id as capture_id, length({sq.clean(sq.sub(sq.sub(sq.sub('html', '(?is)<script.*?</script>', ' '), '(?is)<style.*?</style>', ' '), '(?is)<svg.*?</svg>', ' '))}) as sample_length,
  {sq.stripped('html')} as stripped
from pages""")
def page_text_len(spark, sf):
    return pages.page_text(inp.page_captures(spark, sf)).select(
        "capture_id", F.length("sample").alias("sample_length"), "stripped"
    )


@query("page_links", f"with {PAGE_PARTS} select * from links")
def page_links(spark, sf):
    return pages.page_links(inp.page_captures(spark, sf))


@query("link_host_rollup", f"""
with {PAGE_PARTS}
select regexp_extract(href, '^https?://([^/]+)', 1) as host, count(*) as links, count(distinct capture_id) as pages
from links group by 1""")
def link_host_rollup(spark, sf):
    return pages.link_host_rollup(inp.page_captures(spark, sf))


@query("current_page_query", """
select page_id as capture_id,
  case when url like '%?page=%' then 'paginate_results' else 'browse_listing' end as name,
  regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) as url_pattern,
  regexp_extract(url, '^([^?#]*)', 1) as raw_url,
  case when url like '%?page=%' then 'page,ref' else 'utm_source' end as params,
  case when url like '%?page=%' then 0.55 else 0.53 end as confidence
from pages where url like '%?%'""")
def current_page_query(spark, sf):
    return pages.current_page_query(inp.page_captures(spark, sf)).select(
        "capture_id", "name", "url_pattern", "raw_url",
        F.array_join(F.transform("params", lambda p: p["name"]), ",").alias("params"), "confidence",
    )


@query("crawl_frontier", rf"""
with raw as (
  select page_id as capture_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin,
    regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') as own_path,
    regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1) as l
  from pages),
each as (
  select capture_id, origin, own_path, i as pos, {sq.encoded_path('trim(l[i + 1])')} as path
  from raw, unnest(range(len(l))) as t(i)),
kept as (
  select *, origin || regexp_replace(path, '/+$', '') as key from each
  where path like '/%' and not regexp_matches(path, {sq.lit(fv.FRONTIER_ASSET)})
    and not regexp_matches(path, {sq.lit(fv.FRONTIER_AUTH)})
    and regexp_replace(path, '/+$', '') not in ('', own_path))
select capture_id, origin, pos, key, origin || path as url from kept
qualify row_number() over (partition by capture_id, key order by pos) = 1""")
def crawl_frontier(spark, sf):
    return frontier.crawl_frontier(inp.page_captures(spark, sf))


@query("url_template_clusters", f"""
with u as (
  select page_id as ord, regexp_extract(url, '^https?://([^/?#]+)', 1) as host,
    regexp_extract(url, '^(https?://[^/?#]+)', 1) as raw_origin,
    list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') as segs
  from pages),
w as (
  select {sq.last_two('host')} as origin, raw_origin, ord, segs, len(segs) as depth, i as place,
    segs[i] as entity, segs[i + 1] as value,
    array_to_string(list_transform(segs, lambda s, j: case when j = i + 1 then '*' else s end), '/') as template
  from u, unnest(range(1, len(segs))) as t(i)
  where len(segs) >= 2 and regexp_matches(segs[i], '^[a-zA-Z]')),
v as (
  select origin, depth, place, template, value, min(ord) as ord, arg_min(entity, ord) as entity,
    arg_min(segs, ord) as segs, arg_min(raw_origin, ord) as raw_origin
  from w group by all),
r as (select *,
  regexp_matches(value, '^\\d+$') or regexp_matches(value, '(?i)^[0-9a-f]{{12,}}$')
    or regexp_matches(value, '(?i)^[a-z0-9][a-z0-9-]*[-_]\\d+$') as id_like from v),
g as (
  select origin, depth, place, template, count(*) as members, min(ord) as ord, arg_min(entity, ord) as entity,
    arg_min(value, ord) as example, arg_min(segs, ord) as segs, arg_min(raw_origin, ord) as raw_origin,
    arg_min(id_like, ord) as example_id, avg(case when id_like then 1.0 else 0.0 end) as share
  from r group by all having count(*) >= 8),
n as (
  select *, regexp_replace(lower(regexp_replace(entity, '(?i)s$', '')), '[^a-z0-9]+', '_', 'g') as noun from g
  where share >= 0.5 or regexp_matches(entity, '(?i)^[a-z][a-z-]+s?$')),
p as (select *, 'get_' || noun || '_page' as name, case when example_id then 'id' else noun end as param_name from n),
b as (select * from p qualify row_number() over (partition by origin, name order by members desc, ord) = 1)
select origin, row_number() over (partition by origin order by members desc, ord) as rank, name,
  '/' || array_to_string(list_transform(segs, lambda s, j: case when j = place + 1 then '{{' || param_name || '}}' else s end), '/') as url_pattern,
  raw_origin || '/' || array_to_string(segs, '/') as raw_url, param_name, example, members
from b""")
def url_template_clusters(spark, sf):
    inventory = inp.page_captures(spark, sf).select(F.col("capture_id").alias("ord"), "url")
    return templates.url_template_clusters(inventory, scope="site")


@query("page_duplicates", """
select sha256(html) as dom_hash, count(*) as copies, min(page_id) as first_page from pages group by html having count(*) > 1""")
def page_duplicates(spark, sf):
    captures = inp.page_captures(spark, sf)
    return captures.groupBy("dom_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min("capture_id").alias("first_page")
    ).filter("copies > 1")


# ------------------------------------------------------------------ shop pages: SQL twins
SHOP = """
shop as (
  select replace(p_brand, 'Brand#', '') || '-' || cast(p_partkey // 200 as varchar) as capture_id, *
  from part)
"""


@query("detail_templates", f"""
with {SHOP}, found as (
  select capture_id, '/products/{{id}}' as url_pattern, 'id' as param_name, 'get_product_page' as name,
    0.58 as confidence, count(*) as links,
    arg_min('https://shop.shopsite.net/products/' || p_partkey || '?page=' || (p_partkey % 3) || '&size=' || p_size, p_partkey) as raw_url,
    0 as seen
  from shop group by capture_id
  union all
  select capture_id, '/author/{{author}}', 'author', 'get_author_page', 0.56, count(distinct p_size),
    arg_min('https://shop.shopsite.net/author/' || p_size, p_partkey), 1
  from shop group by capture_id)
select capture_id, row_number() over (partition by capture_id order by links desc, seen) as rank, name,
  url_pattern, raw_url, param_name, links, confidence
from found where links >= 3""")
def detail_templates(spark, sf):
    return templates.detail_templates(inp.shop_pages(spark, sf))


@query("detail_templates_by_site", """
with found as (
  select '/products/{id}' as url_pattern, 'id' as param_name, 'get_product_page' as name, 0.58 as confidence, count(*) as links
  from part
  union all
  select '/author/{author}', 'author', 'get_author_page', 0.56, count(distinct (p_brand, p_partkey // 200, p_size)) from part)
select 'shopsite.net' as site, row_number() over (order by links desc) as rank, name, url_pattern, param_name, links, confidence
from found where links >= 3""")
def detail_templates_by_site(spark, sf):
    return templates.detail_templates(inp.shop_pages(spark, sf), scope="site").drop("raw_url")


@query("query_templates", f"""
with {SHOP}, g as (
  select capture_id, count(distinct p_partkey % 3) as pages, count(distinct p_size % 2) as sorts from shop group by 1)
select capture_id, 1 as rank, 'paginate_results' as name, '/list' as url_pattern,
  'https://shop.shopsite.net/list' as raw_url, case when sorts > 1 then 'page,sort' else 'page' end as params, 0.56 as confidence
from g where pages > 1 or sorts > 1""")
def query_templates(spark, sf):
    return templates.query_templates(inp.shop_pages(spark, sf)).withColumn(
        "params", F.array_join(F.transform("params", lambda p: p["name"]), ",")
    )


@query("page_forms", f"""
with {SHOP}, c as (select distinct capture_id from shop)
select capture_id, 0 as pos, 'GET' as method, 'https://shop.shopsite.net/search' as action, 'search' as purpose, 2 as n_fields from c
union all
select capture_id, 1, 'POST', 'https://shop.shopsite.net/login', 'auth', 2 from c""")
def page_forms(spark, sf):
    return pages.page_forms(inp.shop_pages(spark, sf)).select(
        "capture_id", "pos", "method", "action", "purpose", F.size("fields").alias("n_fields")
    )


@query("form_fields", f"""
with {SHOP}, c as (select distinct capture_id from shop)
select capture_id, f.form_pos, f.pos, f.name, f.type, f.placeholder, f.required from c,
  (values (0, 0, 'q', 'text', 'Find it', true), (0, 1, 'sort', 'select', '', false),
          (1, 0, 'user', 'text', '', true), (1, 1, 'pass', 'password', '', false))
  as f(form_pos, pos, name, type, placeholder, required)""")
def form_fields(spark, sf):
    return pages.form_fields(inp.shop_pages(spark, sf)).withColumn(
        "placeholder", F.coalesce("placeholder", F.lit(""))
    )


@query("page_buttons", f"""
with {SHOP}, c as (select distinct capture_id from shop)
select capture_id, b.pos, b.label from c, (values (0, 'Add to cart'), (1, 'Go now')) as b(pos, label)""")
def page_buttons(spark, sf):
    return pages.page_buttons(inp.shop_pages(spark, sf))


@query("redactions_by_site", f"""
with {SHOP} select 'shopsite.net' as site, count(distinct capture_id) as pages,
  count(distinct capture_id) as pages_redacted, count(distinct capture_id) as inputs_redacted from shop""")
def redactions_by_site(spark, sf):
    return pages.redactions_by_site(inp.shop_pages(spark, sf))


@query("page_kinds", f"""
with {SHOP}, g as (select capture_id, count(*) as n, min(p_partkey // 200) as block from shop group by 1)
select capture_id, case when n >= 2 then 'searchable,product_listing,commerce' else 'searchable,commerce' end as kinds from g""")
def page_kinds(spark, sf):
    return pages.page_kinds(inp.shop_pages(spark, sf)).select(
        "capture_id", F.array_join("kinds", ",").alias("kinds")
    )


@query("form_candidates", f"""
with {SHOP} select distinct capture_id, 'search' as name, 'GET' as method, '/search' as url_pattern,
  'q:query:true,sort:query:false' as params, 0.54 as confidence from shop""")
def form_candidates(spark, sf):
    return cand.form_candidates(inp.shop_pages(spark, sf)).select(
        "capture_id", "name", "method", "url_pattern", _params_text(), "confidence"
    )


def _params_text():
    return F.array_join(
        F.transform(
            "params",
            lambda p: F.concat_ws(":", p["name"], p["place"], p["required"].cast("string")),
        ),
        ",",
    ).alias("params")


SHOP_MATERIAL = f"""
{SHOP}, counts as (
  select capture_id, count(*) as items, count(distinct p_size) as authors, count(distinct p_partkey % 3) as pages,
    count(distinct p_size % 2) as sorts, min(replace(p_brand, 'Brand#', '')) as brand, min(p_partkey) as first_key,
    arg_min('https://shop.shopsite.net/products/' || p_partkey || '?page=' || (p_partkey % 3) || '&size=' || p_size, p_partkey) as item_url,
    arg_min('https://shop.shopsite.net/author/' || p_size, p_partkey) as author_url
  from shop group by 1),
material as (
  select capture_id, 'query' as source, 0 as pos, 'paginate_results' as name, '/brand/' || brand as url_pattern,
    'https://shop.shopsite.net/brand/' || brand as raw_url, 'page:query:false' as params, 0.55 as confidence from counts
  union all
  select capture_id, 'query', 1, 'paginate_results', '/list', 'https://shop.shopsite.net/list',
    case when sorts > 1 then 'page:query:false,sort:query:false' else 'page:query:false' end, 0.56 from counts where pages > 1 or sorts > 1
  union all
  select capture_id, 'detail', 1, 'get_product_page', '/products/{{id}}', item_url, 'id:path:true', 0.58 from counts where items >= 3
  union all
  select capture_id, 'detail', case when items >= 3 then 2 else 1 end, 'get_author_page', '/author/{{author}}', author_url, 'author:path:true', 0.56
  from counts where authors >= 3)
"""


@query("link_candidates", f"with {SHOP_MATERIAL} select * from material")
def link_candidates(spark, sf):
    return cand.link_candidates(pages.mine(inp.shop_pages(spark, sf))).select(
        "capture_id", "source", "pos", "name", "url_pattern", "raw_url", _params_text(), "confidence"
    )


@query("page_capabilities", f"""
with {SHOP}, g as (select capture_id, count(*) as n, count(distinct p_size) as authors from shop group by 1),
c as (
  select capture_id, 0 as o, 'extract_page_metadata' as capability, 0.56 as confidence from g
  union all select capture_id, 1, 'list_page_items', 0.6 from g where n >= 2 or authors >= 3
  union all select capture_id, 2, 'get_product_details', 0.66 from g where n >= 3)
select capture_id, row_number() over (partition by capture_id order by o) - 1 as pos, capability, confidence from c""")
def page_capabilities(spark, sf):
    return cand.page_capabilities(pages.mine(inp.shop_pages(spark, sf))).select(
        "capture_id", "pos", "capability", "confidence"
    )


@query("capability_candidates", """
with c(name, inputs, steps) as (values
  ('extract_page_metadata', '', 'navigate,waitFor,extract'),
  ('search_travel_options', 'origin:true,destination:true,depart_date:false', 'navigate,fill,fill,selectOption,click,waitFor,extract'),
  ('search_in_browser', 'q:true', 'navigate,fill,pressKey,waitFor,extract'),
  ('go_to_next_page', '', 'click,waitFor,extract'),
  ('add_to_cart', '', 'click,waitFor,extract'),
  ('open_cart', '', 'click,waitFor,extract'))
select page_id as capture_id, name, inputs, steps, 'kept' as status from pages, c
where name not in ('add_to_cart', 'search_travel_options') or (name = 'add_to_cart' and page_id % 2 = 0)
  or (name = 'search_travel_options' and page_id % 3 = 0)""")
def capability_candidates(spark, sf):
    found = cand.capability_candidates(inp.snapshot_pages(spark, sf))
    checked = dedupe.validate_candidates(found)
    return checked.select(
        "capture_id", "name",
        F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["required"].cast("string"))), ",").alias("inputs"),
        F.array_join(F.transform("steps", lambda s: s["action"]), ",").alias("steps"), "status",
    )


@query("capability_shares", f"""
with {SHOP}, g as (select capture_id, count(*) as n, count(distinct p_size) as authors from shop group by 1),
c as (
  select 'extract_page_metadata' as capability, 0.56 as confidence, true as offered from g
  union all select 'list_page_items', 0.6, n >= 2 or authors >= 3 from g
  union all select 'get_product_details', 0.66, n >= 3 from g)
select 'shopsite.net' as site, capability, count(*) filter (where offered) as offering, round(avg(confidence) filter (where offered), 9) as confidence,
  count(*) as pages, round(count(*) filter (where offered) / count(*), 9) as share from c group by capability""")
def capability_shares(spark, sf):
    shares = cand.capability_shares(pages.mine(inp.shop_pages(spark, sf)))
    return shares.withColumn("share", F.round("share", 9)).withColumn("confidence", F.round("confidence", 9))


# ------------------------------------------------------------------ product pages
@query("jsonld_types", """
select cast(p_partkey as varchar) as capture_id, 'shopsite.net' as site, t.pos, t.type from part,
  (values (0, 'Product'), (1, 'Thing'), (2, 'Brand'), (3, 'WebSite'), (4, 'SearchAction')) as t(pos, type)""")
def jsonld_types(spark, sf):
    return pages.jsonld_types(inp.product_pages(spark, sf))


@query("search_actions", """
select cast(p_partkey as varchar) as capture_id, 0 as pos, 'search' as name, '/find' as url_pattern,
  'https://shop.shopsite.net/find?term=&x=1' as raw_url, 'term' as query_param, 0.66 as confidence from part""")
def search_actions(spark, sf):
    return pages.search_actions(inp.product_pages(spark, sf))


@query("product_records", """
select cast(p_partkey as varchar) as capture_id, 'https://shop.shopsite.net/product/' || p_partkey as url, p_name as title,
  'S' || p_partkey as sku, printf('%.2f', p_retailprice) as price, 'EUR' as currency, 'InStock' as availability,
  '' as rating, p_brand as brand from part""")
def product_records(spark, sf):
    return records.product_records(inp.product_pages(spark, sf)).drop("review_count", "images")


@query("listing_records", """
select cast(p_partkey as varchar) as capture_id, 0 as pos, 'Next one' as title,
  'https://shop.shopsite.net/item/' || (p_partkey + 1) as url, '$' || printf('%.2f', p_retailprice) as price, '4.5/5' as rating
from part""")
def listing_records(spark, sf):
    return records.listing_records(inp.product_pages(spark, sf))


@query("card_records", """
select cast(s_nationkey as varchar) as capture_id, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as pos, s_name as title,
  case when s_suppkey % 3 = 0 then 'https://n' || s_nationkey || '.shopsite.net/list' else 'https://n' || s_nationkey || '.shopsite.net/s/' || s_suppkey end as url,
  '$' || printf('%.2f', abs(s_acctbal)) as price, case when s_suppkey % 2 = 0 then '4.' || (s_suppkey % 10) || ' stars' else '' end as rating
from supplier""")
def card_records(spark, sf):
    """A page per nation, with a card per supplier, some without a link and some with a rating."""
    return records.card_records(inp.card_pages(spark, sf), "quote", guard=False).select("capture_id", "pos", "title", "url", "price", "rating")


@query("metadata_records", f"""
with {PAGE_PARTS}
select capture_id, count(*) as n_links, min(case when pos = 0 then text end) as first_link from links group by 1""")
def metadata_records(spark, sf):
    return records.metadata_records(inp.page_captures(spark, sf), guard=False).select(
        "capture_id", F.size("links").cast("bigint").alias("n_links"), F.get("links", F.lit(0))["text"].alias("first_link")
    )


# ------------------------------------------------------------------ document pages: quality flags
DOCS = f"""
docs as (
  select *, {sq.stripped('html')} as shown, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title
  from ({inp.doc_pages_sql()}) d)
"""


@query("capture_health", f"""
with {DOCS}, f as (
  select page_id as capture_id, length(shown) as text_length,
    regexp_matches(title, {sq.lit(fv.RENDERED_WALL)}) or regexp_matches(html, {sq.lit(fv.RENDERED_WALL)}) as wall,
    regexp_matches(html, {sq.lit(fv.STATIC_WALL)}) as static_wall,
    length(shown) < 6000 and regexp_matches(shown, {sq.lit(fv.AUTH_WALL_TEXT)}) as login_wall
  from docs)
select capture_id, text_length, wall or text_length < 500 as looks_blocked, login_wall, wall or login_wall as needs_human,
  static_wall, text_length - case when wall or text_length < 500 then 1000000 else 0 end as score
from f""")
def capture_health(spark, sf):
    return health.capture_health(inp.document_pages(spark, sf)).select(
        "capture_id", "text_length", "looks_blocked", "login_wall", "needs_human", "static_wall", "score"
    )


@query("render_need_by_site", f"""
with {DOCS}
select 'textsite.net' as site, count(*) as pages, count(*) filter (where {' or '.join(f"contains(lower(html), '{m}')" for m in fv.NAVIGATION_WALL)}) as need_render
from docs""")
def render_need_by_site(spark, sf):
    return health.render_need_by_site(inp.document_pages(spark, sf))


@query("privacy_withhold", rf"""
with {DOCS}, f as (
  select page_id as capture_id, url, title, {sq.stripped(sq.sub('html', '(?is)<head.*?</head>', ' '))} as body from docs)
select capture_id, url, 'page' as kind, 'Sensitive URL' as label from f where regexp_matches(url, {sq.lit(fv.SENSITIVE_PATH)})
union all
select capture_id, url, 'page', 'Sensitive title' from f where regexp_matches(title, {sq.lit(fv.SENSITIVE_TEXT)})
union all
select capture_id, url, 'text', 'Sensitive page text' from f
where regexp_matches(body, {sq.lit(fv.SENSITIVE_TEXT)}) or regexp_matches(body, {sq.lit(fv.LONG_DIGITS)})""")
def privacy_withhold(spark, sf):
    return health.privacy_withhold(inp.document_pages(spark, sf))


@query("gate_status", f"""
with nav as (
  select conv_id, turn, 'https://app.chatsite.net/thread/' || conv_id as requested_url,
    case when role = 'user' then 'https://app.chatsite.net/thread/' || conv_id || '/' else 'https://app.chatsite.net/login?next=1' end as landed_url,
    lower(text || ' ' || role) as hay, turn % 2 = 0 as has_password from conversations),
m as (select *, list_filter([{', '.join(sq.lit(x) for x in fv.NAVIGATION_WALL)}], lambda x: contains(hay, x))[1] as marker,
  regexp_matches(landed_url, {sq.lit(fv.LOGIN_LANDING_URL)}) or {' or '.join(f"contains(hay, '{m}')" for m in fv.LOGIN_TEXT)} as login,
  landed_url like '%login%' as away from nav)
select conv_id, turn, case when marker is not null then 'captcha' when login and (away or has_password) then 'auth' else 'ok' end as kind,
  case when marker is not null then 'anti-bot challenge page (' || marker || ')' when login and away then 'redirected to a sign-in page'
    when login and has_password then 'this page requires sign-in' else '' end as reason
from m""")
def gate_status(spark, sf):
    c = inp.table(spark, sf, "conversations")
    page = F.concat(F.lit("https://app.chatsite.net/thread/"), F.col("conv_id").cast("string"))
    nav = c.select(
        "conv_id",
        "turn",
        page.alias("requested_url"),
        F.when(F.col("role") == "user", F.concat(page, F.lit("/")))
        .otherwise("https://app.chatsite.net/login?next=1")
        .alias("landed_url"),
        F.col("role").alias("title"),
        "text",
        (F.col("turn") % 2 == 0).alias("has_password"),
        F.lit(False).alias("has_challenge"),
    )
    return health.gate_status(nav).select("conv_id", "turn", "kind", "reason")


# ------------------------------------------------------------------ robots and sitemaps
@query("robots_rules", rf"""
with l as (
  select origin, i as line_no, trim(regexp_replace(ls[i + 1], '#.*$', '')) as line
  from (select origin, regexp_split_to_array(body, '\r?\n') as ls from ({inp.robots_sql()}) r), unnest(range(len(ls))) as t(i)),
a as (select *, last_value(nullif(regexp_extract(line, '(?i)^user-agent\s*:\s*(.+)$', 1), '') ignore nulls)
  over (partition by origin order by line_no rows unbounded preceding) as agent from l),
d as (select origin, line_no, regexp_extract(line, '(?i)^disallow\s*:\s*(\S+)', 1) as rule from a where agent = '*'),
f as (select origin, rule, min(line_no) as line_no from d where rule <> '' group by 1, 2)
select origin, row_number() over (partition by origin order by line_no) - 1 as pos, rule from f""")
def robots_rules(spark, sf):
    return robots.read_robots(inp.robots_files(spark, sf))[0]


@query("robots_gate", f"""
with r as (select origin, '/' || regexp_extract(body, 'Disallow: /([a-z]+)/\\d', 1) || '/' || (length(origin) % 10) as p from ({inp.robots_sql()}) x),
u as (select page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) as path from pages)
select page_id, url, case when starts_with(path, p) then p || '*' when starts_with(path, '/fr/') then '/fr/' else '' end as disallow_rule,
  not (starts_with(path, p) or starts_with(path, '/fr/')) as robots_allowed
from u join r using (origin)""")
def robots_gate(spark, sf):
    targets = inp.table(spark, sf, "pages").select("page_id", "url")
    return robots.robots_gate(targets, inp.robots_files(spark, sf)).select(
        "page_id", "url", F.coalesce("disallow_rule", F.lit("")).alias("disallow_rule"), "robots_allowed"
    )


@query("sitemap_urls", f"""
with s as ({inp.sitemaps_sql()}), m as (select * from s where sitemap_url like '%/maps/%'),
idx as (select distinct regexp_extract(xml, '<loc>(.*?)</loc>', 1) as sitemap_url from s where sitemap_url like '%/index/%')
select m.origin, m.sitemap_url, idx.sitemap_url is not null as via_index, l.pos,
  case when l.pos = 0 then regexp_extract(xml, 'CDATA\\[(.*?)\\]', 1) else regexp_extract(xml, 'CDATA\\[(.*?)\\]', 1) || '&copy=1' end as url
from m left join idx using (sitemap_url), (values (0), (1)) as l(pos)""")
def sitemap_urls(spark, sf):
    return robots.read_sitemaps(inp.sitemap_files(spark, sf))


@query("sitemap_candidates")
def sitemap_candidates(spark, sf):
    found = robots.read_sitemaps(inp.sitemap_files(spark, sf)).select(F.xxhash64("url").alias("ord"), "url")
    return cand.sitemap_candidates(
        templates.url_template_clusters(found, min_members=3, scope="site")
    ).select("capture_id", "pos", "name", "url_pattern", "description", _params_text(), "confidence")


# ------------------------------------------------------------------ API descriptions
@query("openapi_operations", """
with o as (
  select 'https://c' || c_custkey || '.apisite.net' as origin, '/v' || c_nationkey as v, lower(c_mktsegment) as seg, c_name from customer)
select origin, 0 as pos, 'get_one' as name, 'Read ' || c_name as description, 'GET' as method, v || '/' || seg || '/{id}' as url_pattern,
  origin || v || '/' || seg || '/{id}' as raw_url, 'id:path:true' as params, 0.85 as confidence from o
union all
select origin, 1, 'get_one_2', 'DELETE /' || seg || '/{id}', 'DELETE', v || '/' || seg || '/{id}', origin || v || '/' || seg || '/{id}', 'id:path:true', 0.85 from o
union all
select origin, 2, 'post_all', 'POST /all', 'POST', v || '/all', origin || v || '/all', 'page_no:query:false,z:body:false,a:body:true', 0.85 from o""")
def openapi_operations(spark, sf):
    return specs.read_api_specs(inp.api_specs(spark, sf)).select(
        "origin", "pos", "name", "description", "method", "url_pattern", "raw_url", _params_text(), "confidence"
    )


def _fetched(spark, sf):
    docs = inp.api_specs(spark, sf)
    return (
        docs.select("origin", F.lit("/swagger.json").alias("path"), F.lit("not json").alias("body"))
        .unionByName(docs.select("origin", F.lit("/v1/openapi.json").alias("path"), F.col("doc").alias("body")))
        .unionByName(docs.select("origin", F.lit("/api-docs").alias("path"), F.replace("doc", F.lit("3.0.1"), F.lit("3.1.0")).alias("body")))
        .unionByName(docs.select("origin", F.lit("/gql").alias("path"), F.lit("GraphiQL").alias("body")))
        .unionByName(docs.select("origin", F.lit("/api/graphql").alias("path"), F.lit('{"data":null,"errors":[]}').alias("body")))
    )


@query("first_spec_per_origin", f"""
select origin, '/api-docs' as path, replace(doc, '3.0.1', '3.1.0') as doc from ({inp.SPECS_SQL.format(str='varchar')}) s""")
def first_spec_per_origin(spark, sf):
    return specs.first_spec_per_origin(_fetched(spark, sf))


@query("graphql_endpoints", """
select 'https://c' || c_custkey || '.apisite.net' as origin, 'graphql_query' as name, 'POST' as method, '/api/graphql' as url_pattern,
  'https://c' || c_custkey || '.apisite.net/api/graphql' as raw_url, 0.7 as confidence from customer""")
def graphql_endpoints(spark, sf):
    return specs.graphql_endpoints(_fetched(spark, sf)).drop("params")


# ------------------------------------------------------------------ calls
CALLS = f"""
calls as (select *, regexp_extract(raw_url, '^https?://([^/?#]+)', 1) as host,
    regexp_extract(raw_url, '^https?://[^/?#]+([^?#]*)', 1) as path from ({inp.calls_sql()}) c),
templated as (select *, regexp_replace(path, '/\\d+(/|$)', '/{{id}}\\1') as url_pattern from calls),
useful as (select * from templated where method <> 'HEAD' and not regexp_matches(host, {sq.lit(fv.NOISY_HOST)})
  and not regexp_matches(path, {sq.lit(fv.NOISY_PATH)}) and not regexp_matches(path, {sq.lit(fv.STATIC_ASSET)})
  and not regexp_matches(content_type, {sq.lit(fv.NOISY_CONTENT_TYPE)})),
firsts as (select * from useful qualify row_number() over (partition by capture_id, method, url_pattern order by pos) = 1)
"""


def _useful_calls(spark, sf):
    return calls_ops.with_templates(calls_ops.actionable_calls(inp.call_log(spark, sf)))


@query("actionable_calls", f"with {CALLS} select pos, capture_id, method, raw_url from useful")
def actionable_calls(spark, sf):
    return calls_ops.actionable_calls(inp.call_log(spark, sf)).select("pos", "capture_id", "method", "raw_url")


@query("calls_dedup", f"with {CALLS} select pos, capture_id, method, url_pattern, raw_url from firsts")
def calls_dedup(spark, sf):
    return calls_ops.dedupe_calls(_useful_calls(spark, sf)).select(
        "pos", "capture_id", "method", "url_pattern", "raw_url"
    )


@query("calls_ranked", f"""
with {CALLS}, c as (select *, {sq.last_two('host')} <> 'shopsite.net' as cross_site from firsts)
select capture_id, pos, cross_site, row_number() over (partition by capture_id order by cross_site, pos) as rank from c""")
def calls_ranked(spark, sf):
    return calls_ops.rank_calls(calls_ops.dedupe_calls(_useful_calls(spark, sf))).select(
        "capture_id", "pos", "cross_site", "rank"
    )


@query("calls_ranked_contract", f"""
with {CALLS}, c as (select *, {sq.last_two('host')} <> 'shopsite.net' as cross_site from firsts),
p as (select *, row_number() over (partition by capture_id, cross_site order by pos) as pr from c)
select capture_id, pos, cross_site, row_number() over (partition by capture_id order by cross_site, pos) as rank
from p where not cross_site or pr <= 6 qualify rank <= 30""")
def calls_ranked_contract(spark, sf):
    bounds = Limits.contract()
    calls = calls_ops.dedupe_calls(_useful_calls(spark, sf))
    return calls_ops.rank_calls(calls, bounds.cross_site_calls, bounds.candidate_calls).select(
        "capture_id", "pos", "cross_site", "rank"
    )


@query("merge_site_network", f"""
with {CALLS}, s as (select *, capture_id % 2 = 1 as secondary, capture_id // 2 as site from firsts),
own as (select * from s where not secondary),
others as (select * from s where secondary and not exists (
    select 1 from own where own.site = s.site and own.method = s.method and own.url_pattern = s.url_pattern)
  qualify row_number() over (partition by site, method, url_pattern order by capture_id, pos) = 1)
select site, capture_id, pos, method, url_pattern from own union all select site, capture_id, pos, method, url_pattern from others""")
def merge_site_network(spark, sf):
    sited = calls_ops.dedupe_calls(_useful_calls(spark, sf)).withColumn(
        "site", F.floor(F.col("capture_id") / 2)
    )
    return calls_ops.merge_site_network(sited, F.col("capture_id") % 2 == 0).select(
        "site", "capture_id", "pos", "method", "url_pattern"
    )


@query("strip_secret_query", f"""
with {CALLS}
select pos, replace(raw_url, '&token=abc', '') as clean_url, case when raw_url like '%token=%' then 'token' else '' end as dropped from calls""")
def strip_secret_query(spark, sf):
    return calls_ops.strip_secret_query(inp.call_log(spark, sf)).select(
        "pos", "clean_url", F.array_join("dropped_keys", ",").alias("dropped")
    )


@query("dropped_query_keys", f"""
with {CALLS} select {sq.last_two('host')} as site, 'token' as key, count(*) as calls from calls where raw_url like '%token=%' group by 1""")
def dropped_query_keys(spark, sf):
    return calls_ops.dropped_query_keys(inp.call_log(spark, sf))


@query("query_params", f"""
with {CALLS}
select capture_id, pos, k.key_pos, k.key, k.key = 'utm_source' as tracking from calls,
  (values (0, 'page'), (1, 'utm_source'), (2, 'token')) as k(key_pos, key)
where k.key <> 'token' or raw_url like '%token=%'""")
def query_params(spark, sf):
    return calls_ops.query_params(inp.call_log(spark, sf))


def _private_sql(n: str) -> str:
    ranges = []
    for base, bits in fv.PRIVATE_IPV4:
        low = sum(int(o) << k for o, k in zip(base.split("."), (24, 16, 8, 0)))
        ranges.append(f"{n} between {low} and {low + 2 ** (32 - bits) - 1}")
    return "(" + " or ".join(ranges) + ")"


@query("public_targets", f"""
with a as (select event_id, cast(floor(value * 1000003) as bigint) * 7919 % 4294967296 as n from events),
u as (
  select event_id, n, 'http://' || (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) || '/' as url, true as ip from a
  union all select event_id, n, 'https://' || n || '/', true from a
  union all select event_id, 0, 'ftp://shopsite.net/', false from a
  union all select event_id, 0, 'http://x.localhost/', false from a
  union all select event_id, 1, 'http://h' || event_id || '.shopsite.net/', false from a)
select event_id, url from u where (ip and not {_private_sql('n')}) or (not ip and n = 1)""")
def public_targets(spark, sf):
    e = cap_src.spread_small(inp.table(spark, sf, "events")).select(
        "event_id",
        F.pmod(F.floor(F.col("value") * 1000003).cast("bigint") * 7919, F.lit(4294967296)).alias("n"),
    )
    octet = lambda k: F.shiftright("n", k).bitwiseAND(F.lit(255)).cast("string")
    address = F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))
    urls_ = F.array(
        F.concat(F.lit("http://"), address, F.lit("/")),
        F.concat(F.lit("https://"), F.col("n").cast("string"), F.lit("/")),
        F.lit("ftp://shopsite.net/"),
        F.lit("http://x.localhost/"),
        F.concat(F.lit("http://h"), F.col("event_id").cast("string"), F.lit(".shopsite.net/")),
    )
    return frontier.public_targets(e.select("event_id", F.explode(urls_).alias("url")), "url")


@query("scrub_headers", """
select event_id, 'Accept,X-Trace' as kept, case when event_type = 'click' then 'Authorization,x-session-id' else 'Authorization' end as dropped from events""")
def scrub_headers(spark, sf):
    headers = F.create_map(
        F.lit("Authorization"), F.lit("Bearer x"),
        F.lit("Accept"), F.lit("*/*"),
        F.lit("X-Trace"), F.col("props"),
    )
    extra = F.when(
        F.col("event_type") == "click", F.map_concat(headers, F.create_map(F.lit("x-session-id"), F.lit("1")))
    ).otherwise(headers)
    calls = inp.table(spark, sf, "events").select("event_id", extra.alias("headers"), F.lit(None).cast("string").alias("body"))
    out = calls_ops.scrub_calls(calls)
    return out.select(
        "event_id",
        F.array_join(F.map_keys("headers"), ",").alias("kept"),
        F.array_join("dropped_headers", ",").alias("dropped"),
    )


@query("scrub_audit", """
select 'body' as place, 'apitoken' as key, count(*) as calls from events union all
select 'header', 'cookie', count(*) from events""")
def scrub_audit(spark, sf):
    calls = inp.table(spark, sf, "events").select(
        F.create_map(F.lit("Cookie"), F.lit("x"), F.lit("Accept"), F.lit("y")).alias("headers"),
        F.concat(F.lit('{"a":[{"apiToken":"x"}],"b":'), F.col("props"), F.lit("}")).alias("body"),
    )
    return calls_ops.scrub_audit(calls_ops.scrub_calls(calls))


@query("call_schemas", "select event_id, k.key as key, k.type as type from events, (values ('k', 'number')) as k(key, type)")
def call_schemas(spark, sf):
    return calls_ops.call_schemas(inp.table(spark, sf, "events"), "props", ("event_id",))


@query("endpoint_schemas", f"""
with {CALLS} select method, url_pattern, 'k' as key, 'number' as types, count(*) as calls from templated group by 1, 2""")
def endpoint_schemas(spark, sf):
    calls = calls_ops.with_templates(inp.call_log(spark, sf))
    return calls_ops.endpoint_schemas(calls).withColumn("types", F.array_join("types", ","))


@query("network_log", f"""
with {CALLS}
select cast(capture_id as varchar) as capture_id, pos, method, raw_url, url_pattern,
  '{{"type":"object","properties":{{"k":{{"type":"number"}}}}}}' as response_schema from templated""")
def network_log(spark, sf):
    log = inp.call_log(spark, sf).select(
        F.col("capture_id").cast("string").alias("capture_id"), "pos", F.lower("method").alias("method"),
        F.col("raw_url").alias("url"),
        F.create_map(F.lit("Cookie"), F.lit("c")).alias("requestHeaders"),
        F.lit("application/json").alias("reqContentType"), F.col("body").alias("requestPostData"),
        F.lit(200).alias("status"), F.lit("application/json").alias("contentType"), F.col("body").alias("responseBody"),
    )
    return read_network_log(log).select("capture_id", "pos", "method", "raw_url", "url_pattern", "response_schema")


@query("json_select", """
select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as selected from events""")
def json_select(spark, sf):
    wrapped = inp.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"in":'), F.col("props"), F.lit(',"x":1}')).alias("body")
    )
    return requests.json_select(wrapped, F.lit("in.k, missing.z")).select("event_id", "selected")


@query("network_candidates", f"""
with {CALLS}, c as (select *, {sq.last_two('host')} <> 'shopsite.net' as cross_site from firsts),
r as (select *, row_number() over (partition by capture_id order by cross_site, pos) as rank from c)
select capture_id, rank as pos, lower(method) || '_' || event_type as name, method, url_pattern, 0.55 as confidence,
  'id:path:true,page:query:false' || case when raw_url like '%token=%' then ',token:query:false' else '' end as params
from r""")
def network_candidates(spark, sf):
    calls = calls_ops.dedupe_calls(_useful_calls(spark, sf)).withColumn("body_schema", F.lit(None).cast("string"))
    return cand.network_candidates(calls).select(
        "capture_id", "pos", "name", "method", "url_pattern", "confidence", _params_text()
    )


# ------------------------------------------------------------------ coverage
@query("coverage_delta", f"""
with {CALLS}, f as (select *, method || ' ' || url_pattern as sig, cast(capture_id as varchar) as site from useful),
old as (select distinct site, sig from f where ts < timestamp '2024-01-03'),
new as (select f.* from f where ts >= timestamp '2024-01-03' qualify row_number() over (partition by site, sig order by pos, capture_id) = 1)
select new.site, new.sig, new.pos, new.capture_id from new anti join old using (site, sig)""")
def coverage_delta(spark, sf):
    calls = _useful_calls(spark, sf).select(
        "*",
        F.col("capture_id").cast("string").alias("site"),
        urls.endpoint_signature(F.col("method"), F.col("url_pattern")).alias("sig"),
        F.lit(0).alias("source_rank"),
    )
    split = calls.withColumn("late", F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz"))
    known = split.filter("not late").select("site", F.lit("sig").alias("kind"), F.col("sig").alias("value")).distinct()
    return coverage.uncovered(split.filter("late"), known).select("site", "sig", "pos", "capture_id")


@query("coverage_of", f"""
with t as ({inp.tools_sql()})
select distinct site, 'name' as kind, name as value from t union
select distinct site, 'sig', case when kind = 'http' then method || ' /items/{{id}}' else 'GET /a' end from t""")
def coverage_of(spark, sf):
    return coverage.coverage_of(inp.tools(spark, sf))


@query("discovery_delta", f"with {SHOP_MATERIAL} select capture_id, source, pos, 'GET ' || url_pattern as sig from material")
def discovery_delta(spark, sf):
    mined = pages.mine(inp.shop_pages(spark, sf))
    known = coverage.coverage_of(inp.tools(spark, sf))
    return coverage.discovery_delta(mined, None, known)[0].select("capture_id", "source", "pos", "sig")


# ------------------------------------------------------------------ greedy dedupe
GREEDY = """
e as (select user_id as k, event_id as ord, event_type || '_' || (event_id % 9) as name, cast(floor(value / 3) as bigint) as sig,
  row_number() over (partition by user_id order by event_id) as rn from events),
r as (
  select distinct k, 0::bigint as rn, []::varchar[] as names, []::bigint[] as sigs, []::bigint[] as kept from e
  union all
  select r.k, e.rn, case when list_contains(names, name) or list_contains(sigs, sig) then names else list_append(names, name) end,
    case when list_contains(names, name) or list_contains(sigs, sig) then sigs else list_append(sigs, sig) end,
    case when list_contains(names, name) or list_contains(sigs, sig) then kept else list_append(kept, ord) end
  from r join e on e.k = r.k and e.rn = r.rn + 1),
last as (select * from r qualify row_number() over (partition by k order by rn desc) = 1)
"""


def _greedy_input(spark, sf):
    return inp.table(spark, sf, "events").select(
        F.col("user_id").alias("k"),
        F.col("event_id").alias("ord"),
        F.concat_ws("_", "event_type", (F.col("event_id") % 9).cast("string")).alias("name"),
        F.floor(F.col("value") / 3).cast("bigint").cast("string").alias("sig"),
    )


@query("greedy_dedupe", f"with recursive {GREEDY} select k, unnest(kept) as ord from last")
def greedy_dedupe(spark, sf):
    return dedupe.greedy_pairs(_greedy_input(spark, sf), ["k"])


def _candidate_rows(spark, sf):
    param = F.struct(
        F.col("sig").alias("name"), F.lit("query").alias("place"), F.lit("s").alias("key"),
        F.lit("string").alias("type"), F.lit(False).alias("required"),
    )
    return _greedy_input(spark, sf).select(
        F.col("k").alias("capture_id"), F.lit(0).alias("source_rank"), F.lit("network").alias("source"),
        F.col("ord").alias("pos"),
        F.when(F.col("ord") % 10 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"),
        F.lit("d").alias("description"), F.lit("http").alias("kind"), F.lit("GET").alias("method"),
        F.lit("/x").alias("url_pattern"), F.lit("https://a.net/x").alias("raw_url"),
        F.array(param).alias("params"),
        F.lit(None).cast("array<struct<action:string,role:string,selector:string,value:string>>").alias("steps"),
        F.lit(0.5).alias("confidence"),
    )


VALID = GREEDY.replace("from events)", "from events where event_id % 10 <> 0)")


@query("drop_counts", f"""
with recursive {VALID},
k as (select k, unnest(kept) as ord from last), n as (select e.k, e.name, e.ord as from_ord from e join k using (k, ord)),
s as (select e.k, e.ord, case when k.ord is not null then 'kept' when n.from_ord < e.ord then 'name' else 'signature' end as reason
  from e left join k using (k, ord) left join n on n.k = e.k and n.name = e.name
  union all select user_id, event_id, 'contract' from events where event_id % 10 = 0)
select k as capture_id, reason, count(*) as dropped from s where reason <> 'kept' group by all""")
def drop_counts(spark, sf):
    return dedupe.drop_counts(dedupe.validate_candidates(_candidate_rows(spark, sf)))


# ------------------------------------------------------------------ tools: confidence, verification, versions
@query("confidence", f"""
with t as ({inp.tools_sql()})
select server_id, round(avg(least(1, greatest(0, raw_confidence))), 9) as confidence from t group by 1""")
def confidence(spark, sf):
    tools = inp.tools(spark, sf).withColumn("confidence", F.col("raw_confidence"))
    return registry.aggregate_confidence(tools, key="server_id").withColumn("confidence", F.round("confidence", 9))


VERIFIED = f"""
t as ({inp.tools_sql()}), p as ({inp.probes_sql()}),
v as (
  select t.tool_id, t.server_id, least(1.0, greatest(0.0, t.raw_confidence)) as confidence,
    case when t.kind <> 'http' or t.method <> 'GET' or t.p_size = 1 then 'not_verifiable'
      when p.url is null then 'dead' when p.status >= 400 or p.status = 0 then 'dead'
      when contains(lower(p.body), 'just a moment...') then 'blocked'
      when trim(p.body) = '' and p.status <> 204 then 'dead' else 'verified' end as status,
    p.status as http_status
  from t left join p on p.url = t.raw_url)
"""


def _verified(spark, sf):
    newest = inp.table(spark, sf, "part").agg((F.max("p_partkey") + 1).cast("string").alias("value"))
    other = inp.table(spark, sf, "region").select(F.lower("r_name").alias("param"), F.col("r_name").alias("value"))
    fresh = newest.select(F.lit("id").alias("param"), "value").unionByName(other)
    return verify.verify_tools(inp.tools(spark, sf), inp.probes(spark, sf), fresh)


@query("verify_tools", f"""
with {VERIFIED} select tool_id, status, case when status = 'not_verifiable' then null else http_status end as http_status,
  status = 'verified' as generalized from v""")
def verify_tools(spark, sf):
    return _verified(spark, sf).select(
        "tool_id", "status", "http_status", F.coalesce("generalized", F.lit(False)).alias("generalized")
    )


@query("verify_repeated_probes", f"""
with t as ({inp.tools_sql()}), p as ({inp.probes_sql()}),
r as (select url, status, body, timestamp '2024-01-02' as seen from p where url like '%?alt%'
  union all select url, 500, 'old', timestamp '2024-01-01' from p union all select url, 503, 'older', timestamp '2023-01-01' from p),
n as (select * from r qualify row_number() over (partition by url order by seen desc) = 1)
select t.tool_id, case when t.kind <> 'http' or t.method <> 'GET' or t.p_size = 1 then 'not_verifiable'
    when n.url is null then 'dead' when n.status >= 400 or n.status = 0 then 'dead'
    when contains(lower(n.body), 'just a moment...') then 'blocked'
    when trim(n.body) = '' and n.status <> 204 then 'dead' else 'verified' end as status,
  case when t.kind <> 'http' then 'browser tool (no HTTP target)'
    when t.method <> 'GET' then 'non-idempotent method ' || t.method || ' (never replayed live)'
    when t.p_size = 1 then 'placeholder target (no captured value to verify)'
    when n.url is null then 'network error / timeout'
    when n.status >= 400 or n.status = 0 then 'HTTP ' || n.status
    when contains(lower(n.body), 'just a moment...') then 'anti-bot challenge in response'
    when trim(n.body) = '' and n.status <> 204 then 'empty body' end as reason
from t left join n on n.url = t.raw_url""")
def verify_repeated_probes(spark, sf):
    probes = inp.probes(spark, sf)
    when = lambda day: F.lit(day).cast("timestamp").alias("observed_at")
    older = [
        probes.select("url", F.lit(method).alias("method"), F.lit(code).alias("status"), F.lit(body).alias("body"), when(day))
        for method, code, body, day in (("get", 500, "old", "2024-01-01"), ("Get", 503, "older", "2023-01-01"))
    ]
    newest = probes.filter("url like '%?alt%'").select("url", "method", "status", "body", when("2024-01-02"))
    repeated = cand_src.read_probe_results(newest.unionByName(older[0]).unionByName(older[1]))
    return verify.verify_tools(inp.tools(spark, sf), repeated).select("tool_id", "status", "reason")


@query("verify_report", f"""
with {VERIFIED} select server_id, count(*) filter (where status = 'verified') as verified, count(*) filter (where status = 'dead') as dead,
  count(*) filter (where status = 'blocked') as blocked, count(*) filter (where status = 'not_verifiable') as not_verifiable,
  count(*) filter (where status = 'verified') as generalized from v group by 1""")
def verify_report(spark, sf):
    return verify.verify_report(_verified(spark, sf), "server_id")


@query("annotate", f"""
with {VERIFIED} select tool_id, round(case when status = 'verified' then greatest(confidence, 0.9)
  when status in ('dead', 'blocked') then least(confidence, 0.3) else confidence end, 9) as confidence from v""")
def annotate(spark, sf):
    return verify.annotate(inp.tools(spark, sf), _verified(spark, sf)).select(
        "tool_id", F.round("confidence", 9).alias("confidence")
    )


@query("keep_live", f"""
with {VERIFIED}, a as (select server_id from v group by 1 having count(*) filter (where status <> 'dead') = 0)
select tool_id, status from v where status <> 'dead' or server_id in (select server_id from a)""")
def keep_live(spark, sf):
    return verify.keep_live(_verified(spark, sf)).select("tool_id", "status")


@query("cleanup_tools", f"""
with t as ({inp.tools_sql()}), x as (select *, case when p_brand = 'Brand#1' then '/login' when p_brand = 'Brand#2' then '/health/x' else '/healthcare/x' end as pat from t)
select tool_id, case when kind = 'http' then '' else 'https://shop.shopsite.net/{{q}}' end as step from x
where kind <> 'http' or pat = '/healthcare/x'""")
def cleanup_tools(spark, sf):
    tools = inp.tools(spark, sf).withColumn(
        "url_pattern",
        F.when(F.col("p_brand") == "Brand#1", "/login").when(F.col("p_brand") == "Brand#2", "/health/x").otherwise("/healthcare/x"),
    )
    encoded = F.transform("steps", lambda s: s.withField("value", F.lit("https://shop.shopsite.net/%7Bq%7D")))
    tools = tools.withColumn("steps", encoded).withColumn("page_url", F.lit("https://shop.shopsite.net/"))
    return cand.cleanup_tools(tools).select(
        "tool_id", F.when(F.col("kind") == "http", "").otherwise(F.get("steps", F.lit(0))["value"]).alias("step")
    )


@query("write_share", f"""
with t as ({inp.tools_sql()}), w as (select site, kind = 'http' and (method = 'DELETE' or (method = 'POST' and p_type = 'SMALL')) as wr from t)
select site, count(*) as tools, count(*) filter (where wr) as writes, round(count(*) filter (where wr) / count(*), 9) as write_share from w group by 1""")
def write_share(spark, sf):
    return requests.write_share(inp.tools(spark, sf)).withColumn("write_share", F.round("write_share", 9))


@query("request_plan", f"""
with t as ({inp.tools_sql()})
select tool_id, method, 'https://api.shopsite.net/items/a%20' || tool_id || '?alt=xml' as url, kind = 'http' and method in ('DELETE', 'POST') as is_write,
  not (kind = 'http' and method in ('DELETE', 'POST')) as allowed, '{{"n":' || p_size || '}}' as body from t""")
def request_plan(spark, sf):
    extra = lambda name, place: F.struct(
        F.lit(name).alias("name"), F.lit(place).alias("place"), F.lit(name).alias("key"),
        F.lit("string").alias("type"), F.lit(False).alias("required"),
    )
    tools = inp.tools(spark, sf).withColumn("params", F.concat("params", F.array(extra("alt", "query"), extra("n", "body"))))
    args = tools.select(
        F.col("tool_id").alias("call_id"),
        "tool_id",
        F.create_map(
            F.lit("id"), F.concat(F.lit('"a '), F.col("tool_id").cast("string"), F.lit('"')),
            F.lit("alt"), F.lit('"xml"'),
            F.lit("n"), F.col("p_size").cast("string"),
        ).alias("args"),
    )
    return requests.request_plan(tools, args).select("tool_id", "method", "url", "is_write", "allowed", "body")


def _heals(spark, sf):
    return inp.tools(spark, sf).filter("p_size < 20").withColumn("failing_name", F.col("name")).withColumn(
        "name", F.when(F.col("p_size") < 5, F.lit("renamed")).otherwise(F.col("name"))
    ).withColumn("confidence", F.lit(0.99)).select("server_id", "failing_name", *_TOOL_COLUMNS)


_TOOL_COLUMNS = ["name", "description", "kind", "method", "url_pattern", "raw_url", "params", "steps", "confidence"]


@query("heal_replace", f"""
with t as ({inp.tools_sql()})
select server_id, name, p_size between 5 and 19 as healed,
  round(case when p_size between 5 and 19 then 0.99 else least(1.0, greatest(0.0, raw_confidence)) end, 9) as confidence from t""")
def heal_replace(spark, sf):
    tools = inp.tools(spark, sf).select("server_id", *_TOOL_COLUMNS)
    return registry.heal(tools, _heals(spark, sf)).select(
        "server_id", "name", "healed", F.round("confidence", 9).alias("confidence")
    )


@query("heal_outcomes", f"""
with t as ({inp.tools_sql()})
select server_id, name as failing_name, p_size >= 5 as healed, 3 + cast(p_size >= 5 as int) as version,
  case when p_size >= 5 then 'active' else 'degraded' end as status from t where p_size < 20""")
def heal_outcomes(spark, sf):
    tools = inp.tools(spark, sf).select("server_id", *_TOOL_COLUMNS)
    heals = _heals(spark, sf)
    versions = tools.select("server_id").distinct().withColumn("version", F.lit(3))
    return registry.heal_outcomes(heals, registry.heal(tools, heals), versions)


@query("next_version", """
with o as (select 'https://c' || o_custkey || '.net/' as url, o_orderkey as server_id, o_orderstatus from orders),
k as (select url, count(*) as known from o where o_orderstatus <> 'P' group by 1)
select o.url, o.server_id, coalesce(known, 0) + row_number() over (partition by o.url order by o.server_id) as version
from o left join k using (url) where o_orderstatus = 'P'""")
def next_version(spark, sf):
    o = inp.table(spark, sf, "orders").select(
        F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".net/")).alias("url"),
        F.col("o_orderkey").alias("server_id"),
        "o_orderstatus",
    )
    past = registry.next_versions(o.filter("o_orderstatus <> 'P'"), spark.createDataFrame([], "url string, version int"))
    return registry.next_versions(o.filter("o_orderstatus = 'P'"), past).select("url", "server_id", "version")


@query("current_versions", """
select o_custkey as server_id, max(o_orderkey) as version, arg_max(o_orderpriority, o_orderkey) as note from orders group by 1""")
def current_versions(spark, sf):
    v = inp.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("server_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("note")
    )
    return registry.current_versions(v)


@query("registry_status", """
select page_id as capture_id, case when l.n is null then 'broken' else 'active' end as status, coalesce(l.n, 0) as tool_count,
  case when l.n is null then 0.0 else 0.5 end as confidence
from pages left join (select l_orderkey as page_id, count(*) as n from lineitem group by 1) l using (page_id)""")
def registry_status(spark, sf):
    tools = inp.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("capture_id"), F.lit("http").alias("kind"), F.lit(0.5).alias("confidence")
    )
    return registry.registry_status(inp.page_captures(spark, sf), tools).select(
        "capture_id", "status", "tool_count", "confidence"
    )


@query("failures_of_tools", """
select event_id, user_id % 60 as server_id, event_type as tool_name from events
where event_type = 'error' and (user_id % 60) in (select s_suppkey from supplier)""")
def failures_of_tools(spark, sf):
    fails = inp.table(spark, sf, "events").filter("event_type = 'error'").select(
        "event_id", (F.col("user_id") % 60).alias("server_id"), F.col("event_type").alias("tool_name")
    )
    known = inp.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("server_id"), F.lit("error").alias("name"))
    return registry.failures_of_tools(fails, known)


@query("heal_requests", """
select 'self_heal' as kind, user_id % 60 as server_id, event_type as tool_name, count(*) as requests from events
where (user_id % 60) in (select s_suppkey from supplier) and event_type in ('error', 'view') group by all""")
def heal_requests(spark, sf):
    fails = inp.table(spark, sf, "events").select(
        (F.col("user_id") % 60).alias("server_id"), F.col("event_type").alias("tool_name"),
        F.lit("timeout").alias("error_class"), F.col("props").alias("detail"), F.col("ts").alias("observed_at"),
    )
    supplier = inp.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("server_id"))
    known = supplier.withColumn("name", F.explode(F.array(F.lit("error"), F.lit("view"))))
    return failures.heal_requests(fails, known).groupBy("kind", "server_id", "tool_name").agg(
        F.count(F.lit(1)).alias("requests")
    )


@query("registry_split", """
select c_custkey, case when c_acctbal < 0 then 'confidence' else 'sound' end as outcome from customer""")
def registry_split(spark, sf):
    entries = inp.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".net/")).alias("url"),
        F.col("c_name").alias("title"), F.lit("auto_gen").alias("tier"),
        F.when(F.col("c_acctbal") < 0, -1.0).otherwise(0.5).alias("confidence"), F.lit(0).alias("install_count"),
        F.lit("active").alias("status"), F.lit(1).alias("version"),
    )
    sound, refused = sinks.split_registry(entries)
    return sound.select("c_custkey", F.lit("sound").alias("outcome")).unionByName(
        refused.select("c_custkey", F.col("problem").alias("outcome"))
    )


# ------------------------------------------------------------------ contract, proposals, plans
@query("capture_contract", """
select page_id, case when page_id % 3 = 1 then 'secret_header' when page_id % 3 = 2 then 'legal_mode,rendered_with_js' else '' end as errors from pages""")
def capture_contract(spark, sf):
    p = inp.table(spark, sf, "pages")
    from weblode.schema import WIRE_CAPTURE

    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("page_id").cast("string"), 12, "0"))
    call = F.struct(
        F.lit("GET").alias("method"), F.lit("/a").alias("urlPattern"), F.lit("https://a.net/a").alias("rawUrl"),
        F.create_map(F.when(F.col("page_id") % 3 == 1, "Cookie").otherwise("Accept"), F.lit("x")).alias("requestHeaders"),
        F.lit(200).alias("statusCode"), F.lit("text/html").alias("contentType"),
    )
    bad = F.col("page_id") % 3 == 2
    wire = F.to_json(
        F.struct(
            uuid.alias("bundleId"), F.lit("scraper").alias("source"), "url",
            F.lit("2024-01-01T00:00:00Z").alias("capturedAt"),
            F.when(bad, "open").otherwise("safe").alias("legalMode"),
            F.struct("html", F.sha2("html", 256).alias("domHash")).alias("dom"),
            F.array(call).alias("network"),
            F.struct(F.when(~bad, True).alias("renderedWithJs")).alias("meta"),
        )
    )
    parsed = p.select(F.from_json(wire, WIRE_CAPTURE).alias("b")).select("b.*")
    accepted, rejected = cap_src.check_captures(parsed)
    number = lambda c: F.substring(c, 25, 12).cast("bigint").alias("page_id")
    return accepted.select(number(F.col("capture_id")), F.lit("").alias("errors")).unionByName(
        rejected.select(number(F.col("bundleId")), F.array_join("errors", ",").alias("errors"))
    )


@query("read_candidates", """
select event_id as capture_id, 0 as pos, event_type as name, 'GET' as method, '/p/{id}' as url_pattern, 'id:path:true' as params,
  0.25 as confidence from events where event_type <> 'error'""")
def read_candidates(spark, sf):
    raw = inp.table(spark, sf, "events").select(
        F.col("event_id").alias("capture_id"),
        F.when(F.col("event_type") == "error", F.lit("sorry, no tools")).otherwise(
            F.concat(
                F.lit('{"tools":[{"name":"'), F.col("event_type"),
                F.lit('","description":"d","confidence":0.25,"inputSchema":{"type":"object","properties":{"id":{"type":"string"}},"required":["id"]},'
                      '"execution":{"kind":"http","request":{"method":"GET","urlPattern":"/p/{id}","rawUrl":"https://a.net/p/1"},'
                      '"paramMapping":{"id":{"in":"path","key":"id"}}}}]}'),
            )
        ).alias("raw"),
    )
    return cand_src.read_candidates(raw).select(
        "capture_id", "pos", "name", "method", "url_pattern", _params_text(), "confidence"
    )


@query("recipe_candidates", """
select page_id as capture_id, 'search_example' as name, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/s' as raw_url, 0.7 as confidence
from pages where regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\\.)example\\.org$')""")
def recipe_candidates(spark, sf):
    recipes = [cand.Recipe(r"(^|\.)example\.org$", "search_example", "Search.", "/s", (("query", "query", "k", True),))]
    return cand.recipe_candidates(inp.page_captures(spark, sf), recipes).select(
        "capture_id", "name", "raw_url", "confidence"
    )


@query("content_candidates", """
select page_id as capture_id, 'fetch_page_content' as name, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as url_pattern, 0.5 as confidence from pages""")
def content_candidates(spark, sf):
    return cand.content_candidates(inp.page_captures(spark, sf)).select("capture_id", "name", "url_pattern", "confidence")


@query("payload_table", f"""
with {PAGE_PARTS} select capture_id, count(*) as links, any_value(length(p.html)) as dom_length,
  any_value({sq.trim("regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) as title
from links join page_parts p using (capture_id) group by 1""")
def payload_table(spark, sf):
    table = sinks.payload_table(inp.page_captures(spark, sf))
    listed = F.from_json(F.get_json_object("payload", "$.page_analysis.links"), "array<struct<href:string>>")
    return table.select(
        "capture_id", F.size(listed).cast("bigint").alias("links"),
        F.length(F.get_json_object("payload", "$.dom_sample")).alias("dom_length"),
        F.get_json_object("payload", "$.page_analysis.title").alias("title"),
    )


@query("infer_tools", f"""
with {SHOP_MATERIAL}
select capture_id, 'content' as source, 0 as pos, 'fetch_page_content' as name, 'http' as kind, '/brand/' || brand as url_pattern, 0.5 as confidence from counts
union all select capture_id, 'form', 0, 'search', 'http', '/search', 0.54 from counts
union all select capture_id, source, pos, name, 'http', url_pattern, confidence from material where source <> 'query' or pos = 0
union all select capture_id, 'capability', 0, 'extract_page_metadata', 'browser', null, 0.56 from counts
union all select capture_id, 'capability', 1, 'list_page_items', 'browser', null, 0.6 from counts where items >= 2 or authors >= 3
union all select capture_id, 'capability', 2, 'get_product_details', 'browser', null, 0.66 from counts where items >= 3""")
def infer_tools(spark, sf):
    from weblode.plans.pipelines import infer_tools as run

    tools, _ = run(inp.shop_pages(spark, sf))
    return tools.select("capture_id", "source", "pos", "name", "kind", "url_pattern", "confidence")


# ------------------------------------------------------------------ crawl plan, best capture, streams
FRONTIER = ORACLES["crawl_frontier"]


@query("crawl_plan", f"""
with f as ({FRONTIER}), p as (
  select page_id as capture_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin,
    regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') as own_path from pages),
a as (
  select capture_id, 0 as stage, 0 as pos, origin || '/' as url from p
  union all select capture_id, 1, 0, url from p where own_path <> ''
  union all select capture_id, 2, pos, url from f)
select capture_id, url, row_number() over (partition by capture_id order by stage, pos) as visit from a qualify visit <= 4""")
def crawl_plan(spark, sf):
    return frontier.crawl_plan(inp.page_captures(spark, sf)).select("capture_id", "url", "visit")


@query("best_capture", """
select source as url, arg_max(doc_id, (n_chars, -doc_id)) as capture_id, max(n_chars) as score from documents group by 1""")
def best_capture(spark, sf):
    docs = inp.table(spark, sf, "documents").select(
        F.col("source").alias("url"), F.col("doc_id").alias("capture_id"), "n_chars"
    )
    return calls_ops.best_capture(docs, F.col("n_chars")).select("url", "capture_id", "score")


@query("probe_results", f"select url, 'GET' as method, status, body from ({inp.probes_sql()}) p")
def probe_results(spark, sf):
    probes = inp.probes(spark, sf).withColumn("method", F.lower("method"))
    return cand_src.read_probe_results(probes)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("stream_discovery", """
select 'shopsite.net' as site, 'GET /api/' || event_type || '/' || (event_id % 50) as sig, cast(arg_min(user_id, event_id) as varchar) as capture_id
from events group by 1, 2""")
def stream_discovery(spark, sf):
    schema = inp.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    folder = _scratch(spark, "discovery")

    def material(batch: DataFrame) -> DataFrame:
        return batch.select(
            F.lit("shopsite.net").alias("site"),
            urls.endpoint_signature(
                F.lit("GET"),
                F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), (F.col("event_id") % 50).cast("string")),
            ).alias("sig"),
            F.lit(0).alias("source_rank"),
            F.col("event_id").alias("pos"),
            F.col("user_id").alias("capture_id"),
            F.col("props").alias("payload"),
        )

    discovery.stream_discovery(stream, material, f"{folder}/table", f"{folder}/state").awaitTermination()
    return discovery.coverage_table(spark, f"{folder}/table").read().select("site", "sig", "capture_id")


@query("page_drift", """
with b as (select user_id, ts, event_id, event_type || cast(event_id % 3 as varchar) as h, ts >= timestamp '2024-01-15' as late from events),
n as (select user_id, late, arg_max(h, ts) as h from b group by 1, 2)
select 'https://u' || x.user_id || '.net/' as url, x.h as dom_hash, x.late as second,
  x.late and y.h is not null and y.h <> x.h as drifted
from n x left join n y on y.user_id = x.user_id and x.late and not y.late""")
def page_drift(spark, sf):
    folder = _scratch(spark, "drift")
    captures = inp.table(spark, sf, "events").select(
        F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".net/")).alias("url"),
        F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("dom_hash"),
        F.col("ts").cast("timestamp").alias("captured_at"),
    )
    late = F.col("captured_at") >= F.lit("2024-01-15").cast("timestamp")
    drift.drift_batch(captures.filter(~late), 0, folder)
    drift.drift_batch(captures.filter(late), 1, folder)
    return spark.read.parquet(folder).select("url", "dom_hash", (F.col("batch_id") == 1).alias("second"), "drifted")


def _drained(spark, folder: str, parts: list[DataFrame], start: Callable[[DataFrame], object]) -> None:
    """Write each part as files that arrive later, and run the stream after each, from its checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{folder}/in")).awaitTermination()


@query("stream_drift", """
with b as (select user_id, ts, event_type || cast(event_id % 3 as varchar) as h,
    case when ts < timestamp '2024-01-11' then 0 when ts < timestamp '2024-01-21' then 1 else 2 end as part from events),
n as (select user_id, part, arg_max(h, (epoch_us(ts), -ascii(h[1]))) as h, max(ts) as ts from b group by 1, 2)
select 'https://u' || x.user_id || '.net/' as url, x.part::bigint as batch_id, x.h as dom_hash,
  coalesce(lag(x.h) over (partition by x.user_id order by x.part) <> x.h, false) as drifted from n x""")
def stream_drift(spark, sf):
    captures = inp.table(spark, sf, "events").select(
        F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".net/")).alias("url"),
        F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("dom_hash"),
        F.col("ts").cast("timestamp").alias("captured_at"),
    )
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp")
    at = F.col("captured_at")
    parts = [captures.filter(at < day(11)), captures.filter((at >= day(11)) & (at < day(21))), captures.filter(at >= day(21))]
    folder = _scratch(spark, "drift-stream")
    _drained(spark, folder, parts, lambda s: drift.stream_drift(s, f"{folder}/hashes", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/hashes").select("url", F.col("batch_id").cast("bigint").alias("batch_id"), "dom_hash", "drifted")


@query("stream_heal_requests", """
select 'self_heal' as kind, user_id % 60 as server_id, event_type as tool_name, count(distinct user_id % 60) as requests from events
where (user_id % 60) in (select s_suppkey from supplier) and event_type in ('error', 'view') group by all""")
def stream_heal_requests(spark, sf):
    """Repeated failures give one request, and failures of long before, arriving last, give none."""
    fails = inp.table(spark, sf, "events").select(
        (F.col("user_id") % 60).alias("server_id"), F.col("event_type").alias("tool_name"),
        F.lit("timeout").alias("error_class"), F.col("props").alias("detail"), F.col("ts").cast("timestamp").alias("observed_at"),
    )
    known = inp.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("server_id")).withColumn(
        "name", F.explode(F.array(F.lit("error"), F.lit("view"), F.lit("purchase")))
    )
    middle = F.lit("2024-01-15").cast("timestamp")
    now = fails.filter("tool_name != 'purchase'")
    late = fails.filter("tool_name = 'purchase'").withColumn("observed_at", F.col("observed_at") - F.expr("interval 100 days"))
    parts = [now.filter(F.col("observed_at") < middle), now.filter(F.col("observed_at") >= middle).unionByName(late)]
    folder = _scratch(spark, "heal-stream")
    _drained(spark, folder, parts, lambda s: failures.stream_failures(s, known, f"{folder}/out", f"{folder}/state", delay="40 days"))
    return spark.read.parquet(f"{folder}/out").groupBy("kind", "server_id", "tool_name").agg(F.count(F.lit(1)).alias("requests"))


@query("append_registry", """
select 'https://c' || c_custkey || '.shop' || (c_custkey % 7) || '.net/' as url, 1 + (c_custkey % 3) % 2 as version,
  'shop' || (c_custkey % 7) || '.net' as site, case when c_acctbal < 0 then 'confidence' else 'sound' end as outcome, 1 as copies from customer""")
def append_registry(spark, sf):
    """Three batches, of which one is written twice."""
    entries = inp.table(spark, sf, "customer").select(
        F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".shop"), (F.col("c_custkey") % 7).cast("string"), F.lit(".net/")).alias("url"),
        F.col("c_name").alias("title"), F.lit("auto_gen").alias("tier"),
        F.when(F.col("c_acctbal") < 0, -1.0).otherwise(0.5).alias("confidence"), F.lit(0).alias("install_count"),
        F.lit("active").alias("status"), (1 + F.col("c_custkey") % 3 % 2).cast("int").alias("version"), (F.col("c_custkey") % 3).alias("batch"),
    )
    folder = _scratch(spark, "registry")
    for batch in (0, 1, 1, 2):
        table = sinks.append_registry(entries.filter(F.col("batch") == batch).drop("batch"), f"{folder}/t", f"{folder}/refused", batch)
    sound = table.read().select("url", "version", "site", F.lit("sound").alias("outcome"))
    refused = spark.read.parquet(f"{folder}/refused").select(
        "url", "version", urls.registrable_domain(urls.parts_of("url")["host"]).alias("site"), F.col("problem").alias("outcome")
    )
    return sound.unionByName(refused).groupBy("url", "version", "site", "outcome").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("live_tools", """
select s_suppkey as server_id, 'tool_' || n as name, 1 + s_suppkey % 3 as version from supplier, range(3) r(n) where n < 2 or s_suppkey % 3 = 0""")
def live_tools(spark, sf):
    """Versions are written one after another; the tools of each server's highest one are live."""
    supplier = inp.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("server_id"))
    folder = _scratch(spark, "versions")
    for version in (1, 2, 3):
        names = F.sequence(F.lit(0), F.lit(2 if version == 1 else 1))
        tools = supplier.filter(F.col("server_id") % 3 >= version - 1).select(
            "server_id", F.explode(names).alias("n"), F.lit(version).alias("version")
        ).select("server_id", F.concat(F.lit("tool_"), F.col("n").cast("string")).alias("name"), "version")
        sinks.write_versions(tools, folder)
    return sinks.live_tools(spark.read.parquet(folder)).select("server_id", "name", F.col("version").cast("long").alias("version"))


# literals such as 0.58 are decimals in DuckDB; Spark's confidences are doubles
for _name in (
    "current_page_query", "detail_templates", "detail_templates_by_site", "query_templates",
    "form_candidates", "page_capabilities", "search_actions", "openapi_operations",
    "graphql_endpoints", "network_candidates", "registry_status", "read_candidates",
    "recipe_candidates", "content_candidates", "link_candidates", "capability_shares",
):
    ORACLES[_name] = (
        f"select * replace (cast(confidence as double) as confidence) from ({ORACLES[_name]}) q"
    )
