"""Inputs of the registered queries, derived by Spark from the given tables.

Each has a twin written as DuckDB SQL (the ``*_SQL`` texts), so a query and its check start
from the same rows and both grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.schema import WIRE_PAGE
from weblode.sources.captures import read_pages, spread_small


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- captures of the page table ---------------------------------------------------------------
def page_captures(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spread_small(table(spark, sf, "pages")))


# --- call log, one call per event -------------------------------------------------------------
CALLS_SQL = """
select event_id as pos, user_id as capture_id, ts,
  concat('https://www.shopsite.net/u/', cast(user_id as {str})) as page_url,
  case when event_type in ('purchase', 'signup') then 'POST'
       when event_type = 'error' then 'HEAD' else 'GET' end as method,
  concat('https://', case when event_id % 11 = 0 then 'www.google-analytics.com'
                          when event_id % 7 = 0 then 'cdn.other.net'
                          else 'api.shopsite.net' end,
    '/api/', event_type, '/', cast(event_id % 50 as {str}),
    case when event_id % 13 = 0 then '/app.js' else '' end,
    '?page=', cast(event_id % 5 as {str}), '&utm_source=x',
    case when event_id % 17 = 0 then '&token=abc' else '' end) as raw_url,
  case when event_id % 19 = 0 then 'video/mp4' else 'application/json' end as content_type,
  props as body, event_type
from events
"""


def call_log(spark: SparkSession, sf: str) -> DataFrame:
    spread_small(table(spark, sf, "events")).createOrReplaceTempView("events")
    return spark.sql(CALLS_SQL.format(str="string"))


def calls_sql() -> str:
    return CALLS_SQL.format(str="varchar")


# --- shop listing pages: parts of one brand and key range, so a page has at most 200 links ------
def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("block", F.floor(F.col("p_partkey") / 200))
    text = lambda c: F.col(c).cast("string")
    item = F.concat(
        F.lit("<a href='/products/"), text("p_partkey"),
        F.lit("?page="), (F.col("p_partkey") % 3).cast("string"), F.lit("&amp;size="), text("p_size"),
        F.lit("'>Item <b>"), F.col("p_name"), F.lit("</b></a><a href=\"/author/"), text("p_size"),
        F.lit("\">By "), text("p_size"), F.lit("</a><a href=\"http://cdn.other.net/x/"),
        text("p_partkey"), F.lit("\">off</a><a href='/list?page="),
        (F.col("p_partkey") % 3).cast("string"), F.lit("&amp;sort="), (F.col("p_size") % 2).cast("string"),
        F.lit("'>L</a>"),
    )
    tail = (
        "<form action='/search' method=get><input type=text name=q placeholder='Find it'>"
        "<input type=hidden name=h value=1><select name='sort'></select></form>"
        "<form method='POST' action=\"/login\"><input name=user required>"
        "<input type='password' name=pass value=\"s3cret\"></form>"
        "<button class=x>Add to cart</button><input type=submit value='Go now'>"
        "<button>ADD to Cart</button></body></html>"
    )
    pages = part.groupBy("p_brand", "block").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))),
                lambda r: r["item"],
            ),
            "",
        ).alias("items")
    )
    brand = F.regexp_replace("p_brand", "Brand#", "")
    block = F.col("block").cast("string")
    return read_pages(
        pages.select(
            F.concat(brand, F.lit("-"), block).alias("page_id"),
            F.concat(F.lit("https://shop.shopsite.net/brand/"), brand, F.lit("?page="), block).alias("url"),
            F.concat(
                F.lit("<html><head><title>Brand "), brand, F.lit("</title></head><body>"), F.col("items"),
                F.lit(tail),
            ).alias("html"),
        )
    )


# --- product pages with linked data, one per part ---------------------------------------------------
def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    price = F.format_string("%.2f", "p_retailprice")
    return read_pages(
        spread_small(table(spark, sf, "part")).select(
            text("p_partkey").alias("page_id"),
            F.concat(F.lit("https://shop.shopsite.net/product/"), text("p_partkey")).alias("url"),
            F.concat(
                F.lit("<html><head><title>"), F.col("p_name"),
                F.lit("</title><script type='application/ld+json'>[{\"@type\":[\"Product\",\"Thing\"],\"name\":\""),
                F.col("p_name"), F.lit("\",\"sku\":\"S"), text("p_partkey"), F.lit("\",\"brand\":{\"@type\":\"Brand\",\"name\":\""),
                F.col("p_brand"), F.lit("\"},\"offers\":[{\"price\":\""), price,
                F.lit("\",\"priceCurrency\":\"EUR\",\"availability\":\"https://schema.org/InStock\"}]},"
                      "{\"@type\":\"WebSite\",\"potentialAction\":{\"@type\":\"SearchAction\",\"target\":\"/find?term={q}&x=1\"}}]</script></head>"
                      "<body><h1>"),
                F.col("p_name"), F.lit("</h1><ul><li><a href='/item/"), (F.col("p_partkey") + 1).cast("string"),
                F.lit("'>Next one</a> costs $"), price, F.lit(" rated 4.5/5</li></ul></body></html>"),
            ).alias("html"),
        )
    )


def card_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per nation that lists its suppliers as cards."""
    key, text = F.col("s_suppkey"), lambda c: F.col(c).cast("string")
    link = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("<p><a class=more href='/s/"), text("s_suppkey"), F.lit("'>see <b>it</b></a>")))
    rating = F.when(key % 2 == 0, F.concat(F.lit("4."), (key % 10).cast("string"), F.lit(" stars</p>"))).otherwise("")
    card = F.concat(
        F.lit("<div data-i=1 class='wide quote x'><h3>"), F.col("s_name"), F.lit("</h3>"), link, F.lit(" for $"),
        F.format_string("%.2f", F.abs("s_acctbal")), F.lit("<br>"), rating, F.lit("</div><div class=quotes>no card $1</div>"),
    )
    of = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), card.alias("c")))).alias("cards"))
    return read_pages(of.select(
        text("s_nationkey").alias("page_id"),
        F.concat(F.lit("https://n"), text("s_nationkey"), F.lit(".shopsite.net/list")).alias("url"),
        F.concat(F.lit("<html><body><h1>All</h1>"), F.array_join("cards.c", "\n"), F.lit("</body></html>")).alias("html"),
    ))


# --- documents as plain pages -----------------------------------------------------------------------
DOC_PAGES_SQL = """
select doc_id as page_id, concat('https://docs.textsite.net/', source, '/', cast(doc_id as {str})) as url,
  concat('<html><head><title>', source, '</title></head><body><p>', text, '</p></body></html>') as html
from documents
"""


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    spread_small(table(spark, sf, "documents")).createOrReplaceTempView("documents")
    return read_pages(spark.sql(DOC_PAGES_SQL.format(str="string")))


def doc_pages_sql() -> str:
    return DOC_PAGES_SQL.format(str="varchar")


# --- robots files and sitemaps per page origin --------------------------------------------------------
ROBOTS_SQL = """
select origin, concat('User-agent: Bot', {nl}, 'Disallow: /en/', {nl}, 'User-agent: *', {nl},
  'Disallow: /', lang, '/', cast(length(origin) % 10 as {str}), '*  # part', {nl}, 'Disallow:', {nl},
  'Disallow: /fr/', {nl}, 'Sitemap: ', origin, '/sitemap.xml', {nl}, 'User-agent: other', {nl},
  'Disallow: /de/', {nl}) as body
from (select {extract}(url, '^(https?://[^/]+)', 1) as origin,
             min({extract}(url, '^https?://[^/]+/([a-z]+)', 1)) as lang
      from pages group by 1)
"""


def robots_files(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql(ROBOTS_SQL.format(str="string", nl="char(10)", extract="regexp_extract"))


def robots_sql() -> str:
    return ROBOTS_SQL.format(str="varchar", nl="chr(10)", extract="regexp_extract")


SITEMAPS_SQL = """
select {extract}(url, '^(https?://[^/]+)', 1) as origin,
  concat({extract}(url, '^(https?://[^/]+)', 1), '/maps/', cast(page_id as {str}), '.xml') as sitemap_url,
  concat('<urlset><url><loc> <![CDATA[', url, ']]> </loc></url><url><loc>', replace(url, '&', '&amp;'),
         '&amp;copy=1</loc></url></urlset>') as xml
from pages
union all
select {extract}(url, '^(https?://[^/]+)', 1),
  concat({extract}(url, '^(https?://[^/]+)', 1), '/index/', cast(page_id as {str}), '.xml'),
  concat('<sitemapindex xmlns="x"><sitemap><loc>', {extract}(url, '^(https?://[^/]+)', 1), '/maps/',
         cast(page_id as {str}), '.xml</loc></sitemap></sitemapindex>')
from pages where length(url) % 2 = 0
"""


def sitemap_files(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql(SITEMAPS_SQL.format(str="string", extract="regexp_extract"))


def sitemaps_sql() -> str:
    return SITEMAPS_SQL.format(str="varchar", extract="regexp_extract")


# --- API descriptions, one per customer ------------------------------------------------------------------
SPECS_SQL = """
select c_custkey, concat('https://c', cast(c_custkey as {str}), '.apisite.net') as origin,
  concat('{{"openapi":"3.0.1","servers":[{{"url":"/v', cast(c_nationkey as {str}), '/"}}],"paths":{{"/',
    lower(c_mktsegment), '/{{id}}":{{"parameters":[{{"name":"id","in":"path","schema":{{"type":"integer"}}}}],',
    '"get":{{"operationId":"getOne","summary":"Read ', c_name, '"}},"delete":{{"operationId":"getOne"}},',
    '"put":{{"deprecated":true}}}},"/all":{{"post":{{"parameters":[{{"name":"page-no","in":"query"}}],',
    '"requestBody":{{"content":{{"application/json":{{"schema":{{"properties":{{"z":{{"type":"number"}},',
    '"a":{{"type":"string"}}}},"required":["a"]}}}}}}}}}}}}}}}}') as doc
from customer
"""


def api_specs(spark: SparkSession, sf: str) -> DataFrame:
    spread_small(table(spark, sf, "customer")).createOrReplaceTempView("customer")
    return spark.sql(SPECS_SQL.format(str="string"))


# --- tools and probe results, one tool per part --------------------------------------------------------------
TOOLS_SQL = """
select p_partkey as tool_id, p_brand as server_id, 'shopsite.net' as site,
  concat('tool_', cast(p_partkey as {str})) as name,
  case when p_type = 'SMALL' then 'create one item' else 'read one item' end as description,
  case when p_size > 45 then 'browser' else 'http' end as kind,
  case when p_type = 'LARGE' then 'DELETE' when p_type = 'SMALL' then 'POST' else 'GET' end as method,
  '/items/{{id}}' as url_pattern,
  concat('https://api.shopsite.net/items/', case when p_size = 1 then '{{id}}' else cast(p_partkey as {str}) end,
         '?alt=json&token=t') as raw_url,
  (p_size - 5) / 40.0 as raw_confidence, p_size, p_brand, p_type, p_retailprice, p_partkey
from part
"""


def tools_sql() -> str:
    return TOOLS_SQL.format(str="varchar")


def tools(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "part").createOrReplaceTempView("part")
    param = F.struct(
        F.lit("id").alias("name"), F.lit("path").alias("place"), F.lit("id").alias("key"),
        F.lit("string").alias("type"), F.lit(True).alias("required"),
    )
    step = F.struct(
        F.lit("navigate").alias("action"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("selector"), F.lit("https://shop.shopsite.net/a?x=1").alias("value"),
    )
    return (
        spark.sql(TOOLS_SQL.format(str="string"))
        .withColumn("raw_confidence", F.col("raw_confidence").cast("double"))
        .withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw_confidence"))))
        .withColumn("params", F.array(param))
        .withColumn("steps", F.array(step))
    )


def snapshot_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page captures whose snapshot reports live forms and controls, which differ from page to page."""
    field = lambda name, kind, required, selector: F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("string").alias("placeholder"), F.lit(required).alias("required"), F.lit(selector).alias("selector"),
    )

    def form(purpose: str, submit: str | None, *fields) -> Column:
        return F.struct(
            F.lit("#f").alias("selector"), F.lit("GET").alias("method"), F.lit("/s").alias("action"),
            F.lit(purpose).alias("purpose"), F.lit("Go").alias("submitLabel"),
            F.lit(submit).cast("string").alias("submitSelector"), F.array(*fields).alias("fields"),
        )

    def control(label: str, selector: str | Column) -> Column:
        return F.struct(
            F.lit("button").alias("kind"), F.lit(label).alias("label"),
            (selector if isinstance(selector, Column) else F.lit(selector)).alias("selector"), F.lit(None).cast("string").alias("href"),
        )

    search = form("search", None, field("q", "text", True, "#q"))
    travel = form(
        "form", "#go", field("from", "text", True, "#a"), field("to", "text", True, "#b"), field("outbound", "select", False, "#c")
    )
    n = F.col("capture_id")
    page = F.struct(
        F.lit("").alias("visibleText"), F.array().cast("array<string>").alias("headings"),
        F.array(
            control("Show more", "#n"), control("View cart", "#cart"), control("Add to cart", F.when(n % 2 == 0, "#add").otherwise(""))
        ).alias("actions"),
        F.when(n % 3 == 0, F.array(travel, search)).otherwise(F.array(search)).alias("forms"),
        F.lit(None).cast(WIRE_PAGE["appState"].dataType).alias("appState"),
    )
    plain = page_captures(spark, sf).withColumn("html", F.lit("<p>plain</p>")).withColumn("url", F.concat(F.lit("https://plain.net/a"), n))
    return plain.withColumn("page", page.cast(WIRE_PAGE))


PROBES_SQL = """
select concat('https://api.shopsite.net/items/', cast(p_partkey as {str}), '?alt=json&token=t') as url, 'GET' as method,
  case when p_size < 10 then 404 when p_size < 12 then 0 when p_size < 14 then 204 when p_size < 18 then 302 else 200 end as status,
  case when p_size between 20 and 24 then 'Just a moment... ok' when p_size between 12 and 16 then '  ' else p_name end as body
from part where p_brand <> 'Brand#3'
union all
select concat('https://api.shopsite.net/items/', cast(max(p_partkey) + 1 as {str})), 'GET', 200, 'fresh' from part
"""


def probes(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(PROBES_SQL.format(str="string"))


def probes_sql() -> str:
    return PROBES_SQL.format(str="varchar")
