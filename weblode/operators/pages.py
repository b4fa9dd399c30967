"""Structure mining of captured pages.

``page_facts`` adds every mined part of a page as a column.  All of it is computed inside the
row that holds the html, so it is one narrow scan; a job that needs two parts selects two
columns and the optimizer drops the rest.  Html itself never leaves the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import built_once, cut, head, keep_first, let
from ..functions.json_help import read_linked_data
from ..functions.rows import unnest
from ..schema import WHOLE, Limits
from ..session import staged

_ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
_FORM = r"(?is)<form\b[^>]*>.*?</form>"
_FIELD = r"(?i)<(?:input|select|textarea)\b[^>]*>"
_BUTTON = (
    r"""(?is)<button\b[^>]*>.*?</button>"""
    r"""|<input\b[^>]*\btype\s*=\s*["']?(?:submit|button)["']?[^>]*>"""
)
_SCRIPT = r"(?is)<script\b[^>]*>.*?</script>"
_HEADING = r"(?is)<(h[1-3])\b[^>]*>.*?</\1\s*>"


def _all(doc: Column, pattern: str) -> Column:
    return F.regexp_extract_all(doc, F.lit(pattern), F.lit(0))


def _opening(element: Column) -> Column:
    return F.regexp_extract(element, r"(?is)^<[a-z0-9]+\b([^>]*)>", 1)


def _inner(element: Column) -> Column:
    return F.regexp_replace(element, r"(?is)^<[a-z0-9]+\b[^>]*>|</[a-z0-9]+\s*>$", "")


def is_search_name(name: Column) -> Column:
    return F.lower(name).isin(fv.SEARCH_FIELDS)


def links_of(markup: Column, base: Column, limit: int | None = None, text_limit: int | None = None) -> Column:
    """Ordered ``array<struct<pos, href, text>>``: distinct http(s) links of one page."""

    def link(anchor: Column, pos: Column) -> Column:
        tokens = text.attribute_tokens(_opening(anchor))
        return F.struct(
            urls.absolute(text.attribute(tokens, "href"), base).alias("key"),
            pos.cast("long").alias("pos"),
            text.clean_text(_inner(anchor), text_limit).alias("text"),
        )

    found = F.filter(
        F.transform(_all(markup, _ANCHOR), link),
        lambda a: a["key"].isNotNull()
        & ((a["text"] != "") | a["key"].rlike(r"(?i)^https?://[^/]*/(?:[^?#]*/)?(?:dp|products?|items?|p)/")),
    )
    return F.transform(
        head(keep_first(found), limit),
        lambda a: F.struct(a["pos"].alias("pos"), a["key"].alias("href"), a["text"].alias("text")),
    )


def forms_of(markup: Column, base: Column, limits: Limits = WHOLE) -> Column:
    """Ordered array of forms with method, action, purpose and visible named fields."""

    def field(tag: Column) -> Column:
        def from_tokens(tokens: Column) -> Column:
            kind = F.lower(F.regexp_extract(tag, r"(?i)^<(\w+)", 1))
            name = text.attribute(tokens, "name")
            typed = F.coalesce(F.nullif(text.attribute(tokens, "type"), F.lit("")), F.lit("text"))
            return F.struct(
                name.alias("name"),
                F.lower(F.when(kind == "input", typed).otherwise(kind)).alias("type"),
                F.nullif(text.attribute(tokens, "placeholder"), F.lit("")).alias("placeholder"),
                (text.has_attribute(tokens, "required") | is_search_name(name)).alias("required"),
            )

        return let(text.attribute_tokens(_opening(tag)), from_tokens)

    def form(block: Column, pos: Column) -> Column:
        tokens = text.attribute_tokens(_opening(block))
        action = F.nullif(text.attribute(tokens, "action"), F.lit(""))
        fields = F.filter(
            F.transform(_all(_inner(block), _FIELD), field),
            lambda f: f["name"].isNotNull()
            & (f["name"] != "")
            & ~f["type"].isin(fv.SKIPPED_FIELD_TYPES),
        )

        def described(fs: Column) -> Column:
            searching = F.exists(fs, lambda f: is_search_name(f["name"]) | (f["type"] == "search"))
            purpose = (
                F.when(_inner(block).rlike(r"""(?i)type\s*=\s*["']?password"""), "auth")
                .when(searching, "search")
                .otherwise("form")
            )
            post = F.coalesce(text.attribute(tokens, "method"), F.lit("")).rlike("(?i)post")
            return F.struct(
                pos.cast("long").alias("pos"),
                F.when(post, "POST").otherwise("GET").alias("method"),
                F.when(action.isNull(), urls.href_of(base))
                .otherwise(urls.absolute(action, base))
                .alias("action"),
                purpose.alias("purpose"),
                fs.alias("fields"),
            )

        return let(head(fields, limits.fields), described)

    found = F.filter(F.transform(_all(markup, _FORM), form), lambda f: f["action"].isNotNull())
    return head(found, limits.forms)


def buttons_of(markup: Column, limit: int | None = None, text_limit: int | None = None) -> Column:
    """Ordered distinct button labels, compared without case."""

    def label(tag: Column, pos: Column) -> Column:
        value = F.when(
            tag.rlike(r"(?i)^<button"), text.clean_text(_inner(tag), text_limit)
        ).otherwise(
            text.clean_text(
                F.coalesce(text.attribute(text.attribute_tokens(_opening(tag)), "value"), F.lit("")),
                text_limit,
            )
        )
        return let(value, lambda v: F.struct(F.lower(v).alias("key"), pos.cast("long").alias("pos"), v.alias("label")))

    found = F.filter(F.transform(_all(markup, _BUTTON), label), lambda b: b["label"] != "")
    return F.transform(
        head(keep_first(found), limit),
        lambda b: F.struct(b["pos"].alias("pos"), b["label"].alias("label")),
    )


def linked_data_scripts(html: Column) -> Column:
    """Bodies of the linked-data scripts, from raw html."""
    scripts = F.filter(
        _all(html, _SCRIPT),
        lambda s: F.coalesce(
            text.attribute(text.attribute_tokens(_opening(s)), "type"), F.lit("")
        ).rlike(r"(?i)ld\+json"),
    )
    return F.transform(scripts, _inner)


def search_actions_of(raw_actions: Column, page: Column, limit: int | None = None) -> Column:
    """Search endpoints announced in linked data, distinct by path and parameter."""

    def action(raw: Column, pos: Column) -> Column:
        target = raw["target"]
        templated = F.contains(target, F.lit("{"))
        filled = F.regexp_replace(target, r"\{[^}]+\}", "placeholder")
        in_target = F.regexp_extract(target, r"[?&]([^=&{}]+)=\{[^}]+\}", 1)
        in_query = F.regexp_extract(
            raw["query_input"], r"(?i)(?:required\s+)?name=([a-zA-Z0-9_-]+)", 1
        )

        def build(resolved: Column) -> Column:
            href = urls.href_of(resolved)
            param = F.coalesce(F.nullif(in_target, F.lit("")), F.nullif(in_query, F.lit("")))
            return F.struct(
                F.concat_ws("?", resolved["path"], param).alias("key"),
                pos.cast("long").alias("pos"),
                resolved["path"].alias("url_pattern"),
                F.when(templated, F.regexp_replace(href, "^(.*?)placeholder", "$1"))
                .otherwise(href)
                .alias("raw_url"),
                param.alias("query_param"),
            )

        resolved = F.when(target != "", urls.resolve_parts(filled, page))
        return let(resolved, build)

    found = F.filter(
        F.transform(raw_actions, action),
        lambda a: a["raw_url"].isNotNull() & a["query_param"].isNotNull(),
    )
    return F.transform(
        head(keep_first(found), limit),
        lambda a: F.struct(
            F.lit("search").alias("name"),
            a["url_pattern"].alias("url_pattern"),
            a["raw_url"].alias("raw_url"),
            a["query_param"].alias("query_param"),
            F.lit(0.66).alias("confidence"),
        ),
    )


def current_page_patterns(page: Column, max_params: int | None = None) -> Column:
    """Struct with the search action and the query pattern of the page's own address."""

    def build(keys: Column) -> Column:
        where = F.concat(page["origin"], page["path"])
        search = F.get(F.filter(keys, is_search_name), F.lit(0))
        paging = F.get(F.filter(keys, lambda k: k.rlike(fv.PAGE_FIELD)), F.lit(0))
        others = head(
            F.filter(
                keys,
                lambda k: ~F.coalesce(k == search, F.lit(False))
                & ~F.coalesce(k == paging, F.lit(False)),
            ),
            max_params,
        )
        param = lambda name, required: F.struct(
            name.alias("name"), F.lit(required).alias("required")
        )
        params = F.concat(
            F.when(search.isNotNull(), F.array(param(search, True))).otherwise(
                F.array().cast("array<struct<name:string,required:boolean>>")
            ),
            F.when(paging.isNotNull(), F.array(param(paging, False))).otherwise(
                F.array().cast("array<struct<name:string,required:boolean>>")
            ),
            F.transform(others, lambda k: param(k, False)),
        )
        action = F.when(
            search.isNotNull(),
            F.struct(
                F.lit("search").alias("name"),
                page["path"].alias("url_pattern"),
                where.alias("raw_url"),
                search.alias("query_param"),
                F.lit(0.61).alias("confidence"),
            ),
        )
        pattern = F.when(
            paging.isNotNull() | (F.size(others) > 0),
            F.struct(
                F.when(search.isNotNull(), "search")
                .when(paging.isNotNull(), "paginate_results")
                .otherwise("browse_listing")
                .alias("name"),
                page["path"].alias("url_pattern"),
                where.alias("raw_url"),
                params.alias("params"),
                F.when(search.isNotNull(), 0.6)
                .when(paging.isNotNull(), 0.55)
                .otherwise(0.53)
                .alias("confidence"),
            ),
        )
        return F.struct(action.alias("action"), pattern.alias("pattern"))

    return let(
        urls.query_keys(F.coalesce(page["query"], F.lit(""))),
        build,
    )


def product_segment(segs: Column) -> Column:
    """0-based place of the first product segment that has a follower, or NULL."""
    return F.array_min(
        F.filter(
            F.transform(
                segs,
                lambda s, i: F.when(
                    F.lower(s).isin(fv.PRODUCT_SEGMENTS) & (i < F.size(segs) - 1), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
    )


def kinds_of(
    url: Column,
    host: Column,
    title: Column,
    sample: Column,
    types: Column,
    forms: Column,
    links: Column,
    state: Column,
    sample_limit: int | None = None,
) -> Column:
    """Set of page kinds, in a fixed order."""
    has_type = lambda pattern: F.exists(types, lambda t: t.rlike(pattern))
    texts = F.struct(
        F.lower(url).alias("url"),
        F.lower(
            F.concat_ws(" ", url, F.coalesce(title, F.lit("")), cut(sample, sample_limit))
        ).alias("hay"),
        F.lower(F.coalesce(F.to_json(state), F.lit("[]"))).alias("state"),
    )

    def facts(t: Column) -> Column:
        commerce = (
            has_type(fv.COMMERCE_TYPE)
            | t["url"].rlike(fv.COMMERCE_URL)
            | (~t["url"].rlike(fv.COMMERCE_TEXT_EXEMPT_URL) & t["hay"].rlike(fv.COMMERCE_TEXT))
        )
        travel = (
            host.rlike(fv.TRAVEL_HOST)
            | t["hay"].rlike(text.ascii_words(fv.TRAVEL_TEXT))
            | has_type(fv.TRAVEL_TYPE)
        )
        detail_links = F.filter(
            links, lambda a: let(urls.segments(urls.path_of(a["href"])), product_segment).isNotNull()
        )
        return F.struct(
            commerce.alias("commerce"),
            travel.alias("travel"),
            (has_type("(?i)product") | t["url"].rlike(fv.PRODUCT_PAGE_URL)).alias("product"),
            (F.size(detail_links) >= 2).alias("listing"),
            t["state"].rlike(fv.STATE_DETAIL).alias("state_detail"),
            t["state"].rlike(fv.STATE_LISTING).alias("state_listing"),
            t["hay"].rlike(fv.CART_TEXT).alias("cart"),
        )

    def kinds(f: Column) -> Column:
        travel = f["travel"] & ~f["commerce"]
        return F.array_compact(
            F.array(
                F.when(F.exists(forms, lambda x: x["purpose"] == "search"), "searchable"),
                F.when(travel, "travel"),
                F.when(f["product"] | (~travel & f["state_detail"]), "product_detail"),
                F.when(~travel & (f["listing"] | f["state_listing"]), "product_listing"),
                F.when(f["cart"] | f["commerce"], "commerce"),
            )
        )

    return let(let(texts, facts), kinds)


@built_once
def _fact(name: str, limits: Limits) -> Column:
    col = F.col
    if name == "here":
        return urls.parts(col("url"))
    if name == "site":
        return urls.registrable_domain(col("here.host"))
    if name == "markup":
        return text.rendered_markup(col("html"))
    if name == "base":
        return urls.base_of(col("markup"), col("here"))
    if name == "links":
        # bound here, so that the base is found once a page and not within the function of each link
        return let(col("base"), lambda base: links_of(col("markup"), base, limits.links, limits.link_text))
    if name == "forms":
        return let(col("base"), lambda base: forms_of(col("markup"), base, limits))
    if name == "buttons":
        return buttons_of(col("markup"), limits.buttons, limits.button_label)
    if name == "linked_data":
        return read_linked_data(linked_data_scripts(col("html")))
    visible = F.coalesce(col("page.visibleText"), F.lit(""))
    sample = F.concat(visible, F.lit("\n"), text.text_sample(col("html"), limits.sample))
    return text.clean_text(sample, limits.sample)


_NEEDS = {
    "here": [],
    "site": ["here"],
    "markup": [],
    "base": ["here", "markup"],
    "links": ["base"],
    "forms": ["base"],
    "buttons": ["markup"],
    "linked_data": [],
    "sample": [],
}


def page_facts(captures: DataFrame, *wanted: str, limits: Limits = WHOLE) -> DataFrame:
    """Captures plus the wanted mined parts as columns (see the module note).

    Parts that are already columns are used as they are, so jobs also run on ``mine``'s output.
    """
    done: list[str] = []

    def add(name: str) -> None:
        if name in captures.columns:
            return
        for need in _NEEDS[name]:
            add(need)
        if name not in done:
            done.append(name)

    for name in wanted:
        add(name)
    out = captures
    for name in done:
        out = out.withColumn(name, _fact(name, limits))
    return out


def mine(captures: DataFrame, workdir: str | None = None, limits: Limits = WHOLE) -> DataFrame:
    """Every mined part without the html, materialised once to be shared by several jobs."""
    parts = page_facts(
        captures, "site", "linked_data", "sample", "forms", "links", "buttons", limits=limits
    ).drop("html", "markup", "network")
    return staged(parts, workdir, "mined")


@built_once
def canonical_href() -> Column:
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<link\b([^>]*)>"), F.lit(1))
    found = F.transform(
        tags,
        lambda tag: let(
            text.attribute_tokens(tag),
            lambda t: F.struct(
                F.lower(F.coalesce(text.attribute(t, "rel"), F.lit(""))).alias("rel"),
                F.coalesce(text.attribute(t, "href"), F.lit("")).alias("href"),
            ),
        ),
    )
    canonical = F.filter(found, lambda x: (x["rel"] == "canonical") & (x["href"] != ""))
    return urls.absolute(F.get(canonical, F.lit(0))["href"], F.col("here"))


@built_once
def _description() -> Column:
    return text.meta_description(F.col("html"))


def page_profile(captures: DataFrame) -> DataFrame:
    """Title, description, canonical address, base, lengths, and how many pages share the html."""
    col = F.col
    profiles = page_facts(captures, "base").select(
        "capture_id",
        "url",
        F.coalesce(col("title"), text.title_of(col("html"))).alias("title"),
        _description().alias("description"),
        canonical_href().alias("canonical_url"),
        urls.href_of(col("base")).alias("base_url"),
        F.length("html").alias("html_length"),
        F.length(text.stripped_text(col("html"))).alias("text_length"),
        "dom_hash",
    )
    copies = captures.groupBy("dom_hash").agg(F.count(F.lit(1)).alias("copies"))
    return profiles.join(copies, "dom_hash", "left")


def page_text(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """The three readings of a page: sample, readable and stripped."""
    html = F.col("html")
    return captures.select(
        "capture_id",
        text.text_sample(html, limits.sample).alias("sample"),
        text.readable_text(html, limits.readable).alias("readable"),
        text.stripped_text(html).alias("stripped"),
    )


def page_links(captures: DataFrame, limits: Limits = WHOLE, shown_only: bool = False) -> DataFrame:
    """Edge table ``capture_id, url, site, pos, href, text``."""
    facts = page_facts(captures, "site", "links", limits=limits)
    array = head(F.col("links"), limits.shown_links) if shown_only else F.col("links")
    return unnest(facts, ["capture_id", "url", "site"], array, "pos")


def link_host_rollup(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Links and linking pages per target host; page links are already distinct per page."""
    links = page_links(captures, limits)
    return (
        links.select("capture_id", urls.parts(F.col("href"))["host"].alias("host"))
        .groupBy("host", "capture_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("host")
        .agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))
    )


def page_forms(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    return unnest(
        page_facts(captures, "forms", limits=limits), ["capture_id", "url"], F.col("forms"), "pos"
    )


def form_fields(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    forms = page_forms(captures, limits)
    numbered = F.transform(
        F.col("fields"), lambda f, i: F.struct(i.cast("long").alias("pos"), f.alias("f"))
    )
    return unnest(
        forms, ["capture_id", F.col("pos").alias("form_pos")], numbered, "pos"
    ).select("capture_id", "form_pos", "pos", "f.*")


def page_buttons(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    return unnest(
        page_facts(captures, "buttons", limits=limits), ["capture_id"], F.col("buttons"), "pos"
    )


def jsonld_types(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    types = F.transform(
        head(F.col("linked_data.types"), limits.jsonld_types),
        lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("type")),
    )
    return unnest(
        page_facts(captures, "site", "linked_data", limits=limits), ["capture_id", "site"], types, "pos"
    )


@built_once
def all_search_actions(limits: Limits = WHOLE) -> Column:
    """The page's own search address first, then the announced ones."""
    own = current_page_patterns(F.col("here"), limits.page_params)["action"]
    found = search_actions_of(F.col("linked_data.actions"), F.col("here"), limits.search_actions)
    return F.concat(F.array_compact(F.array(own)), found)


def search_actions(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    facts = page_facts(captures, "here", "linked_data", limits=limits)
    numbered = F.transform(
        all_search_actions(limits), lambda a, i: F.struct(i.cast("long").alias("pos"), a.alias("a"))
    )
    return unnest(facts, ["capture_id"], numbered, "pos").select("capture_id", "pos", "a.*")


@built_once
def own_query_pattern(max_params: int | None = None) -> Column:
    return current_page_patterns(F.col("here"), max_params)["pattern"]


def current_page_query(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Query pattern of each page's own address."""
    facts = page_facts(captures, "here")
    return unnest(facts, ["capture_id"], F.array_compact(F.array(own_query_pattern(limits.page_params))), "name")


@built_once
def kinds_column(limits: Limits = WHOLE) -> Column:
    col = F.col
    return kinds_of(
        col("url"),
        F.coalesce(col("here.host"), F.lit("")),
        col("title"),
        col("sample"),
        col("linked_data.types"),
        col("forms"),
        col("links"),
        col("page.appState"),
        limits.kind_sample,
    )


def page_kinds(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Page kinds; row-local, so no join of the mined parts is needed."""
    facts = page_facts(captures, "site", "linked_data", "sample", "forms", "links", limits=limits)
    return facts.select("capture_id", "url", "site", kinds_column(limits).alias("kinds"))


def headings_of(html: Column, limit: int | None = None) -> Column:
    raw = head(_all(text.rendered_markup(html), _HEADING), limit)
    clean = F.transform(raw, lambda h: text.clean_text(_inner(h), None))
    return F.filter(clean, lambda h: h != "")


def redact_inputs(captures: DataFrame) -> DataFrame:
    """Captures with credential-like input values blanked, and the number blanked per page."""
    html = text.redact_inputs(F.col("html"))
    return captures.withColumn("redactions", text.redaction_count(F.col("html"))).withColumn(
        "html", html
    )


def redactions_by_site(captures: DataFrame) -> DataFrame:
    return (
        captures.select(
            urls.registrable_domain(urls.parts(F.col("url"))["host"]).alias("site"),
            text.redaction_count(F.col("html")).alias("n"),
        )
        .groupBy("site")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("n") > 0).alias("pages_redacted"),
            F.sum("n").alias("inputs_redacted"),
        )
    )
