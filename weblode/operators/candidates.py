"""Candidates for callable endpoints and page capabilities, from mined material.

Every builder returns the same columns (``schema.CANDIDATE_COLUMNS``), so they are unioned.
``source_rank`` gives the order in which sources are considered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import built_once, head, let
from ..functions.json_help import INPUT_DDL, body_inputs
from ..functions.rows import unnest
from ..schema import CANDIDATE_COLUMNS, PARAMS_DDL, STEPS_DDL, WHOLE, Limits
from .calls import actionable_calls, rank_calls
from .pages import all_search_actions, kinds_column, page_facts
from .templates import all_query_patterns, detail_templates

RANK = {
    "recipe": 0,
    "content": 1,
    "form": 2,
    "search_action": 3,
    "query": 4,
    "detail": 5,
    "capability": 6,
    "network": 7,
    "sitemap": 8,
    "spec": 9,
}


def _param(name: Column, place: str | Column, key: Column, type_: str | Column = "string", required: Column | bool = False) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        name.alias("name"),
        lit(place).alias("place"),
        key.alias("key"),
        lit(type_).alias("type"),
        lit(required).alias("required"),
    )


def _no_params() -> Column:
    return F.array().cast(PARAMS_DDL)


def _no_steps() -> Column:
    return F.lit(None).cast(STEPS_DDL)


def as_candidates(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Lay ``rows`` out as candidates of one source."""
    fixed = {
        "source_rank": F.lit(RANK[source]),
        "source": F.lit(source),
        "kind": F.lit("http"),
        "method": F.lit("GET"),
        "params": _no_params(),
        "steps": _no_steps(),
    }
    fixed.update(columns)
    return rows.select(
        *[
            fixed[c].alias(c) if c in fixed else F.col(c)
            for c in CANDIDATE_COLUMNS
        ]
    ).withColumn("pos", F.col("pos").cast("bigint")).withColumn(
        "params", F.col("params").cast(PARAMS_DDL)
    )


def content_candidates(captures: DataFrame) -> DataFrame:
    """The page itself, once per capture."""
    described = F.concat(
        F.lit("Fetch the page content (readable text) from "),
        F.col("url"),
        F.coalesce(F.concat(F.lit(" - "), F.col("title")), F.lit("")),
        F.lit("."),
    )
    return as_candidates(
        captures,
        "content",
        pos=F.lit(0),
        name=F.lit("fetch_page_content"),
        description=F.substring(described, 1, 1000),
        url_pattern=F.coalesce(urls.parts_of("url")["path"], F.lit("/")),
        raw_url=F.col("url"),
        confidence=F.lit(0.5),
    )


@built_once
def _useful_form() -> Column:
    col = F.col
    search = col("purpose") == "search"
    challenge = col("action").rlike(fv.CHALLENGE_FORM) | F.exists(
        "fields",
        lambda f: F.concat_ws(" ", f["name"], F.coalesce(f["placeholder"], F.lit(""))).rlike(fv.CHALLENGE_FORM),
    )
    optional_only = ~F.exists("fields", lambda f: f["required"])
    return (
        (col("purpose") != "auth")
        & (F.size("fields") > 0)
        & ~challenge
        & (search | ~col("action").rlike(fv.LOW_VALUE_FORM_ACTION))
        & ~((col("method") == "GET") & ~search & optional_only)
    )


def form_candidates(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Forms worth calling."""
    facts = page_facts(captures, "forms", limits=limits)
    forms = unnest(facts, ["capture_id"], head(F.col("forms"), limits.candidate_forms), "pos").filter(_useful_form())
    search = F.col("purpose") == "search"
    action = urls.parts_of("action")
    host = F.regexp_replace(action["origin"], "^https?://", "")
    place = F.when(F.col("method") == "POST", "body").otherwise("query")
    # a repeated field name keeps its first place and takes part once
    fields = head(F.col("fields"), limits.candidate_fields)
    names = F.array_distinct(F.transform(fields, lambda f: f["name"]))
    params = F.transform(
        names,
        lambda n: _param(
            n,
            place,
            n,
            required=F.exists(fields, lambda f: (f["name"] == n) & f["required"]),
        ),
    )
    return as_candidates(
        forms,
        "form",
        name=F.when(search, "search").otherwise(urls.call_name(F.col("method"), action["path"])),
        description=F.when(
            search, F.concat(F.lit("Search "), host, F.lit(" (submits the page's search form)."))
        ).otherwise(
            F.concat(
                F.lit("Submit the "), F.col("method"), F.lit(" form at "), action["path"],
                F.lit(" on "), host, F.lit("."),
            )
        ),
        method=F.col("method"),
        url_pattern=action["path"],
        raw_url=F.col("action"),
        params=params,
        confidence=F.when(search, 0.54).otherwise(0.5),
    )


@built_once
def _call_params(limits: Limits = WHOLE) -> Column:
    path_names = F.array_distinct(F.regexp_extract_all("url_pattern", F.lit(r"\{(\w+)\}"), F.lit(1)))
    in_path = F.transform(path_names, lambda n: _param(n, "path", n, required=True))
    query_names = F.filter(
        urls.query_keys(F.coalesce(urls.parts_of("raw_url")["query"], F.lit(""))),
        lambda k: ~k.rlike(fv.TRACKING_PARAM) & (k != "_"),
    )
    in_query = F.transform(
        F.filter(query_names, lambda k: ~F.array_contains(path_names, k)),
        lambda k: _param(k, "query", k),
    )

    def with_body(base: Column) -> Column:
        taken = F.transform(base, lambda p: p["name"])
        found = F.transform(
            F.coalesce("_inputs", F.array().cast(INPUT_DDL)),
            lambda b: _param(
                F.when(F.array_contains(taken, b["name"]), F.concat(F.lit("body_"), b["name"])).otherwise(b["name"]),
                "body",
                b["key"],
                b["type"],
                b["required"],
            ),
        )
        declared = F.from_json("body_schema", "properties map<string,string>")["properties"]
        by_schema = F.transform(
            F.filter(
                head(F.coalesce(F.map_entries(declared), F.array().cast("array<struct<key:string,value:string>>")), limits.schema_keys),
                lambda e: ~F.array_contains(taken, e["key"]),
            ),
            lambda e: _param(
                e["key"],
                "body",
                e["key"],
                F.coalesce(F.get_json_object(e["value"], "$.type"), F.lit("string")),
            ),
        )
        has_body = F.coalesce(F.col("body") != "", F.lit(False))
        return F.concat(base, F.when(has_body, found).otherwise(by_schema))

    return let(F.concat(in_path, in_query), with_body)


def network_candidates(calls: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Observed API calls as candidates: the page's own site first."""
    ranked = rank_calls(actionable_calls(calls), limits.cross_site_calls, limits.candidate_calls)
    inputs = body_inputs(F.col("body"))
    if limits.body_depth is not None:
        inputs = F.filter(inputs, lambda b: b["depth"] <= limits.body_depth)
    filled = ranked.withColumn("_inputs", head(inputs, limits.body_fields)).withColumn(
        "params", _call_params(limits)
    )
    needless = (
        (F.size("params") == 0)
        & (F.upper("method") == "GET")
        & ~F.col("url_pattern").rlike(fv.CALL_PATH_HINT)
    )
    primary = F.exists("params", lambda p: (p["place"] == "body") & p["required"])
    verb = F.concat_ws(" ", F.col("method"), F.col("url_pattern"))
    return as_candidates(
        filled.filter(~needless),
        "network",
        pos=F.col("rank"),
        name=urls.call_name(F.col("method"), F.col("url_pattern")),
        description=F.when(
            primary,
            F.concat(verb, F.lit(" (observed API; replays the site's request with your inputs)")),
        ).otherwise(F.concat(verb, F.lit(" (observed API call)"))),
        method=F.col("method"),
        raw_url=F.col("raw_url"),
        params=F.col("params"),
        confidence=F.when(primary, 0.62).otherwise(0.55),
    )


def link_candidates(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Search actions, query groups and detail templates as candidates."""
    facts = page_facts(captures, "here", "linked_data", limits=limits)
    numbered = F.transform(
        all_search_actions(limits), lambda a, i: F.struct(i.alias("pos"), a.alias("a"))
    )
    actions = unnest(facts, ["capture_id"], numbered, "pos").select("capture_id", "pos", "a.*")
    searched = as_candidates(
        actions,
        "search_action",
        description=F.concat(F.lit("Search the site with its search address ("), F.col("query_param"), F.lit(").")),
        params=F.array(_param(F.lit("query"), "query", F.col("query_param"), required=True)),
    )
    queried = as_candidates(
        all_query_patterns(captures, limits),
        "query",
        pos=F.col("rank"),
        description=F.concat(
            F.when(F.col("name") == "search", "Search or refine results on ")
            .when(F.col("name") == "paginate_results", "Paginate or filter listing results on ")
            .otherwise("Browse listing results on "),
            F.col("raw_url"),
            F.lit("."),
        ),
        params=F.transform("params", lambda p: _param(p["name"], "query", p["name"], required=p["required"])),
    )
    detailed = as_candidates(
        detail_templates(captures, limits=limits),
        "detail",
        pos=F.col("rank"),
        description=F.concat(F.lit("Fetch a detail page by "), F.col("param_name"), F.lit(" and return readable page text.")),
        params=F.array(_param(F.col("param_name"), "path", F.col("param_name"), required=True)),
    )
    return searched.unionByName(queried).unionByName(detailed)


def _step(action: str | Column, value: Column | None = None, role: str | Column | None = None, selector: str | Column | None = None) -> Column:
    """One step of a capability; what a step does not use is NULL."""
    given = {"action": action, "role": role, "selector": selector, "value": value}
    return F.struct(
        *((x if isinstance(x, Column) else F.lit(x)).cast("string").alias(name) for name, x in given.items())
    )


def _input(name: Column, required: Column | bool) -> Column:
    """An input that a person or caller fills in; it is put into steps, not into a request."""
    return _param(name, "input", name, required=required)


def _then_read(mode: str) -> list[Column]:
    return [_step("waitFor", role="page", selector="body"), _step("extract", F.lit(mode))]


def _read_page(target: Column, mode: str) -> Column:
    return F.array(_step("navigate", target), *_then_read(mode))


def _capability(
    test: Column, name: str, confidence: Column | float, steps: Column, inputs: Column | None = None, target: Column | None = None
) -> Column:
    level = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(
        F.coalesce(test, F.lit(False)),
        F.struct(
            F.lit(name).alias("capability"),
            level.cast("double").alias("confidence"),
            (F.col("url") if target is None else target).alias("target"),
            (_no_params() if inputs is None else inputs).cast(PARAMS_DDL).alias("inputs"),
            steps.cast(STEPS_DDL).alias("steps"),
        ),
    )


def _filled_query(url: Column, keys: Column, inputs: Column) -> Column:
    """An address whose query takes each input, in the form ``key={{input}}``."""
    pairs = F.zip_with(keys, inputs, lambda k, p: F.concat(k, F.lit("={{"), p["name"], F.lit("}}")))
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(F.size(pairs) > 0, F.concat(bare, F.lit("?"), F.array_join(pairs, "&"))).otherwise(bare)


def _fill(field: Column, name: Column) -> Column:
    """The step that puts an input into a field; NULL where the field cannot be found again."""
    listed = field["type"] == "select"
    return F.when(
        field["selector"] != "",
        _step(
            F.when(listed, "selectOption").otherwise("fill"),
            F.concat(F.lit("{{"), name, F.lit("}}")),
            F.coalesce(F.nullif(field["type"], F.lit("")), F.lit("input")),
            field["selector"],
        ),
    )


def _submit(form: Column) -> Column:
    """The step that sends a form: its button, else Enter in its first field."""
    first = F.get(F.filter(form["fields"], lambda f: f["selector"] != ""), F.lit(0))
    return F.when(form["submitSelector"] != "", _step("click", role="button", selector=form["submitSelector"])).when(
        first.isNotNull(),
        _step("pressKey", F.lit("Enter"), F.coalesce(F.nullif(first["type"], F.lit("")), F.lit("input")), first["selector"]),
    )


def _form_steps(form: Column, fills: Column) -> Column:
    return F.array_compact(
        F.concat(F.array(_step("navigate", F.col("url"))), fills, F.array(_submit(form), *_then_read("json:listing")))
    )


def _travel_fields(form: Column) -> Column:
    """Fields of a travel form by what they ask for, each slot taken by the first field that fits; NULL for other forms."""
    slots = F.array(*map(F.lit, fv.TRAVEL_FIELDS))

    def take(taken: Column, field: Column) -> Column:
        words = F.lower(F.concat_ws(" ", field["name"], field["label"], field["placeholder"], field["type"]))
        fits = F.array_compact(
            F.array(*(F.when(words.rlike(text.ascii_words(p)), F.lit(slot)) for slot, p in fv.TRAVEL_FIELDS.items()))
        )
        free = F.get(F.array_except(fits, F.transform(taken, lambda t: t["slot"])), F.lit(0))
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(free.alias("slot"), field.alias("field")))))

    none = F.filter(F.transform(form["fields"], lambda f: F.struct(F.lit("").alias("slot"), f.alias("field"))), lambda x: F.lit(False))
    taken = F.aggregate(form["fields"], none, take)
    complete = lambda t: F.size(F.array_intersect(F.transform(t, lambda x: x["slot"]), F.slice(slots, 1, 2))) == 2
    return let(taken, lambda t: F.when(complete(t), t))


def _travel_search(form: Column) -> Column:
    def build(taken: Column) -> Column:
        always = lambda x: x["slot"].isin("origin", "destination")
        return _capability(
            taken.isNotNull(), "search_travel_options", 0.7,
            _form_steps(form, F.transform(taken, lambda x: _fill(x["field"], x["slot"]))),
            F.transform(taken, lambda x: _input(x["slot"], always(x) | F.coalesce(x["field"]["required"], F.lit(False)))),
        )

    return let(_travel_fields(form), build)


def _live_search(form: Column) -> Column:
    return _capability(
        form.isNotNull(), "search_in_browser", 0.63,
        _form_steps(form, F.transform(form["fields"], lambda f: _fill(f, f["name"]))),
        F.transform(form["fields"], lambda f: _input(f["name"], F.coalesce(f["required"], F.lit(False)))),
    )


def _control(action: Column, name: str, confidence: float) -> Column:
    """A control of the page, clicked where it stands."""
    click = _step("click", role=F.coalesce(F.nullif(action["kind"], F.lit("")), F.lit("button")), selector=action["selector"])
    return _capability(action["selector"] != "", name, confidence, F.array(click, *_then_read("json:metadata")))


def page_capabilities(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """One row per page and thing it can be used for, with a confidence."""
    col = F.col
    facts = page_facts(captures, "site", "linked_data", "sample", "forms", "links", limits=limits)
    kinds = facts.select(
        "capture_id",
        "site",
        "url",
        kinds_column(limits).alias("kinds"),
        all_search_actions(limits).alias("search"),
        col("page.forms").alias("live_forms"),
        col("page.actions").alias("actions"),
    )
    first_detail = detail_templates(captures, top=1, limits=limits).select(
        "capture_id",
        col("name").alias("detail_name"),
        col("confidence").alias("detail_confidence"),
        col("param_name").alias("detail_param"),
        F.concat(
            urls.origin_of(col("raw_url")),
            F.regexp_replace("url_pattern", r"\{(\w+)\}", "{{$1}}"),
        ).alias("detail_url"),
    )
    query_search = (
        all_query_patterns(captures, limits)
        .filter(col("name") == "search")
        .groupBy("capture_id")
        .agg(F.min_by(F.struct("raw_url", "params"), "rank").alias("query_search"))
    )
    joined = kinds.join(first_detail, "capture_id", "left").join(query_search, "capture_id", "left")
    has = lambda kind: F.array_contains("kinds", kind)
    travel = has("travel")
    item_name = col("detail_name").isin("get_product_page", "get_item_page")
    product_name = F.when(col("detail_name") == "get_product_page", True)
    own_search = F.get("search", F.lit(0))
    search_url = F.coalesce(own_search["raw_url"], col("query_search.raw_url"))
    search_inputs = F.when(
        own_search.isNotNull(), F.array(_input(F.lit("query"), True), _input(F.lit("page"), False))
    ).otherwise(F.transform("query_search.params", lambda p: _input(p["name"], p["required"])))
    search_keys = F.when(
        own_search.isNotNull(), F.array(own_search["query_param"], F.lit("page"))
    ).otherwise(F.transform("query_search.params", lambda p: p["name"]))
    found = F.array(
        _capability(F.lit(True), "extract_page_metadata", 0.56, _read_page(col("url"), "json:metadata")),
        _capability(travel, "list_travel_options", 0.65, _read_page(col("url"), "json:listing")),
        _capability(
            ~travel & (col("detail_name").isNotNull() | has("product_listing")), "list_page_items", 0.6,
            _read_page(col("url"), "json:listing"),
        ),
        *(
            _capability(
                ~travel & item_name & test, name, F.greatest("detail_confidence", F.lit(0.66)),
                _read_page(col("detail_url"), "json:product"), F.array(_input(col("detail_param"), True)), col("detail_url"),
            )
            for test, name in ((product_name, "get_product_details"), (product_name.isNull(), "get_item_details"))
        ),
        _capability(
            ~travel & ~F.coalesce(item_name, F.lit(False)) & has("product_detail"), "get_product_details", 0.64,
            _read_page(col("url"), "json:product"),
        ),
        _capability(
            search_url.isNotNull(), "list_search_results", 0.67,
            _read_page(_filled_query(search_url, search_keys, search_inputs), "json:listing"), search_inputs, search_url,
        ),
        _travel_search(F.get(F.filter("live_forms", lambda f: _travel_fields(f).isNotNull()), F.lit(0))),
        _live_search(
            F.get(F.filter("live_forms", lambda f: (f["purpose"] == "search") & (F.size(f["fields"]) > 0)), F.lit(0))
        ),
        *(
            _control(F.get(F.filter("actions", lambda a: a["label"].rlike(text.ascii_words(pattern))), F.lit(0)), name, level)
            for name, (pattern, level) in fv.ACTION_CONTROLS.items()
        ),
    )
    numbered = F.transform(
        F.array_compact(found), lambda x, i: F.struct(i.cast("bigint").alias("pos"), x.alias("x"))
    )
    return unnest(joined, ["capture_id", "site", "url"], numbered, "pos").select(
        "capture_id", "site", "url", "pos", "x.*"
    )


def capability_candidates(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Page capabilities as candidates, with their inputs and steps."""
    return as_candidates(
        page_capabilities(captures, limits),
        "capability",
        name=F.col("capability"),
        description=F.concat(F.lit("Page capability: "), F.col("capability"), F.lit(".")),
        kind=F.lit("browser"),
        method=F.lit(None).cast("string"),
        url_pattern=F.lit(None).cast("string"),
        raw_url=F.col("target"),
        params=F.col("inputs"),
        steps=F.col("steps"),
    )


def capability_shares(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Share of a site's pages that offer each capability."""
    rows = page_capabilities(captures, limits)
    pages = (
        captures.select(urls.registrable_domain(urls.parts_of("url")["host"]).alias("site"))
        .groupBy("site")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
    return (
        rows.groupBy("site", "capability")
        .agg(F.count(F.lit(1)).alias("offering"), F.avg("confidence").alias("confidence"))
        .join(pages, "site")
        .withColumn("share", F.col("offering") / F.col("pages"))
    )


def sitemap_candidates(clusters: DataFrame) -> DataFrame:
    """One candidate per URL template; the capture is the origin itself."""
    return as_candidates(
        clusters,
        "sitemap",
        capture_id=F.col("origin"),
        pos=F.col("rank"),
        description=F.concat(
            F.lit("Fetch a detail page by "), F.col("param_name"),
            F.lit(" (from the site's sitemap, e.g. "), F.col("example"), F.lit(")."),
        ),
        params=F.array(_param(F.col("param_name"), "path", F.col("param_name"), required=True)),
        confidence=F.lit(0.6),
    )


def spec_candidates(operations: DataFrame) -> DataFrame:
    return as_candidates(
        operations,
        "spec",
        capture_id=F.col("origin"),
        method=F.col("method"),
        params=F.col("params"),
    )


@dataclass(frozen=True)
class Recipe:
    """A tool known beforehand for hosts that match a pattern; supplied by the caller."""

    host_pattern: str
    name: str
    description: str
    url_pattern: str
    params: tuple[tuple[str, str, str, bool], ...] = field(default_factory=tuple)
    method: str = "GET"
    confidence: float = 0.7


def recipe_candidates(captures: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Recipes whose host pattern matches the page; the short list is part of the plan itself."""
    u = captures.select("capture_id", urls.parts_of("url").alias("u"))

    def one(i: int, r: Recipe) -> Column:
        params = F.array(
            *[_param(F.lit(n), place, F.lit(key), required=required) for n, place, key, required in r.params]
        ).cast(PARAMS_DDL)
        return F.when(
            F.col("u.host").rlike(r.host_pattern),
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(r.name).alias("name"),
                F.lit(r.description).alias("description"),
                F.lit(r.method).alias("method"),
                F.lit(r.url_pattern).alias("url_pattern"),
                params.alias("params"),
                F.lit(r.confidence).alias("confidence"),
            ),
        )

    if not recipes:
        raise ValueError("give at least one recipe")
    found = F.array_compact(F.array(*[one(i, r) for i, r in enumerate(recipes)]))
    rows = unnest(u, ["capture_id", F.col("u.origin").alias("origin")], found, "pos")
    return as_candidates(
        rows,
        "recipe",
        method=F.col("method"),
        raw_url=F.concat("origin", "url_pattern"),
        params=F.col("params"),
    )


def repair_steps(tools: DataFrame) -> DataFrame:
    """Undo the encoding of ``{`` and ``}`` in step values."""
    fixed = F.transform(
        "steps",
        lambda s: s.withField(
            "value", F.regexp_replace(F.regexp_replace(s["value"], "(?i)%7b", "{"), "(?i)%7d", "}")
        ),
    )
    encoded = F.exists("steps", lambda s: F.coalesce(s["value"].rlike("(?i)%7b"), F.lit(False)))
    return tools.withColumn("steps", F.when(encoded, fixed).otherwise(F.col("steps")))


@built_once
def junk_tool() -> Column:
    """Sign-in flows, health probes and monitoring hosts; the captured page is never junk."""
    col = F.col
    page_path = urls.parts_of("page_url")["path"]
    host = F.coalesce(urls.parts_of("raw_url")["host"], F.lit(""))
    noise = (
        col("url_pattern").rlike(fv.AUTH_PATH)
        | col("url_pattern").rlike(fv.PROBE_PATH)
        | host.rlike(fv.INFRA_HOST)
    )
    return (
        (col("kind") == "http")
        & ~col("name").isin(fv.PROTECTED_NAMES)
        & ~F.coalesce(col("url_pattern") == page_path, F.lit(False))
        & F.coalesce(noise, F.lit(False))
    )


def cleanup_tools(tools: DataFrame) -> DataFrame:
    """Repair and filter tools that carry ``page_url``."""
    return repair_steps(tools).filter(~junk_tool())


def with_content_floor(tools: DataFrame, captures: DataFrame) -> DataFrame:
    """Add the page itself for captures left without a tool."""
    empty = captures.join(tools.select("capture_id").distinct(), "capture_id", "left_anti")
    return tools.select(*CANDIDATE_COLUMNS).unionByName(content_candidates(empty))


def all_candidates(
    captures: DataFrame,
    calls: DataFrame | None = None,
    recipes: list[Recipe] | None = None,
    limits: Limits = WHOLE,
) -> DataFrame:
    """Every candidate of every capture, each with its source rank and place."""
    out = content_candidates(captures)
    for more in (
        form_candidates(captures, limits),
        link_candidates(captures, limits),
        capability_candidates(captures, limits),
    ):
        out = out.unionByName(more)
    if calls is not None:
        out = out.unionByName(network_candidates(calls, limits))
    if recipes:
        out = recipe_candidates(captures, recipes).unionByName(out)
    return out
