"""Data-quality flags of captures: walls, thin shells, gates and sensitive pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import any_contains, built_once, cut, let, matches
from ..functions.rows import unnest
from ..schema import WHOLE, Limits
from .pages import page_facts


@built_once
def _health(limits: Limits) -> Column:
    col = F.col
    title = F.coalesce(col("title"), F.lit(""))
    page_html = col("html")
    calls = F.coalesce(F.size("network"), F.lit(0))

    texts = F.struct(
        text.stripped_text(page_html).alias("shown"), F.lower(page_html).alias("low")
    )

    def flags(t: Column) -> Column:
        length = F.length(t["shown"])
        window = cut(page_html, limits.wall_window)
        wall = title.rlike(fv.RENDERED_WALL) | matches(
            window, t["low"], fv.RENDERED_WALL, fv.WALL_WORDS
        )
        password = (
            F.contains(t["low"], F.lit("password"))
            & page_html.rlike(fv.PASSWORD_FIELD)
            & (
                title.rlike(text.ascii_words(fv.LOGIN_TITLE))
                | col("url").rlike(text.ascii_words(fv.LOGIN_PAGE_URL))
                | (length < 2000)
            )
        )
        interstitial = (
            (calls == 0)
            & (length < 6000)
            & matches(t["shown"], t["low"], fv.AUTH_WALL_TEXT, fv.AUTH_WALL_WORDS)
        )
        needs_script = F.contains(t["low"], F.lit("javascript")) & page_html.rlike(
            text.ascii_words(fv.NEEDS_SCRIPT)
        )
        return F.struct(
            length.alias("text_length"),
            calls.alias("calls"),
            wall.alias("wall"),
            (password | interstitial).alias("login_wall"),
            matches(page_html, t["low"], fv.STATIC_WALL, fv.WALL_WORDS).alias("static_wall"),
            any_contains(t["low"], fv.NAVIGATION_WALL).alias("bot_walled"),
            (needs_script & page_html.rlike(fv.APP_MOUNT) & (length < 600)).alias("spa_shell"),
        )

    return let(texts, flags)


def capture_health(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Wall and shell flags and the quality score of each capture."""
    h = lambda name: F.col(f"h.{name}")
    blocked = h("wall") | ((h("text_length") < 500) & (h("calls") == 0))
    return captures.withColumn("h", _health(limits)).select(
        "capture_id",
        "url",
        h("text_length").alias("text_length"),
        h("calls").alias("calls"),
        blocked.alias("looks_blocked"),
        h("login_wall").alias("login_wall"),
        (h("wall") | h("login_wall")).alias("needs_human"),
        (h("login_wall") | (h("wall") & (h("text_length") < 3000))).alias("human_wall"),
        h("static_wall").alias("static_wall"),
        h("bot_walled").alias("bot_walled"),
        h("spa_shell").alias("spa_shell"),
        (
            h("calls").cast("bigint") * 1000
            + h("text_length")
            - F.when(blocked, 1_000_000).otherwise(0)
        ).alias("score"),
    )


def render_need(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Whether a page needs a real browser: walled, or an empty shell without any endpoint."""
    return capture_health(captures, limits).select(
        "capture_id",
        "url",
        "text_length",
        "bot_walled",
        "spa_shell",
        "calls",
        (F.col("bot_walled") | (F.col("spa_shell") & (F.col("calls") == 0))).alias("needs_render"),
    )


def render_need_by_site(captures: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    need = render_need(captures, limits).withColumn(
        "site", urls.registrable_domain(urls.parts_of("url")["host"])
    )
    return need.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("needs_render").alias("need_render")
    )


def same_target(a: str, b: str) -> Column:
    """Same address apart from fragment, trailing slash and case of origin and path."""

    def key(p: Column) -> Column:
        path = F.regexp_replace(p["path"], "/+$", "")
        return F.concat(F.lower(F.concat(p["origin"], path)), p["query"])

    return F.coalesce(
        let(urls.parts_of(a), key) == let(urls.parts_of(b), key),
        F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit("")),
    )


def gate_status(navigations: DataFrame) -> DataFrame:
    """``requested_url, landed_url, title, text, has_password, has_challenge`` to kind and reason."""
    col = F.col
    hay = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))))
    found = F.filter(
        F.array(*[F.lit(m) for m in fv.NAVIGATION_WALL]), lambda m: F.contains(col("_hay"), m)
    )
    login = F.coalesce("landed_url", F.lit("")).rlike(fv.LOGIN_LANDING_URL) | any_contains(
        col("_hay"), fv.LOGIN_TEXT
    )
    away = (F.coalesce("requested_url", F.lit("")) != "") & ~same_target("requested_url", "landed_url")
    flagged = (
        navigations.withColumn("_hay", hay)
        .withColumn("_marker", F.get(found, F.lit(0)))
        .withColumn("_login", login)
        .withColumn("_away", away)
    )
    challenge = F.coalesce("has_challenge", F.lit(False))
    auth = col("_login") & (col("_away") | F.coalesce("has_password", F.lit(False)))
    kind = (
        F.when(challenge | col("_marker").isNotNull(), "captcha").when(auth, "auth").otherwise("ok")
    )
    reason = (
        F.when(challenge, F.lit("anti-bot challenge widget detected"))
        .when(
            col("_marker").isNotNull(),
            F.concat(F.lit("anti-bot challenge page ("), col("_marker"), F.lit(")")),
        )
        .when(auth & col("_away"), F.lit("redirected to a sign-in page"))
        .when(auth, F.lit("this page requires sign-in"))
        .otherwise("")
    )
    return (
        flagged.withColumn("kind", kind)
        .withColumn("reason", reason)
        .drop("_hay", "_marker", "_login", "_away")
    )


def gates_by_site(gates: DataFrame) -> DataFrame:
    site = urls.registrable_domain(urls.parts_of("requested_url")["host"])
    return gates.groupBy(site.alias("site"), "kind").agg(F.count(F.lit(1)).alias("navigations"))


@built_once
def _withheld() -> Column:
    """Reasons to withhold a page, as an array of ``struct<kind, label>``."""
    col = F.col
    path = text.ascii_words(fv.SENSITIVE_PATH)
    body = text.stripped_text(
        F.regexp_replace("html", r"(?is)<head\b.*?</head>", " ")
    )
    forms = F.regexp_extract_all("markup", F.lit(r"(?i)<form\b([^>]*)>"), F.lit(1))

    def attr_text(tag: Column, names: tuple[str, ...]) -> Column:
        return let(
            text.attribute_tokens(tag),
            lambda t: F.concat_ws(" ", *[text.attribute(t, n) for n in names]),
        )

    form_text = F.transform(forms, lambda tag: attr_text(tag, ("action", "name", "id", "aria-label")))
    inputs = F.regexp_extract_all(
        "markup", F.lit(r"(?i)<(?:input|select|textarea|button)\b([^>]*)>"), F.lit(1)
    )
    field_text = F.transform(
        inputs, lambda tag: attr_text(tag, ("name", "type", "autocomplete", "placeholder", "id"))
    )
    one = lambda test, kind, label: F.when(
        F.coalesce(test, F.lit(False)),
        F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label")),
    )
    in_form = F.exists(form_text, lambda t: t.rlike(path) | t.rlike(fv.SENSITIVE_FIELD))
    in_field = (F.size(forms) > 0) & F.exists(field_text, lambda t: t.rlike(fv.SENSITIVE_FIELD))
    in_text = let(
        body,
        lambda b: matches(b, F.lower(b), fv.SENSITIVE_TEXT, fv.SENSITIVE_TEXT_WORDS)
        | b.rlike(text.ascii_words(fv.LONG_DIGITS)),
    )
    return F.array_compact(
        F.array(
            one(col("url").rlike(path), "page", "Sensitive URL"),
            one(col("title").rlike(fv.SENSITIVE_TEXT), "page", "Sensitive title"),
            one(in_form, "form", "Sensitive form"),
            one(in_field, "field", "Sensitive field"),
            one(in_text, "text", "Sensitive page text"),
        )
    )


def privacy_withhold(captures: DataFrame) -> DataFrame:
    """Long table ``capture_id, url, kind, label`` of the reasons to withhold pages."""
    return unnest(page_facts(captures, "markup"), ["capture_id", "url"], _withheld(), "kind")


def releasable(captures: DataFrame) -> DataFrame:
    """Captures that no reason withholds; decided in the row, so no join is needed."""
    marked = page_facts(captures, "markup").withColumn("_reasons", F.size(_withheld()))
    return marked.filter(F.col("_reasons") == 0).drop("_reasons", "markup")
