"""Markup and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .expr import apply_sql, cut, let, sql_let, sql_text

_ATTRIBUTE = (
    r"""[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
)


# what surrounds the bare value in name="value", name='value' and name=value
_NAME_AND_QUOTES = r"""(?s)^[^=]*=\s*["']?|["']$"""
_WORD = "[A-Za-z0-9_]"


def ascii_words(pattern: str) -> str:
    """Make ``\\b`` look at ASCII letters only, as the patterns expect.

    All patterns given here start and end with word characters, so the boundary before the
    words is a look-behind and the one after them a look-ahead.
    """
    head, *rest = pattern.split(r"\b")
    for i, piece in enumerate(rest):
        leads = "(" in "".join(rest[i:])
        head += (f"(?<!{_WORD})" if leads else f"(?!{_WORD})") + piece
    return head


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{fv.WS}+|{fv.WS}+$", "")


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"{fv.WS}+", " ")


def rendered_markup(html: Column) -> Column:
    """Markup without comments and without script, style, template, svg and math blocks."""
    no_comments = F.regexp_replace(html, fv.COMMENT, " ")
    return F.regexp_replace(no_comments, fv.NON_RENDERED, " ")


def _decoded(text: str, skip: tuple[str, ...] = ()) -> str:
    """SQL: entities replaced one after the other, so ``&amp;lt;`` decodes twice."""
    out = "t"
    for entity, char in fv.ENTITIES:
        if entity not in skip:
            out = f"regexp_replace({out}, {sql_text('(?i)' + entity)}, {sql_text(char)})"
    return sql_let(text, "t", f"if(contains(t, '&'), {out}, t)")


def decode_entities(text: Column, skip: tuple[str, ...] = ()) -> Column:
    return apply_sql(_decoded("v", skip), text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def clean_text(text: Column, limit: int | None) -> Column:
    """Visible text of a fragment: tags out, spaces collapsed, trimmed, then decoded and cut."""
    bare = "regexp_replace(v, '<[^>]+>', ' ')"
    single = f"regexp_replace({bare}, {sql_text(fv.WS + '+')}, ' ')"
    trimmed = f"regexp_replace({single}, {sql_text(f'^{fv.WS}+|{fv.WS}+$')}, '')"
    body = _decoded(trimmed)
    if limit is not None:
        cut_off = f"if(length(d) > {limit}, concat(substring(d, 1, {limit - 3}), '...'), d)"
        body = sql_let(body, "d", cut_off)
    return apply_sql(body, text)


def attribute_tokens(tag: Column) -> Column:
    """Attributes of one tag as raw ``name=value`` tokens, in order."""
    return F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))


def has_attribute(tokens: Column, name: str) -> Column:
    return F.exists(tokens, lambda t: t.rlike(rf"(?i)^{name}(?:\s*=|$)"))


def attribute(tokens: Column, name: str) -> Column:
    """Value of the last attribute called ``name``: '' when it has none, NULL when absent."""
    named = sql_text(rf"(?i)^{name}(?:\s*=|$)")
    raw = f"if(contains(k, '='), regexp_replace(k, {sql_text(_NAME_AND_QUOTES)}, ''), '')"
    value = f"case when k is not null then {_decoded(raw)} end"
    last = f"try_element_at(filter(v, x -> x rlike {named}), -1)"
    return apply_sql(sql_let(last, "k", value), tokens)


def title_of(html: Column, limit: int | None = None) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return F.when(raw != "", clean_text(raw, limit))


def capture_title(html: Column, limit: int | None = None) -> Column:
    """The title stored with a capture: trimmed, not decoded."""
    raw = cut(trim_ws(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), limit)
    return F.when(raw != "", raw)


def meta_description(html: Column, limit: int | None = None) -> Column:
    """Content of the first named description, else of the first ``og:description``."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b([^>]*)>"), F.lit(1))
    metas = F.transform(
        tags,
        lambda tag: let(
            attribute_tokens(tag),
            lambda tokens: F.struct(
                F.lower(
                    F.coalesce(
                        F.nullif(attribute(tokens, "name"), F.lit("")),
                        attribute(tokens, "property"),
                        F.lit(""),
                    )
                ).alias("name"),
                F.coalesce(attribute(tokens, "content"), F.lit("")).alias("content"),
            ),
        ),
    )

    def pick(found: Column) -> Column:
        def content(name: str) -> Column:
            hits = F.filter(found, lambda m: (m["name"] == name) & (m["content"] != ""))
            return F.get(hits, F.lit(0))["content"]

        return F.coalesce(content("description"), content("og:description"))

    return clean_text(let(metas, pick), limit)


def text_sample(html: Column, limit: int | None = None) -> Column:
    body = html
    for tag in ("script", "style", "svg"):
        body = F.regexp_replace(body, f"(?is)<{tag}.*?</{tag}>", " ")
    return clean_text(body, limit)


def stripped_text(html: Column) -> Column:
    """Text used to judge how much a page shows."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    return trim_ws(collapse_ws(strip_tags(body)))


def readable_text(html: Column, limit: int | None = None) -> Column:
    """Readable text with line breaks at block ends."""
    body = F.regexp_replace(html, fv.COMMENT, " ")
    for tag in ("script", "style", "head", "noscript", "svg"):
        body = F.regexp_replace(body, f"(?is)<{tag}.*?</{tag}>", " ")
    body = F.regexp_replace(
        body, r"(?i)</(p|div|li|h[1-6]|tr|section|article|header|footer)>", "\n"
    )
    body = F.regexp_replace(body, r"(?i)<br\s*/?>", "\n")
    body = decode_entities(strip_tags(body), skip=("&#x27;",))
    body = F.regexp_replace(body, r"[ \t]+", " ")
    body = F.regexp_replace(body, rf"\n{fv.WS}*\n{fv.WS}*\n+", "\n\n")
    body = F.regexp_replace(body, rf"(?m)^[^\S\n]+|[^\S\n]+$", "")
    body = trim_ws(body)
    if limit is None:
        return body
    return let(
        body,
        lambda t: F.when(
            F.length(t) > limit, F.concat(cut(t, limit), F.lit("\n\n...[truncated]"))
        ).otherwise(t),
    )


def redact_inputs(html: Column) -> Column:
    """Blank the value attribute of credential-like inputs; nothing else changes."""
    tags = F.array_distinct(
        F.filter(
            F.regexp_extract_all(html, F.lit(r"(?i)<input\b[^>]*>"), F.lit(0)),
            lambda tag: tag.rlike(fv.SENSITIVE_INPUT) & tag.rlike(fv.INPUT_VALUE_ATTR),
        )
    )
    blanked = F.aggregate(
        tags,
        html,
        lambda doc, tag: F.replace(
            doc,
            tag,
            F.regexp_replace(tag, fv.INPUT_VALUE_ATTR, f' value="{fv.REDACTED}"'),
        ),
    )
    return F.when(F.size(tags) > 0, blanked).otherwise(html)


def redaction_count(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<input\b[^>]*>"), F.lit(0))
    return F.size(
        F.filter(
            tags, lambda tag: tag.rlike(fv.SENSITIVE_INPUT) & tag.rlike(fv.INPUT_VALUE_ATTR)
        )
    )
