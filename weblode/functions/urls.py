"""URL expressions that follow the web platform's parsing rules for http(s).

Lower-case scheme and host, default ports dropped, dot segments resolved, unsafe and
non-ASCII characters percent-encoded.  Everything stays a column expression, so it runs
inside the scan stage.  Not covered: punycode for non-ASCII host names (kept as they are).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .expr import apply_sql, built_once, let, sql_let, sql_text

_SEP = chr(1)
_CUT = _SEP.join(["$1", "$2", "$3", "$4", "$5"])
_EDGE_SPACE = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]+"
_HTTP = r"(?is)^(https?):[/\\]+([^/\\?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_BAD_PATH = r'[^\x21\x24-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e]'
_BAD_QUERY = r"""[^\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e]"""
_BAD_FRAGMENT = r'[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e]'
_VALID_HOST = r"""^(?:\[[0-9a-f:.]+\]|[^\x00-\x20#%/<>?@\\^`{|}":\[\]]+)$"""
_DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
_ONE_DOT = r"(?i)^(?:\.|%2e)$"
_TWO_DOTS = r"(?i)^(?:\.|%2e){2}$"


def _escape(text: str, unsafe: str) -> str:
    """SQL: percent-encode what matches ``unsafe``; untouched text costs one test."""
    pattern = sql_text(unsafe)
    one = f"if(c rlike {pattern}, regexp_replace(hex(encode(c, 'UTF-8')), '(..)', '%$1'), c)"
    whole = f"if(t rlike {pattern}, array_join(transform(split(t, ''), c -> {one}), ''), t)"
    return sql_let(text, "t", whole)


def _without_dots(path: str) -> str:
    """SQL: resolve ``.`` and ``..`` segments."""
    two, one, either = (sql_text(x) for x in (_TWO_DOTS, _ONE_DOT, _DOT_SEGMENT))
    step = f"""(done, seg) -> case
        when seg rlike {two} then slice(done, 1, greatest(size(done) - 1, 0))
        when seg rlike {one} then done
        else concat(done, array(seg)) end"""
    ends_open = f"element_at(segs, -1) rlike {one} or element_at(segs, -1) rlike {two}"
    folded = f"""concat('/', array_join(concat(
        aggregate(segs, cast(array() as array<string>), {step}),
        if({ends_open}, array(''), cast(array() as array<string>))), '/'))"""
    resolved = sql_let("split(substring(p, 2), '/', -1)", "segs", folded)
    return sql_let(path, "p", f"if(p rlike {either}, {resolved}, p)")


def _numeric_host(host: str) -> str:
    """SQL: dotted form of a host written as decimal, octal or hexadecimal numbers.

    ``http://2130706433/`` and ``http://0x7f.1/`` both name 127.0.0.1.
    """
    number = r"""try_cast(try_cast(case
        when part rlike '^0x[0-9a-f]*$' then conv(concat('0', substring(part, 3)), 16, 10)
        when part rlike '^0[0-7]+$' then conv(part, 8, 10)
        when part rlike '^(0|[1-9][0-9]*)$' then part end as decimal(20, 0)) as bigint)"""
    room = "element_at(array(4294967296L, 16777216L, 65536L, 256L), size(n))"
    lead = "slice(n, 1, size(n) - 1)"
    value = f"""case when size(n) <= 4 and not exists(n, x -> x is null) then
        case when not exists({lead}, x -> x > 255) and element_at(n, -1) < {room}
          then aggregate({lead}, 0L, (acc, x) -> acc * 256 + x) * {room} + element_at(n, -1) end end"""
    octets = ", ".join(f"cast(shiftright(a, {k}) & 255 as string)" for k in (24, 16, 8, 0))
    dotted = f"case when a is not null then concat_ws('.', {octets}) end"
    numbers = f"transform(split(rtrim('.', h), '[.]'), part -> {number})"
    converted = sql_let(sql_let(numbers, "n", value), "a", dotted)
    ends_in_number = r"h rlike '^(?:[^\\[]*[.])?(?:[0-9]+|0x[0-9a-f]*)[.]?$'"
    return sql_let(host, "h", f"if({ends_in_number}, {converted}, h)")


def _parts_text() -> str:
    """SQL over ``v``: a URL taken apart, or NULL unless it is a valid http(s) URL."""
    # the slash in the middle is a backslash in URLs written by hand
    path = r"regexp_replace(p[2], '\\\\', '/')"
    taken = f"""named_struct(
        'scheme', lower(p[0]),
        'host', {_numeric_host("regexp_replace(a, ':[0-9]*$', '')")},
        'port', regexp_replace(regexp_extract(a, ':([0-9]*)$', 1), '^0+(?=.)', ''),
        'path', {_without_dots(_escape(path, _BAD_PATH))},
        'query', {_escape("p[3]", _BAD_QUERY)},
        'fragment', {_escape("p[4]", _BAD_FRAGMENT)})"""
    fields = sql_let("lower(regexp_replace(p[1], '^.*@', ''))", "a", taken)
    port = "if(concat_ws(':', f.scheme, f.port) in ('http:80', 'https:443'), '', f.port)"
    valid = f"""f.host rlike {sql_text(_VALID_HOST)}
        and (f.port = '' or try_cast(f.port as bigint) <= 65535)"""
    finished = f"""case when {valid} then named_struct(
        'scheme', f.scheme, 'host', f.host, 'port', {port},
        'origin', concat(f.scheme, '://', f.host, if({port} = '', '', concat(':', f.port))),
        'path', if(f.path = '', '/', f.path), 'query', f.query, 'fragment', f.fragment) end"""
    cut = f"split(regexp_replace({_tidy('v')}, {sql_text(_HTTP)}, {sql_text(_CUT)}), {sql_text(_SEP)}, -1)"
    return sql_let(cut, "p", f"case when size(p) = 5 then {sql_let(fields, 'f', finished)} end")


def _tidy(url: str) -> str:
    return f"regexp_replace({url}, {sql_text(_EDGE_SPACE)}, '')"


def parts(url: Column) -> Column:
    """Struct of ``scheme, host, port, origin, path, query, fragment``; NULL unless a valid http(s) URL.

    ``query`` keeps its ``?`` and ``fragment`` its ``#``; ``host`` excludes the port.
    """
    return apply_sql(_PARTS, url)


@built_once
def parts_of(column: str) -> Column:
    """``parts`` of a named column."""
    return parts(F.col(column))


def href_of(p: Column) -> Column:
    return F.concat(p["origin"], p["path"], p["query"], p["fragment"])


def path_of(href: Column) -> Column:
    """Path of an already canonical URL."""
    return F.regexp_extract(href, r"^https?://[^/?#]*([^?#]*)", 1)


def origin_of(href: Column) -> Column:
    """Origin of an already canonical URL (user information never counts)."""
    return F.regexp_extract(href, r"^(https?://[^/?#]*)", 1)


def query_of(href: Column) -> Column:
    """Query of an already canonical URL, with its ``?``."""
    return F.regexp_extract(href, r"^[^?#]*(\?[^#]*)", 1)


def canonical(url: Column) -> Column:
    return let(parts(url), href_of)


def _joined_text() -> str:
    """SQL over ``v`` (``href``, ``base``): the text of the address a link points to."""
    folder = "regexp_replace(b.path, '[^/]*$', '')"
    same_scheme = "lower(substring_index(h, ':', 1)) = b.scheme"
    bare = "regexp_replace(h, '^[^:]*:', '')"
    return sql_let(
        "v.base",
        "b",
        sql_let(
            _tidy("v.href"),
            "h",
            rf"""case
              when b is null then null
              when h rlike '(?i)^https?:[/\\\\]' then h
              when h rlike '(?i)^https?:' and {same_scheme} then concat(b.origin, {folder}, {bare})
              when h rlike '(?i)^https?:' then concat(substring_index(h, ':', 1), '://', {bare})
              when h rlike '^[a-zA-Z][a-zA-Z0-9+.-]*:' then null
              when h rlike '^[/\\\\][/\\\\]' then concat(b.scheme, ':', h)
              when h rlike '^[/\\\\]' then concat(b.origin, h)
              when h like '?%' then concat(b.origin, b.path, h)
              when h like '#%' then concat(b.origin, b.path, b.query, h)
              when h = '' then concat(b.origin, b.path, b.query)
              else concat(b.origin, {folder}, h) end""",
        ),
    )


def resolve_parts(href: Column, base: Column) -> Column:
    """Parts of ``href`` seen from ``base`` (a struct made by ``parts``); NULL if not http(s)."""
    return parts(apply_sql(_JOINED, F.struct(href.alias("href"), base.alias("base"))))


def absolute(href: Column, base: Column) -> Column:
    """Absolute URL text; NULL for an empty href or any scheme but http(s)."""
    return let(
        href, lambda h: F.when(h != "", let(resolve_parts(h, base), href_of))
    )


def base_of(markup: Column, page: Column) -> Column:
    """Parts of the address relative links start from: first ``<base href>``, else ``page`` parts."""
    tag = F.regexp_extract(F.regexp_replace(markup, fv.COMMENT, " "), r"(?i)<base\b[^>]*>", 0)
    value = r"""(?is)^.*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)).*$"""

    def of_href(href: Column) -> Column:
        return F.when(href != "", F.coalesce(resolve_parts(href, page), page)).otherwise(page)

    href = let(tag, lambda t: F.when(t.rlike(value), F.regexp_replace(t, value, "$1$2$3")).otherwise(""))
    return let(href, of_href)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def form_decode(text: Column) -> Column:
    """Decode ``+`` and ``%xx``; text with a broken escape is kept as written."""
    return F.when(
        text.rlike("[%+]"), F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))
    ).otherwise(text)


def query_pairs(query: Column) -> Column:
    """Ordered ``array<struct<name, value>>`` of a query string, with or without its ``?``."""
    body = F.regexp_replace(query, r"^\?", "")
    return F.transform(
        F.filter(F.split(body, "&"), lambda kv: kv != ""),
        lambda kv: F.struct(
            form_decode(F.regexp_replace(kv, "(?s)=.*$", "")).alias("name"),
            form_decode(
                F.when(F.contains(kv, F.lit("=")), F.regexp_replace(kv, "(?s)^[^=]*=", "")).otherwise("")
            ).alias("value"),
        ),
    )


def query_keys(query: Column) -> Column:
    return F.array_distinct(F.transform(query_pairs(query), lambda p: p["name"]))


def first_values(query: Column) -> Column:
    """One ``struct<name, value>`` per parameter, holding its first value."""

    def first(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("name"),
                F.get(F.filter(pairs, lambda p: p["name"] == n), F.lit(0))["value"].alias("value"),
            ),
        )

    return let(query_pairs(query), first)


def encode_query(pairs: Column) -> Column:
    return F.array_join(
        F.transform(
            pairs,
            lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])),
        ),
        "&",
    )


def encode_component(text: Column) -> Column:
    """Percent-encoding for one path value."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def template_path(path: Column) -> Column:
    """Path with identifiers replaced by ``{id}``, ``{id2}`` and so on."""

    def step(acc: Column, seg: Column) -> Column:
        hit = seg.rlike(fv.CALL_ID_SEGMENT)
        name = F.concat(
            F.lit("{id"),
            F.when(acc["n"] == 0, F.lit("")).otherwise((acc["n"] + 1).cast("string")),
            F.lit("}"),
        )
        return F.struct(
            (acc["n"] + F.when(hit, 1).otherwise(0)).alias("n"),
            F.concat(acc["out"], F.array(F.when(hit, name).otherwise(seg))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(
        F.split(path, "/", -1), start, step, lambda acc: F.array_join(acc["out"], "/")
    )
    return F.when(folded == "", F.lit("/")).otherwise(folded)


def registrable_domain(host: Column) -> Column:
    """Last two labels of a host name."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda s: s != "")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def normalized_pattern(pattern: Column) -> Column:
    """Endpoint path used for coverage: no query, ``{{x}}`` as ``{x}``, always rooted."""
    text = F.regexp_replace(F.coalesce(pattern, F.lit("")), r"\{\{(\w+)\}\}", "{$1}")
    text = F.regexp_replace(text, r"(?s)\?.*$", "")
    text = F.when(
        text.rlike("(?i)^https?:"), F.coalesce(parts(text)["path"], text)
    ).otherwise(text)
    return (
        F.when(text == "", F.lit("/"))
        .when(F.startswith(text, F.lit("/")) | (text == "APPSTATE"), text)
        .otherwise(F.concat(F.lit("/"), text))
    )


def endpoint_signature(method: Column, pattern: Column) -> Column:
    verb = F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit("GET")))
    return F.concat_ws(" ", verb, normalized_pattern(pattern))


def looks_like_id(segment: Column) -> Column:
    out = F.lit(False)
    for pattern in fv.ID_SEGMENTS:
        out = out | segment.rlike(pattern)
    return out


def singular(word: Column) -> Column:
    out = F.when(F.lit(False), word)
    for ending, replacement in fv.PLURAL_ENDINGS:
        out = out.when(word.rlike(ending), F.regexp_replace(word, ending, replacement))
    return out.otherwise(word)


def snake_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "(?i)[^a-z0-9]+", "_"), "^_+|_+$", ""))


def call_name(method: Column, pattern: Column) -> Column:
    """Readable name for an endpoint: verb plus its last two telling segments."""
    named = F.filter(
        F.split(pattern, "/"), lambda s: (s != "") & ~F.startswith(s, F.lit("{"))
    )

    def build(all_segments: Column) -> Column:
        telling = F.filter(all_segments, lambda s: ~s.rlike(fv.GENERIC_SEGMENT))
        used = F.when(F.size(telling) > 0, telling).otherwise(all_segments)
        tail = F.when(F.size(used) > 2, F.slice(used, -2, 2)).otherwise(used)
        joined = F.array_join(tail, "_")
        base = F.when(joined == "", F.lit("endpoint")).otherwise(joined)
        name = F.concat_ws("_", F.lower(method), F.regexp_replace(base, "(?i)[^a-z0-9]+", "_"))
        return F.lower(F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_|_$", ""))

    return let(
        let(named, build),
        lambda n: F.when(n.rlike("^[a-z]"), n).otherwise(F.concat(F.lit("call_"), n)),
    )


_PARTS = _parts_text()
_JOINED = _joined_text()
