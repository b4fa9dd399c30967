"""Pieces of DuckDB SQL shared by the checks, written apart from the library."""

from __future__ import annotations

SPACE = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def rendered(html: str) -> str:
    out = sub(html, r"(?s)<!--.*?-->", " ")
    blocks = "|".join(
        rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "template", "svg", "math")
    )
    return sub(out, f"(?is){blocks}", " ")


def trim(text: str) -> str:
    return sub(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: str) -> str:
    return sub(text, f"{SPACE}+", " ")


def decode(text: str) -> str:
    for entity, to in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"),
    ):
        text = sub(text, f"(?i){entity}", to)
    return text


def clean(text: str) -> str:
    return decode(trim(squeeze(sub(text, "<[^>]+>", " "))))


def stripped(html: str) -> str:
    blocks = "|".join(rf"<{tag}\b.*?</{tag}>" for tag in ("script", "style", "noscript"))
    return trim(squeeze(sub(sub(html, f"(?is){blocks}", " "), "<[^>]+>", " ")))


def encoded_path(path: str) -> str:
    return f"replace(replace(replace(url_encode({path}), '%2F', '/'), '%2C', ','), '%3A', ':')"


def last_two(host: str) -> str:
    return rf"regexp_extract({host}, '([^.]+\.[^.]+)$', 1)"


def lit(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"
