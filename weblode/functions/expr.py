"""Small building blocks for expressions over arrays inside one row.

A page, a call log line or a specification is one row, so most mining is done with array
functions in place: no explode, no shuffle, one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column that ``make`` builds.

    A column is only a description and holds no data, but describing a long expression means
    thousands of calls into the JVM; jobs that name their inputs can share it.
    """
    return lru_cache(maxsize=None)(make)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def sql_text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_let(value: str, name: str, body: str) -> str:
    """SQL form of ``let``."""
    return f"transform(array({value}), {name} -> {body})[0]"


@lru_cache(maxsize=None)
def _lambda(body: str) -> Column:
    return F.expr(f"v -> {body}")


def apply_sql(body: str, value: Column) -> Column:
    """Evaluate SQL text over the variable ``v`` bound to ``value``.

    For expressions used all over the library: the text is parsed once per process, where the
    same expression put together call by call would be rebuilt for every use.
    """
    return F.call_function("transform", F.array(value), _lambda(body))[0]


def keep_first(array: Column) -> Column:
    """Keep the first of each key in an array of ``struct<key, pos, ...>``, in ``pos`` order.

    Sorting puts equal keys next to each other, so the pass is n log n rather than the
    quadratic look-back a position search would need.
    """

    def distinct(sorted_rows: Column) -> Column:
        fresh = F.filter(
            sorted_rows,
            lambda row, i: (i == 0)
            | (F.get(sorted_rows, i - 1)["key"] != row["key"]),
        )
        return fresh

    first = let(F.array_sort(array), distinct)
    by_pos = F.transform(first, lambda r: F.struct(r["pos"].alias("pos"), r.alias("row")))
    return F.transform(F.array_sort(by_pos), lambda r: r["row"])


def head(array: Column, n: int | None) -> Column:
    """First ``n`` elements, or all of them when ``n`` is None."""
    return array if n is None else F.slice(array, 1, n)


def cut(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def first_where(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def any_contains(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def matches(hay: Column, low: Column, pattern: str, words: list[str]) -> Column:
    """``hay rlike pattern`` behind a cheap test.

    ``low`` is ``hay`` in lower case; every match of ``pattern`` holds one of ``words``, and a
    substring search is far cheaper than trying every alternative at every character.
    """
    return any_contains(low, words) & hay.rlike(pattern)
