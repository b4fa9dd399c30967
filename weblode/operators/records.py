"""Records extracted from pages: products, listings and page metadata."""

from __future__ import annotations

import bisect
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import built_once, cut, head, keep_first, let
from ..functions.rows import unnest
from .health import releasable
from .pages import headings_of, page_facts

_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
_CARD_TAGS = {"article", "li", "div"}
_CARD = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.LongType()),
            T.StructField("href", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("price", T.StringType()),
            T.StructField("rating", T.StringType()),
        ]
    )
)


class _PageReader(HTMLParser):
    """The elements of a page as intervals: each has its place in document order, the place after its last descendant, and the
    part of the page's text that it spans. One pass, whatever is nested in what."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.length = 0
        #: tag, attributes, text start, text end, place after the last descendant; the index is the place.
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.hidden = 0
        self.cards: list[int] = []
        #: Links and the nearest open card of each.
        self.links: list[tuple[int, int | None]] = []
        self.link: int | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "template"):
            self.hidden += 1
        given = dict(attrs)
        at = len(self.nodes)
        self.nodes.append([tag, given, self.length, None, None])
        if tag == "a" and given.get("href"):
            if self.link is not None and self.nodes[self.link][3] is None:
                self.nodes[self.link][3:] = [self.length, at]  # a link ends where the next one begins
            self.link = at
            self.links.append((at, self.cards[-1] if self.cards else None))
        if tag in _VOID:
            self.nodes[at][3:] = [self.length, at + 1]
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(at)
        if tag in _CARD_TAGS:
            self.cards.append(at)

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def _close(self, depth: int) -> None:
        for at in reversed(self.open[depth:]):
            node = self.nodes[at]
            if node[3] is None:
                node[3:] = [self.length, len(self.nodes)]
            self.places[node[0]].pop()
            if node[0] in ("script", "style", "template"):
                self.hidden -= 1
            if self.cards and self.cards[-1] == at:
                self.cards.pop()
        del self.open[depth:]

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            self.length += len(data)

    def read(self, doc: str) -> _PageReader:
        try:
            self.feed(doc)
            self.close()
        except (AssertionError, ValueError):
            pass  # the parser gives up on some broken declarations; what was read still counts
        self._close(0)
        return self


class _Shown:
    """The text of a page with white space squeezed, its spans, and the first price and rating within a span."""

    def __init__(self, page: _PageReader):
        raw = "".join(page.parts)
        gaps = [(m.start(), m.end()) for m in re.finditer(r"\s+", raw)]
        self.text = re.sub(r"\s+", " ", raw)
        self.gap_starts = [a for a, _ in gaps]
        self.gap_ends = [b for _, b in gaps]
        lost, self.lost = 0, [0]
        for a, b in gaps:
            lost += b - a - 1
            self.lost.append(lost)
        self.found = [[(m.start(), m.end()) for m in p.finditer(self.text)] for p in (_PRICE, _RATING)]
        self.found_ends = [[b for _, b in own] for own in self.found]

    def at(self, place: int) -> int:
        """Place in the squeezed text of a place in the raw one."""
        before = bisect.bisect_left(self.gap_starts, place)
        if before and place < self.gap_ends[before - 1]:  # inside a gap, of which one blank stays
            return self.gap_starts[before - 1] - self.lost[before - 1] + 1
        return place - self.lost[before]

    def span(self, start: int, end: int, most: int | None = None) -> str:
        """Text between two places of the raw text; at most its first ``most`` characters."""
        a, b = self.at(start), self.at(end)
        a += a < b and self.text[a] == " "
        return (self.text[a:b] if most is None else self.text[a : min(b, a + most)]).strip()

    def first(self, kind: int, start: int, end: int) -> str:
        """First match of a pattern within a span, as if there were nothing around it.

        Matches of the whole text serve but at the span's ends, where a piece of bounded length is searched anew.
        """
        a, b = self.at(start), self.at(end)
        found, pattern, text = self.found[kind], (_PRICE, _RATING)[kind], self.text
        i = bisect.bisect_right(self.found_ends[kind], a)
        edge = min(b, a + NEAR if i == len(found) or found[i][0] >= a else found[i][1] + NEAR)
        head = pattern.search(text[a:edge])
        if head and (head.end() < edge - a or edge == b):
            return head[0]
        while i < len(found) and found[i][0] < a:
            i += 1
        inside = pattern.match(text, found[i][0], b) if i < len(found) and found[i][0] < b else None
        tail = pattern.search(text, b - NEAR, b) if b - NEAR > a else pattern.search(text[a:b])
        starts = [(m.start() + (a if m is tail and b - NEAR <= a else 0), m[0]) for m in (inside, tail) if m]
        return min(starts)[1] if starts else ""


#: Characters beside an end of a span that are searched anew; a rating is shorter.
NEAR = 32
_PRICE = re.compile(fv.PRICE_TEXT, re.ASCII)
_RATING = re.compile(fv.RATING_TEXT, re.ASCII)


def listed_links(doc: str) -> list[dict]:
    """Links of a page, each with its text and the first price and rating that its nearest card shows."""
    page = _PageReader().read(doc)
    shown = _Shown(page)
    cards: dict[int | None, tuple[str, str]] = {None: ("", "")}
    rows = []
    for pos, (at, card) in enumerate(page.links):
        if card not in cards:
            _, _, start, end, _ = page.nodes[card]
            cards[card] = (shown.first(0, start, end), shown.first(1, start, end))
        _, given, start, end, _ = page.nodes[at]
        price, rating = cards[card]
        rows.append({"pos": pos, "href": given["href"], "text": shown.span(start, end), "price": price, "rating": rating})
    return rows


@F.pandas_udf(_CARD)
def read_cards(html: pd.Series) -> pd.Series:
    """Links with the price and rating that their nearest article, li or div shows.

    What is returned, and the work, grows with the page, not with links times cards.
    """
    return html.map(lambda doc: listed_links(doc) if doc else [])


def _first_text(pattern: str) -> Column:
    """Text of the first element whose opening tag matches ``pattern``."""
    whole = F.regexp_extract("markup", rf"(?is)<([a-z][a-z0-9]*)\b(?=[^>]*{pattern})[^>]*>(.*?)</\1\s*>", 2)
    return F.nullif(text.clean_text(whole, None), F.lit(""))


def _item_property(name: str) -> str:
    return rf"""\bitemprop\s*=\s*["']?{name}\b"""


def _class_word(name: str) -> str:
    return rf"""\bclass\s*=\s*["'][^"']*(?<![\w-]){name}(?![\w-])"""


def _test_id(name: str) -> str:
    return rf"""\bdata-testid\s*=\s*["']{name}["']"""


def _id(name: str) -> str:
    return rf"""\bid\s*=\s*["']?{name}\b"""


@built_once
def _product() -> Column:
    p = F.col("linked_data.product")
    given = lambda name: F.nullif(p[name], F.lit(""))
    heading = F.nullif(
        text.clean_text(F.regexp_extract("markup", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), None), F.lit("")
    )
    currency_tag = F.regexp_extract(
        "markup", rf"(?i)<[a-z]+\b(?=[^>]*{_item_property('priceCurrency')})([^>]*)>", 1
    )
    empty = F.lit("")
    return F.struct(
        F.coalesce(given("title"), heading, _first_text(_id("title")), _first_text(_test_id("product-title")), empty).alias("title"),
        F.coalesce(given("sku"), F.regexp_extract("here.path", fv.SKU_PATH, 1)).alias("sku"),
        F.coalesce(
            given("price"),
            _first_text(_class_word("a-offscreen")),
            _first_text(_item_property("price")),
            _first_text(_test_id("price")),
            _first_text(_class_word("price")),
            empty,
        ).alias("price"),
        F.coalesce(given("currency"), text.attribute(text.attribute_tokens(currency_tag), "content"), empty).alias("currency"),
        F.coalesce(
            text.trim_ws(F.regexp_replace(given("availability"), r"(?s)^.*/", "")),
            _first_text(_id("availability")),
            _first_text(r"\bdata-availability\b"),
            _first_text(_class_word("availability")),
            empty,
        ).alias("availability"),
        F.coalesce(
            given("rating"),
            _first_text(_test_id("rating")),
            _first_text(_class_word("a-icon-alt")),
            _first_text(_item_property("ratingValue")),
            empty,
        ).alias("rating"),
        F.coalesce(
            given("review_count"),
            _first_text(_id("acrCustomerReviewText")),
            _first_text(_item_property("reviewCount")),
            empty,
        ).alias("review_count"),
        F.coalesce(given("brand"), _first_text(_test_id("brand")), _first_text(_item_property("brand")), empty).alias("brand"),
        F.coalesce(p["images"], F.array().cast("array<string>")).alias("images"),
    )


def product_records(captures: DataFrame, guard: bool = True) -> DataFrame:
    """One product record per page: linked data first, then markup."""
    pages = releasable(captures) if guard else captures
    facts = page_facts(pages, "here", "markup", "linked_data")
    return facts.withColumn("p", _product()).select("capture_id", "url", "p.*")


@built_once
def _listing(top: int | None) -> Column:
    def row(card: Column, base: Column) -> Column:
        return F.struct(
            urls.absolute(card["href"], base).alias("key"),
            card["pos"].alias("pos"),
            card["text"].alias("title"),
            card["price"].alias("price"),
            card["rating"].alias("rating"),
        )

    found = F.filter(
        let(F.col("base"), lambda base: F.transform("cards", lambda card: row(card, base))),
        lambda r: (r["title"] != "") & F.coalesce(r["key"].rlike(fv.LISTING_HREF), F.lit(False)),
    )
    first = keep_first(found)
    return first if top is None else F.slice(first, 1, top)


def listing_records(captures: DataFrame, top: int | None = None, guard: bool = True) -> DataFrame:
    """Items a page lists: product-like links with the price and rating of their card."""
    pages = releasable(captures) if guard else captures
    # a page without any product segment, in its links or in what they are resolved against, lists nothing
    shaped = F.concat_ws(" ", "html", urls.href_of(F.col("base"))).rlike(r"(?i)\b(dp|products?|item|items|itm|sku|p)\b")
    facts = page_facts(pages, "base").withColumn("cards", read_cards(F.when(shaped, F.col("html"))))
    return unnest(facts, ["capture_id"], _listing(top), "pos").select(
        "capture_id", "pos", "title", F.col("key").alias("url"), "price", "rating"
    )


def card_records(
    captures: DataFrame, card_class: str, scan: int | None = None, top: int | None = None, guard: bool = True,
    title_length: int | None = None, text_length: int | None = None,
) -> DataFrame:
    """Items a page lists in elements of one class (innermost closing tag), distinct by content."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", card_class):
        raise ValueError("card_class is one class name")
    pages = releasable(captures) if guard else captures
    facts = page_facts(pages, "base")
    pattern = rf"(?is)<([a-z][a-z0-9]*)\b(?=[^>]*{_class_word(card_class)})[^>]*>.*?</\1\s*>"
    cards = F.regexp_extract_all("markup", F.lit(pattern), F.lit(0))
    if scan is not None:
        cards = F.slice(cards, 1, scan)

    def row(card: Column, pos: Column, base: Column) -> Column:
        body = text.clean_text(card, None)
        heading = text.clean_text(
            F.regexp_extract(card, r"""(?is)<(h[1-5]|[a-z]+(?=[^>]*(?:class\s*=\s*["'][^"']*title|itemprop\s*=\s*["']?name)))\b[^>]*>(.*?)</""", 2),
            None,
        )
        anchor = F.regexp_extract(card, r"(?is)<a\b(?=[^>]*\bhref)([^>]*)>", 1)
        anchor_text = text.clean_text(F.regexp_extract(card, r"(?is)<a\b(?=[^>]*\bhref)[^>]*>(.*?)</a>", 1), None)
        href = urls.absolute(text.attribute(text.attribute_tokens(anchor), "href"), base)

        def build(b: Column) -> Column:
            title = F.coalesce(
                F.nullif(heading, F.lit("")), F.nullif(anchor_text, F.lit("")), cut(b, title_length)
            )
            short = cut(b, text_length)
            return F.struct(
                F.concat_ws("|", title, short).alias("key"),
                pos.cast("bigint").alias("pos"),
                title.alias("title"),
                F.coalesce(href, F.col("url")).alias("url"),
                F.regexp_extract(b, fv.PRICE_TEXT, 0).alias("price"),
                F.regexp_extract(b, text.ascii_words(fv.RATING_TEXT), 0).alias("rating"),
                short.alias("text"),
            )

        return let(body, build)

    # the base is bound outside: within the function of a card it would be found anew, in the whole page, for each card
    each = let(F.col("base"), lambda base: F.transform(cards, lambda card, pos: row(card, pos, base)))
    found = keep_first(F.filter(each, lambda r: r["text"] != ""))
    if top is not None:
        found = F.slice(found, 1, top)
    fields = found
    return unnest(
        facts.withColumn("_cards", fields).drop("url"), ["capture_id"], F.col("_cards"), "pos"
    ).drop("key")


def metadata_records(captures: DataFrame, guard: bool = True, headings: int | None = None, links: int | None = None) -> DataFrame:
    """Title, description, headings and links of each page."""
    pages = releasable(captures) if guard else captures
    facts = page_facts(pages, "links")
    shown = F.transform(
        head(F.filter("links", lambda a: a["text"] != ""), links),
        lambda a: F.struct(a["text"].alias("text"), a["href"].alias("url")),
    )
    return facts.select(
        "capture_id",
        "url",
        F.coalesce("title", text.title_of(F.col("html"))).alias("title"),
        text.meta_description(F.col("html")).alias("description"),
        headings_of(F.col("html"), headings).alias("headings"),
        shown.alias("links"),
    )
