from pyspark.sql import functions as F

from weblode.functions import text
from weblode.operators import candidates, health, pages as P, records, templates
from weblode.sources.captures import read_pages
from weblode.schema import Limits

URL = "https://a.com/dir/page?x=1"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_links_ignore_what_is_not_rendered(pages):
    html = (
        "<!-- <a href='/c'>c</a> --><script>'<a href=\"/s\">s</a>'</script><style>a{}</style>"
        "<template><a href='/t'>t</a></template><noscript><a href='/n'>n</a></noscript>"
        "<a class=x href=/v>v <b>bold</b> &amp;lt;</a><a href='/v'>again</a><a href='/empty'></a>"
        "<a href='/product/9'><img></a><a HREF='first' href='last'>dup</a><svg><a href='/g'>g</a></svg>"
    )
    got = rows(P.page_links(pages(("1", URL, html))).orderBy("pos"), "href", "text")
    assert got == [
        ("https://a.com/n", "n"),
        ("https://a.com/v", "v bold <"),
        ("https://a.com/product/9", ""),
        ("https://a.com/dir/last", "dup"),
    ]


def test_unterminated_block_is_left_alone(pages):
    html = "<a href='/a'>a</a><script>var x = 1; <a href='/b'>b</a>"
    assert rows(P.page_links(pages(("1", URL, html))), "href") == [("https://a.com/a",), ("https://a.com/b",)]


def test_base_href(pages):
    html = "<!--<base href='http://trap.com/'>--><base href='//cdn.a.com/x/y'><a href='z'>z</a>"
    assert rows(P.page_links(pages(("1", URL, html))), "href") == [("https://cdn.a.com/x/z",)]
    odd = "<base href='ftp://x/'><a href='z'>z</a>"
    assert rows(P.page_links(pages(("1", URL, odd))), "href") == [("https://a.com/dir/z",)]


def test_limits_are_optional(pages):
    html = "".join(f"<a href='/l{i}'>t</a>" for i in range(200))
    page = pages(("1", URL, html))
    assert P.page_links(page).count() == 200
    assert P.page_links(page, Limits.contract()).count() == 160
    assert P.page_links(page, Limits.contract(), shown_only=True).count() == 80


def test_forms_fields_buttons(pages):
    html = (
        "<form action='/s' method=get><input name=q type=search placeholder='Find'><input type=hidden name=h>"
        "<select name=sort></select><textarea name='t' required></textarea><input name=b type=submit value='Go'></form>"
        "<form method=POST><input type='password' name=p></form><form action='mailto:x'><input name=n></form>"
        "<button> Buy  now </button><button>BUY NOW</button><input value='Send' type='button'>"
    )
    page = pages(("1", URL, html))
    assert rows(P.page_forms(page).orderBy("pos"), "pos", "method", "action", "purpose") == [
        (0, "GET", "https://a.com/s", "search"),
        (1, "POST", "https://a.com/dir/page?x=1", "auth"),
    ]
    assert rows(P.form_fields(page).orderBy("form_pos", "pos"), "name", "type", "required") == [
        ("q", "search", True), ("sort", "select", False), ("t", "textarea", True), ("p", "password", False),
    ]
    assert rows(P.page_buttons(page).orderBy("pos"), "label") == [("Go",), ("Buy now",), ("Send",)]


def test_profile_and_copies(pages):
    html = (
        "<title> A &amp; B </title><meta name=other content=x><meta property='og:description' content='og'>"
        "<meta NAME='Description' content='real &quot;one&quot;'><link rel=canonical href='/c'>"
    )
    got = P.page_profile(pages(("1", URL, html), ("2", URL, html))).collect()
    assert {(r.title, r.description, r.canonical_url, r.copies) for r in got} == {
        ("A &amp; B", 'real "one"', "https://a.com/c", 2)
    }


def test_linked_data(pages):
    html = (
        "<script type='application/ld+json'>{bad</script>"
        "<script type='application/ld+json'>{\"@type\":\"WebSite\",\"potentialAction\":[{\"@type\":[\"SearchAction\"],"
        "\"target\":{\"urlTemplate\":\"/find?q={q}&l=1\"}},{\"@type\":\"SearchAction\",\"target\":\"/find?q={z}\"},"
        "{\"@type\":\"SearchAction\",\"target\":\"/other\",\"query-input\":\"required name=term\"}]}</script>"
    )
    page = pages(("1", "https://a.com/?s=1", html))
    assert [r.type for r in P.jsonld_types(page).orderBy("pos").collect()] == ["WebSite", "SearchAction"]
    assert rows(P.search_actions(page).orderBy("pos"), "url_pattern", "query_param", "raw_url") == [
        ("/", "s", "https://a.com/"),
        ("/find", "q", "https://a.com/find?q=&l=1"),
        ("/other", "term", "https://a.com/other"),
    ]


def test_page_kinds(pages):
    shop = "<a href='/product/1'>a</a><a href='/product/2'>b</a><form><input name=q></form> add to cart"
    trip = "<p>cheap flights to everywhere</p>"
    got = dict(rows(P.page_kinds(pages(("s", URL, shop), ("t", URL, trip), ("n", URL, "<p>hi</p>"))), "capture_id", "kinds"))
    assert got == {"s": ["searchable", "product_listing", "commerce"], "t": ["travel"], "n": []}


def test_redaction(spark, pages):
    html = "<input type=password value='a b'><input name=otp value=1><input name=city value=x>"
    out = P.redact_inputs(pages(("1", URL, html))).first()
    assert out.html == "<input type=password value=\"__redacted__\"><input name=otp value=\"__redacted__\"><input name=city value=x>"
    assert out.redactions == 2


def test_texts(spark):
    df = spark.createDataFrame([("<head><title>t</title></head><p>a  b</p><noscript>n</noscript><br>c&nbsp;&amp;lt;<style>x</style>",)], "h string")
    sample, readable, bare = df.select(
        text.text_sample(F.col("h"), None), text.readable_text(F.col("h")), text.stripped_text(F.col("h"))
    ).first()
    assert sample == "t a b n c <"
    assert readable == "a b\n\nc <"
    assert bare == "t a b c&nbsp;&amp;lt;"


def test_detail_and_query_templates(pages):
    html = "".join(f"<a href='/product/{i}?page={i}&q=a'>A</a>" for i in range(3))
    html += "".join(f"<a href='/shop/red-cap_{i}/x'>B</a>" for i in range(4))
    html += "<a href='/package/a/b'>p</a><a href='/package/c'>p</a><a href='/package/@d/e'>p</a>"
    html += "<a href='/l?page=2&sort=a'>1</a><a href='/l?page=3&sort=a'>2</a><a href='/m?a=1'>m</a><a href='//b.com/product/1'>o</a>"
    page = pages(("1", "https://a.com/", html))
    got = rows(templates.detail_templates(page).orderBy("rank"), "name", "url_pattern", "links")
    assert got == [
        ("get_product_page", "/shop/{id}/x", 4),
        ("get_product_page", "/product/{id}", 3),
        ("get_package_page", "/package/{package}", 3),
    ]
    query = templates.query_templates(page).select("name", "url_pattern", F.to_json("params").alias("p")).collect()
    assert [tuple(r) for r in query] == [("paginate_results", "/l", '[{"name":"page","required":false}]')]


def test_clusters(spark):
    urls = [(i, f"https://a.com/project/p{i}/") for i in range(9)] + [(20 + i, f"https://a.com/x/{i}") for i in range(3)]
    urls += [(40, "not a url"), (41, "https://a.com/one")]
    got = templates.url_template_clusters(spark.createDataFrame(urls, "ord long, url string")).collect()
    assert [(r.name, r.url_pattern, r.param_name, r.example, r.members) for r in got] == [
        ("get_project_page", "/project/{project}", "project", "p0", 9)
    ]


def test_health(pages):
    wall = "<title>Just a moment</title><p>wait</p>"
    login = "<form><input type=password name=p></form> please"
    spa = "<div id='root'></div><noscript>You need to enable JavaScript to run</noscript>"
    good = "<p>" + "word " * 300 + "</p>"
    h = {r.capture_id: r for r in health.capture_health(pages(("w", URL, wall), ("l", URL, login), ("s", URL, spa), ("g", URL, good))).collect()}
    assert (h["w"].looks_blocked, h["w"].needs_human, h["w"].human_wall) == (True, True, True)
    assert (h["l"].login_wall, h["l"].needs_human) == (True, True)
    assert (h["s"].spa_shell, h["s"].looks_blocked) == (True, True)
    assert (h["g"].looks_blocked, h["g"].score) == (False, 1499)


def test_privacy(pages):
    page = pages(
        ("a", "https://a.com/checkout", "<p>x</p>"),
        ("b", "https://a.com/p", "<form><input name=email></form>"),
        ("c", "https://a.com/p", "<p>call 4111 1111 1111 1111</p>"),
        ("d", "https://a.com/p", "<p>fine</p>"),
    )
    got = {(r.capture_id, r.kind) for r in health.privacy_withhold(page).collect()}
    assert got == {("a", "page"), ("b", "field"), ("c", "text")}
    assert [r.capture_id for r in health.releasable(page).collect()] == ["d"]


def test_records(pages):
    html = (
        "<h1>Cap</h1><span class='price old'>$5</span><div itemprop=brand>Acme</div>"
        "<ul><li><a href='/item/1'>One</a> $1,200.50 4.5 stars</li><li><a href='/item/1'>dup</a></li>"
        "<li><a href='/about'>no</a></li><li><a href='/item/2'>Two</a> £3 <script>$9</script></li></ul>"
    )
    page = pages(("1", "https://a.com/product/sku7", html))
    product = records.product_records(page, guard=False).first()
    assert (product.title, product.sku, product.price, product.brand) == ("Cap", "sku7", "$5", "Acme")
    assert rows(records.listing_records(page, guard=False).orderBy("pos"), "title", "url", "price", "rating") == [
        ("One", "https://a.com/item/1", "$1,200.50", "4.5 stars"),
        ("Two", "https://a.com/item/2", "£3", ""),
    ]
    cards = "<div class='quote x'><h3>T</h3><a href='/q'>l</a> CAD 7</div><div class=other>n</div><div class='quote x'><h3>T</h3><a href='/q'>l</a> CAD 7</div>"
    got = rows(records.card_records(pages(("1", URL, cards)), "quote", guard=False), "title", "url", "price")
    assert got == [("T", "https://a.com/q", "CAD 7")]


def test_the_base_is_found_once_a_page_and_not_for_each_card_or_link(pages):
    html = "<base href='/b/'>" + "".join(f"<div class='quote'><h3>T{i}</h3><a href='item/{i}'>l{i}</a> $ {i}</div>" for i in range(3))
    page = pages(("1", URL, html))
    for found, address in (
        (records.card_records(page, "quote", guard=False), "url"),
        (records.listing_records(page, guard=False), "url"),
        (P.page_links(page), "href"),
    ):
        assert sorted(r[address] for r in found.collect()) == [f"https://a.com/b/item/{i}" for i in range(3)]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # an argument stands before the function that is applied to each element, what is done for each element after it
        inside = [line for line in plan.splitlines() if "<base" in line]
        assert inside and all("regexp_extract_all" not in line[: line.index("<base")] for line in inside)


def test_listed_links_equal_a_search_of_each_card():
    import random
    import re

    rng = random.Random(3)
    parts = ["$3", "£1,5", "CAD 7", " ", "\n", "4.5", "/5", "4 stars", "5", "x", "out of 5", " 3 out of 5", "9", ".", "<b>", "</b>", "<li>", "</li>", "<div>", "</div>", "<a href='/item/1'>", "</a>", "<script>$9</script>", "<br>", "</p>", "long words without any number "]
    for _ in range(400):
        doc = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        page = records._PageReader().read(doc)
        raw = "".join(page.parts)
        squeeze = lambda a, b: re.sub(r"\s+", " ", raw[a:b]).strip()  # noqa: B023, E731
        for row, (at, card) in zip(records.listed_links(doc), page.links, strict=True):
            body = "" if card is None else squeeze(*page.nodes[card][2:4])
            first = lambda p: m[0] if (m := p.search(body)) else ""  # noqa: B023, E731
            assert row["text"] == squeeze(*page.nodes[at][2:4])
            assert (row["price"], row["rating"]) == (first(records._PRICE), first(records._RATING)), (doc, body)


def test_nested_cards_are_read_in_one_pass():
    import time

    start = time.perf_counter()
    for doc in ("<div>price $3 <a href='/item/1'>x" * 20_000, "<p>a <a href='/item/1'>x</a>" * 20_000, "<div>none <a href='/item/1'>x</a>" * 20_000):
        assert len(records.listed_links(doc)) == 20_000
    assert time.perf_counter() - start < 9


def test_form_candidates_filter(pages):
    html = (
        "<form action='/newsletter' method=post><input name=mail></form>"
        "<form action='/g'><input name=city></form>"
        "<form action='/captcha' method=post><input name=a></form>"
        "<form action='/api/orders' method=post><input name=a required></form>"
        "<form action='/s'><input name=query></form>"
    )
    got = rows(candidates.form_candidates(pages(("1", URL, html))).orderBy("pos"), "name", "method", "confidence")
    assert got == [("post_orders", "POST", 0.5), ("search", "GET", 0.54)]


def test_broken_html_never_fails(spark, pages):
    html = (
        "<html><head><base href='/b/'><title>T</title><script type='application/ld+json'>{\"@type\":\"Product\",\"name\":\"x\"}</script>"
        "<![if x]><!-- c --><style>p{}</style></head><body><form action='/s'><input name=q value=\"a'b\"></form>"
        "<ul><li><a href='/item/1'>One &amp; <b>two</b></a> $5</li></ul><svg><a href=x></svg><button>Go</button></body></html>"
    )
    page = pages(*[(str(i), URL, html[:i]) for i in range(0, len(html) + 1, 5)])
    facts = P.page_facts(page, "site", "links", "forms", "buttons", "linked_data", "sample")
    assert facts.select("links", "forms", "buttons", "linked_data", "sample").count() == page.count()
    facts.select("links", "forms", "buttons", "linked_data", "sample").write.format("noop").mode("overwrite").save()
    records.listing_records(page, guard=False).write.format("noop").mode("overwrite").save()
    records.product_records(page, guard=False).write.format("noop").mode("overwrite").save()
    health.capture_health(page).write.format("noop").mode("overwrite").save()
    odd = pages(("1", "not a url", "<a href='/x'>x</a>"), ("2", URL, "<a href='http://[bad'>x</a><a href='/%zz?%'>y</a>"))
    got = {(r.capture_id, r.href) for r in P.page_links(odd).collect()}
    assert got == {("2", "https://a.com/%zz?%")}


def test_query_templates_across_captures_and_bounded(spark):
    """Order over captures is by identifier, then place, for integer and text identifiers; the bound keeps the first names that are listed."""
    def page(i, links):
        return i, "https://shop.example/", "".join(f'<a href="{h}">x</a>' for h in links)

    data = [
        page(9, ["/list?z=1&q=a&page=1", "/list?z=2&q=a&page=2"]),
        page(-3, ["/list?plain=1&page=3&z=2", "/other?c=", "/other?c=1"]),
        page(10, ["/other?c=2", "/late?u=1", "/late?u=2"]),
    ]
    for kind in ("long", "string"):
        table = read_pages(spark.createDataFrame(data, f"page_id {kind}, url string, html string"))
        got = templates.query_templates(table, scope="site").orderBy("rank").collect()
        assert [(r.rank, r.url_pattern, r.name) for r in got] == [(1, "/list", "search"), (2, "/other", "browse_listing"), (3, "/late", "browse_listing")]
        assert [p.name for p in got[0].params] == ["page", "z", "q"]
        two = templates.query_templates(table, scope="site", max_params=2).filter("rank = 1").collect()[0]
        assert [p.name for p in two.params] == ["page", "z"] and two.name == "search"
