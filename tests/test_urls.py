import pytest
from pyspark.sql import functions as F

from weblode.functions import urls

CASES = [
    ("http://Ex.com:80/a/../b?x=1#f", "http://h/", "http://ex.com/b?x=1#f"),
    ("../c d/é", "https://h.com/a/b/c", "https://h.com/a/c%20d/%C3%A9"),
    ("?q={a}", "https://h.com/a/b?z#f", "https://h.com/a/b?q={a}"),
    ("#t", "https://h.com/a/b?z#f", "https://h.com/a/b?z#t"),
    ("//x.y/z", "https://h.com/", "https://x.y/z"),
    ("mailto:a@b", "https://h.com/", None),
    ("javascript:void(0)", "https://h.com/", None),
    ("", "https://h.com/", None),
    ("http://2130706433/", "https://h/", "http://127.0.0.1/"),
    ("http://0x7f.1/", "https://h/", "http://127.0.0.1/"),
    ("http://0177.0.0.1/", "https://h/", "http://127.0.0.1/"),
    ("http://256.1.1.1/", "https://h/", None),
    ("..", "https://h/a/b/c", "https://h/a/"),
    ("/p/{id}", "https://h/", "https://h/p/%7Bid%7D"),
    ("http://[::1]:8080/x", "https://h/", "http://[::1]:8080/x"),
    ("\\\\evil\\p", "https://h/", "https://evil/p"),
    ("http://a b/", "https://h/", None),
    ("http://h.com:99999/", "https://h/", None),
    ("  /a\n/b ", "https://h/", "https://h/a/b"),
    ("HTTPS://H.com/%7e/./x", "https://h/", "https://h.com/%7e/x"),
]


def test_absolute(spark):
    rows = [(i, h, b) for i, (h, b, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, h string, b string")
    got = {
        r.i: r.u
        for r in df.select("i", urls.absolute(F.col("h"), urls.parts(F.col("b"))).alias("u")).collect()
    }
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


@pytest.mark.parametrize(
    "path, want",
    [
        ("/a/12/b/34/c", "/a/{id}/b/{id2}/c"),
        ("/", "/"),
        ("/x/deadbeefdead/", "/x/{id}/"),
        ("/u/123e4567-e89b-12d3-a456-426614174000", "/u/{id}"),
        ("/a1/b", "/a1/b"),
    ],
)
def test_template_path(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(urls.template_path(F.col("p"))).first()[0] == want


def test_query_pairs_and_encoding(spark):
    df = spark.createDataFrame([("?a=1&a=2&b=x+y%20z&&c&d=%zz",)], "q string")
    pairs, first, again = df.select(
        urls.query_pairs(F.col("q")),
        urls.first_values(F.col("q")),
        urls.encode_query(urls.query_pairs(F.col("q"))),
    ).first()
    assert [tuple(p) for p in pairs] == [("a", "1"), ("a", "2"), ("b", "x y z"), ("c", ""), ("d", "%zz")]
    assert [tuple(p) for p in first] == [("a", "1"), ("b", "x y z"), ("c", ""), ("d", "%zz")]
    assert again == "a=1&a=2&b=x+y+z&c=&d=%25zz"


def test_signature_and_names(spark):
    df = spark.createDataFrame(
        [("get", "/x/{{id}}?q=1"), ("get", "https://a.com/x/{{id}}?q=1"), ("", "y"), ("post", ""), ("APPSTATE", "APPSTATE")],
        "m string, p string",
    )
    got = [r[0] for r in df.select(urls.endpoint_signature(F.col("m"), F.col("p"))).collect()]
    assert got == ["GET /x/{id}", "GET /x/%7Bid%7D", "GET /y", "POST /", "APPSTATE APPSTATE"]
    names = spark.createDataFrame(
        [("POST", "/musicbox/v1/search"), ("GET", "/harbour/api/graphql"), ("GET", "/api/v1/"), ("GET", "/{id}")],
        "m string, p string",
    ).select(urls.call_name(F.col("m"), F.col("p")))
    assert [r[0] for r in names.collect()] == [
        "post_musicbox_search", "get_harbour", "get_api_v1", "get_endpoint",
    ]


def test_domain_and_words(spark):
    df = spark.createDataFrame([("bolt.api.cnn.com",), ("localhost",), ("a.co.uk",)], "h string")
    assert [r[0] for r in df.select(urls.registrable_domain(F.col("h"))).collect()] == ["cnn.com", "localhost", "co.uk"]
    words = spark.createDataFrame([("stories",), ("buses",), ("items",), ("news",), ("x",)], "w string")
    assert [r[0] for r in words.select(urls.singular(F.col("w"))).collect()] == ["story", "bus", "item", "new", "x"]
