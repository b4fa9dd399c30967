import json
import random

from pyspark.sql import functions as F

from weblode.operators import calls, coverage, dedupe, frontier, registry, requests, verify
from weblode.sources import captures as cap
from weblode.sources import robots, specs
from weblode.sources.calls import read_network_log
from weblode.sources.candidates import read_candidates
from weblode.schema import NETWORK_LOG, PARAMS_DDL, STEPS_DDL, Limits


def greedy(pairs):
    """Brute force: walk in order; dropped rows reserve nothing."""
    names, sigs, kept = set(), set(), set()
    for ord_, name, sig in sorted(pairs):
        if name not in names and sig not in sigs:
            names.add(name), sigs.add(sig), kept.add(ord_)
    return kept


def test_greedy_matches_brute_force_both_ways(spark):
    rng = random.Random(7)
    rows = [("x", 1, "a", "1"), ("x", 2, "b", "1"), ("x", 3, "b", "2"), ("y", 1, "a", "1"), ("y", 2, "a", "2"), ("y", 3, "c", "2")]
    for k in "pqr":
        rows += [(k, i, f"n{rng.randrange(12)}", f"s{rng.randrange(12)}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ord long, name string, sig string")
    want = {(k, o) for k in "xypqr" for o in greedy([r[1:] for r in rows if r[0] == k])}
    assert {tuple(r) for r in dedupe.greedy_pairs(df, ["k"]).collect()} == want
    assert {tuple(r) for r in dedupe.greedy_pairs(df, ["k"], split_over=4).collect()} == want
    assert {("x", 1), ("x", 3), ("y", 1), ("y", 3)} <= want


def tool(spark, rows):
    """Candidate rows from (capture, rank, pos, name, method, pattern, raw_url)."""
    df = spark.createDataFrame(
        rows, "capture_id string, source_rank int, pos long, name string, method string, url_pattern string, raw_url string"
    )
    return df.select(
        "capture_id", "source_rank", F.lit("network").alias("source"), "pos", "name", F.lit("d").alias("description"),
        F.lit("http").alias("kind"), "method", "url_pattern", "raw_url",
        F.array().cast(PARAMS_DDL).alias("params"), F.lit(None).cast(STEPS_DDL).alias("steps"), F.lit(0.5).alias("confidence"),
    )


def test_validation_reasons(spark):
    df = tool(
        spark,
        [
            ("c", 0, 0, "Bad Name", "GET", "/a", "u"),
            ("c", 0, 1, "taken", "GET", "/b", "u"),
            ("c", 0, 2, "one", "GET", "/c", "u"),
            ("c", 0, 3, "two", "GET", "/c", "u"),
            ("c", 0, 4, "one", "GET", "/d", "u"),
            ("c", 0, 5, "barred", "GET", "/e", "u"),
            ("c", 0, 6, "three", "GET", "/d", "u"),
        ],
    )
    seen = spark.createDataFrame([("c", "taken")], "capture_id string, name string")
    out = dedupe.validate_candidates(df, seen_names=seen, barred=F.col("name") == "barred")
    assert {r.pos: r.status for r in out.collect()} == {
        0: "contract", 1: "name", 2: "kept", 3: "signature", 4: "name", 5: "barred", 6: "kept",
    }


def test_robots(spark):
    body = (
        "Sitemap: https://a.com/0.xml\nUser-agent: Bot\nDisallow: /bot\nUser-agent: x\nUser-agent: *\nDisallow: /p*  # c\r\n"
        "disallow:/q\nDisallow:\nDisallow: /p*\nAllow: /p/ok\nUser-agent: y\nDisallow: /y\nsitemap: https://a.com/1.xml"
    )
    df = spark.createDataFrame([("https://a.com", body)], "origin string, body string")
    rules, maps = robots.read_robots(df)
    assert [r.rule for r in rules.orderBy("pos").collect()] == ["/p*", "/q"]
    assert [r.sitemap_url for r in maps.orderBy("pos").collect()] == ["https://a.com/0.xml", "https://a.com/1.xml"]
    targets = spark.createDataFrame(
        [("https://a.com/p1?x",), ("https://a.com/z",), ("https://b.com/p",), ("junk",)], "url string"
    )
    got = {r.url: (r.robots_allowed, r.disallow_rule) for r in robots.robots_gate(targets, df).collect()}
    assert got == {
        "https://a.com/p1?x": (False, "/p*"), "https://a.com/z": (True, None), "https://b.com/p": (True, None), "junk": (True, None),
    }
    assert all(r.robots_allowed for r in robots.robots_gate(targets, df, policy="full").collect())
    assert [robots.robots_policy(w) for w in ("Obey", "off", "?", None)] == ["respect", "full", None, None]


def test_openapi(spark):
    spec = {
        "openapi": "3.0", "servers": [{"url": "/api/v2/"}],
        "paths": {
            "/pets/{id}": {
                "parameters": [{"name": "id", "in": "path", "schema": {"type": "integer"}}],
                "delete": {"operationId": "getPet"}, "get": {"operationId": "getPet", "summary": "S"}, "put": {"deprecated": True},
            },
            "/pets": {"post": {
                "operationId": "createPet",
                "parameters": [{"$ref": "#/x"}, {"name": "ck", "in": "cookie"}, {"name": "lim-it", "in": "query", "required": True}],
                "requestBody": {"content": {"application/json": {"schema": {"properties": {"z": {}, "lim_it": {"type": "number"}}, "required": ["lim_it"]}}}},
            }},
            "bad": {}, "/get": {"get": {"operationId": "getPet_2"}},
        },
    }
    two = {"swagger": "2.0", "host": "api.b.com", "basePath": "/v1", "schemes": ["http"],
           "paths": {"/u/{x}": {"get": {"parameters": [{"name": "x", "in": "path"}, {"in": "body", "name": "b", "schema": {"properties": {"q": {"type": "string"}}}}]}}}}
    df = spark.createDataFrame([("https://a.com", json.dumps(spec)), ("https://b.com", json.dumps(two)), ("https://c.com", "nope")], "origin string, doc string")
    got = {(r.origin, r.pos): r for r in specs.read_api_specs(df).collect()}
    a = [got[("https://a.com", i)] for i in range(4)]
    assert [(r.name, r.method, r.url_pattern) for r in a] == [
        ("get_pet", "GET", "/api/v2/pets/{id}"), ("get_pet_2", "DELETE", "/api/v2/pets/{id}"),
        ("create_pet", "POST", "/api/v2/pets"), ("get_pet_2_2", "GET", "/api/v2/get"),
    ]
    assert [(p.name, p.place, p.key, p.type, p.required) for p in a[2].params] == [
        ("lim_it", "query", "lim-it", "string", True), ("z", "body", "z", "string", False), ("lim_it_2", "body", "lim_it", "number", True),
    ]
    b = got[("https://b.com", 0)]
    assert (b.name, b.raw_url, [p.place for p in b.params]) == ("get_u_by", "http://api.b.com/v1/u/{x}", ["path", "body"])


def test_network_log(spark):
    row = lambda pos, url, **kw: {"capture_id": "c", "pos": pos, "url": url, **kw}
    log = spark.createDataFrame(
        [
            row(0, "https://a.com/v1/7?q=1", method="post", requestHeaders={"Cookie": "x", "X-Session-Id": "y", "Accept": "z"},
                reqContentType="application/json", requestPostData='{"b":1,"password":"p","n":{"token":"t","k":[{"otp":1},2]}}',
                status=200, contentType="application/json", responseBody='{"a":[1],"b":null}'),
            row(1, "http://127.0.0.1/x"), row(2, "http://10.0.0.8/x"), row(3, "ftp://a.com/"), row(4, "https://localhost/"),
        ],
        NETWORK_LOG,
    )
    rows = read_network_log(log).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.method, r.url_pattern, dict(r.headers)) == ("POST", "/v1/{id}", {"Accept": "z"})
    assert r.body == '{"b":1,"n":{"k":[{},2]}}'
    assert json.loads(r.response_schema)["properties"] == {"a": {"type": "array"}, "b": {"type": "null"}}
    assert json.loads(r.body_schema)["properties"]["password"] == {"type": "string"}


def test_public_addresses(spark):
    private = ["127.0.0.1", "10.255.0.1", "172.31.255.255", "192.168.1.1", "169.254.1.1", "100.64.0.1", "198.19.0.1", "[::1]",
               "[fd00::1]", "[fe80::1]", "[::ffff:10.0.0.1]", "[::ffff:a00:1]", "localhost", "a.localhost", "0x7f.1", "3232235777"]
    public = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "[2001:db8::1]", "example.org", "192.0.1.1"]
    df = spark.createDataFrame([(f"http://{h}/",) for h in private + public], "u string")
    assert {r.u for r in frontier.public_targets(df, "u").collect()} == {f"http://{h}/" for h in public}
    looked = spark.createDataFrame([("example.org", "93.184.216.34"), ("example.org", "10.0.0.1"), ("8.8.8.8", "8.8.8.8")], "host string, address string")
    assert [r.u for r in frontier.public_targets(df, "u", looked).collect()] == ["http://8.8.8.8/"]


def test_frontier_and_plan(spark, pages):
    html = ("<a href='/b?x=1'>b</a><a href=\"/b/\">b2</a><a href='/a.png'>i</a><a href='/login'>l</a><a href='#x'>h</a>"
            "<a href='https://o.com/z'>o</a><a href='/'>root</a><a href='/dir/page/'>self</a><a href='/c'>c</a><a href='/d'>d</a>")
    page = pages(("1", "https://a.com/dir/page", html))
    assert [r.url for r in frontier.crawl_frontier(page).orderBy("pos").collect()] == ["https://a.com/b", "https://a.com/c", "https://a.com/d"]
    rules = spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /b")], "origin string, body string")
    plan = [r.url for r in frontier.crawl_plan(page, rules, max_pages=3).orderBy("visit").collect()]
    assert plan == ["https://a.com/", "https://a.com/dir/page", "https://a.com/c"]


def test_ranking_keeps_own_site_first(spark):
    rows = [("c", "https://www.a.com/", i, "GET", f"https://{'api.a.com' if i % 2 else 'b.net'}/r{i}/x", "") for i in range(80)]
    df = spark.createDataFrame(rows, "capture_id string, page_url string, pos long, method string, raw_url string, content_type string")
    every = calls.rank_calls(df).orderBy("rank").collect()
    assert [r.pos for r in every] == [*range(1, 80, 2), *range(0, 80, 2)]
    bounds = Limits.contract()
    bounded = lambda rows: calls.rank_calls(rows, bounds.cross_site_calls, bounds.candidate_calls)
    got = bounded(df).orderBy("rank").collect()
    assert [r.pos for r in got] == list(range(1, 61, 2))
    few = bounded(df.filter("pos % 2 = 0 or pos < 9")).orderBy("rank").collect()
    assert [r.pos for r in few] == [1, 3, 5, 7, 0, 2, 4, 6, 8, 10]


def test_coverage(spark):
    known = spark.createDataFrame([("s", "sig", "GET /a/{id}")], "site string, kind string, value string")
    material = spark.createDataFrame(
        [("s", "GET /a/{id}", 0, 0, "c"), ("s", "GET /b", 1, 5, "c"), ("s", "GET /b", 0, 9, "c"), ("t", "GET /a/{id}", 0, 0, "c")],
        "site string, sig string, source_rank int, pos long, capture_id string",
    )
    got = {(r.site, r.sig, r.source_rank, r.pos) for r in coverage.uncovered(material, known).collect()}
    assert got == {("s", "GET /b", 0, 9), ("t", "GET /a/{id}", 0, 0)}
    old = tool(spark, [("s", 0, 0, "one", "GET", "/a", "u")])
    new = tool(spark, [("s", 1, 0, "one", "GET", "/z", "u"), ("s", 1, 1, "two", "get", "/a?q=1", "u"), ("s", 1, 2, "three", "GET", "/y", "u")])
    assert {r.name for r in coverage.merge_new_tools(old, new, "capture_id").collect()} == {"one", "three"}


def test_verification_order(spark):
    t = tool(spark, [(n, 0, 0, n, m, "/p/{id}", u) for n, m, u in [
        ("ok", "GET", "https://a.com/p/1"), ("gone", "GET", "https://a.com/p/2"), ("wall", "GET", "https://a.com/p/3"),
        ("void", "GET", "https://a.com/p/4"), ("none", "GET", "https://a.com/p/5"), ("write", "POST", "https://a.com/p/1"),
        ("stub", "GET", "https://a.com/p/{id}"), ("nocontent", "GET", "https://a.com/p/6"), ("moved", "GET", "https://a.com/p/7"),
    ]]).withColumn("params", F.array(F.struct(F.lit("id").alias("name"), F.lit("path").alias("place"), F.lit("id").alias("key"),
                                              F.lit("string").alias("type"), F.lit(True).alias("required"))))
    probes = spark.createDataFrame(
        [("https://a.com/p/1", "GET", 200, "x"), ("https://a.com/p/2", "GET", 404, "captcha"), ("https://a.com/p/3", "GET", 200, "a CAPTCHA b"),
         ("https://a.com/p/4", "GET", 200, " \n"), ("https://a.com/p/6", "GET", 204, ""), ("https://a.com/p/7", "GET", 301, "m"),
         ("https://a.com/p/new%20one", "GET", 500, "")],
        "url string, method string, status int, body string",
    )
    fresh = spark.createDataFrame([("id", "new one")], "param string, value string")
    got = {r.name: (r.status, r.generalized, r.reason) for r in verify.verify_tools(t, probes, fresh).collect()}
    assert got["ok"] == ("verified", False, "captured ok but fresh value 'new one' -> HTTP 500")
    assert got["gone"][:1] + got["gone"][2:] == ("dead", "HTTP 404")
    assert got["wall"][0] == "blocked" and got["void"][2] == "empty body" and got["none"][2] == "network error / timeout"
    assert got["write"][0] == got["stub"][0] == "not_verifiable"
    assert got["nocontent"][0] == got["moved"][0] == "verified"
    report = verify.verify_report(verify.verify_tools(t, probes, fresh)).first()
    assert (report.verified, report.dead, report.blocked, report.not_verifiable, report.generalized) == (3, 3, 1, 2, 0)


def test_heal_and_versions(spark):
    base = tool(spark, [("s", 0, 0, n, "GET", f"/{n}", "u") for n in ("a", "b")]).withColumnRenamed("capture_id", "server_id").drop("source_rank", "source", "pos")
    fix = base.withColumn("failing_name", F.lit("a")).withColumn("url_pattern", F.lit("/new"))
    renamed = fix.filter("name = 'b'")
    healed = registry.heal(base, fix.filter("name = 'a'").unionByName(renamed))
    assert {(r.name, r.url_pattern, r.healed) for r in healed.collect()} == {("a", "/new", True), ("b", "/b", False)}
    past = spark.createDataFrame([("u", 2), ("u", 5)], "url string, version int")
    batch = spark.createDataFrame([("u", "s1"), ("u", "s2"), ("v", "s3")], "url string, server_id string")
    assert {tuple(r) for r in registry.next_versions(batch, past).select("server_id", "version").collect()} == {("s1", 6), ("s2", 7), ("s3", 1)}


def test_request_plan(spark):
    p = lambda n, place, key: F.struct(F.lit(n).alias("name"), F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit("string").alias("type"), F.lit(False).alias("required"))
    t = tool(spark, [("s", 0, 0, "read_it", "POST", "/p/{id}/{sub}", "https://a.com/p/1/2?alt=json&key=secret&n=1")]).withColumn("tool_id", F.lit("t")).withColumn(
        "params", F.array(p("id", "path", "id"), p("sub", "path", "sub"), p("alt", "query", "alt"), p("q", "query", "q"), p("deep", "body", "a.b"), p("h", "header", "X-H"))
    ).withColumn("body", F.lit('{"ctx":1,"a":{"b":0,"c":2}}'))
    calls_ = [("1", {"id": '"a/b"', "sub": "7", "alt": '"xml"', "q": '"x y"', "deep": '"v"', "h": '"1"'}), ("2", {"id": '"z"'})]
    args = spark.createDataFrame([(c, "t", a) for c, a in calls_], "call_id string, tool_id string, args map<string,string>")
    got = {r.call_id: r for r in requests.request_plan(t, args).collect()}
    assert got["1"].url == "https://a.com/p/a%2Fb/7?alt=xml&n=1&q=x+y"
    assert got["1"].body == '{"ctx":1,"a":{"b":"v","c":2}}' and dict(got["1"].headers) == {"X-H": "1"} and got["1"].allowed
    assert got["2"].missing == ["sub"] and not got["2"].allowed
    w = t.withColumn("name", F.lit("x")).withColumn("description", F.lit("create an order"))
    assert not any(r.allowed for r in requests.request_plan(w, args).collect())
    assert [r.allowed for r in requests.request_plan(w, args, allow_writes=True).orderBy("call_id").collect()] == [True, False]


def test_write_flags_word_rule(spark):
    t = tool(spark, [("s", 0, i, n, m, "/x", "u") for i, (n, m) in enumerate([("create_item", "POST"), ("create", "POST"), ("read", "PUT"), ("read", "GET")])])
    got = [r.is_write for r in requests.write_flags(t).orderBy("pos").collect()]
    assert got == [False, True, True, False]


def test_json_select(spark):
    df = spark.createDataFrame([('[{"a":{"b":1,"c":2},"d":3},{"d":4}]',), ("not json",)], "body string")
    got = [r.selected for r in requests.json_select(df, F.lit("a.b, d")).collect()]
    assert got == ['[{"b":1,"d":3},{"d":4}]', "not json"]


def test_contract(spark, tmp_path):
    good = {
        "bundleId": "11111111-1111-4111-8111-111111111111", "source": "scraper", "url": "https://a.com/", "capturedAt": "2024-01-01T00:00:00Z",
        "legalMode": "safe", "dom": {"html": "<p>", "domHash": "x"}, "network": [], "meta": {"renderedWithJs": True},
    }
    call = {"method": "GET", "urlPattern": "/", "rawUrl": "https://a.com/", "requestHeaders": {"Cookie": "x"}, "statusCode": 200, "contentType": ""}
    bundles = [good, {**good, "network": [call]}, {**good, "tier": 9}, {**good, "dom": {"html": "x" * 200_001, "domHash": "x"}}]
    path = tmp_path / "b.json"
    path.write_text("\n".join(map(json.dumps, bundles)) + "\n{broken\n")
    assert cap.read_captures(spark, str(path))[0].count() == 2
    accepted, rejected = cap.read_captures(spark, str(path), Limits.contract())
    assert accepted.count() == 1
    assert sorted(e for r in rejected.collect() for e in r.errors if e in ("secret_header", "tier", "html", "unreadable")) == [
        "html", "html", "secret_header", "tier", "unreadable",
    ]
    assert cap.check_captures(spark.read.schema(cap.WIRE_CAPTURE).json(str(path)), Limits())[0].count() == 2


def test_proposals(spark):
    one = {"name": "x", "description": "d", "confidence": 0.4, "inputSchema": {"properties": {"q": {"type": "number"}}, "required": ["q"]},
           "execution": {"kind": "http", "request": {"method": "GET", "urlPattern": "/a", "rawUrl": "https://a.com/a"}, "paramMapping": {"q": {"in": "query", "key": "k"}}}}
    df = spark.createDataFrame([("a", json.dumps([one])), ("b", json.dumps({"tools": [one, one]})), ("c", "sorry"), ("d", "{}")], "capture_id string, raw string")
    rows = read_candidates(df).collect()
    assert sorted((r.capture_id, r.pos) for r in rows) == [("a", 0), ("b", 0), ("b", 1)]
    assert tuple(rows[0].params[0]) == ("q", "query", "k", "number", True)


def snapshot(spark, page, html="<p>x</p>", url="https://www.a.com/list"):
    """Accepted captures with a page snapshot."""
    bundle = {
        "bundleId": "11111111-1111-4111-8111-111111111111", "source": "extension", "url": url, "capturedAt": "2024-01-01T00:00:00Z",
        "legalMode": "safe", "dom": {"html": html, "domHash": "x"}, "network": [], "page": page, "meta": {"renderedWithJs": True},
    }
    df = spark.createDataFrame([(json.dumps(bundle),)], "raw string").select(F.from_json("raw", cap.WIRE_CAPTURE).alias("b")).select("b.*")
    return cap.check_captures(df)[0]


PAGE = {
    "actions": [
        {"kind": "button", "label": "Show more", "selector": "#m"}, {"kind": "button", "label": "Add to cart", "selector": "#c"},
        {"kind": "link", "label": "textbook", "selector": "#t"},
    ],
    "forms": [
        {"selector": "#f", "method": "GET", "purpose": "search", "fields": [{"name": "q", "type": "text", "required": True}]},
        {"selector": "#g", "method": "POST", "action": "https://www.a.com/go", "purpose": "form",
         "fields": [{"name": "from", "type": "text", "required": True}, {"name": "to", "type": "text", "required": True}]},
    ],
    "appState": [{"source": "window.__STATE__", "keys": ["items"]}],
}


def test_capabilities_of_a_live_page(spark):
    from weblode.operators.candidates import page_capabilities

    got = {r.capability: r.confidence for r in page_capabilities(snapshot(spark, PAGE)).collect()}
    assert got == {
        "extract_page_metadata": 0.56, "list_page_items": 0.6, "search_travel_options": 0.7, "search_in_browser": 0.63,
        "go_to_next_page": 0.62, "add_to_cart": 0.7, "open_cart": 0.61,
    }


def test_delta_of_a_live_page(spark):
    captures = snapshot(spark, PAGE)
    known = spark.createDataFrame([("a.com", "name", "add_to_cart"), ("a.com", "sig", "POST /go")], "site string, kind string, value string")
    delta, flags = coverage.discovery_delta(captures, None, known)
    assert {(r.source, r.sig) for r in delta.collect()} == {("form", "GET /list"), ("appstate", "APPSTATE /window.__STATE__")}
    assert [r.name for r in coverage.new_actions(captures, known).collect()] == ["go_to_next_page"]
    assert flags.first().has_new
    everything = known.unionByName(spark.createDataFrame(
        [("a.com", "sig", "GET /list"), ("a.com", "name", "go_to_next_page")], known.schema))
    assert not coverage.discovery_delta(captures, None, everything)[1].first().has_new
