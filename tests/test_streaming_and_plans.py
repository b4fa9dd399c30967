from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from weblode.operators.calls import with_templates
from weblode.plans import pipelines
from weblode.sources import sinks
from weblode.sources.snapshots import Snapshot
from weblode.streaming import discovery, drift, failures


def material(batch):
    return batch.select("site", "sig", "capture_id", "payload", F.lit(0).alias("source_rank"), "pos")


def test_discovery_stream_is_idempotent(spark, tmp_path):
    schema = "site string, sig string, capture_id string, payload string, pos long"
    source, table = str(tmp_path / "in"), str(tmp_path / "coverage")
    first = spark.createDataFrame([("s", "GET /a", "c1", "p", 0), ("s", "GET /a", "c2", "p", 1), ("s", "GET /b", "c1", "p", 2)], schema)
    first.coalesce(1).write.parquet(source)
    stream = lambda: discovery.stream_discovery(
        spark.readStream.schema(schema).parquet(source), material, table, str(tmp_path / "ckpt")
    )
    stream().awaitTermination(120)
    spark.createDataFrame([("s", "GET /a", "c3", "p", 0), ("s", "GET /c", "c3", "p", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    stream().awaitTermination(120)
    found = discovery.coverage_table(spark, table)
    rows = found.read().select("sig", "capture_id", "batch_id").collect()
    assert sorted((r.sig, r.capture_id, r.batch_id) for r in rows) == [("GET /a", "c1", 0), ("GET /b", "c1", 0), ("GET /c", "c3", 1)]
    discovery.discover_batch(material(first), 0, table)  # the first batch once more
    assert found.read().count() == 3 and found.read(1).count() == 2


def test_snapshot_batches_cost_the_same_after_any_history(spark, tmp_path):
    """Fifty batches of sixteen new keys each."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        table = Snapshot(spark, str(tmp_path / "t"), "key string, value long", ["key"], bits=1, piece_rows=40)
        read = {}
        for batch in range(50):
            rows = spark.range(0, 16, 1, 1).select(F.concat(F.lit(f"k{batch}-"), F.col("id").cast("string")).alias("key"), F.col("id").alias("value"))
            if batch % 4 == 3:
                read[batch] = sum(p.rows for p in table.touched(rows.filter("value < 2"), table.pieces(batch)))
            table.commit(rows, batch)
        assert table.read().count() == 50 * 16
        assert sum(p.rows for p in table.pieces()) == 50 * 16
        # two keys meet a bounded part of the table, which goes on growing
        assert max(n for b, n in read.items() if b > 30) <= 1.6 * max(n for b, n in read.items() if 10 < b < 25)
        old = spark.createDataFrame([("k0-3", 3), ("new", 0)], "key string, value long")
        assert {r.key for r in table.known(old, 50).collect()} >= {"k0-3"}
        assert max(Counter((p.level, p.bits, p.slot) for p in table.pieces()).values()) < table.fan_in
        before = sorted(map(tuple, table.read().collect()))
        assert table.vacuum(keep=2) > 0 and table.batches() == [48, 49]
        assert sorted(map(tuple, table.read().collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_drift(spark, tmp_path):
    path = str(tmp_path / "hash")
    day = lambda d: f"2024-01-0{d} 00:00:00"
    frame = lambda *rows: spark.createDataFrame(list(rows), "url string, dom_hash string, t string").withColumn("captured_at", F.to_timestamp("t"))
    drift.drift_batch(frame(("u", "h1", day(1)), ("v", "h1", day(1))), 0, path)
    drift.drift_batch(frame(("u", "h2", day(2)), ("v", "h1", day(2))), 1, path)
    hashes = spark.read.parquet(path)
    assert {r.url for r in drift.drift_jobs(hashes).collect()} == {"u"}


def test_drift_stream_restarts_and_keeps_the_newest(spark, tmp_path):
    schema = "url string, dom_hash string, captured_at timestamp"
    at = lambda d: datetime(2024, 1, d)
    source, hashes = str(tmp_path / "in"), str(tmp_path / "hashes")
    batches = [
        [("u", "h1", at(1)), ("u", "h0", at(1)), ("v", None, at(1)), ("w", "h1", None)],
        [("u", "h2", at(5)), ("v", None, at(2)), ("w", "h1", at(1))],
        [("u", "h0", at(3)), ("v", "h3", at(9))],  # a late capture of u
        [("u", "h2", at(6))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        drift.stream_drift(stream, hashes, str(tmp_path / "state"), bits=1, fan_bits=1).awaitTermination(120)
    got = {(r.batch_id, r.url, r.dom_hash, r.drifted) for r in spark.read.parquet(hashes).collect()}
    assert got == {
        (0, "u", "h0", False), (0, "v", None, False), (0, "w", "h1", False), (1, "u", "h2", True), (1, "v", None, False), (1, "w", "h1", False),
        (2, "u", "h0", True), (2, "v", "h3", True), (3, "u", "h2", False),
    }
    latest = drift._newest(drift.latest_table(spark, hashes, bits=1, fan_bits=1).read())
    assert {(r.url, r.dom_hash) for r in latest.collect()} == {("u", "h2"), ("v", "h3"), ("w", "h1")}


def test_repeated_and_late_failures_give_one_heal_request(spark, tmp_path):
    schema = "server_id string, tool_name string, error_class string, detail string, observed_at timestamp"
    at = lambda h, m=0: datetime(2024, 1, 1 + h // 24, h % 24, m)
    tools = spark.createDataFrame([("s", "t"), ("s", "u")], "server_id string, name string")
    batches = [
        [("s", "t", "timeout", "a", at(1)), ("s", "t", "timeout", "b", at(1, 5)), ("s", "x", "timeout", "c", at(1)), ("s", "t", "odd", "d", at(1))],
        [("s", "t", "timeout", "e", at(1, 20)), ("s", "u", "timeout", "f", at(1, 30))],
        [("s", "x", "timeout", "g", at(30))],  # only the watermark moves on
        [("s", "t", "timeout", "h", at(31)), ("s", "u", "timeout", "late", at(2))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        failures.stream_failures(stream, tools, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = [(r.tool_name, r.failure.observed_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("t", at(1)), ("t", at(31)), ("u", at(1, 30))] or sorted(got) == [("t", at(1, 5)), ("t", at(31)), ("u", at(1, 30))]


def test_failures(spark):
    fails = spark.createDataFrame([("s", "t", "timeout", "d"), ("s", "x", "timeout", "d"), ("s", "t", "odd", "d")], "server_id string, tool_name string, error_class string, detail string").withColumn("observed_at", F.current_timestamp())
    tools = spark.createDataFrame([("s", "t"), ("s", "t")], "server_id string, name string")
    assert failures.heal_requests(fails, tools).count() == 1


def test_plans_end_to_end(spark, pages, tmp_path):
    html = "".join(f"<a href='/product/{i}'>P{i}</a>" for i in range(4)) + "<form action='/find'><input name=q></form>"
    captures = pages(("a", "https://shop.net/", html), ("b", "https://other.net/login", "<p>x</p>"))
    log = with_templates(
        spark.createDataFrame(
            [("a", "https://shop.net/", 0, "GET", "https://api.shop.net/v1/search/9?q=x&utm_a=1", "application/json"),
             ("a", "https://shop.net/", 1, "GET", "https://api.shop.net/health/ping?x=1", "application/json")],
            "capture_id string, page_url string, pos long, method string, raw_url string, content_type string",
        ).withColumn("body", F.lit(None).cast("string")).withColumn("body_schema", F.lit(None).cast("string"))
    )
    tools, status = pipelines.generate(captures, log, workdir=str(tmp_path / "work"))
    got = {(r.capture_id, r.name) for r in tools.collect()}
    assert {("a", "fetch_page_content"), ("a", "search"), ("a", "get_product_page"), ("a", "get_search"), ("a", "list_page_items"), ("b", "fetch_page_content")} <= got
    assert not any("ping" in n for _, n in got)
    # every placeholder of a path is a declared input, and names are unique per capture
    for r in tools.filter("kind = 'http'").collect():
        assert {p.split("}")[0] for p in r.url_pattern.split("{")[1:]} <= {p.name for p in r.params}
    assert tools.groupBy("capture_id", "name").count().filter("count > 1").count() == 0
    assert {r.status for r in status.collect()} == {"active"}
    probes = spark.createDataFrame([("https://shop.net/", "GET", 200, "ok")], "url string, method string, status int, body string")
    live = pipelines.emit(tools, probes)
    assert ("a", "fetch_page_content", 0.8) in {(r.capture_id, r.name, r.confidence) for r in live.collect()}
    rules = spark.createDataFrame([("https://other.net", "User-agent: *\nDisallow: /log*")], "origin string, body string")
    assert pipelines.prepare_payloads(captures).count() == 2
    assert [r.capture_id for r in pipelines.prepare_payloads(captures, rules).collect()] == ["a"]
    assert pipelines.prepare_payloads(captures, rules, policy="full").count() == 2


def test_registry_tables(spark, tmp_path):
    entry = lambda url, conf, v: (url, "t", "auto_gen", conf, 0, "active", v)
    schema = "url string, title string, tier string, confidence double, install_count int, status string, version int"
    rows = spark.createDataFrame([entry("https://a.com/", 0.5, 1), entry("https://a.com/", 7.0, 2)], schema)
    table, refused = str(tmp_path / "r"), str(tmp_path / "x")
    sinks.append_registry(rows, table, refused)
    sinks.append_registry(rows, table, refused, batch_id=0)
    assert sinks.append_registry(rows, table, refused, batch_id=0).read().count() == 1
    assert sinks.append_registry(rows, table, refused).read().count() == 2
    assert {r.problem for r in spark.read.parquet(refused).collect()} == {"confidence"}
    tools = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("s", "a", 2)], "server_id string, name string, version int")
    sinks.write_versions(tools, str(tmp_path / "v"))
    live = sinks.live_tools(spark.read.parquet(str(tmp_path / "v")))
    assert [(r.name, r.version) for r in live.collect()] == [("a", 2)]
