"""One host, capture or template may own a large part of all rows."""

from pyspark.sql import functions as F

from weblode.functions.rows import first_rows, number_rows
from weblode.operators import calls, dedupe, templates


def test_salted_top_rows_equal_plain_ones(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        ((F.col("id") * 7919) % 6007).alias("o"),
    )
    got = {tuple(r) for r in first_rows(df, ["k"], [F.col("o")], n=1500).select("k", "o").collect()}
    rows = sorted((r.k, r.o) for r in df.collect())
    want, seen = set(), {}
    for k, o in rows:
        seen[k] = seen.get(k, 0) + 1
        if seen[k] <= 1500:
            want.add((k, o))
    assert got == want


def test_keep_first_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("capture_id"), F.col("id").cast("string").substr(9, 9).alias("method"),
        F.lit("/a/{id}").alias("url_pattern"),
        F.lit("https://a.com/a/1").alias("raw_url"), F.col("id").alias("pos"),
    )
    out = calls.dedupe_calls(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before and once after the exchange
    assert sorted(r.pos for r in out.collect()) == [0, 1]


def test_hot_origin_clusters(spark):
    df = spark.range(4000).select(
        F.col("id").alias("ord"),
        F.when(
            F.col("id") % 3 == 0, F.concat(F.lit("https://hot.com/product/"), F.col("id").cast("string"))
        ).otherwise(
            F.concat(F.lit("https://h"), (F.col("id") % 200).cast("string"), F.lit(".com/x/"), F.col("id").cast("string"))
        ).alias("url"),
    )
    got = {r.origin: r.members for r in templates.url_template_clusters(df).collect()}
    assert got["https://hot.com"] == 1334
    assert len(got) == 201


def test_hot_capture_is_matched_by_components(spark):
    df = spark.range(3000).select(
        F.lit("hot").alias("k"), F.col("id").alias("ord"),
        F.concat(F.lit("n"), (F.col("id") * 31 % 211).cast("string")).alias("name"),
        F.concat(F.lit("s"), (F.col("id") * 17 % 197).cast("string")).alias("sig"),
    )
    names, sigs, want = set(), set(), set()
    for r in df.orderBy("ord").collect():
        if r.name not in names and r.sig not in sigs:
            names.add(r.name), sigs.add(r.sig), want.add(r.ord)
    assert {r.ord for r in dedupe.greedy_pairs(df, ["k"], split_over=100).collect()} == want


def test_long_chain_is_matched_in_few_rounds(spark):
    """A hundred thousand pairs of one capture, each sharing its name or signature with the next, besides small chains."""
    n = 100_000
    chain = spark.range(n).select(
        F.lit("hot").alias("k"), F.col("id").alias("ord"), F.concat(F.lit("n"), F.expr("(id + 1) div 2").cast("string")).alias("name"),
        F.concat(F.lit("s"), F.expr("id div 2").cast("string")).alias("sig"),
    )
    pieces = spark.range(3000).select(
        F.lit("hot").alias("k"), (F.col("id") + n).alias("ord"), F.concat(F.lit("m"), F.expr("id div 3").cast("string")).alias("name"),
        F.concat(F.lit("t"), F.expr("(id + 1) div 3").cast("string")).alias("sig"),
    )
    names, sigs, want = set(), set(), set()
    df = chain.unionByName(pieces)
    for r in df.orderBy("ord").collect():
        if r.name not in names and r.sig not in sigs:
            names.add(r.name), sigs.add(r.sig), want.add(r.ord)
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.ord for r in dedupe.greedy_pairs(df, ["k"]).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want
    assert jobs < 150  # a round takes a few; rounds follow the logarithm of the chain


def test_hot_key_is_numbered_by_parts(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 6007).alias("o"),
    )
    rows = sorted((r.k, r.o) for r in df.collect())
    want, seen = set(), {}
    for k, o in rows:
        seen[k] = seen.get(k, 0) + 1
        want.add((k, o, seen[k]))
    out = number_rows(df.repartition(6), ["k"], ["o"], "n")
    assert {(r.k, r.o, r.n) for r in out.collect()} == want


def test_clusters_shuffle_no_paths(spark):
    """A position sends its value and hashes; two rows of one address under one place count once."""
    deep = "/".join(f"section{i}" for i in range(40))
    df = spark.range(60).select(
        (F.col("id") % 30).alias("ord"), F.concat(F.lit(f"https://deep.com/{deep}/"), (F.col("id") % 30).cast("string")).alias("url")
    )
    out = templates.url_template_clusters(df)
    assert [(r.members, r.example, r.url_pattern) for r in out.collect()] == [(30, "0", f"/{deep}/{{id}}")]
