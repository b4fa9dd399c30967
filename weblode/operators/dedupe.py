"""Validation and two-key deduplication of candidates.

A candidate is dropped when its name is taken, when it is barred, or when its execution
signature is taken; dropped candidates reserve nothing.  Walked in order this is a greedy
matching of names to signatures.  Pairs that share neither a name nor a signature, directly or through others, do not
concern one another, so a capture with very many pairs is split into its connected components.  Each capture or
component is walked once in order, by one task that holds no more than the names and signatures it has kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.graphs import component_labels
from ..session import staged


def contract_problem() -> Column:
    """First contract rule a candidate breaks, or NULL."""
    col = F.col
    bad_param = F.exists(
        "params",
        lambda p: p["name"].isNull()
        | (F.length(p["name"]) > 128)
        | ~F.coalesce(p["place"].isin(fv.PARAM_PLACES), F.lit(False))
        | p["key"].isNull()
        | (F.length(p["key"]) > 256),
    )
    http = col("kind") == "http"
    checks = [
        (col("name").isNull() | ~col("name").rlike(fv.TOOL_NAME) | (F.length("name") > 64), "name"),
        (col("description").isNull() | ~F.length("description").between(1, 1000), "description"),
        (col("confidence").isNull() | ~col("confidence").between(0, 1), "confidence"),
        (col("kind").isNull() | ~col("kind").isin("http", "browser"), "kind"),
        (http & (col("method").isNull() | col("url_pattern").isNull() | col("raw_url").isNull()), "request"),
        (http & (col("params").isNull() | F.coalesce(bad_param, F.lit(False))), "params"),
        (~http & (col("steps").isNull() | (F.size("steps") > 50)), "steps"),
        (
            ~http
            & F.coalesce(
                F.exists("steps", lambda s: ~F.coalesce(s["action"].isin(fv.STEP_ACTIONS), F.lit(False))),
                F.lit(False),
            ),
            "step_action",
        ),
    ]
    out = F.when(F.lit(False), "")
    for test, name in checks:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out


def execution_signature() -> Column:
    """What a candidate does, whatever it is called."""
    mapping = F.array_join(
        F.array_sort(
            F.transform("params", lambda p: F.concat_ws(":", p["name"], p["place"], p["key"]))
        ),
        ",",
    )
    http = F.concat_ws("|", F.lit("http"), F.upper("method"), F.col("url_pattern"), mapping)
    inputs = F.to_json(
        F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["required"].alias("required")))
    )
    browser = F.concat_ws("|", F.lit("browser"), inputs, F.to_json("steps"))
    return F.when(F.col("kind") == "http", http).otherwise(browser)


def _walk(keys: list[str]):
    """Kept pairs of rows sorted by ``keys``, part and order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, sigs = None, set(), set()
        for batch in batches:
            units = zip(*(batch.column(k).to_pylist() for k in (*keys, "_part")), strict=True)
            keep = []
            for own, name, sig in zip(units, batch.column("name").to_pylist(), batch.column("sig").to_pylist(), strict=True):
                if own != unit:
                    unit, names, sigs = own, set(), set()
                free = name not in names and sig not in sigs
                if free:
                    names.add(name)
                    sigs.add(sig)
                keep.append(free)
            yield batch.select([*keys, "ord"]).filter(pa.array(keep, pa.bool_()))

    return task


def greedy_pairs(candidates: DataFrame, keys: list[str], split_over: int = 1 << 16) -> DataFrame:
    """``keys, ord`` of the candidates that survive; input has ``keys, name, sig, ord``.

    Only the first of equal pairs can survive, so pairs are first reduced in the map tasks.  Keys with more than ``split_over`` pairs are
    walked component by component; that only deals out the work.  NULL names or signatures equal one another.
    """
    pairs = candidates.groupBy(*keys, "name", "sig").agg(F.min("ord").alias("ord"))
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs"))
    # only the few large keys are listed, so a hot one is never joined row by row to its own size
    large = staged(sizes.filter(F.col("_pairs") > split_over).select(*keys), None, "large_keys")
    whole = pairs.withColumn("_part", F.lit(0).cast("bigint"))
    if not large.isEmpty():
        # names of nodes that met by chance would only join two components
        node = lambda kind, value: F.xxhash64(*keys, F.lit(kind), value)
        split = staged(pairs.join(large, keys, "left_semi").withColumn("_name", node("name", "name")), None, "large")
        labels = component_labels(split.select(F.col("_name").alias("a"), node("sig", "sig").alias("b")))
        parts = split.join(labels.select(F.col("node").alias("_name"), F.col("label").alias("_part")), "_name").drop("_name")
        whole = whole.join(large, keys, "left_anti").unionByName(parts)
    kinds = dict(candidates.dtypes)
    sorted_ = whole.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", "ord", "name", "sig")
    return sorted_.mapInArrow(_walk(keys), ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "ord")))


def validate_candidates(
    candidates: DataFrame,
    keys: list[str] | None = None,
    seen_names: DataFrame | None = None,
    barred: Column | None = None,
    split_over: int = 1 << 16,
) -> DataFrame:
    """Candidates with ``status``: kept, contract, name, barred or signature.

    ``seen_names`` holds ``keys, name`` already in use; ``barred`` marks rows to drop outright.
    Candidates are taken in (source_rank, pos) order.
    """
    keys = keys or ["capture_id"]
    ordered = (
        candidates.withColumn("problem", contract_problem())
        .withColumn("sig", execution_signature())
        .withColumn("ord", F.col("source_rank").cast("bigint") * F.lit(1 << 40) + F.col("pos").cast("bigint"))
        .withColumn("_barred", F.lit(False) if barred is None else F.coalesce(barred, F.lit(False)))
    )
    if seen_names is None:
        ordered = ordered.withColumn("_seen", F.lit(False))
    else:
        known = seen_names.select(*keys, "name").distinct().withColumn("_seen", F.lit(True))
        ordered = ordered.join(known, [*keys, "name"], "left").withColumn(
            "_seen", F.coalesce("_seen", F.lit(False))
        )
    eligible = ordered.filter(F.col("problem").isNull() & ~F.col("_seen") & ~F.col("_barred"))
    kept = greedy_pairs(eligible.select(*keys, "name", "sig", "ord"), keys, split_over).withColumn(
        "_kept", F.lit(True)
    )
    marked = ordered.join(kept, [*keys, "ord"], "left")
    names = (
        marked.filter("_kept").groupBy(*keys, "name").agg(F.min("ord").alias("_name_from"))
    )
    status = (
        F.when(F.col("_kept"), "kept")
        .when(F.col("problem").isNotNull(), "contract")
        .when(F.col("_seen") | (F.col("_name_from") < F.col("ord")), "name")
        .when(F.col("_barred"), "barred")
        .otherwise("signature")
    )
    return (
        marked.join(names, [*keys, "name"], "left")
        .withColumn("status", status)
        .drop("_kept", "_seen", "_barred", "_name_from", "ord")
    )


def drop_counts(validated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dropped candidates per reason."""
    return (
        validated.filter(F.col("status") != "kept")
        .groupBy(*(keys or ["capture_id"]), F.col("status").alias("reason"))
        .agg(F.count(F.lit(1)).alias("dropped"))
    )
