"""Proposals from outside, and probe results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cut, let
from ..functions.rows import first_rows, unnest
from ..schema import PARAMS_DDL, STEPS_DDL, WHOLE, Limits

_TOOL = (
    "name string, description string, confidence double, inputSchema string, "
    "execution struct<kind:string, request:struct<method:string,urlPattern:string,rawUrl:string>, "
    "paramMapping:map<string,struct<`in`:string,`key`:string>>, "
    "steps:array<struct<action:string,target:struct<role:string,selector:string>,value:string>>>"
)


def read_candidates(raw: DataFrame, source: str = "proposed", source_rank: int = 0) -> DataFrame:
    """``(capture_id, raw)`` to candidate rows.

    Accepts a JSON array or ``{"tools": [...]}``; any other text gives no rows.
    """
    listed = F.coalesce(
        F.from_json("raw", "array<string>"),
        F.from_json("raw", "tools array<string>")["tools"],
        F.array().cast("array<string>"),
    )
    numbered = F.transform(
        listed, lambda t, i: F.struct(i.cast("bigint").alias("pos"), F.from_json(t, _TOOL).alias("t"))
    )
    rows = unnest(raw, ["capture_id"], numbered, "pos")
    schema = F.from_json(
        F.col("t.inputSchema"), "properties map<string,struct<type:string>>, required array<string>"
    )
    params = let(
        schema,
        lambda s: F.transform(
            F.map_entries("t.execution.paramMapping"),
            lambda e: F.struct(
                e["key"].alias("name"),
                e["value"]["in"].alias("place"),
                e["value"]["key"].alias("key"),
                F.coalesce(F.try_element_at(s["properties"], e["key"])["type"], F.lit("string")).alias("type"),
                F.coalesce(F.array_contains(s["required"], e["key"]), F.lit(False)).alias("required"),
            ),
        ),
    )
    steps = F.transform(
        "t.execution.steps",
        lambda x: F.struct(
            x["action"].alias("action"),
            x["target"]["role"].alias("role"),
            x["target"]["selector"].alias("selector"),
            x["value"].alias("value"),
        ),
    )
    return rows.select(
        "capture_id",
        F.lit(source_rank).alias("source_rank"),
        F.lit(source).alias("source"),
        "pos",
        F.col("t.name").alias("name"),
        F.col("t.description").alias("description"),
        F.col("t.execution.kind").alias("kind"),
        F.col("t.execution.request.method").alias("method"),
        F.col("t.execution.request.urlPattern").alias("url_pattern"),
        F.col("t.execution.request.rawUrl").alias("raw_url"),
        params.cast(PARAMS_DDL).alias("params"),
        steps.cast(STEPS_DDL).alias("steps"),
        F.col("t.confidence").alias("confidence"),
    )


def read_probe_results(probes: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """``(url, method, status, body)`` as the verifier expects them: one row per target.

    Of several probes of a target the newest counts, by ``observed_at`` where the table has it; equals
    are decided by status and body, so reruns agree.
    """
    named = probes.select(
        "url",
        F.upper(F.coalesce("method", F.lit("GET"))).alias("method"),
        F.col("status").cast("int").alias("status"),
        cut(F.coalesce("body", F.lit("")), limits.html).alias("body"),
        (F.col("observed_at") if "observed_at" in probes.columns else F.lit(None).cast("timestamp")).alias("observed_at"),
    )
    newest = [F.desc_nulls_last("observed_at"), F.col("status"), F.sha2("body", 256)]
    return first_rows(named, ["url", "method"], newest).drop("observed_at")
