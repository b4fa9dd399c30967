"""Raw network logs to call rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_help import body_shape, scrub_body
from ..functions.rows import first_rows
from ..operators.calls import scrub_headers, with_templates
from ..operators.frontier import public_target
from ..schema import NETWORK_LOG, WHOLE, Limits


def load_network_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NETWORK_LOG).json(path)


def read_network_log(log: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Log lines (``schema.NETWORK_LOG``) to scrubbed, templated calls.

    Keeps http(s) targets that are not obviously private.  The address test runs before any
    body is parsed.
    """
    kept = log.filter(F.col("url").rlike("(?i)^https?://") & public_target("url"))
    if limits.url is not None:
        kept = kept.filter(F.length("url") <= limits.url)
    if limits.calls is not None:
        kept = first_rows(kept, ["capture_id"], [F.col("pos")], n=limits.calls)
    json_request = F.coalesce(F.col("reqContentType"), F.lit("")).rlike("(?i)json")
    json_response = F.coalesce(F.col("contentType"), F.lit("")).rlike("(?i)json")
    replay = F.col("_body.replay")
    if limits.request_body is not None:
        replay = F.when(F.length(replay) <= limits.request_body, replay)
    shaped = kept.withColumn(
        "_body", scrub_body(F.when(json_request, F.col("requestPostData")))
    ).withColumn("response_schema", body_shape(F.when(json_response, F.col("responseBody"))))
    calls = shaped.select(
        "capture_id",
        "pos",
        F.upper(F.coalesce("method", F.lit("GET"))).alias("method"),
        F.col("url").alias("raw_url"),
        scrub_headers(
            F.coalesce("requestHeaders", F.create_map().cast("map<string,string>")), limits
        ).alias("headers"),
        F.col("_body.shape").alias("body_schema"),
        replay.alias("body"),
        "response_schema",
        F.coalesce("status", F.lit(0)).alias("status"),
        F.coalesce("contentType", F.lit("")).alias("content_type"),
    )
    return with_templates(calls)
