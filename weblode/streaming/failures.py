"""Tool failures to heal requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv


def known_failures(failures: DataFrame, tools: DataFrame, server: str = "server_id") -> DataFrame:
    """Well-formed failures of known tools, from a streaming or a batch ``failures`` frame."""
    known = tools.select(server, F.col("name").alias("tool_name")).distinct()
    sound = failures.filter(
        F.col("error_class").isin(fv.FAILURE_CLASSES) & F.col("observed_at").isNotNull()
    )
    return sound.join(known, [server, "tool_name"])


def heal_requests(failures: DataFrame, tools: DataFrame, server: str = "server_id") -> DataFrame:
    """Stream-static join: one heal request per well-formed failure of a known tool.

    Works on a streaming or a batch ``failures`` frame with ``server_id, tool_name, error_class,
    detail, observed_at``.
    """
    return known_failures(failures, tools, server).select(
        F.lit("self_heal").alias("kind"),
        server,
        "tool_name",
        F.struct("error_class", "detail", "observed_at").alias("failure"),
    )


def first_heal_requests(failures: DataFrame, tools: DataFrame, delay: str = "1 hour", server: str = "server_id") -> DataFrame:
    """One heal request for the failures of a tool that lie within ``delay`` of its first one.

    ``failures`` is a stream.  Its state holds one row per failing tool and lets go of it once the watermark has passed; failures that
    arrive later than ``delay`` after newer ones are dropped.
    """
    # the watermark comes first: it advances with every event, known tool or not
    timed = failures.withWatermark("observed_at", delay)
    once = known_failures(timed, tools, server).dropDuplicatesWithinWatermark([server, "tool_name"])
    return once.select(
        F.lit("self_heal").alias("kind"),
        server,
        "tool_name",
        F.struct("error_class", "detail", "observed_at").alias("failure"),
    )


def stream_failures(
    failures: DataFrame, tools: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", server: str = "server_id"
) -> StreamingQuery:
    """Write the heal requests of a stream of failures, repeated failures of a tool giving one, until it is drained."""
    return (
        first_heal_requests(failures, tools, delay, server)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
