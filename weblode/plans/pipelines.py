"""The three entry points, end to end over a corpus.

Stages that several later steps read are written to ``workdir`` once (or checkpointed when no
folder is given), so html is parsed once and a lost executor costs a re-read, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import candidates as cand
from ..operators.calls import dedupe_calls
from ..operators.coverage import merge_new_tools
from ..operators.dedupe import drop_counts, validate_candidates
from ..operators.frontier import public_targets
from ..operators.pages import mine
from ..operators.registry import registry_status
from ..operators.verify import annotated_confidence, keep_live, verify_tools
from ..session import staged
from ..schema import CANDIDATE_COLUMNS, WHOLE, Limits
from ..sources.robots import robots_gate
from ..sources.sinks import payload_table


def prepare_payloads(
    captures: DataFrame, robots: DataFrame | None = None, policy: str = "respect", limits: Limits = WHOLE
) -> DataFrame:
    """Captures to the per-page input of a proposer.

    Only public pages that robots rules allow.  The rules meet addresses alone, and pages that are not
    allowed are dropped before anything is mined.
    """
    public = public_targets(captures, "url")
    if robots is not None:
        gated = robots_gate(public.select("capture_id", "url"), robots, policy=policy)
        allowed = gated.filter("robots_allowed").select("capture_id").distinct()
        public = public.join(allowed, "capture_id", "left_semi")
    return payload_table(public, limits=limits)


def infer_tools(
    captures: DataFrame,
    calls: DataFrame | None = None,
    recipes: list[cand.Recipe] | None = None,
    proposals: DataFrame | None = None,
    workdir: str | None = None,
    limits: Limits = WHOLE,
) -> tuple[DataFrame, DataFrame]:
    """Captures (and their calls) to (clean tools, dropped-candidate counts)."""
    mined = mine(captures, workdir, limits)
    if calls is not None:
        calls = dedupe_calls(calls)
    found = cand.all_candidates(mined, calls, recipes, limits)
    if proposals is not None:
        found = found.unionByName(proposals)
    table = staged(found, workdir, "candidates")
    checked = staged(validate_candidates(table), workdir, "checked")
    pages = mined.select("capture_id", F.col("url").alias("page_url"))
    kept = checked.filter(F.col("status") == "kept").join(pages, "capture_id")
    clean = cand.cleanup_tools(kept).select(*CANDIDATE_COLUMNS)
    return cand.with_content_floor(clean, mined), drop_counts(checked)


def generate(
    captures: DataFrame,
    calls: DataFrame | None = None,
    recipes: list[cand.Recipe] | None = None,
    specs: DataFrame | None = None,
    probes: DataFrame | None = None,
    fresh_values: DataFrame | None = None,
    workdir: str | None = None,
    limits: Limits = WHOLE,
) -> tuple[DataFrame, DataFrame]:
    """Captures to (tools with confidence, registry rows): infer, add described operations, verify."""
    tools, _ = infer_tools(captures, calls, recipes, workdir=workdir, limits=limits)
    if specs is not None:
        # described operations belong to the origin: they are attached to its first page, not to each
        origins = (
            captures.select("capture_id", urls.parts_of("url")["origin"].alias("origin"))
            .groupBy("origin").agg(F.min("capture_id").alias("capture_id"))
        )
        described = (
            cand.spec_candidates(specs)
            .withColumnRenamed("capture_id", "origin")
            .join(origins, "origin")
            .select(*CANDIDATE_COLUMNS)
        )
        tools = merge_new_tools(tools, described, key="capture_id")
    if probes is not None:
        verified = verify_tools(tools, probes, fresh_values)
        tools = verified.withColumn("confidence", annotated_confidence()).select(*tools.columns)
    tools = staged(tools, workdir, "tools")
    return tools, registry_status(captures, tools)


def emit(
    tools: DataFrame, probes: DataFrame, fresh_values: DataFrame | None = None
) -> DataFrame:
    """Proposed tools to the ones worth publishing: public, sound, alive (or all, if none lives)."""
    named = tools.withColumn("server_id", F.col("capture_id"))
    checked = validate_candidates(named, ["capture_id"])
    sound = checked.filter(F.col("status") == "kept").drop("status")
    public = sound.filter(F.col("kind") != "http").unionByName(
        public_targets(sound.filter(F.col("kind") == "http"), "raw_url")
    )
    live = keep_live(verify_tools(public, probes, fresh_values))
    return live.withColumn("confidence", annotated_confidence())
