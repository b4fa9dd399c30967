"""Captures: contract-checked bundles, and plain html tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed_values as fv
from ..functions import text, urls
from ..functions.expr import cut
from ..functions.json_help import SECRET_FIELD_RLIKE
from ..schema import WHOLE, WIRE_CALL, WIRE_CAPTURE, WIRE_PAGE, Limits

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$"
_ANY_URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:\S+$"

CAPTURE_COLUMNS = [
    "capture_id",
    "url",
    "captured_at",
    "title",
    "rendered_with_js",
    "html",
    "dom_hash",
    "network",
    "page",
]


def secret_name(name: Column) -> Column:
    """Whether a header or field name is on the secret list."""
    return F.lower(name).isin(fv.SECRET_HEADERS) | name.rlike(SECRET_FIELD_RLIKE)


def _too_long(value: Column, limit: int | None) -> Column:
    if limit is None:
        return F.lit(False)
    return F.coalesce(F.length(value) > limit, F.lit(False))


def _missing_or_long(value: Column, limit: int | None) -> Column:
    return value.isNull() | _too_long(value, limit)


def _call_problem(call: Column, limits: Limits) -> Column:
    keys = F.map_keys(call["requestHeaders"])
    return (
        _missing_or_long(call["method"], 16)
        | _missing_or_long(call["urlPattern"], limits.url)
        | _missing_or_long(call["rawUrl"], limits.url)
        | ~call["rawUrl"].rlike(_ANY_URL)
        | call["requestHeaders"].isNull()
        | call["statusCode"].isNull()
        | call["contentType"].isNull()
        | _too_long(call["requestBody"], limits.request_body)
        | F.exists(keys, lambda k: F.length(k) > 256)
        | F.exists(
            F.map_values(call["requestHeaders"]),
            lambda v: _missing_or_long(v, limits.header_value),
        )
    )


def _any(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def _longer(array: Column, n: int | None) -> Column:
    if n is None:
        return F.lit(False)
    return F.coalesce(F.size(array) > n, F.lit(False))


def _page_problem(page: Column, limits: Limits) -> Column:
    bounded = lambda n: None if limits.listed is None else n  # noqa: E731  bounds of the contract, or none
    def bad_field(f: Column) -> Column:
        return (
            _missing_or_long(f["name"], bounded(256))
            | _missing_or_long(f["type"], bounded(64))
            | _too_long(f["label"], bounded(512))
            | _too_long(f["placeholder"], bounded(512))
            | f["required"].isNull()
            | _too_long(f["selector"], bounded(2_000))
        )

    def bad_form(f: Column) -> Column:
        return (
            _missing_or_long(f["selector"], bounded(2_000))
            | f["method"].isNull()
            | ~f["method"].isin("GET", "POST")
            | f["purpose"].isNull()
            | ~f["purpose"].isin(fv.FORM_PURPOSES)
            | f["fields"].isNull()
            | _longer(f["fields"], limits.listed)
            | _any(f["fields"], bad_field)
        )

    def bad_action(a: Column) -> Column:
        return (
            a["kind"].isNull()
            | ~a["kind"].isin(fv.ACTION_KINDS)
            | _missing_or_long(a["label"], bounded(512))
            | _missing_or_long(a["selector"], bounded(2_000))
        )

    def bad_state(s: Column) -> Column:
        return _missing_or_long(s["source"], bounded(512)) | _longer(s["keys"], bounded(200)) | _longer(s["types"], limits.listed)

    return (
        _too_long(page["visibleText"], limits.visible_text)
        | _longer(page["headings"], limits.listed)
        | _longer(page["actions"], bounded(300))
        | _any(page["actions"], bad_action)
        | _longer(page["forms"], bounded(50))
        | _any(page["forms"], bad_form)
        | _longer(page["appState"], bounded(50))
        | _any(page["appState"], bad_state)
    )


def contract_errors(limits: Limits) -> Column:
    """Names of the contract rules a bundle breaks; empty when it is accepted."""
    c = F.col
    headers = lambda call: F.map_keys(call["requestHeaders"])
    rules = {
        "unreadable": c("_corrupt_record").isNotNull(),
        "bundle_id": c("bundleId").isNull() | ~c("bundleId").rlike(_UUID),
        "source": c("source").isNull() | ~c("source").isin(fv.CAPTURE_SOURCES),
        "url": c("url").isNull() | ~c("url").rlike(_ANY_URL),
        "captured_at": c("capturedAt").isNull()
        | ~c("capturedAt").rlike(_ISO_TIME)
        | F.try_to_timestamp(c("capturedAt")).isNull(),
        "legal_mode": c("legalMode").isNull() | ~c("legalMode").isin(fv.LEGAL_MODES),
        "tier": c("tier").isNotNull() & ~c("tier").isin(1, 2, 3, 4),
        "html": c("dom.html").isNull() | _too_long(c("dom.html"), limits.html),
        "dom_hash": _missing_or_long(c("dom.domHash"), 128),
        "selectors": _longer(c("dom.selectorsOfInterest"), None if limits.listed is None else 200)
        | _any(
            c("dom.selectorsOfInterest"),
            lambda e: _missing_or_long(e["role"], 128)
            | _missing_or_long(e["selector"], 2_000)
            | _longer(e["fallbackSelectors"], 10),
        ),
        "network": c("network").isNull()
        | _longer(c("network"), limits.calls)
        | _any(c("network"), lambda x: _call_problem(x, limits)),
        "too_many_headers": _any(c("network"), lambda x: _longer(headers(x), limits.headers)),
        "secret_header": _any(c("network"), lambda x: F.exists(headers(x), secret_name)),
        "page": c("page").isNotNull() & _page_problem(c("page"), limits),
        "rendered_with_js": c("meta.renderedWithJs").isNull(),
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()])
    )


def check_captures(bundles: DataFrame, limits: Limits = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Split parsed bundles into (accepted captures, rejected bundles with their errors).

    Rules of form always hold; rules of size only with the limits that set them.
    """
    if "_corrupt_record" not in bundles.columns:
        bundles = bundles.withColumn("_corrupt_record", F.lit(None).cast("string"))
    checked = bundles.withColumn("errors", contract_errors(limits))
    accepted = checked.filter(F.size("errors") == 0).select(
        F.col("bundleId").alias("capture_id"),
        "url",
        F.try_to_timestamp(F.col("capturedAt")).alias("captured_at"),
        F.col("meta.title").alias("title"),
        F.col("meta.renderedWithJs").alias("rendered_with_js"),
        F.col("dom.html").alias("html"),
        F.col("dom.domHash").alias("dom_hash"),
        "network",
        "page",
        F.col("dom.selectorsOfInterest").alias("selectors"),
    )
    rejected = checked.filter(F.size("errors") > 0).select("bundleId", "url", "errors", "_corrupt_record")
    return accepted, rejected


def read_captures(
    spark: SparkSession, path: str, limits: Limits = WHOLE
) -> tuple[DataFrame, DataFrame]:
    """Bundle JSON lines, checked against the closed contract; a bad bundle is refused whole."""
    schema = StructType(WIRE_CAPTURE.fields + [StructField("_corrupt_record", StringType())])
    bundles = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return check_captures(bundles, limits)


def spread_small(scan: DataFrame) -> DataFrame:
    """Spread a direct file scan over all cores when it has fewer files than there are cores.

    Mining html is work for the processor.  The rows are the same either way; a corpus has more
    files than cores and is left alone.
    """
    spark = scan.sparkSession
    cores = int(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    return scan if len(scan.inputFiles()) >= cores else scan.repartition(cores)


def read_pages(pages: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Captures from a table of ``page_id, url, html``; no calls, not rendered."""
    html = cut(F.col("html"), limits.html)
    return pages.select(
        F.col("page_id").alias("capture_id"),
        "url",
        F.lit(None).cast("timestamp").alias("captured_at"),
        text.capture_title(html, limits.title).alias("title"),
        F.lit(False).alias("rendered_with_js"),
        html.alias("html"),
        F.sha2(html, 256).alias("dom_hash"),
        F.array().cast(f"array<{WIRE_CALL.simpleString()}>").alias("network"),
        F.lit(None).cast(WIRE_PAGE).alias("page"),
    )


def calls_of(captures: DataFrame) -> DataFrame:
    """One row per captured call, with its place in the capture."""
    return captures.select(
        "capture_id", F.col("url").alias("page_url"), F.posexplode("network").alias("pos", "call")
    ).select(
        "capture_id",
        "page_url",
        F.col("pos").cast("long"),
        F.col("call.method").alias("method"),
        F.col("call.urlPattern").alias("url_pattern"),
        F.col("call.rawUrl").alias("raw_url"),
        F.col("call.requestHeaders").alias("headers"),
        F.col("call.requestBodySchema").alias("body_schema"),
        F.col("call.requestBody").alias("body"),
        F.col("call.responseSchema").alias("response_schema"),
        F.col("call.statusCode").alias("status"),
        F.col("call.contentType").alias("content_type"),
    )


def site_of(url: Column) -> Column:
    """Site key of a page: the last two labels of its host."""
    return urls.registrable_domain(urls.parts(url)["host"])
