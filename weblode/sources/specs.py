"""API descriptions (JSON) to operations, and GraphQL endpoints.

A description is one row; maps read by ``from_json`` keep document order, so naming and
limits that depend on the order are decided inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import urls
from ..functions.expr import built_once, let
from ..functions.rows import first_rows, unnest

_SPEC = (
    "openapi string, swagger string, paths map<string,string>, "
    "servers array<struct<url:string>>, host string, basePath string, schemes array<string>"
)
_ITEM = "parameters array<string>, " + ", ".join(f"`{m}` string" for m in fv.SPEC_METHODS)
_OPERATION = (
    "operationId string, summary string, description string, deprecated boolean, "
    "parameters array<string>, requestBody struct<content:map<string,struct<schema:string>>>"
)
_PARAMETER = (
    "name string, `in` string, required boolean, `$ref` string, type string, "
    "schema string, description string"
)
_BODY = "properties map<string,string>, required array<string>"




def parse_spec(doc: Column) -> Column:
    """Parsed description, or NULL when the text is not one."""
    return let(
        F.from_json(doc, _SPEC),
        lambda s: F.when(
            (s["openapi"].isNotNull() | s["swagger"].isNotNull()) & s["paths"].isNotNull(), s
        ),
    )


def _base_url(spec: Column, origin: Column) -> Column:
    server = F.get(spec["servers"], F.lit(0))["url"]
    resolved = urls.absolute(server, urls.parts(origin))
    scheme = F.when(
        F.coalesce(F.array_contains(spec["schemes"], "https"), F.lit(True)), F.lit("https")
    ).otherwise(F.coalesce(F.get(spec["schemes"], F.lit(0)), F.lit("https")))
    hosted = F.when(
        spec["host"] != "",
        F.concat(scheme, F.lit("://"), spec["host"], F.coalesce(spec["basePath"], F.lit(""))),
    )
    return F.regexp_replace(F.coalesce(resolved, hosted, origin), "/+$", "")


def _operation_slug(text: Column) -> Column:
    snake = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2")
    cleaned = F.regexp_replace(F.regexp_replace(snake, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return let(
        F.substring(F.lower(cleaned), 1, 64),
        lambda s: F.when((s == "") | s.rlike("^[a-z]"), s).otherwise(
            F.substring(F.concat(F.lit("op_"), s), 1, 64)
        ),
    )


def _argument_name(name: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "")
    return let(cleaned, lambda n: F.when(n == "", F.lit("arg")).otherwise(n))


def suffix_repeats(names: Column) -> Column:
    """Names made unique with ``_2``, ``_3`` ..., skipping suffixes already taken."""

    def step(used: Column, name: Column) -> Column:
        numbered = lambda i: F.concat(name, F.lit("_"), i.cast("string"))
        # earlier repeats took the numbers below this one, so it is free unless a real name holds it
        next_number = F.greatest(F.size(F.filter(F.slice(names, 1, F.size(used)), lambda n: n == name)) + 1, F.lit(2))
        options = F.transform(F.sequence(next_number, next_number + F.size(used)), numbered)
        fresh = F.when(~F.array_contains(used, numbered(next_number)), numbered(next_number)).otherwise(
            F.get(F.filter(options, lambda o: ~F.array_contains(used, o)), F.lit(0))
        )
        chosen = F.when(F.array_contains(used, name), fresh).otherwise(name)
        return F.concat(used, F.array(chosen))

    return F.aggregate(names, F.array().cast("array<string>"), step)


def _json_type(found: Column) -> Column:
    return F.when(found.isin(fv.JSON_TYPES), found).otherwise("string")


def _raw_param(name: Column, place: str | Column, type_: Column, required: Column) -> Column:
    return F.struct(
        _argument_name(name).alias("name"),
        (F.lit(place) if isinstance(place, str) else place).alias("place"),
        name.alias("key"),
        _json_type(type_).alias("type"),
        F.coalesce(required, F.lit(False)).alias("required"),
    )


def _body_params(schema_text: Column) -> Column:
    def build(schema: Column) -> Column:
        return F.transform(
            F.map_entries(schema["properties"]),
            lambda e: _raw_param(
                e["key"],
                "body",
                F.coalesce(
                    F.get_json_object(e["value"], "$.schema.type"),
                    F.get_json_object(e["value"], "$.type"),
                ),
                F.array_contains(schema["required"], e["key"]),
            ),
        )

    return let(F.from_json(schema_text, _BODY), build)


def _parameters(raw: Column) -> Column:
    """Parameters of an operation; unresolved references and cookies are left out."""

    def one(text: Column) -> Column:
        def build(p: Column) -> Column:
            inline = F.array(
                _raw_param(
                    p["name"],
                    p["in"],
                    F.coalesce(F.get_json_object(p["schema"], "$.type"), p["type"]),
                    p["required"] | (p["in"] == "path"),
                )
            )
            return (
                F.when(p["$ref"].isNotNull(), None)
                .when(p["in"] == "body", _body_params(p["schema"]))
                .when(
                    p["in"].isin("path", "query", "header") & (p["name"] != ""), inline
                )
            )

        return let(F.from_json(text, _PARAMETER), build)

    return F.flatten(F.filter(F.transform(raw, one), lambda x: x.isNotNull()))


def _unique_params(params: Column) -> Column:
    def rename(ps: Column) -> Column:
        names = suffix_repeats(F.transform(ps, lambda p: p["name"]))
        return let(
            names,
            lambda ns: F.transform(
                ps,
                lambda p, i: F.struct(
                    F.get(ns, i).alias("name"),
                    p["place"].alias("place"),
                    p["key"].alias("key"),
                    p["type"].alias("type"),
                    p["required"].alias("required"),
                ),
            ),
        )

    return let(params, rename)


_NO_PARAMS = "array<struct<name:string,place:string,key:string,type:string,required:boolean>>"


@built_once
def _operations(max_operations: int | None) -> Column:
    def of_item(entry: Column) -> Column:
        def methods(item: Column) -> Column:
            return F.array(
                *[
                    F.struct(
                        F.lit(m).alias("method"),
                        entry["key"].alias("path"),
                        F.coalesce(item["parameters"], F.array().cast("array<string>")).alias("shared"),
                        item[m].alias("text"),
                        F.from_json(item[m], _OPERATION).alias("op"),
                    )
                    for m in fv.SPEC_METHODS
                ]
            )

        return let(F.from_json(entry["value"], _ITEM), methods)

    rooted = F.filter(F.map_entries(F.col("spec.paths")), lambda e: F.startswith(e["key"], F.lit("/")))
    found = F.filter(
        F.flatten(F.transform(rooted, of_item)),
        lambda o: o["text"].rlike(r"^\s*\{") & ~F.coalesce(o["op"]["deprecated"], F.lit(False)),
    )
    return found if max_operations is None else F.slice(found, 1, max_operations)


@built_once
def _named_operations() -> Column:
    def slug(o: Column) -> Column:
        by_path = F.concat_ws("_", o["method"], F.regexp_replace(o["path"], r"\{[^}]+\}", "by"))
        own = _operation_slug(F.coalesce(o["op"]["operationId"], F.lit("")))
        return F.coalesce(
            F.nullif(own, F.lit("")),
            F.nullif(_operation_slug(by_path), F.lit("")),
            F.concat(o["method"], F.lit("_endpoint")),
        )

    names = suffix_repeats(F.transform(F.col("ops"), slug))
    return let(
        names,
        lambda ns: F.transform(
            F.col("ops"),
            lambda o, i: F.struct(i.cast("long").alias("pos"), F.get(ns, i).alias("name"), o.alias("o")),
        ),
    )


@built_once
def _operation_params() -> Column:
    listed = _parameters(
        F.concat(F.col("o.shared"), F.coalesce(F.col("o.op.parameters"), F.array().cast("array<string>")))
    )
    content = F.col("o.op.requestBody.content")
    body = F.coalesce(
        _body_params(F.try_element_at(content, F.lit("application/json"))["schema"]),
        F.array().cast(_NO_PARAMS),
    )
    return _unique_params(F.concat(listed, body))


def read_api_specs(specs: DataFrame, max_operations: int | None = None) -> DataFrame:
    """``(origin, doc)`` to one row per live operation, named from the description.

    ``max_operations`` bounds a report per description; by default all are kept.
    """
    parsed = (
        specs.withColumn("spec", parse_spec(F.col("doc")))
        .withColumn("base_url", _base_url(F.col("spec"), F.col("origin")))
        .withColumn("base", urls.parts_of("base_url"))
        .withColumn("ops", _operations(max_operations))
    )
    rows = unnest(parsed, ["origin", "base_url", "base"], _named_operations(), "pos")
    prefix = F.regexp_replace(F.coalesce(F.col("base.path"), F.lit("")), "/+$", "")
    pattern = F.concat(prefix, F.col("o.path"))
    host = F.coalesce(F.col("base.origin"), F.regexp_replace("origin", "/+$", ""))
    return rows.select(
        "origin",
        "pos",
        "name",
        F.substring(
            F.coalesce(
                F.nullif("o.op.summary", F.lit("")),
                F.nullif("o.op.description", F.lit("")),
                F.concat_ws(" ", F.upper("o.method"), F.col("o.path")),
            ),
            1,
            1000,
        ).alias("description"),
        F.upper("o.method").alias("method"),
        pattern.alias("url_pattern"),
        F.concat(host, pattern).alias("raw_url"),
        _operation_params().alias("params"),
        F.lit(0.85).alias("confidence"),
    ).filter(F.col("name").rlike(fv.TOOL_NAME) & (F.length("name") <= 64))


def _ordered_locations(spark: SparkSession, locations: list[str]) -> Column:
    """Place of column ``path`` in a fixed list, or NULL."""
    return F.nullif(
        F.array_position(F.array(*[F.lit(x) for x in locations]), F.col("path")), F.lit(0).cast("long")
    )


def first_spec_per_origin(fetched: DataFrame) -> DataFrame:
    """``(origin, path, body)`` to the first usable description per origin, in probing order."""
    usable = (
        fetched.withColumn("probe", _ordered_locations(fetched.sparkSession, fv.SPEC_LOCATIONS))
        .filter(F.col("probe").isNotNull())
        .filter(parse_spec(F.col("body")).isNotNull())
    )
    return first_rows(usable, ["origin"], [F.col("probe")]).select(
        "origin", "path", F.col("body").alias("doc")
    )


def _looks_like_graphql(body: Column, window: int | None) -> Column:
    hay = F.lower(body if window is None else F.substring(body, 1, window))
    return (
        hay.rlike("graphiql|graphql playground|must provide query string|missing query|graphql")
        | (F.contains(hay, F.lit('"data"')) & F.contains(hay, F.lit('"errors"')))
    )


def graphql_endpoints(fetched: DataFrame, window: int | None = None) -> DataFrame:
    """``(origin, path, body)`` to one passthrough candidate per origin."""
    found = (
        fetched.withColumn("probe", _ordered_locations(fetched.sparkSession, fv.GRAPHQL_LOCATIONS))
        .filter(F.col("probe").isNotNull())
        .filter(_looks_like_graphql(F.col("body"), window))
    )
    param = lambda name, type_, required: F.struct(
        F.lit(name).alias("name"),
        F.lit("body").alias("place"),
        F.lit(name).alias("key"),
        F.lit(type_).alias("type"),
        F.lit(required).alias("required"),
    )
    return first_rows(found.drop("body"), ["origin"], [F.col("probe")]).select(
        "origin",
        F.lit("graphql_query").alias("name"),
        F.lit("POST").alias("method"),
        F.col("path").alias("url_pattern"),
        F.concat("origin", "path").alias("raw_url"),
        F.array(param("query", "string", True), param("variables", "object", False)).alias("params"),
        F.lit(0.7).alias("confidence"),
    )
