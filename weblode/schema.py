"""Column layouts and size limits.

``Limits()`` keeps whole texts and whole lists and is what every job uses unless told otherwise.
``Limits.contract()`` holds every bound of the capture contract and of the bounded reports, for
callers who need page-for-page agreement with a bounded capture.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Limits:
    html: int | None = None
    wall_window: int | None = None
    probe_window: int | None = None
    sample: int | None = None
    readable: int | None = None
    links: int | None = None
    shown_links: int | None = None
    forms: int | None = None
    fields: int | None = None
    buttons: int | None = None
    jsonld_types: int | None = None
    search_actions: int | None = None
    headers: int | None = None
    header_value: int | None = None
    calls: int | None = None
    request_body: int | None = None
    url: int | None = None
    title: int | None = None
    description: int | None = None
    link_text: int | None = None
    button_label: int | None = None
    headings: int | None = None
    kind_sample: int | None = None
    page_params: int | None = None
    detail_templates: int | None = None
    query_groups: int | None = None
    query_params: int | None = None
    candidate_forms: int | None = None
    candidate_fields: int | None = None
    candidate_calls: int | None = None
    cross_site_calls: int | None = None
    schema_keys: int | None = None
    body_fields: int | None = None
    body_depth: int | None = None
    app_states: int | None = None
    new_actions: int | None = None
    dom_sample: int | None = None
    visible_text: int | None = None
    name: int | None = None
    listed: int | None = None

    @staticmethod
    def contract() -> "Limits":
        return Limits(
            html=200_000,
            wall_window=60_000,
            probe_window=20_000,
            sample=8_000,
            readable=40_000,
            links=160,
            shown_links=80,
            forms=12,
            fields=16,
            buttons=80,
            jsonld_types=40,
            search_actions=8,
            headers=64,
            header_value=2_000,
            calls=200,
            request_body=32_000,
            url=4_000,
            title=240,
            description=500,
            link_text=180,
            button_label=120,
            headings=12,
            kind_sample=2_000,
            page_params=6,
            detail_templates=6,
            query_groups=8,
            query_params=6,
            candidate_forms=6,
            candidate_fields=8,
            candidate_calls=30,
            cross_site_calls=6,
            schema_keys=12,
            body_fields=6,
            body_depth=2,
            app_states=12,
            new_actions=8,
            dom_sample=8_000,
            visible_text=12_000,
            name=256,
            listed=100,
        )


WHOLE = Limits()


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, INT, LONG, BOOL, DBL = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.DoubleType(),
)

ELEMENT = _s(("role", STR), ("selector", STR), ("fallbackSelectors", T.ArrayType(STR)))

# one captured call as written on the wire; free-form schemas stay JSON text
WIRE_CALL = _s(
    ("method", STR),
    ("urlPattern", STR),
    ("rawUrl", STR),
    ("requestHeaders", T.MapType(STR, STR)),
    ("requestBodySchema", STR),
    ("requestBody", STR),
    ("responseSchema", STR),
    ("statusCode", INT),
    ("contentType", STR),
)

WIRE_FIELD = _s(
    ("name", STR),
    ("type", STR),
    ("label", STR),
    ("placeholder", STR),
    ("required", BOOL),
    ("selector", STR),
)

WIRE_FORM = _s(
    ("selector", STR),
    ("method", STR),
    ("action", STR),
    ("purpose", STR),
    ("submitLabel", STR),
    ("submitSelector", STR),
    ("fields", T.ArrayType(WIRE_FIELD)),
)

WIRE_ACTION = _s(("kind", STR), ("label", STR), ("selector", STR), ("href", STR))

WIRE_STATE = _s(
    ("source", STR),
    ("keys", T.ArrayType(STR)),
    ("schema", STR),
    ("types", T.ArrayType(STR)),
)

WIRE_PAGE = _s(
    ("visibleText", STR),
    ("headings", T.ArrayType(STR)),
    ("actions", T.ArrayType(WIRE_ACTION)),
    ("forms", T.ArrayType(WIRE_FORM)),
    ("appState", T.ArrayType(WIRE_STATE)),
)

WIRE_CAPTURE = _s(
    ("bundleId", STR),
    ("source", STR),
    ("url", STR),
    ("capturedAt", STR),
    ("legalMode", STR),
    ("tier", INT),
    (
        "dom",
        _s(("html", STR), ("domHash", STR), ("selectorsOfInterest", T.ArrayType(ELEMENT))),
    ),
    ("network", T.ArrayType(WIRE_CALL)),
    ("page", WIRE_PAGE),
    ("meta", _s(("title", STR), ("robotsAllowed", BOOL), ("renderedWithJs", BOOL))),
)

# one line of a raw network log
NETWORK_LOG = _s(
    ("capture_id", STR),
    ("pos", LONG),
    ("method", STR),
    ("url", STR),
    ("requestHeaders", T.MapType(STR, STR)),
    ("reqContentType", STR),
    ("requestPostData", STR),
    ("status", INT),
    ("contentType", STR),
    ("responseBody", STR),
)

PARAM = _s(("name", STR), ("place", STR), ("key", STR), ("type", STR), ("required", BOOL))
STEP = _s(("action", STR), ("role", STR), ("selector", STR), ("value", STR))

# every proposal of a callable endpoint or page capability
CANDIDATE_COLUMNS = [
    "capture_id",
    "source_rank",
    "source",
    "pos",
    "name",
    "description",
    "kind",
    "method",
    "url_pattern",
    "raw_url",
    "params",
    "steps",
    "confidence",
]
PARAMS_DDL = "array<struct<name:string,place:string,key:string,type:string,required:boolean>>"
STEPS_DDL = "array<struct<action:string,role:string,selector:string,value:string>>"
