"""Trace export requests: reading, flattening and event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.spans import event_time, hex_id
from tracewarden.schema import SPAN_COLUMNS

# The JSON form writes ids as hex text, 64-bit numbers as text, and names in
# camel case (fixed values of the export format).
_JSON_VALUE_LEAF = (
    "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,"
    "arrayValue:string,kvlistValue:string,bytesValue:string>"
)
_JSON_ATTRIBUTES = f"array<struct<key:string,value:{_JSON_VALUE_LEAF}>>"
_JSON_SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,flags:int,"
    "name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{_JSON_ATTRIBUTES},"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_JSON_ATTRIBUTES},"
    "droppedAttributesCount:int>>,"
    "links:array<struct<traceId:string,spanId:string,traceState:string,"
    f"attributes:{_JSON_ATTRIBUTES},droppedAttributesCount:int,flags:int>>,"
    "droppedAttributesCount:int,droppedEventsCount:int,droppedLinksCount:int,"
    "status:struct<message:string,code:int>>"
)
REQUESTS = (
    "resourceSpans array<struct<"
    f"resource:struct<attributes:{_JSON_ATTRIBUTES},droppedAttributesCount:int>,"
    "scopeSpans:array<struct<"
    f"scope:struct<name:string,version:string,attributes:{_JSON_ATTRIBUTES},"
    "droppedAttributesCount:int>,"
    f"spans:array<{_JSON_SPAN}>,schemaUrl:string>>,schemaUrl:string>>"
)


def read_otlp(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Export requests, one JSON object per line, with a fixed schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(REQUESTS).option("mode", "FAILFAST").json(path)


def read_otlp_kafka(
    spark: SparkSession, servers: str, topic: str, descriptor: str, message: str
) -> DataFrame:
    """Requests from a broker, from the earliest offset, decoded from protobuf.

    Needs the Kafka and protobuf packages on the class path.  ``descriptor``
    is the compiled descriptor file of the export request ``message``.
    """
    from pyspark.sql.protobuf.functions import from_protobuf

    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    # Values nest in values; deeper ones than this are cut by the decoder.
    options = {"recursive.fields.max.depth": "3", "enums.as.ints": "true", "mode": "FAILFAST"}
    return decoded_requests(raw.select(from_protobuf("value", message, descriptor, options).alias("r")), "r")


def decoded_requests(df: DataFrame, column: str) -> DataFrame:
    """Requests from a struct whose fields bear the names of the descriptor.

    Ids and byte values are binary there, times and counts numbers.
    """
    has = lambda kind, name: name in kind.fieldNames()

    def values(v: Column, kind) -> Column:
        nested = lambda name: F.to_json(v[name]) if has(kind, name) else F.lit(None).cast("string")
        return F.struct(
            v["string_value"].alias("stringValue"),
            v["bool_value"].alias("boolValue"),
            v["int_value"].cast("string").alias("intValue"),
            v["double_value"].alias("doubleValue"),
            nested("array_value").alias("arrayValue"),
            nested("kvlist_value").alias("kvlistValue"),
            F.base64(v["bytes_value"]).alias("bytesValue"),
        )

    def attributes(c: Column, kind) -> Column:
        inner = kind["attributes"].dataType.elementType["value"].dataType
        one = lambda a: F.struct(a["key"].alias("key"), values(a["value"], inner).alias("value"))
        return F.transform(c["attributes"], one).alias("attributes")

    dropped = lambda c: c["dropped_attributes_count"].cast("int").alias("droppedAttributesCount")
    text = lambda c, name: c.cast("string").alias(name)

    def span(s: Column, kind) -> Column:
        event_kind, link_kind = (kind[n].dataType.elementType for n in ("events", "links"))
        events = F.transform(
            s["events"],
            lambda e: F.struct(
                text(e["time_unix_nano"], "timeUnixNano"), e["name"].alias("name"), attributes(e, event_kind), dropped(e)
            ),
        )
        links = F.transform(
            s["links"],
            lambda x: F.struct(
                hex_id(x["trace_id"]).alias("traceId"), hex_id(x["span_id"]).alias("spanId"),
                x["trace_state"].alias("traceState"), attributes(x, link_kind), dropped(x), x["flags"].cast("int").alias("flags"),
            ),
        )
        status = F.struct(s["status"]["message"].alias("message"), s["status"]["code"].cast("int").alias("code"))
        return F.struct(
            hex_id(s["trace_id"]).alias("traceId"),
            hex_id(s["span_id"]).alias("spanId"),
            hex_id(s["parent_span_id"]).alias("parentSpanId"),
            s["trace_state"].alias("traceState"),
            s["flags"].cast("int").alias("flags"),
            s["name"].alias("name"),
            s["kind"].cast("int").alias("kind"),
            text(s["start_time_unix_nano"], "startTimeUnixNano"),
            text(s["end_time_unix_nano"], "endTimeUnixNano"),
            attributes(s, kind),
            events.alias("events"),
            links.alias("links"),
            dropped(s),
            s["dropped_events_count"].cast("int").alias("droppedEventsCount"),
            s["dropped_links_count"].cast("int").alias("droppedLinksCount"),
            F.when(s["status"].isNotNull(), status).alias("status"),
        )

    def scope_spans(ss: Column, kind) -> Column:
        scope, scope_kind = ss["scope"], kind["scope"].dataType
        named = F.struct(scope["name"].alias("name"), scope["version"].alias("version"), attributes(scope, scope_kind), dropped(scope))
        inner = kind["spans"].dataType.elementType
        spans = F.transform(ss["spans"], lambda s: span(s, inner))
        return F.struct(F.when(scope.isNotNull(), named).alias("scope"), spans.alias("spans"), ss["schema_url"].alias("schemaUrl"))

    def resource_spans(rs: Column, kind) -> Column:
        resource, resource_kind = rs["resource"], kind["resource"].dataType
        named = F.struct(attributes(resource, resource_kind), dropped(resource))
        inner = kind["scope_spans"].dataType.elementType
        scopes = F.transform(rs["scope_spans"], lambda ss: scope_spans(ss, inner))
        return F.struct(F.when(resource.isNotNull(), named).alias("resource"), scopes.alias("scopeSpans"), rs["schema_url"].alias("schemaUrl"))

    kind = df.schema[column].dataType["resource_spans"].dataType.elementType
    made = F.transform(F.col(column)["resource_spans"], lambda rs: resource_spans(rs, kind))
    return df.select(made.cast(REQUESTS.split(" ", 1)[1]).alias("resourceSpans"))


def _as_field_types() -> str:
    name, kind = REQUESTS.split(" ", 1)
    return f"{name}:{kind}"


def parse_requests(df: DataFrame, column: str) -> DataFrame:
    """Requests from a text column that holds one JSON request per row.

    A malformed request fails the job, as in ``read_otlp``; a NULL has no spans.
    """
    parsed = F.from_json(F.col(column), f"struct<{_as_field_types()}>", {"mode": "FAILFAST"})
    return df.select(parsed.alias("r")).select("r.*")


def _attributes(column: Column) -> Column:
    def entry(a: Column) -> Column:
        v = a["value"]
        return F.struct(
            a["key"].alias("key"),
            F.struct(
                v["stringValue"].alias("string_value"),
                v["boolValue"].alias("bool_value"),
                v["intValue"].cast("bigint").alias("int_value"),
                v["doubleValue"].alias("double_value"),
                v["arrayValue"].alias("array_value"),
                v["kvlistValue"].alias("kvlist_value"),
                F.unbase64(v["bytesValue"]).alias("bytes_value"),
            ).alias("value"),
        )

    return F.transform(F.coalesce(column, F.array().cast(_JSON_ATTRIBUTES)), entry)


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _id(column: Column) -> Column:
    return F.lower(_text(column))


def flatten_spans(requests: DataFrame) -> DataFrame:
    """One row per span, carrying its resource, its scope and both schema urls."""
    # From a plain explode the optimizer infers filters that would parse the
    # requests again; empty lists are dropped after the last one instead.
    each = lambda column, name: F.posexplode_outer(column).alias("at", name)
    # Resource and scope are built once each, before their spans are listed.
    resource, scope = F.col("rs.resource"), F.col("ss.scope")
    per_resource = requests.select(each("resourceSpans", "rs")).select(
        F.struct(
            _attributes(resource["attributes"]).alias("attributes"),
            _zero(resource["droppedAttributesCount"]).alias("dropped_attributes_count"),
        ).cast(SPAN_COLUMNS["resource"]).alias("resource"),
        _text(F.col("rs.schemaUrl")).alias("resource_url"),
        F.col("rs.scopeSpans").alias("scopes"),
    )
    per_scope = per_resource.select("resource", "resource_url", each("scopes", "ss")).select(
        "resource",
        "resource_url",
        F.struct(
            _text(scope["name"]).alias("name"),
            _text(scope["version"]).alias("version"),
            _attributes(scope["attributes"]).alias("attributes"),
            _zero(scope["droppedAttributesCount"]).alias("dropped_attributes_count"),
        ).cast(SPAN_COLUMNS["scope"]).alias("scope"),
        _text(F.col("ss.schemaUrl")).alias("scope_url"),
        F.col("ss.spans").alias("spans"),
    )
    per_span = per_scope.select("resource", "resource_url", "scope", "scope_url", each("spans", "s"))
    per_span = per_span.filter("at is not null")
    s = F.col("s")
    events = F.transform(
        F.coalesce(s["events"], F.array()),
        lambda e: F.struct(
            e["timeUnixNano"].cast("bigint").alias("time_unix_nano"),
            _text(e["name"]).alias("name"),
            _attributes(e["attributes"]).alias("attributes"),
            _zero(e["droppedAttributesCount"]).alias("dropped_attributes_count"),
        ),
    )
    links = F.transform(
        F.coalesce(s["links"], F.array()),
        lambda x: F.struct(
            _id(x["traceId"]).alias("trace_id"),
            _id(x["spanId"]).alias("span_id"),
            _text(x["traceState"]).alias("trace_state"),
            _attributes(x["attributes"]).alias("attributes"),
            _zero(x["droppedAttributesCount"]).alias("dropped_attributes_count"),
            _zero(x["flags"]).alias("flags"),
        ),
    )
    columns = {
        "trace_id": _id(s["traceId"]),
        "span_id": _id(s["spanId"]),
        "parent_span_id": _id(s["parentSpanId"]),
        "trace_state": _text(s["traceState"]),
        "flags": _zero(s["flags"]),
        "name": _text(s["name"]),
        "kind": _zero(s["kind"]),
        "start_time_unix_nano": s["startTimeUnixNano"].cast("bigint"),
        "end_time_unix_nano": s["endTimeUnixNano"].cast("bigint"),
        "attributes": _attributes(s["attributes"]),
        "events": events,
        "links": links,
        "dropped_attributes_count": _zero(s["droppedAttributesCount"]),
        "dropped_events_count": _zero(s["droppedEventsCount"]),
        "dropped_links_count": _zero(s["droppedLinksCount"]),
        "status": F.struct(
            _text(s["status"]["message"]).alias("message"),
            _zero(s["status"]["code"]).alias("code"),
        ),
        "scope": F.col("scope"),
        "scope_schema_url": F.col("scope_url"),
        "resource": F.col("resource"),
        "resource_schema_url": F.col("resource_url"),
    }
    return per_span.select(
        *[columns[name].cast(kind).alias(name) for name, kind in SPAN_COLUMNS.items()]
    )


def with_event_time(spans: DataFrame, max_out_of_orderness: str = "500 milliseconds") -> DataFrame:
    """Add ``ts`` (span start, millisecond precision); streams get a watermark.

    Spark takes the watermark from the largest event time seen anywhere, so a
    source partition that falls idle never holds it back.
    """
    timed = spans.withColumn("ts", event_time(F.col("start_time_unix_nano")))
    return timed.withWatermark("ts", max_out_of_orderness) if spans.isStreaming else timed
