"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import payloads, spans as fs, terms
from tracewarden.operators import formulas as fm
from tracewarden.operators import metrics, monitor, properties, routing, temporal, trace_query, tree
from tracewarden.operators import sessions as ss
from tracewarden.plans import sql
from tracewarden.schema import (
    text_entry,
    KEY_VALUES, attribute_entry, bool_value, double_value, number_value, text_value,
)
from tracewarden.session import freeze, shared_dir
from tracewarden.sinks import text as text_sink, verdicts as verdict_sink
from tracewarden.sinks.spans import SpanStore
from tracewarden.sources import otlp, simspans, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000
GAP = 6 * HOUR
TTL = 48 * HOUR
LIMIT = 500_000_000
DAY_NS = 86_400_000_000_000


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def events(spark, d):
    return tables.spans_from_events(spark, d)


def chats(spark, d):
    return tables.spans_from_conversations(spark, d)


def orders(spark, d):
    return tables.spans_from_orders(spark, d)


def keyed(spark, d):
    return ss.key_by_attribute(events(spark, d), "bucket")


def by_trace(spark, d):
    return ss.key_by_trace(events(spark, d))


IDS = ["trace_id", "span_id"]
BUCKET_KEY = "coalesce(bucket, trace_id)"
EV_SESSIONS = sql.sessions(sql.EVENTS, BUCKET_KEY, GAP)
TRACE_SESSIONS = sql.sessions(sql.EVENTS, "trace_id", GAP)


# Columns used all over; built on call because they need a running session.
def attrs() -> Column:
    return F.col("attributes")


def messages_of() -> Column:
    return F.col("events")


def start() -> Column:
    return F.col("start_time_unix_nano")


def end() -> Column:
    return F.col("end_time_unix_nano")


def times() -> list[Column]:
    return [start().alias("start_ns"), end().alias("end_ns")]


def is_error() -> Column:
    return F.col("name") == "error"


def is_buy() -> Column:
    return F.col("name") == "purchase"


def tests() -> dict[str, Column]:
    return {"p": is_error(), "q": is_buy()}


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# --- sources ---------------------------------------------------------------

def _json_attributes(attributes: Column) -> Column:
    return F.transform(
        attributes,
        lambda a: F.struct(
            a["key"].alias("key"),
            F.struct(
                a["value"]["string_value"].alias("stringValue"),
                a["value"]["int_value"].cast("string").alias("intValue"),
            ).alias("value"),
        ),
    )


def _requests(spans: DataFrame) -> DataFrame:
    """One request per span: the span, two markers of it, and empty lists."""

    def span(suffix: str) -> Column:
        return F.struct(
            F.col("trace_id").alias("traceId"),
            F.concat("span_id", F.lit(suffix)).alias("spanId"),
            F.col("parent_span_id").alias("parentSpanId"),
            F.concat("name", F.lit(suffix)).alias("name"),
            F.col("kind"),
            start().cast("string").alias("startTimeUnixNano"),
            end().cast("string").alias("endTimeUnixNano"),
            _json_attributes(attrs()).alias("attributes"),
        )

    def scope(name: str, *spans: Column) -> Column:
        empty = F.filter(F.array(span("")), lambda _: F.lit(False))
        return F.struct(
            F.struct(F.lit(name).alias("name")).alias("scope"),
            (F.array(*spans) if spans else empty).alias("spans"),
            F.lit("schema/" + name).alias("schemaUrl"),
        )

    scopes = F.array(scope("main", span("")), scope("marks", span("-a"), span("-b")), scope("none"))
    resource = F.struct(
        F.struct(_json_attributes(F.col("resource.attributes")).alias("attributes")).alias("resource"),
        scopes.alias("scopeSpans"),
        F.lit("schema/resource").alias("schemaUrl"),
    )
    return spans.select(
        F.to_json(F.struct(F.array(resource).alias("resourceSpans"))).alias("value")
    )


_FLAT = f"""WITH {sql.EVENTS}
SELECT trace_id, span_id || suffix AS span_id, parent_span_id, name || suffix AS name, start_ns, end_ns,
       name AS event_type, service, scope, 'schema/' || scope AS scope_url, k
FROM spans, (VALUES ('', 'main'), ('-a', 'marks'), ('-b', 'marks')) AS m(suffix, scope)"""


def _flat_columns(spans: DataFrame) -> DataFrame:
    return spans.select(
        *IDS, "parent_span_id", "name", *times(),
        fs.attribute(attrs(), "event.type").alias("event_type"),
        trace_query.service_name().alias("service"),
        F.col("scope.name").alias("scope"),
        F.col("scope_schema_url").alias("scope_url"),
        fs.attribute(attrs(), "k").cast("int").alias("k"),
    )


@query("a1_read_otlp", _FLAT)
def a1_read_otlp(spark, d):
    path = scratch(spark)
    _requests(events(spark, d)).write.text(path)
    return _flat_columns(otlp.flatten_spans(otlp.read_otlp(spark, path)))


@query("a2_flatten_spans", _FLAT)
def a2_flatten_spans(spark, d):
    return _flat_columns(otlp.flatten_spans(otlp.parse_requests(_requests(events(spark, d)), "value")))


@query("a3_event_time", f"WITH {sql.EVENTS} SELECT span_id, start_ns // 1000000 AS ts_ms FROM spans")
def a3_event_time(spark, d):
    return otlp.with_event_time(events(spark, d)).select("span_id", F.unix_millis("ts").alias("ts_ms"))


_SIM_COLUMNS = "trace_id, span_id, parent_id, span_name, start_offset_ms, duration_ms"


@query("a5_read_sim_spans", f"""WITH {sql.SIM}
SELECT trace_id || s AS trace_id, span_id, parent_id, span_name, start_offset_ms, duration_ms,
       span_id AS line FROM sim, (VALUES ('-0'), ('-1')) AS x(s)""")
def a5_read_sim_spans(spark, d):
    folders = [scratch(spark), scratch(spark)]
    for folder in folders:
        text_sink.write_sim_spans(tables.sim_spans_from_orders(spark, d), folder, "gzip")
    return simspans.read_sim_spans(spark, folders).select(
        *_SIM_COLUMNS.split(", "), F.col("attributes")["line"].alias("line")
    )


@query("a7_spans_from_events", f"""WITH {sql.EVENTS}
SELECT trace_id, span_id, parent_span_id, name, start_ns, end_ns, bucket, service FROM spans""")
def a7_spans_from_events(spark, d):
    return events(spark, d).select(
        *IDS, "parent_span_id", "name", *times(),
        fs.attribute(attrs(), "bucket").alias("bucket"), trace_query.service_name().alias("service"),
    )


@query("a7_spans_from_conversations", f"""WITH {sql.CONVERSATIONS}
SELECT trace_id, span_id, parent_span_id, name, start_ns, end_ns, chat_id,
       CASE WHEN role IN ('user', 'assistant') THEN text END AS said FROM spans""")
def a7_spans_from_conversations(spark, d):
    said = payloads.message_text(F.coalesce(
        fs.event_attribute(F.get(messages_of(), F.lit(0)), "content"),
        fs.event_attribute(F.get(messages_of(), F.lit(0)), "message"),
    ))
    return chats(spark, d).select(
        *IDS, "parent_span_id", "name", *times(),
        fs.attribute(attrs(), "chat_id").alias("chat_id"), said.alias("said"),
    )


@query("a7_spans_from_orders", f"""WITH {sql.ORDERS}
SELECT trace_id, span_id, parent_span_id, name, start_ns, end_ns FROM spans""")
def a7_spans_from_orders(spark, d):
    return orders(spark, d).select(*IDS, "parent_span_id", "name", *times())


# --- the duration monitor and its documents -------------------------------

def errors_monitor(**settings) -> monitor.SumMonitor:
    return properties.duration_safety(
        "time in errors",
        matches=fs.has_attribute(attrs(), "event.type", "error"),
        limit_nanos=LIMIT,
        gap_ms=GAP,
        **settings,
    )


_ERRORS = sql.duration_verdicts(LIMIT, "name = 'error'", "time in errors")
_VERDICT = "key, session_start, session_end, propertyName, truthValue"


@query("e8_run_monitor", f"WITH {TRACE_SESSIONS}, {_ERRORS} SELECT {_VERDICT} FROM judged")
def e8_run_monitor(spark, d):
    return monitor.run_monitor(events(spark, d), errors_monitor())


@query("e10_duration_safety", f"""WITH {sql.sessions(sql.EVENTS, BUCKET_KEY, GAP, TTL)},
{sql.duration_verdicts(LIMIT, "name = 'error'", "time in errors")} SELECT {_VERDICT} FROM judged""")
def e10_duration_safety(spark, d):
    return monitor.run_monitor(events(spark, d), errors_monitor(key_attribute="bucket", ttl_ms=TTL))


def documents(spark, d):
    return verdict_sink.verdict_documents(
        e8_run_monitor(spark, d), F.timestamp_seconds(F.lit(1_710_000_000))
    )


def _doc_columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        "key", F.unix_millis("startDate").alias("start_ms"),
        F.unix_millis("evaluationDate").alias("evaluated_ms"), "propertyName", "truthValue",
    )


_DOCS = f"""WITH {TRACE_SESSIONS}, {_ERRORS}, docs AS (
SELECT key, session_start AS start_ms, 1710000000000 AS evaluated_ms, propertyName, truthValue FROM judged)"""


@query("b1_verdict_documents", f"{_DOCS} SELECT * FROM docs")
def b1_verdict_documents(spark, d):
    return _doc_columns(documents(spark, d))


@query("b2_write_verdicts", f"{_DOCS} SELECT * FROM docs UNION ALL SELECT * FROM docs")
def b2_write_verdicts(spark, d):
    path = scratch(spark)
    docs = documents(spark, d)
    verdict_sink.write_verdicts(docs, path)
    verdict_sink.write_verdicts(docs, path)
    return _doc_columns(spark.read.parquet(path))


@query("b3_time_series_layout", f"""{_DOCS}
SELECT propertyName, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n
FROM docs GROUP BY ALL""")
def b3_time_series_layout(spark, d):
    path = scratch(spark)
    verdict_sink.write_verdicts(documents(spark, d), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("propertyName", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("b4_verdicts_in_range", f"""{_DOCS} SELECT * FROM docs
WHERE propertyName = 'time in errors' AND start_ms BETWEEN 1704844800000 AND 1705449600000""")
def b4_verdicts_in_range(spark, d):
    at = [F.timestamp_seconds(F.lit(s)) for s in (1_704_844_800, 1_705_449_600)]
    return _doc_columns(verdict_sink.verdicts_in_range(documents(spark, d), "time in errors", *at))


@query("b5_latest_verdicts", f"""{_DOCS} SELECT * FROM docs
QUALIFY row_number() OVER (PARTITION BY key, propertyName ORDER BY evaluated_ms DESC, start_ms DESC) = 1""")
def b5_latest_verdicts(spark, d):
    return _doc_columns(verdict_sink.latest_verdicts(documents(spark, d)))


# The text form of a span term.
_ATTR_TERMS = """'["event.type", "' || name || '"]' ||
  CASE WHEN bucket IS NULL THEN '' ELSE ' ["bucket", "' || bucket || '"]' END || ' ["k", "' || k || '"]'"""
_SPAN_TERM = f"""' < span("' || trace_id || '/' || span_id || '") : Span | traceId : "' || trace_id
  || '", spanId : "' || span_id || '", parentSpanId : "' || parent_span_id || '", name : "' || name
  || '", startTimeUnixNano : ' || start_ns || ', endTimeUnixNano : ' || end_ns
  || ', attributes : ' || {_ATTR_TERMS} || ', events : nil > '"""


@query("b6_span_terms", f"WITH {sql.EVENTS} SELECT {_SPAN_TERM} AS value FROM spans")
def b6_span_terms(spark, d):
    path = scratch(spark)
    text_sink.write_span_terms(events(spark, d), path)
    return spark.read.text(path)


@query("b7_write_sim_spans", f"WITH {sql.SIM} SELECT {_SIM_COLUMNS} FROM sim")
def b7_write_sim_spans(spark, d):
    path = scratch(spark)
    text_sink.write_sim_spans(tables.sim_spans_from_orders(spark, d), path, "gzip")
    return simspans.read_sim_spans(spark, [path], add_index=False).select(*_SIM_COLUMNS.split(", "))


# --- column functions ------------------------------------------------------

@query("c1_hex_id", "SELECT c_custkey, lower(hex(c_name)) AS hex FROM customer")
def c1_hex_id(spark, d):
    return tables.load(spark, d, "customer").select(
        "c_custkey", fs.hex_id(F.col("c_name").cast("binary")).alias("hex")
    )


@query("c2_is_root", f"WITH {sql.EVENTS} SELECT span_id, parent_span_id = '' AS is_root FROM spans")
def c2_is_root(spark, d):
    return events(spark, d).select("span_id", fs.is_root(F.col("parent_span_id")).alias("is_root"))


@query("c3_event_label", f"""WITH {sql.EVENTS}
SELECT CASE WHEN e THEN 'SpanEnd(' || end_ns ELSE 'SpanStart(' || start_ns END
       || ', (' || name || ', ' || span_id || ', ' || trace_id || '))' AS label
FROM spans, (VALUES (true), (false)) AS x(e)""")
def c3_event_label(spark, d):
    label = fs.event_label(
        ~F.col("is_end"), F.col("epoch_unix_nano"), F.col("name"), F.col("span_id"), F.col("trace_id")
    )
    return ss.to_events(events(spark, d)).select(label.alias("label"))


@query("c3_named", f"WITH {sql.EVENTS} SELECT span_id, name FROM spans WHERE name = 'purchase'")
def c3_named(spark, d):
    return fs.named(events(spark, d), "purchase").select("span_id", "name")


@query("c4_nanos_to_ms", f"""WITH {sql.EVENTS}
SELECT span_id, end_ns // 1000000 AS end_ms, (end_ns // 1000000) * 1000000 AS back FROM spans""")
def c4_nanos_to_ms(spark, d):
    ms = fs.nanos_to_ms(end())
    return events(spark, d).select("span_id", ms.alias("end_ms"), fs.ms_to_nanos(ms).alias("back"))


@query("c5_any_value_to_string", """
SELECT c_custkey, kind, CASE kind WHEN 's' THEN c_mktsegment || '\\"\\/\\u00E9' WHEN 'i' THEN CAST(c_nationkey AS VARCHAR)
  WHEN 'b' THEN CASE WHEN c_nationkey > 9 THEN 'true' ELSE 'false' END WHEN 'a' THEN 'unsupportedArrayValue'
  WHEN 'k' THEN 'unsupportedKvlistValue' WHEN 'y' THEN lower(hex(c_name)) WHEN 'd' THEN
  CAST(c_nationkey + 0.5 AS DOUBLE)::VARCHAR ELSE '' END AS text
FROM customer, (VALUES ('s'), ('i'), ('b'), ('a'), ('k'), ('y'), ('d'), ('n')) AS x(kind)""")
def c5_any_value_to_string(spark, d):
    blank = text_value(F.lit(None))
    values = {
        "s": text_value(F.concat("c_mktsegment", F.lit('"/\u00e9'))),
        "i": number_value(F.col("c_nationkey")),
        "b": bool_value(F.col("c_nationkey") > 9),
        "a": blank.withField("array_value", F.lit("[1]")),
        "k": blank.withField("kvlist_value", F.lit("{}")),
        "y": blank.withField("bytes_value", F.col("c_name").cast("binary")),
        "d": double_value(F.col("c_nationkey") + 0.5),
        "n": blank,
    }
    entries = F.array(*[attribute_entry(k, v) for k, v in values.items()]).cast(KEY_VALUES)
    rows = tables.load(spark, d, "customer").select("c_custkey", F.explode(entries).alias("e"))
    return rows.select(
        "c_custkey", F.col("e.key").alias("kind"), fs.any_value_to_string(F.col("e.value")).alias("text")
    )


@query("c6_escape_json", r"""
SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE
    WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = '/' THEN '\/'
    WHEN unicode(c) = 10 THEN '\n' WHEN unicode(c) = 13 THEN '\r' WHEN unicode(c) = 9 THEN '\t'
    WHEN unicode(c) = 8 THEN '\b' WHEN unicode(c) = 12 THEN '\f'
    WHEN unicode(c) > 65535 THEN printf('\u%04X\u%04X', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023))
    WHEN unicode(c) > 127 OR unicode(c) < 32 THEN printf('\u%04X', unicode(c)) ELSE c END), '') AS escaped
FROM documents""")
def c6_escape_json(spark, d):
    return tables.load(spark, d, "documents").select(
        "doc_id", payloads.escape_json(F.col("text")).alias("escaped")
    )


@query("c7_render_terms", f"""WITH {sql.EVENTS}
SELECT CASE WHEN e THEN 'spanEnd(mon("m"), ' ELSE 'spanStart(mon("m"), ' END || {_SPAN_TERM} || ')' AS value
FROM spans, (VALUES (true), (false)) AS x(e)""")
def c7_render_terms(spark, d):
    return terms.message_terms(ss.to_events(events(spark, d)), 'mon("m")')


@query("c8_attribute", f"WITH {sql.EVENTS} SELECT span_id, bucket, CAST(k AS VARCHAR) AS k FROM spans")
def c8_attribute(spark, d):
    return events(spark, d).select(
        "span_id", fs.attribute(attrs(), "bucket").alias("bucket"), fs.attribute(attrs(), "k").alias("k")
    )


@query("c9_string_attribute", f"""WITH {sql.EVENTS}
SELECT span_id, bucket, CAST(NULL AS VARCHAR) AS k FROM spans""")
def c9_string_attribute(spark, d):
    return events(spark, d).select(
        "span_id", fs.string_attribute(attrs(), "bucket").alias("bucket"),
        fs.string_attribute(attrs(), "k").alias("k"),
    )


@query("c10_has_attribute", f"""WITH {sql.EVENTS}
SELECT span_id, name = 'error' AS is_error, coalesce(bucket = 'k3', false) AS in_k3 FROM spans""")
def c10_has_attribute(spark, d):
    return events(spark, d).select(
        "span_id", fs.has_attribute(attrs(), "event.type", "error").alias("is_error"),
        fs.has_attribute(attrs(), "bucket", "k3").alias("in_k3"),
    )


@query("c11_event_by_name", f"""WITH {sql.CONVERSATIONS}
SELECT span_id, CASE WHEN role = 'user' THEN start_ns END AS asked_at FROM spans""")
def c11_event_by_name(spark, d):
    found = fs.event_by_name(messages_of(), "gen_ai.user.message")
    return chats(spark, d).select("span_id", found["time_unix_nano"].alias("asked_at"))


@query("c12_has_event", f"""WITH {sql.CONVERSATIONS}
SELECT span_id, role = 'assistant' AS answered FROM spans""")
def c12_has_event(spark, d):
    return chats(spark, d).select("span_id", fs.has_event(messages_of(), "gen_ai.choice").alias("answered"))


@query("c13_event_names", f"""WITH {sql.CONVERSATIONS}
SELECT span_id, CASE role WHEN 'user' THEN 'gen_ai.user.message' ELSE 'gen_ai.choice' END AS event
FROM spans WHERE role IN ('user', 'assistant')""")
def c13_event_names(spark, d):
    rows = chats(spark, d).select("span_id", F.explode("events").alias("e"))
    return rows.select("span_id", fs.event_name(F.col("e")).alias("event"))


@query("c14_event_attribute", f"""WITH {sql.CONVERSATIONS}
SELECT span_id, CASE WHEN role = 'user' THEN length(text) END AS n FROM spans""")
def c14_event_attribute(spark, d):
    raw = fs.event_attribute(fs.event_by_name(messages_of(), "gen_ai.user.message"), "content")
    return chats(spark, d).select(
        "span_id", F.length(payloads.message_text(raw)).cast("bigint").alias("n")
    )


@query("c15_span_duration", f"WITH {sql.ORDERS} SELECT span_id, abs(end_ns - start_ns) AS duration FROM spans")
def c15_span_duration(spark, d):
    return orders(spark, d).select("span_id", fs.span_duration_nanos(start(), end()).alias("duration"))


@query("c16_matches_span", """
SELECT event_id, event_type = 'error' AS matches, event_id % 3 = 0 AND event_id % 2 = 0 AS image FROM events""")
def c16_matches_span(spark, d):
    rows = tables.load(spark, d, "events")
    # Spans with both, one, or none of the attributes of an image span.
    operation = F.when(F.col("event_id") % 3 == 0, "execute_tool").otherwise("chat")
    tool = F.when(F.col("event_id") % 2 == 0, "generate_image").otherwise("search")
    entries = F.array(
        text_entry("event.type", F.col("event_type")), text_entry("gen_ai.operation.name", operation),
        text_entry("gen_ai.tool.name", tool),
    ).cast(KEY_VALUES)
    rows = rows.select("event_id", entries.alias("attributes"))
    return rows.select(
        "event_id", fs.matches_span(F.col("attributes"), {"event.type": "error"}).alias("matches"),
        fs.is_image_generation_span(F.col("attributes")).alias("image"),
    )


@query("c17_text_contains", """SELECT doc_id, strpos(lower(text), 'the') > 0 AS any_case,
strpos(text, 'The') > 0 AS exact FROM documents""")
def c17_text_contains(spark, d):
    return tables.load(spark, d, "documents").select(
        "doc_id", payloads.text_contains(F.col("text"), "The", True).alias("any_case"),
        payloads.text_contains(F.col("text"), "The").alias("exact"),
    )


@query("c18_message_text", """SELECT doc_id, kind, CASE WHEN kind = 'one' THEN text END AS message
FROM documents, (VALUES ('one'), ('two'), ('object'), ('plain')) AS x(kind)""")
def c18_message_text(spark, d):
    one = F.struct("text")
    kinds = {
        "one": F.to_json(F.array(one)), "two": F.to_json(F.array(one, one)),
        "object": F.to_json(one), "plain": F.col("text"),
    }
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("p")) for k, v in kinds.items()]))
    rows = tables.load(spark, d, "documents").select("doc_id", forms.alias("f"))
    return rows.select("doc_id", "f.kind", payloads.message_text(F.col("f.p")).alias("message"))


@query("c19_count_down", "SELECT l_orderkey, l_linenumber, greatest(l_linenumber - 1, 0) AS n FROM lineitem")
def c19_count_down(spark, d):
    return tables.load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", fs.count_down(F.col("l_linenumber")).alias("n")
    )


@query("c20_json_fields", f"""WITH {sql.EVENTS}
SELECT event_id, CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) END AS k, event_type AS kind,
  CASE WHEN k % 2 = 0 THEN event_type END AS sometimes, k % 3 <> 0 AS has_k
FROM (SELECT *, name AS event_type FROM spans)""")
def c20_json_fields(spark, d):
    number = F.get_json_object("props", "$.k").cast("int")
    some = F.when(number % 2 == 0, F.col("event_type"))
    nested = F.to_json(F.struct(
        F.when(number % 3 != 0, number).alias("k"),
        F.struct(F.struct(F.col("event_type").alias("kind"), some.alias("x")).alias("inner")).alias("outer"),
    ))
    rows = tables.load(spark, d, "events").select("event_id", nested.alias("payload"))
    found = payloads.json_fields(rows, "payload", {"k": "k", "kind": "outer.inner.kind", "sometimes": "outer.inner.x"})
    return found.select("event_id", "k", "kind", "sometimes", payloads.has_json_key(F.col("payload"), "k").alias("has_k"))


@query("c21_parse_json_column", """
SELECT 'props' AS source, CAST(event_id AS BIGINT) AS id, false AS parsed_error FROM events
UNION ALL SELECT 'text', doc_id, true FROM documents""")
def c21_parse_json_column(spark, d):
    props = tables.load(spark, d, "events").select(F.lit("props").alias("source"), F.col("event_id").alias("id"), F.col("props").alias("raw"))
    texts = tables.load(spark, d, "documents").select(F.lit("text").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    return payloads.parse_json_column(props.unionByName(texts), "raw").select("source", "id", "parsed_error")


@query("c21_kinds_and_values", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'BIGINT' WHEN 2 THEN 'DECIMAL' WHEN 3 THEN 'STRING'
  WHEN 4 THEN 'BOOLEAN' WHEN 5 THEN 'ARRAY' ELSE 'TEXT' END AS kind,
  CASE event_id % 7 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN event_id || '.5'
  WHEN 3 THEN '"' || event_type || '"' WHEN 4 THEN 'true' WHEN 5 THEN '[' || event_id || ',null]' ELSE event_type END AS value,
  event_id % 7 = 6 AS parsed_error FROM events""")
def c21_kinds_and_values(spark, d):
    n, name, number = F.col("event_id") % 7, F.col("event_type"), F.col("event_id").cast("string")
    raw = (
        F.when(n == 0, F.col("props")).when(n == 1, number).when(n == 2, F.concat(number, F.lit(".5")))
        .when(n == 3, F.concat(F.lit('"'), name, F.lit('"'))).when(n == 4, F.lit("true"))
        .when(n == 5, F.concat(F.lit("["), number, F.lit(", null]"))).otherwise(name)
    )
    read = payloads.parse_json_column(tables.load(spark, d, "events").withColumn("raw", raw), "raw")
    kind = F.split_part("parsed_kind", F.lit("("), F.lit(1))
    return read.select(
        "event_id", F.split_part(kind, F.lit("<"), F.lit(1)).alias("kind"),
        F.coalesce(F.to_json("parsed"), F.col("raw")).alias("value"), "parsed_error",
    )


@query("c22_typed_values", """SELECT kind, count(*) FILTER (WHERE ok) AS typed, count(*) FILTER (WHERE NOT ok) AS mismatched
FROM (SELECT 'bigint' AS kind, try_cast(substr(c_name, 10) AS BIGINT) IS NOT NULL AS ok FROM customer
UNION ALL SELECT 'bigint', try_cast(c_mktsegment AS BIGINT) IS NOT NULL FROM customer
UNION ALL SELECT 'double', try_cast(substr(c_name, 10) AS DOUBLE) IS NOT NULL FROM customer
UNION ALL SELECT 'double', try_cast(c_mktsegment AS DOUBLE) IS NOT NULL FROM customer) GROUP BY kind""")
def c22_typed_values(spark, d):
    c = tables.load(spark, d, "customer")
    values = c.select(F.explode(F.array(F.substring("c_name", 10, 20), F.col("c_mktsegment"))).alias("v"))
    counts = [
        payloads.type_mismatches(values, "v", k).select(F.lit(k).alias("kind"), "typed", "mismatched")
        for k in ("bigint", "double")
    ]
    return counts[0].unionByName(counts[1])


@query("c22_typed_getters", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey AS BIGINT) END AS as_int,
  CASE WHEN o_orderkey % 6 = 1 THEN o_custkey + 0.25::DOUBLE END AS as_float,
  CASE WHEN o_orderkey % 6 = 2 THEN CASE o_custkey % 2 WHEN 0 THEN 'true' ELSE 'false' END END AS as_bool,
  CASE WHEN o_orderkey % 6 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS as_date,
  CASE WHEN o_orderkey % 6 = 4 THEN o_orderpriority END AS as_string FROM orders""")
def c22_typed_getters(spark, d):
    n, number = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    raw = (
        F.when(n == 0, number).when(n == 1, F.concat(number, F.lit(".25")))
        .when(n == 2, F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("false"))
        .when(n == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n == 4, F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit("["), number, F.lit("]")))
    )
    rows = tables.load(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    words = {c: F.col(c).cast("string") for c in ("as_bool", "as_date")}
    return payloads.typed_getters(rows, "raw").drop("raw").withColumns(words)


@query("c23_json_quality_report", """
SELECT count(*) AS payloads, count(*) FILTER (WHERE event_id % 5 = 0) AS objects,
       count(*) FILTER (WHERE event_id % 5 = 2) AS other_json,
       count(*) FILTER (WHERE event_id % 5 = 1) AS repeated_keys,
       count(*) FILTER (WHERE event_id % 5 > 2) AS broken FROM events""")
def c23_json_quality_report(spark, d):
    kind = F.col("event_id") % 5
    payload = (
        F.when(kind == 0, F.col("props")).when(kind == 1, F.lit('{"k": 1, "j": 2, "k": 3}'))
        .when(kind == 2, F.lit("[1, 2]")).when(kind == 3, F.concat(F.lit('{"k": '), F.col("event_type"))).otherwise(F.col("event_type"))
    )
    rows = tables.load(spark, d, "events").select(payload.alias("payload"))
    return payloads.json_quality_report(rows, "payload")


@query("c24_invalid_dates", """SELECT l_orderkey, l_linenumber, dd, mm, yy FROM (
SELECT l_orderkey, l_linenumber, l_suppkey % 32 AS dd, l_linenumber + 1 AS mm, 1900 + l_partkey % 200 AS yy FROM lineitem)
WHERE try_strptime(printf('%04d-%02d-%02d', yy, mm, dd), '%Y-%m-%d') IS NULL""")
def c24_invalid_dates(spark, d):
    rows = tables.load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 32).alias("dd"),
        (F.col("l_linenumber") + 1).alias("mm"), (1900 + F.col("l_partkey") % 200).alias("yy"),
    )
    return payloads.invalid_dates(rows, F.col("dd"), F.col("mm"), F.col("yy"))


@query("c25_attribute_filter", """
SELECT event_id, false AS unfiltered FROM events WHERE json_extract_string(props, '$.k') = '42'
UNION ALL SELECT event_id, true FROM events""")
def c25_attribute_filter(spark, d):
    rows = tables.load(spark, d, "events")
    some = payloads.attribute_filter(rows, "props", "k", "42").select("event_id", F.lit(False).alias("unfiltered"))
    every = payloads.attribute_filter(rows, "props", None, None).select("event_id", F.lit(True).alias("unfiltered"))
    return some.unionByName(every)


# --- sessions and events ---------------------------------------------------

_ORDER_SESSIONS = sql.sessions(sql.ORDERS, "trace_id", GAP)


@query("d1_dedupe_spans", f"""WITH {_ORDER_SESSIONS}
SELECT key, session_start, span_id, start_ns, end_ns FROM deduped""")
def d1_dedupe_spans(spark, d):
    placed = ss.sessionize(ss.key_by_trace(orders(spark, d)).select("key", *IDS, "start_time_unix_nano", "end_time_unix_nano"), GAP)
    return ss.dedupe_spans(placed).select("key", "session_start", "span_id", *times())


@query("d2_to_events", f"""WITH {sql.EVENTS}
SELECT span_id, false AS is_end, start_ns AS epoch_ns FROM spans
UNION ALL SELECT span_id, true, end_ns FROM spans""")
def d2_to_events(spark, d):
    return ss.to_events(events(spark, d)).select("span_id", "is_end", F.col("epoch_unix_nano").alias("epoch_ns"))


_EVENT = "row(epoch_ns, trace_id, span_id, is_end)"
_SEQ = "row_number() OVER (PARTITION BY key, session_start ORDER BY epoch_ns, trace_id, span_id, is_end)"


@query("d3_order_events", f"""WITH {TRACE_SESSIONS}
SELECT key, session_start, span_id, is_end, {_SEQ} AS seq FROM evs""")
def d3_order_events(spark, d):
    placed = ss.sessionize(by_trace(spark, d).select("key", *IDS, "start_time_unix_nano", "end_time_unix_nano"), GAP)
    return ss.order_events(ss.to_events(placed)).select("key", "session_start", "span_id", "is_end", "seq")


@query("d4_key_by_trace", f"WITH {sql.EVENTS} SELECT trace_id AS key, span_id FROM spans")
def d4_key_by_trace(spark, d):
    return by_trace(spark, d).select("key", "span_id")


@query("d5_key_by_attribute", f"WITH {sql.EVENTS} SELECT {BUCKET_KEY} AS key, span_id FROM spans")
def d5_key_by_attribute(spark, d):
    return keyed(spark, d).select("key", "span_id")


@query("d6_sessionize", f"""WITH {EV_SESSIONS}
SELECT key, span_id, session_start, session_end FROM placed""")
def d6_sessionize(spark, d):
    return ss.sessionize(keyed(spark, d), GAP).select("key", "span_id", "session_start", "session_end")


@query("d7_session_sequence", f"""WITH {_ORDER_SESSIONS}
SELECT key, session_start, span_id, is_end, epoch_ns, {_SEQ} AS seq FROM evs""")
def d7_session_sequence(spark, d):
    spans = ss.key_by_trace(orders(spark, d)).select("key", *IDS, "start_time_unix_nano", "end_time_unix_nano")
    return ss.session_sequence(spans, GAP).select(
        "key", "session_start", "span_id", "is_end", F.col("epoch_unix_nano").alias("epoch_ns"), "seq"
    )


@query("d8_session_counters", f"""WITH {sql.sessions(sql.ORDERS, "trace_id", GAP)}
SELECT key, session_start, session_end, count(*) AS n_spans, count(DISTINCT span_id) AS n_distinct,
       count(DISTINCT CASE WHEN parent_span_id = '' THEN span_id END) AS n_roots,
       count(*) - count(DISTINCT span_id) AS n_duplicates,
       count(*) AS n_trace_keyed FROM placed GROUP BY ALL""")
def d8_session_counters(spark, d):
    return ss.session_counters(ss.sessionize(ss.key_by_trace(orders(spark, d)), GAP))


@query("d8_key_fallbacks", f"""WITH {EV_SESSIONS}
SELECT key, session_start, count(*) AS n_spans, count(*) FILTER (WHERE key = trace_id) AS n_trace_keyed
FROM placed GROUP BY ALL""")
def d8_key_fallbacks(spark, d):
    counters = ss.session_counters(ss.sessionize(keyed(spark, d), GAP))
    return counters.select("key", "session_start", "n_spans", "n_trace_keyed")


@query("d10_ignore_windows", f"""WITH {EV_SESSIONS}
SELECT key, span_id, session_start FROM placed
QUALIFY count(*) OVER (PARTITION BY key, session_start) >= 3""")
def d10_ignore_windows(spark, d):
    placed = ss.sessionize(keyed(spark, d), GAP)
    return ss.ignore_windows(placed, ss.session_counters(placed).filter("n_spans < 3")).select(
        "key", "span_id", "session_start"
    )


_BOUGHT = f"""WITH {TRACE_SESSIONS},
kept AS (
  SELECT key, session_start FROM evs GROUP BY ALL
  HAVING bool_or(name = 'purchase') AND NOT arg_max(is_end AND name = 'error', row(epoch_ns, trace_id, span_id, is_end))),
{_ERRORS.replace("FROM deduped", "FROM deduped SEMI JOIN kept USING (key, session_start)")}"""


@query("d10_ignore_by_events", f"{_BOUGHT} SELECT {_VERDICT} FROM judged")
def d10_ignore_by_events(spark, d):
    """Sessions without a purchase, or that end in an error, are not judged."""
    m = errors_monitor(
        ignore_features={"bought": ("any", is_buy()), "failed": ("last", F.col("is_end") & is_error())},
        ignore_session=~F.col("bought") | F.col("failed"),
    )
    return monitor.run_monitor(events(spark, d), m)


@query("d11_older_than", f"""WITH {sql.CONVERSATIONS}
SELECT span_id, 1700000000 + conv_id * 86400 < 1702000000 - 86400 AS too_old,
  conv_id % 2 = 0 AND 1700000000 + conv_id * 86400 < 1702000000 - 86400 AS numbered_too_old FROM spans""")
def d11_older_than(spark, d):
    spans = ss.key_by_attribute(chats(spark, d), "chat_id")
    as_of = F.lit(1_702_000_000)
    return spans.select(
        "span_id", ss.older_than(F.col("key"), as_of).alias("too_old"),
        # Keys that end in no number are never too old.
        ss.older_than(
            F.when(F.pmod(F.conv(F.col("trace_id"), 16, 10).cast("bigint"), F.lit(2)) == 0, F.col("key")).otherwise(
                F.concat("key", F.lit("/none"))
            ),
            as_of,
        ).alias("numbered_too_old"),
    )


_ROOTS = """
roots AS (SELECT key, min(start_ns) AS root_start FROM keyed2 WHERE parent_span_id = '' GROUP BY key)"""
_KEYED = "keyed2 AS (SELECT *, trace_id AS key FROM spans)"
TICK = 6 * HOUR


def _letters_sql(source: str, keyed_rows: str, p: str, q: str) -> str:
    return f"""{source}, {keyed_rows}, {_ROOTS},
marked AS (
  SELECT e.key, floor((epoch_ns - root_start) / {TICK}000000.0) AS letter, {p} AS p, {q} AS q, epoch_ns, span_id, is_end
  FROM (SELECT *, false AS is_end, start_ns AS epoch_ns FROM keyed2
        UNION ALL SELECT *, true, end_ns FROM keyed2) e JOIN roots USING (key)),
filled AS (
  SELECT key, CAST(letter AS BIGINT) AS letter, count(*) AS n_events, bool_or(p) AS p, bool_or(q) AS q
  FROM marked WHERE letter >= 0 GROUP BY ALL),
spread AS (
  SELECT key, unnest(generate_series(0, max(letter))) AS letter FROM filled GROUP BY key),
letters AS (
  SELECT key, letter, coalesce(n_events, 0) AS n_events, coalesce(p, false) AS p, coalesce(q, false) AS q
  FROM spread LEFT JOIN filled USING (key, letter))"""


_LETTERS = _letters_sql(sql.EVENTS, _KEYED, "name = 'error'", "name = 'purchase'")


@query("d12_tumbling_letters", f"WITH {_LETTERS} SELECT key, letter, n_events, p, q FROM letters")
def d12_tumbling_letters(spark, d):
    return ss.tumbling_letters(by_trace(spark, d), TICK, tests())


@query("d12_early_events", f"""WITH {_letters_sql(sql.ORDERS, _KEYED, "false", "false")}
SELECT key, span_id, is_end, epoch_ns, CAST(letter AS BIGINT) AS letter FROM marked WHERE letter < 0""")
def d12_early_events(spark, d):
    return ss.early_events(ss.key_by_trace(orders(spark, d)), TICK).select(
        "key", "span_id", "is_end", F.col("epoch_unix_nano").alias("epoch_ns"), "letter"
    )


@query("d13_root_aligned_events", f"""WITH {sql.EVENTS}, {_KEYED},
firsts AS (
  SELECT key, span_id AS root_id, start_ns AS root_start FROM keyed2 WHERE parent_span_id = ''),
kept AS (
  SELECT e.*, root_id FROM (SELECT *, false AS is_end, start_ns AS epoch_ns FROM keyed2
    UNION ALL SELECT *, true, end_ns FROM keyed2) e JOIN firsts USING (key) WHERE epoch_ns >= root_start)
SELECT key, span_id, is_end, row_number() OVER (PARTITION BY key ORDER BY
  CASE WHEN span_id = root_id THEN CASE WHEN is_end THEN 2 ELSE 0 END ELSE 1 END,
  epoch_ns, trace_id, span_id, is_end) AS seq FROM kept""")
def d13_root_aligned_events(spark, d):
    return ss.root_aligned_events(by_trace(spark, d).drop("attributes", "resource")).select("key", "span_id", "is_end", "seq")


@query("d14_multiple_root_errors", f"""WITH {sql.CONVERSATIONS}
SELECT trace_id AS key, span_id, 'more than one root span' AS error FROM spans WHERE parent_span_id = ''
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id) > 1""")
def d14_multiple_root_errors(spark, d):
    return ss.multiple_root_errors(ss.key_by_trace(chats(spark, d))).select("key", "span_id", "error")


# --- monitors --------------------------------------------------------------

@query("e2_evaluate", f"""WITH {EV_SESSIONS}
SELECT key, session_start, CAST(sum(CASE WHEN name = 'error' THEN end_ns - start_ns ELSE 0 END) AS BIGINT) AS state
FROM deduped GROUP BY ALL""")
def e2_evaluate(spark, d):
    """Each session by itself."""
    m = errors_monitor(key_attribute="bucket", across_sessions=False)
    return monitor.evaluate(events(spark, d), m).select("key", "session_start", "state")


def _stretch(bought: Column, head: Column, tail: Column, best: Column) -> Column:
    return F.struct(bought.alias("bought"), head.alias("head"), tail.alias("tail"), best.alias("best"))


def _merged(a: Column, b: Column) -> Column:
    return _stretch(
        a["bought"] | b["bought"],
        F.when(a["bought"], a["head"]).otherwise(a["head"] + b["head"]),
        F.when(b["bought"], b["tail"]).otherwise(a["tail"] + b["tail"]),
        F.greatest(a["best"], b["best"], F.when(a["bought"], a["tail"] + b["head"]).otherwise(0)),
    )


def last_error_monitor(**settings) -> monitor.Monitor:
    """General fold: state is (errors since the last purchase, longest such run).

    A stretch is summed up by whether it holds a purchase, the errors before
    the first and after the last one, and the longest run after a purchase.
    """
    zero, one, no = F.lit(0), F.lit(1), F.lit(False)
    return monitor.Monitor(
        neutral=_stretch(no, zero, zero, zero),
        lift=lambda e: F.when(e["error"], _stretch(no, one, one, zero)).otherwise(
            _stretch(F.coalesce(e["buy"], no), zero, zero, zero)
        ),
        merge=_merged,
        enter=lambda s, m: F.struct(
            F.when(m["bought"], m["tail"]).otherwise(s["run"] + m["tail"]).alias("run"),
            F.greatest(s["longest"], s["run"] + m["head"], m["best"]).alias("longest"),
        ),
        name="few errors between purchases",
        init=F.struct(F.lit(0).alias("run"), F.lit(0).alias("longest")),
        step=lambda s, e: F.when(
            e["error"],
            F.struct((s["run"] + 1).alias("run"), F.greatest(s["longest"], s["run"] + 1).alias("longest")),
        ).when(e["buy"], F.struct(F.lit(0).alias("run"), s["longest"].alias("longest"))).otherwise(s),
        verdict=lambda s: F.when(s["longest"] > 5, False).when(s["run"] == 0, True),
        features={"error": F.col("is_end") & is_error(), "buy": F.col("is_end") & is_buy()},
        rules={"error": F.col("is_end") & is_error(), "buy": F.col("is_end") & is_buy()},
        gap_ms=GAP,
        **settings,
    )


_RUNS = """
moves AS (
  SELECT key, session_start, session_end, epoch_ns, trace_id, span_id,
         row_number() OVER w AS idx,
         CASE WHEN is_end AND name = 'error' THEN 1 ELSE 0 END AS err,
         sum(CASE WHEN is_end AND name = 'purchase' THEN 1 ELSE 0 END) OVER w AS part
  FROM evs WINDOW w AS (PARTITION BY key ORDER BY session_start, epoch_ns, trace_id, span_id, is_end)),
runs AS (
  SELECT *, sum(err) OVER (PARTITION BY key, part ORDER BY idx) AS run FROM moves),
longest AS (
  SELECT *, max(run) OVER (PARTITION BY key ORDER BY idx) AS longest FROM runs),
judged AS (
  SELECT key, session_start, session_end, 'few errors between purchases' AS propertyName,
         CASE WHEN longest > 5 THEN 'False' WHEN run = 0 THEN 'True' ELSE 'Undecided' END AS truthValue
  FROM longest QUALIFY row_number() OVER (PARTITION BY key, session_start ORDER BY idx DESC) = 1)"""


@query("e1_general_fold", f"WITH {TRACE_SESSIONS}, {_RUNS} SELECT {_VERDICT} FROM judged")
def e1_general_fold(spark, d):
    return monitor.run_monitor(events(spark, d), last_error_monitor())


@query("e3_evaluate_steps", f"""WITH {TRACE_SESSIONS}
SELECT key, session_start, span_id, is_end, CAST(sum(CASE WHEN is_end AND name = 'error' THEN end_ns - start_ns ELSE 0 END)
  OVER (PARTITION BY key ORDER BY session_start, epoch_ns, trace_id, span_id, is_end ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state
FROM evs""")
def e3_evaluate_steps(spark, d):
    return monitor.evaluate_steps(events(spark, d), errors_monitor()).select(
        "key", "session_start", "span_id", "is_end", "state"
    )


@query("e4_state_across_sessions", f"""WITH {TRACE_SESSIONS}, {_ERRORS}
SELECT key, session_start, CAST(sum(amount) OVER (PARTITION BY key ORDER BY session_start) AS BIGINT) AS state FROM totals""")
def e4_state_across_sessions(spark, d):
    return monitor.evaluate(events(spark, d), errors_monitor()).select("key", "session_start", "state")


@query("e5_state_ttl", f"""WITH {sql.sessions(sql.EVENTS, "trace_id", GAP, TTL)}, {_ERRORS}
SELECT key, session_start, CAST(generation AS INTEGER) AS generation,
  CAST(sum(amount) OVER (PARTITION BY key, generation ORDER BY session_start) AS BIGINT) AS state FROM totals""")
def e5_state_ttl(spark, d):
    return monitor.evaluate(events(spark, d), errors_monitor(ttl_ms=TTL)).select(
        "key", "session_start", "generation", "state"
    )


@query("e6_three_valued_verdict", f"WITH {TRACE_SESSIONS}, {_RUNS} SELECT truthValue, count(*) AS n FROM judged GROUP BY ALL")
def e6_three_valued_verdict(spark, d):
    found = e1_general_fold(spark, d)
    return found.groupBy("truthValue").agg(F.count(F.lit(1)).alias("n"))


@query("e7_verdict_rows", f"""WITH {EV_SESSIONS}, {_ERRORS} SELECT {_VERDICT} FROM judged""")
def e7_verdict_rows(spark, d):
    m = errors_monitor(key_attribute="bucket")
    return monitor.verdicts(monitor.evaluate(events(spark, d), m), m)


@query("e9_unmatched_events", f"""WITH {TRACE_SESSIONS}
SELECT key, session_start, span_id, is_end FROM evs WHERE NOT (is_end AND name IN ('error', 'purchase'))""")
def e9_unmatched_events(spark, d):
    return monitor.unmatched_events(events(spark, d), last_error_monitor()).select(
        "key", "session_start", "span_id", "is_end"
    )


MENTION, TURNS = "the", 2


def judged_chats(spark, d) -> DataFrame:
    """The judge here calls a reply impolite when it holds a certain syllable."""
    replies = tables.load(spark, d, "conversations").filter("role = 'assistant'")
    return replies.dropna(subset=["text"]).select(
        F.sha2("text", 256).alias("digest"), F.contains("text", F.lit("que")).alias("impolite")
    ).distinct()


def mention_monitor(spark, d, **settings) -> monitor.StateMonitor:
    return properties.mention_response(
        "mention gets a reaction", word=MENTION, turns=TURNS, judged=judged_chats(spark, d),
        key_attribute="chat_id", gap_ms=HOUR, **settings,
    )


# One fold for the SQL check: the next state after an event, by recursion over
# the events of a key in order.
_MENTION_SQL = f"""WITH RECURSIVE {sql.sessions(sql.CONVERSATIONS, "chat_id", HOUR)},
seqd AS (
  SELECT key, session_start, session_end, span_id, is_end,
    row_number() OVER (PARTITION BY key ORDER BY session_start, epoch_ns, trace_id, span_id, is_end) AS idx,
    role = 'user' AND strpos(lower(text), '{MENTION}') > 0 AS mention,
    role = 'assistant' AND strpos(text, 'que') > 0 AS reaction, parent_span_id = '' AS root
  FROM evs),
folded AS (
  SELECT key, CAST(0 AS BIGINT) AS idx, false AS pending, {TURNS} AS turns FROM (SELECT DISTINCT key FROM seqd)
  UNION ALL
  SELECT s.key, s.idx,
    CASE WHEN NOT is_end THEN pending OR mention
         WHEN pending AND reaction AND turns > 0 THEN false ELSE pending END,
    CASE WHEN NOT is_end THEN CASE WHEN NOT pending AND mention THEN {TURNS} ELSE turns END
         WHEN pending AND NOT reaction AND root THEN greatest(turns - 1, 0) ELSE turns END
  FROM folded f JOIN seqd s ON s.key = f.key AND s.idx = f.idx + 1),
judged AS (
  SELECT s.key, session_start, session_end, span_id, is_end, s.idx,
    CASE WHEN NOT pending THEN 'True' WHEN turns = 0 THEN 'False' ELSE 'Undecided' END AS truthValue
  FROM folded f JOIN seqd s ON s.key = f.key AND s.idx = f.idx)"""


@query("e11_mention_response", f"""{_MENTION_SQL}
SELECT key, session_start, session_end, 'mention gets a reaction' AS propertyName, truthValue FROM judged
QUALIFY row_number() OVER (PARTITION BY key, session_start ORDER BY idx DESC) = 1""")
def e11_mention_response(spark, d):
    return monitor.run_monitor(chats(spark, d), mention_monitor(spark, d))


@query("e11_mention_steps", f"{_MENTION_SQL} SELECT key, span_id, is_end, truthValue FROM judged")
def e11_mention_steps(spark, d):
    steps = monitor.evaluate_steps(chats(spark, d), mention_monitor(spark, d))
    return steps.select("key", "span_id", "is_end", monitor.truth(F.col("verdict")).alias("truthValue"))


@query("e12_classify_text", """
SELECT d.doc_id, CASE j.toxic WHEN 1 THEN 'True' WHEN 0 THEN 'False' ELSE 'Undecided' END AS impolite
FROM documents d LEFT JOIN (SELECT text, max(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY text) j
ON d.text = j.text""")
def e12_classify_text(spark, d):
    docs = tables.load(spark, d, "documents").select("doc_id", "text")
    labels = tables.load(spark, d, "labels").select("doc_id", "toxic")
    judged = docs.join(labels, "doc_id").groupBy(F.sha2("text", 256)).agg(
        F.first("text").alias("text"), (F.max("toxic") == 1).alias("impolite")
    )
    return properties.classify_text(docs, "text", judged).select(
        "doc_id", monitor.truth(F.col("impolite")).alias("impolite")
    )


@query("e12_judge_texts", """SELECT count(*) AS texts, count(*) FILTER (WHERE strpos(text, 'que') > 0) AS impolite
FROM (SELECT DISTINCT text FROM documents)""")
def e12_judge_texts(spark, d):
    docs = tables.load(spark, d, "documents")
    judged = properties.judge_texts(docs, "text", lambda texts: texts.str.contains("que", regex=False))
    return judged.agg(F.count(F.lit(1)).alias("texts"), F.count_if("impolite").alias("impolite"))


@query("e12_judge_new_texts", """SELECT doc_id, CASE WHEN text IS NULL THEN 'Undecided'
  WHEN strpos(text, 'que') > 0 THEN 'True' ELSE 'False' END AS impolite FROM documents""")
def e12_judge_new_texts(spark, d):
    """A second judge of the same name is asked nothing, as all texts have answers."""
    docs = tables.load(spark, d, "documents")
    path = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    properties.judge_new_texts(docs, "text", lambda texts: texts.str.contains("que", regex=False), path, "que")
    known = properties.judge_new_texts(docs, "text", lambda texts: ~texts.str.contains("que", regex=False), path, "que")
    return properties.classify_text(docs.select("doc_id", "text"), "text", known).select(
        "doc_id", monitor.truth(F.col("impolite")).alias("impolite")
    )


@query("e13_bot_message", f"""WITH {sql.CONVERSATIONS}
SELECT span_id, CASE WHEN role = 'assistant' THEN text END AS message FROM spans""")
def e13_bot_message(spark, d):
    return chats(spark, d).select("span_id", fs.bot_message(attrs(), messages_of()).alias("message"))


@query("e14_is_mention_span", f"""WITH {sql.CONVERSATIONS}
SELECT span_id, role = 'user' AND strpos(lower(text), '{MENTION}') > 0 AS mention FROM spans""")
def e14_is_mention_span(spark, d):
    return chats(spark, d).select(
        "span_id", fs.is_mention_span(F.col("parent_span_id"), messages_of(), MENTION).alias("mention")
    )


_TWO = f"""WITH {TRACE_SESSIONS}, {_ERRORS}, {_RUNS.replace("judged", "judged2")},
both_found AS (SELECT {_VERDICT} FROM judged UNION ALL SELECT {_VERDICT} FROM judged2)"""


def two_monitors(spark, d):
    return monitor.run_monitors(events(spark, d), [errors_monitor(), last_error_monitor()])


@query("e15_several_monitors", f"{_TWO} SELECT * FROM both_found")
def e15_several_monitors(spark, d):
    return two_monitors(spark, d)


@query("e16_verdict_summary", f"{_TWO} SELECT propertyName, truthValue, count(*) AS n FROM both_found GROUP BY ALL")
def e16_verdict_summary(spark, d):
    return monitor.verdict_summary(two_monitors(spark, d))


SHIP_LIMIT = 200 * DAY_NS


@query("e10_duration_of_orders", f"""WITH {_ORDER_SESSIONS},
{sql.duration_verdicts(SHIP_LIMIT, "name = 'ship'", "days on the way")} SELECT {_VERDICT} FROM judged""")
def e10_duration_of_orders(spark, d):
    m = properties.duration_safety(
        "days on the way", matches=F.col("name") == "ship", limit_nanos=SHIP_LIMIT, gap_ms=GAP
    )
    return monitor.run_monitor(orders(spark, d), m)


def shipping_monitor() -> monitor.StateMonitor:
    """After an order has begun, three of its lines are shipped."""
    states = ["none", 0, 1, 2, 3]
    ends = F.col("is_end")
    rules = [
        monitor.Rule("order", ~ends & (F.col("name") == "order"), {"none": 0}),
        monitor.Rule("ship", ends & (F.col("name") == "ship"), {0: 1, 1: 2, 2: 3}),
    ]
    return monitor.StateMonitor.of(
        "three lines shipped", states, "none", rules, {3: True, "none": False}, gap_ms=GAP
    )


@query("e11_states_of_orders", f"""WITH {_ORDER_SESSIONS},
begun AS (SELECT key, session_start, min({_EVENT}) AS first FROM evs WHERE NOT is_end AND name = 'order' GROUP BY ALL),
shipped AS (
  SELECT e.key, e.session_start, session_end, any_value(first) IS NULL AS unordered,
         count(*) FILTER (WHERE is_end AND name = 'ship' AND {_EVENT} > first) AS n
  FROM evs e LEFT JOIN begun b ON e.key = b.key AND e.session_start = b.session_start GROUP BY ALL)
SELECT key, session_start, session_end, 'three lines shipped' AS propertyName,
       CASE WHEN unordered THEN 'False' WHEN n >= 3 THEN 'True' ELSE 'Undecided' END AS truthValue FROM shipped""")
def e11_states_of_orders(spark, d):
    return monitor.run_monitor(orders(spark, d), shipping_monitor())


# --- temporal checks -------------------------------------------------------

SEQ = ["epoch_unix_nano", "trace_id", "span_id", "is_end"]
KEYS = ["key", "session_start"]


def session_rows(spark, d):
    """Events of the sessions by bucket, with the event's name."""
    spans = keyed(spark, d).select(
        "key", *IDS, "start_time_unix_nano", "end_time_unix_nano", "name", "parent_span_id"
    )
    # Each check reads the rows twice, on closed and on open sequences.
    return freeze(ss.session_events(spans, GAP))


def both(judged: DataFrame) -> DataFrame:
    """A check on closed and on open sequences, in two columns of words."""
    words = {c: monitor.truth(F.col(c)) for c in ("closed", "open")}
    return judged.withColumns(words)


def _check(closed: str, opened: str, source: str = EV_SESSIONS, table: str = "evs") -> str:
    return f"""WITH {source}, checked AS (
SELECT key, session_start, {closed} AS c, {opened} AS o FROM {table} GROUP BY key, session_start)
SELECT key, session_start, {sql.truth('c')} AS closed, {sql.truth('o')} AS "open" FROM checked"""


@query("f1_always", _check("bool_and(name <> 'error')", "CASE WHEN NOT bool_and(name <> 'error') THEN false END"))
def f1_always(spark, d):
    rows = session_rows(spark, d)
    return both(temporal.always(rows, KEYS, ~is_error(), None))


@query("f2_eventually", _check("bool_or(name = 'purchase')", "CASE WHEN bool_or(name = 'purchase') THEN true END"))
def f2_eventually(spark, d):
    rows = session_rows(spark, d)
    return both(temporal.eventually(rows, KEYS, is_buy(), None))


_PLACE = "row(epoch_ns, trace_id, span_id, is_end)"


@query("f3_eventually_always", _check(f"arg_max(name <> 'error', {_PLACE})", "CAST(NULL AS BOOLEAN)"))
def f3_eventually_always(spark, d):
    rows = session_rows(spark, d)
    return both(temporal.eventually_always(rows, KEYS, SEQ, ~is_error(), None))


_ANSWERED = f"""max(CASE WHEN name = 'error' THEN {_PLACE} END) IS NULL OR
coalesce(max(CASE WHEN name = 'error' THEN {_PLACE} END) <= max(CASE WHEN name = 'purchase' THEN {_PLACE} END), false)"""


@query("f4_response", _check(_ANSWERED, "CAST(NULL AS BOOLEAN)"))
def f4_response(spark, d):
    rows = session_rows(spark, d)
    return both(temporal.response(rows, KEYS, SEQ, is_error(), is_buy(), None))


def _bounded(source: str, keys: str, table: str, order: str, position: str, p: str, q: str, within: int) -> str:
    return f"""WITH {source},
ahead AS (
  SELECT *, {p} AS is_p, {position} AS pos,
    min(CASE WHEN {q} THEN {position} END) OVER (PARTITION BY {keys} ORDER BY {order}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_q,
    max({position}) OVER (PARTITION BY {keys}) AS final
  FROM {table}),
checked AS (
  SELECT {keys}, NOT bool_or(is_p AND coalesce(next_q - pos > {within}, true)) AS c,
    CASE WHEN bool_or(is_p AND CASE WHEN next_q IS NULL THEN pos + {within} < final ELSE next_q - pos > {within} END)
      THEN false END AS o
  FROM ahead GROUP BY {keys})
SELECT {keys}, {sql.truth('c')} AS closed, {sql.truth('o')} AS "open" FROM checked"""


@query("f5_bounded_response_time", _bounded(
    EV_SESSIONS, "key, session_start", "evs", "epoch_ns, trace_id, span_id, is_end", "epoch_ns",
    "name = 'error'", "name = 'purchase'", DAY_NS // 4))
def f5_bounded_response_time(spark, d):
    rows = ss.session_events(keyed(spark, d), GAP)
    return both(temporal.bounded_response(
        rows, KEYS, SEQ, "epoch_unix_nano", is_error(), is_buy(), DAY_NS // 4, None))


@query("f5_bounded_response_events", _bounded(
    f"{EV_SESSIONS}, seqd AS (SELECT *, {_SEQ} AS seq FROM evs)", "key, session_start", "seqd", "seq", "seq",
    "name = 'error'", "name = 'purchase'", 10))
def f5_bounded_response_events(spark, d):
    rows = ss.order_events(session_rows(spark, d))
    return both(temporal.bounded_response(rows, KEYS, ["seq"], "seq", is_error(), is_buy(), 10, None))


@query("f6_connectives", f"""WITH {EV_SESSIONS}, checked AS (
SELECT key, session_start, CASE WHEN bool_or(name = 'error') THEN false END AS a,
  CASE WHEN bool_or(name = 'purchase') THEN true END AS b FROM evs GROUP BY ALL)
SELECT key, session_start, {sql.truth('(a AND b)')} AS both_hold, {sql.truth('(a OR b)')} AS some_hold,
  {sql.truth('(NOT a)')} AS negated, {sql.truth('(NOT a OR b)')} AS implied FROM checked""")
def f6_connectives(spark, d):
    rows = session_rows(spark, d)
    held = temporal.combine(
        KEYS, a=temporal.always(rows, KEYS, ~is_error(), False), b=temporal.eventually(rows, KEYS, is_buy(), False)
    )
    a, b = F.col("a"), F.col("b")
    return held.select(
        *KEYS, monitor.truth(a & b).alias("both_hold"), monitor.truth(a | b).alias("some_hold"),
        monitor.truth(~a).alias("negated"), monitor.truth(temporal.implies(a, b)).alias("implied"),
    )


_FIRST = sql.sessions(sql.EVENTS, "trace_id", 3 * 24 * HOUR)
_FIRST_KEYED = "keyed2 AS (SELECT * FROM placed WHERE sno = 1)"


@query("f7_formula_on_letters", _bounded(
    _letters_sql(_FIRST, _FIRST_KEYED, "name = 'error'", "name = 'purchase'"),
    "key", "letters", "letter", "letter", "p", "q", 8))
def f7_formula_on_letters(spark, d):
    spans = by_trace(spark, d).drop("attributes", "resource", "scope", "events", "links", "status")
    letters = temporal.letters_of_first_session(spans, 3 * 24 * HOUR, TICK, tests())
    return both(temporal.bounded_response(
        letters, ["key"], ["letter"], "letter", F.col("p"), F.col("q"), 8, None))


_FIRST_LETTERS = _letters_sql(_FIRST, _FIRST_KEYED, "name = 'error'", "name = 'purchase'")
_AHEAD = "PARTITION BY key ORDER BY letter ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
WITHIN = 8


_JUDGED = [
    "response_closed", "until_closed", "until_open", "nested_closed", "nested_open", "settled_closed", "soon_closed", "soon_open"
]


@query("f7_formulas", f"""WITH {_FIRST_LETTERS},
ahead AS (
  SELECT *, min(CASE WHEN q THEN letter END) OVER ({_AHEAD}) AS next_q,
    min(CASE WHEN n_events = 0 THEN letter END) OVER ({_AHEAD}) AS next_r,
    max(letter) OVER (PARTITION BY key) AS final FROM letters),
checked AS (
  SELECT key,
    NOT bool_or(p AND next_q IS NULL) AS response_closed,
    coalesce(bool_and(next_q IS NOT NULL) FILTER (letter = 0), false)
      AND NOT coalesce(bool_or(p AND next_q = first_q AND letter < first_q), false) AS until_closed,
    CASE WHEN bool_or(p AND letter < coalesce(first_q, final + 1)) THEN false WHEN any_value(first_q) IS NOT NULL THEN true END AS until_open,
    NOT bool_or(p AND NOT (next_q IS NOT NULL AND (next_r IS NULL OR next_r >= next_q))) AS nested_closed,
    CASE WHEN bool_or(p AND next_r IS NOT NULL AND (next_q IS NULL OR next_r < next_q)) THEN false END AS nested_open,
    NOT bool_or(p AND letter = final) AND bool_or(q) AS settled_closed,
    NOT bool_or(p AND (next_q IS NULL OR next_q - letter > {WITHIN})) AS soon_closed,
    CASE WHEN bool_or(p AND CASE WHEN next_q IS NULL THEN letter + {WITHIN} <= final ELSE next_q - letter > {WITHIN} END) THEN false END AS soon_open
  FROM (SELECT *, min(CASE WHEN q THEN letter END) OVER (PARTITION BY key) AS first_q FROM ahead) GROUP BY key)
SELECT key, 'Undecided' AS response_open, 'Undecided' AS settled_open,
  {", ".join(f"{sql.truth(c)} AS {c}" for c in _JUDGED)} FROM checked""")
def f7_formulas(spark, d):
    """Five formulas on letters: whether errors are answered, whether a purchase
    comes before any error, whether no quiet tick lies between an error and the
    next purchase, whether errors end and something is bought, and whether
    answers come soon."""
    p, q, quiet = fm.atom("p"), fm.atom("q"), ~fm.atom("busy")
    asked = {
        "response": fm.response(p, q),
        "until": fm.until(~p, q),
        "nested": fm.always(p >> fm.until(~quiet, q)),
        "settled": fm.eventually(fm.always(~p)) & fm.eventually(q),
        "soon": fm.response(p, q, within=WITHIN),
    }
    spans = by_trace(spark, d).drop("attributes", "resource", "scope", "events", "links", "status")
    found = fm.formulas_on_letters(spans, 3 * 24 * HOUR, TICK, tests() | {"busy": F.lit(True)}, asked)
    return found.select("key", *[monitor.truth(F.col(c)).alias(c) for c in found.columns if c != "key"])


@query("f7_formula_monitor", f"""WITH {EV_SESSIONS}, checked AS (
SELECT key, session_start, session_end,
  min({_PLACE}) FILTER (name = 'error') AS e, min({_PLACE}) FILTER (name = 'purchase') AS b FROM evs GROUP BY ALL)
SELECT key, session_start, session_end, 'bought-first' AS propertyName,
  CASE WHEN b IS NOT NULL AND (e IS NULL OR b < e) THEN 'True' WHEN e IS NOT NULL THEN 'False' ELSE 'Undecided' END AS truthValue
FROM checked""")
def f7_formula_monitor(spark, d):
    """Is nothing an error before the first purchase of a session?  As a monitor of events."""
    bought_first = fm.until(~fm.atom("error"), fm.atom("buy"))
    m = fm.formula_monitor(
        "bought-first", bought_first, {"error": is_error(), "buy": is_buy()},
        key_attribute="bucket", gap_ms=GAP, across_sessions=False,
    )
    return monitor.run_monitor(events(spark, d), m)


@query("f8_task_has_result", f"""WITH {sql.ORDERS},
ends AS (
  SELECT trace_id, max(CASE WHEN name = 'order' THEN row(start_ns, 0, span_id) END) AS p,
         max(CASE WHEN name = 'ship' THEN row(end_ns, 1, span_id) END) AS q
  FROM spans GROUP BY trace_id)
SELECT trace_id, CASE WHEN p IS NULL OR coalesce(p <= q, false) THEN 'True' ELSE 'False' END AS truthValue FROM ends""")
def f8_task_has_result(spark, d):
    spans = orders(spark, d).select("trace_id", "span_id", "name", start().alias("s"), end().alias("e"))
    is_ship = F.col("name") == "ship"
    rows = spans.select(
        "trace_id", "span_id", "name", F.when(is_ship, F.col("e")).otherwise(F.col("s")).alias("at"),
        is_ship.cast("int").alias("kind"),
    )
    found = temporal.task_has_result(rows, ["trace_id"], ["at", "kind", "span_id"], "order", "ship")
    return found.select("trace_id", monitor.truth(F.col("holds")).alias("truthValue"))


# --- trace search ----------------------------------------------------------

_USER_7 = f"{7:032x}"


@query("g1_get_trace", f"""WITH {sql.EVENTS} SELECT trace_id, span_id, name, start_ns, end_ns FROM spans
WHERE trace_id = '{_USER_7}' AND start_ns >= 1704500000000000000 AND start_ns < 1706000000000000000""")
def g1_get_trace(spark, d):
    found = trace_query.get_trace(events(spark, d), _USER_7, 1704500000000000000, 1706000000000000000)
    return found.select(*IDS, "name", *times())


_MATCH = """service = 'svc1' AND name = 'error' AND bucket = 'k3' AND start_ns >= 1704500000000000000
AND start_ns < 1706000000000000000 AND end_ns - start_ns BETWEEN 10000000 AND 200000000"""
CONDITIONS = dict(
    service="svc1", operation="error", attributes={"bucket": "k3", "service.name": "svc1"},
    start_min=1704500000000000000, start_max=1706000000000000000,
    duration_min=10_000_000, duration_max=200_000_000,
)


@query("g2_find_traces", f"""WITH {sql.EVENTS} SELECT trace_id, span_id, name FROM spans
WHERE trace_id IN (SELECT trace_id FROM spans WHERE {_MATCH})""")
def g2_find_traces(spark, d):
    return trace_query.find_traces(events(spark, d), **CONDITIONS).select(*IDS, "name")


def stored(spark, d) -> SpanStore:
    store = SpanStore(scratch(spark))
    store.append(events(spark, d))
    return store


@query("g1_stored_trace", f"""WITH {sql.EVENTS} SELECT trace_id, span_id, name, start_ns, end_ns FROM spans
WHERE trace_id = '{_USER_7}' AND start_ns >= 1704500000000000000 AND start_ns < 1706000000000000000""")
def g1_stored_trace(spark, d):
    found = stored(spark, d).get_trace(spark, _USER_7, 1704500000000000000, 1706000000000000000)
    return found.select(*IDS, "name", *times())


@query("g2_stored_traces", f"""WITH {sql.EVENTS} SELECT trace_id, span_id, name FROM spans
WHERE trace_id IN (SELECT trace_id FROM spans WHERE {_MATCH})""")
def g2_stored_traces(spark, d):
    return stored(spark, d).find_traces(spark, **CONDITIONS).select(*IDS, "name")


@query("g3_search_depth", f"""WITH {sql.EVENTS} SELECT trace_id, span_id, name FROM spans
WHERE trace_id IN (SELECT DISTINCT trace_id FROM spans WHERE {_MATCH} ORDER BY trace_id LIMIT 3)""")
def g3_search_depth(spark, d):
    return trace_query.find_traces(events(spark, d), limit=3, **CONDITIONS).select(*IDS, "name")


@query("g4_services", f"WITH {sql.EVENTS} SELECT DISTINCT service FROM spans")
def g4_services(spark, d):
    return trace_query.services(events(spark, d))


@query("g5_operations", f"WITH {sql.EVENTS} SELECT DISTINCT name, 1 AS kind FROM spans WHERE service = 'svc2'")
def g5_operations(spark, d):
    return trace_query.operations(events(spark, d), "svc2", 1)


# --- trees -----------------------------------------------------------------

@query("h1_duplicate_span_ids", f"""WITH {sql.ORDERS}
SELECT trace_id, span_id, count(*) AS copies FROM spans GROUP BY ALL HAVING count(*) > 1""")
def h1_duplicate_span_ids(spark, d):
    return tree.duplicate_span_ids(orders(spark, d))


_TREE = f"""WITH RECURSIVE {sql.SIM},
tree AS (
  SELECT trace_id, span_id, 0 AS depth, span_id AS path, start_offset_ms + 1000 AS start_ms,
         CAST(NULL AS BIGINT) AS parent_start_ms, duration_ms FROM sim WHERE parent_id IS NULL
  UNION ALL
  SELECT s.trace_id, s.span_id, t.depth + 1, t.path || '/' || s.span_id,
         greatest(s.start_offset_ms + 1000, t.start_ms), t.start_ms, s.duration_ms
  FROM tree t JOIN sim s ON s.trace_id = t.trace_id AND s.parent_id = t.span_id)"""


@query("h2_span_tree", f"{_TREE} SELECT trace_id, span_id, depth, path FROM tree")
def h2_span_tree(spark, d):
    return tree.span_tree(tables.sim_spans_from_orders(spark, d))


@query("h3_tree_errors", f"""WITH RECURSIVE {sql.CONVERSATIONS},
tops AS (SELECT trace_id, min(span_id) AS span_id FROM spans WHERE parent_span_id = '' GROUP BY trace_id),
tree AS (
  SELECT trace_id, span_id FROM tops
  UNION ALL
  SELECT s.trace_id, s.span_id FROM tree t JOIN spans s
  ON s.trace_id = t.trace_id AND s.parent_span_id = t.span_id AND s.parent_span_id <> ''),
totals AS (
  SELECT trace_id, count(*) AS spans, (SELECT count(*) FROM tree t WHERE t.trace_id = s.trace_id) AS reached
  FROM spans s GROUP BY trace_id)
SELECT trace_id, spans, CASE WHEN reached = 0 THEN 'no root span' ELSE 'not a tree' END AS error
FROM totals WHERE reached <> spans""")
def h3_tree_errors(spark, d):
    spans = chats(spark, d).select(*IDS, F.col("parent_span_id").alias("parent_id"))
    return tree.tree_errors(spans)


@query("h4_descendants", f"""{_TREE}, listed AS (SELECT *, string_split(path, '/') AS ids FROM tree)
SELECT a.trace_id, a.span_id, any_value(a.depth) AS depth, any_value(a.position) AS position, count(*) AS size
FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ids) - 1 AS position FROM listed) a
JOIN listed b ON a.trace_id = b.trace_id AND b.ids[:len(a.ids)] = a.ids
GROUP BY a.trace_id, a.span_id""")
def h4_descendants(spark, d):
    return tree.preorder(tables.sim_spans_from_orders(spark, d))


_TIMELINE = f"""{_TREE},
plan AS (
  SELECT a.trace_id, a.span_id, any_value(a.start_ms) AS start_ms, any_value(a.parent_start_ms) AS parent_start_ms,
         max(b.start_ms + b.duration_ms) AS end_ms
  FROM tree a JOIN tree b ON a.trace_id = b.trace_id AND (b.path = a.path OR starts_with(b.path, a.path || '/'))
  GROUP BY a.trace_id, a.span_id)"""


@query("h5_effective_timeline", f"{_TIMELINE} SELECT trace_id, span_id, start_ms, end_ms FROM plan")
def h5_effective_timeline(spark, d):
    plan = tree.effective_timeline(tables.sim_spans_from_orders(spark, d))
    return plan.select("trace_id", "span_id", "start_ms", "end_ms")


@query("h6_late_spans", f"""{_TIMELINE}
SELECT trace_id, span_id, parent_start_ms - start_offset_ms - 1000 AS behind_ms,
  CASE WHEN parent_start_ms - start_offset_ms - 1000 > 500 THEN 'error' ELSE 'started at once' END AS outcome
FROM plan JOIN sim USING (trace_id, span_id) WHERE parent_start_ms > start_offset_ms + 1000""")
def h6_late_spans(spark, d):
    plan = tree.effective_timeline(tables.sim_spans_from_orders(spark, d))
    return tree.late_spans(plan).select("trace_id", "span_id", "behind_ms", "outcome")


@query("h7_no_time_spans", f"WITH {sql.SIM} SELECT trace_id, span_id, duration_ms FROM sim WHERE duration_ms <= 0")
def h7_no_time_spans(spark, d):
    return tree.no_time_spans(tables.sim_spans_from_orders(spark, d)).select("trace_id", "span_id", "duration_ms")


@query("h8_sim_to_spans", f"""{_TIMELINE}
SELECT trace_id, span_id, coalesce(parent_id, '') AS parent_span_id, span_name AS name, 1 AS kind,
  (start_ms + 1700000000000) * 1000000 AS start_ns, (end_ms + 1700000000000) * 1000000 AS end_ns, span_id AS line
FROM plan JOIN sim USING (trace_id, span_id)""")
def h8_sim_to_spans(spark, d):
    plan = tree.effective_timeline(tables.sim_spans_from_orders(spark, d))
    return tree.sim_to_spans(plan, 1_700_000_000_000).select(
        *IDS, "parent_span_id", "name", "kind", *times(), fs.attribute(attrs(), "line").alias("line")
    )


# --- routing ---------------------------------------------------------------

def messages(spark, d):
    """Events as messages: the topic is the event type."""
    nation = (F.col("user_id") % 25).cast("string").alias("nation")
    attributes = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.struct(nation).alias("user")))
    return tables.load(spark, d, "events").select(
        F.col("event_id").alias("msg_id"), F.col("event_type").alias("topic"), attributes.alias("attributes")
    )


def topic_subscriptions(spark, d):
    topics = tables.load(spark, d, "events").select(F.col("event_type").alias("topic")).distinct()
    names = F.array(F.lit("all"), F.concat(F.lit("only-"), F.col("topic")))
    return topics.select("topic", F.explode(names).alias("subscription"))


def subscribers(spark, d):
    nations = tables.load(spark, d, "nation").select(
        F.lit("all").alias("subscription"), F.col("n_name").alias("subscriber"),
        F.lit("user.nation").alias("filter_key"), F.col("n_nationkey").cast("string").alias("filter_value"),
    )
    regions = tables.load(spark, d, "region").select(
        F.lit("only-error").alias("subscription"), F.col("r_name").alias("subscriber"),
        F.lit(None).cast("string").alias("filter_key"), F.lit(None).cast("string").alias("filter_value"),
    )
    return nations.unionByName(regions)


def routed(spark, d):
    return routing.route(routing.fan_out(messages(spark, d), topic_subscriptions(spark, d)), subscribers(spark, d))


_ROUTED = """WITH msgs AS (SELECT event_id AS msg_id, event_type AS topic, CAST(user_id % 25 AS INTEGER) AS nation FROM events),
routed AS (
  SELECT n_name AS subscriber, 'all' AS subscription, topic, msg_id FROM msgs JOIN nation ON nation = n_nationkey
  UNION ALL
  SELECT r_name, 'only-error', topic, msg_id FROM msgs, region WHERE topic = 'error'),
expected AS (SELECT n_name AS subscriber, msg_id FROM msgs JOIN nation ON n_nationkey = nation OR
  (n_nationkey = 0 AND topic = 'error' AND nation = 1))"""


@query("i1_fan_out", """SELECT event_id AS msg_id, event_type AS topic, s AS subscription
FROM events, (VALUES ('all'), ('only')) AS x(kind), LATERAL (SELECT CASE kind WHEN 'all' THEN 'all' ELSE 'only-' || event_type END AS s)""")
def i1_fan_out(spark, d):
    return routing.fan_out(messages(spark, d), topic_subscriptions(spark, d)).select("msg_id", "topic", "subscription")


@query("i2_route", f"{_ROUTED} SELECT subscriber, subscription, topic, msg_id FROM routed")
def i2_route(spark, d):
    return routed(spark, d)


@query("i3_received", f"""{_ROUTED} SELECT subscriber, msg_id,
row_number() OVER (PARTITION BY subscriber ORDER BY msg_id) AS position FROM (SELECT DISTINCT subscriber, msg_id FROM routed)""")
def i3_received(spark, d):
    return routing.received(routed(spark, d))


def expected(spark, d):
    """What each nation should get: its own messages, and one nation too much."""
    rows = messages(spark, d).withColumn("nation", payloads.json_field(F.col("attributes"), "user.nation").cast("int"))
    wanted = F.when((F.col("topic") == "error") & (F.col("nation") == 1), F.array("nation", F.lit(0))).otherwise(
        F.array("nation")
    )
    rows = rows.select("msg_id", F.explode(wanted).alias("n_nationkey"))
    nations = tables.load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("subscriber"))
    return rows.join(nations, "n_nationkey").select("subscriber", "msg_id")


@query("i4_msg_received", f"""{_ROUTED} SELECT subscriber, msg_id, EXISTS (
SELECT 1 FROM routed r WHERE r.subscriber = e.subscriber AND r.msg_id = e.msg_id) AS received FROM expected e""")
def i4_msg_received(spark, d):
    return routing.msg_received(routed(spark, d), expected(spark, d))


@query("i5_undelivered", f"""{_ROUTED} SELECT subscriber, msg_id FROM expected e WHERE NOT EXISTS (
SELECT 1 FROM routed r WHERE r.subscriber = e.subscriber AND r.msg_id = e.msg_id)""")
def i5_undelivered(spark, d):
    return routing.undelivered(routed(spark, d), expected(spark, d))


@query("i5_delivery_check", f"""{_ROUTED}, seen AS (SELECT e.*, EXISTS (
SELECT 1 FROM routed r WHERE r.subscriber = e.subscriber AND r.msg_id = e.msg_id) AS received FROM expected e)
SELECT subscriber, count(*) AS expected, count(*) FILTER (WHERE received) AS delivered, bool_and(received) AS holds
FROM seen GROUP BY subscriber""")
def i5_delivery_check(spark, d):
    return routing.delivery_check(routed(spark, d), expected(spark, d))


# --- metrics ---------------------------------------------------------------

@query("j1_spans_per_second", f"""WITH {sql.EVENTS}
SELECT start_ns // 60000000000 * 60000 AS minute_ms, service AS label, count(*) AS n, count(*) / 60.0::DOUBLE AS per_second
FROM spans GROUP BY ALL""")
def j1_spans_per_second(spark, d):
    return metrics.per_minute(events(spark, d), fs.nanos_to_ms(start()), trace_query.service_name())


@query("j1_verdicts_per_second", f"""WITH {TRACE_SESSIONS}, {_ERRORS}
SELECT session_end // 60000 * 60000 AS minute_ms, count(*) AS n, count(*) / 60.0::DOUBLE AS per_second
FROM judged GROUP BY ALL""")
def j1_verdicts_per_second(spark, d):
    return metrics.per_minute(e8_run_monitor(spark, d), F.col("session_end"))


@query("j2_spans_processed", f"""WITH {EV_SESSIONS},
sizes AS (SELECT key, session_start, count(*) AS n FROM placed GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS spans_processed, count(*) AS sessions FROM sizes WHERE n >= 3""")
def j2_spans_processed(spark, d):
    counters = ss.session_counters(ss.sessionize(keyed(spark, d), GAP))
    return metrics.processed_total(counters, F.col("n_spans") < 3)


@query("j3_rate_by", f"""WITH {sql.EVENTS}
SELECT service AS label, start_ns // 15000000000 * 15000 + i * 15000 AS window_end_ms, count(*) / 60.0::DOUBLE AS per_second
FROM spans, (VALUES (1), (2), (3), (4)) AS x(i) GROUP BY ALL""")
def j3_rate_by(spark, d):
    return metrics.rate_by(events(spark, d), fs.nanos_to_ms(start()), trace_query.service_name())


@query("j3_counter_rate", """WITH samples AS (
  SELECT event_type AS label, epoch_us(ts) // 1000 AS ms, (event_id % 997)::DOUBLE AS value FROM events),
ends AS (SELECT DISTINCT label, ceil(ms / 21600000.0)::BIGINT * 21600000 + i * 21600000 AS window_end_ms
  FROM samples, (VALUES (0), (1), (2), (3)) AS x(i)),
inside AS (SELECT e.label, window_end_ms, ms, value, lag(value) OVER w AS before, first_value(value) OVER w AS begin
  FROM ends e JOIN samples s ON e.label = s.label AND ms > window_end_ms - 86400000 AND ms <= window_end_ms
  WINDOW w AS (PARTITION BY e.label, window_end_ms ORDER BY ms, value)),
sums AS (SELECT label, window_end_ms, count(*) AS samples, min(begin) AS begin,
  sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS increase,
  (max(ms) - min(ms)) / 1000 AS seconds, (min(ms) - (window_end_ms - 86400000)) / 1000 AS ahead, (window_end_ms - max(ms)) / 1000 AS behind
  FROM inside GROUP BY label, window_end_ms),
near AS (SELECT *, seconds / (samples - 1) AS mean,
  CASE WHEN increase > 0 AND begin >= 0 THEN least(ahead, seconds * (begin / increase)) ELSE ahead END AS nearer FROM sums WHERE seconds > 0)
SELECT label, window_end_ms, samples, increase, increase * ((seconds + CASE WHEN nearer >= mean * 1.1::DOUBLE THEN mean / 2 ELSE nearer END
  + CASE WHEN behind >= mean * 1.1::DOUBLE THEN mean / 2 ELSE behind END) / seconds) / 86400 AS per_second FROM near""")
def j3_counter_rate(spark, d):
    samples = spark.read.parquet(f"{d}/events.parquet")
    return metrics.counter_rate(samples, F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 997, F.col("event_type"), 86_400, 21_600)
