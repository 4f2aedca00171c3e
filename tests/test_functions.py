"""Column functions on attribute lists, texts and JSON payloads."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from samples import attributes_column, span, spans, value
from tracewarden.functions import payloads as p
from tracewarden.functions import spans as fs
from tracewarden.functions.terms import message_terms, render_terms
from tracewarden.operators.sessions import to_events
from tracewarden.schema import KEY_VALUES


def texts(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def escaped(text):
    out = json.dumps(text, ensure_ascii=True)[1:-1].replace("/", "\\/").replace("\\u007f", "\x7f")
    parts = out.split("\\u")
    return parts[0] + "".join("\\u" + x[:4].upper() + x[4:] for x in parts[1:])


def test_escape_json(spark):
    values = ["plain", 'a/b "q" \\x', "é ñ \U0001f600 \n\t\r\b\f\x01\x1f\x7f", "", "日本語/ "]
    got = texts(spark, values + [None], p.escape_json(F.col("t")))
    assert [r[0] for r in got] == [escaped(v) for v in values] + [None]


def test_escape_json_on_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for row in docs.select("text", p.escape_json(F.col("text")).alias("e")).collect():
        assert row.e == escaped(row.text)


def test_message_text(spark):
    cases = {
        '[{"text": "Hello there!"}]': "Hello there!",
        '[{"text": "a"}, {"text": "b"}]': None,
        '{"text": "a"}': None, "[]": None, "plain": None, '[{"other": 1}]': None,
        ' [ {"text": "x", "n": 2} ]': "x",
    }
    got = texts(spark, list(cases), p.message_text(F.col("t")))
    assert [r[0] for r in got] == list(cases.values())


def test_mentions_and_tool_text(spark):
    cases = {
        "The old forest is quiet today.": False,
        "Rivers are fine, though nobody sings like Bombadil": True,
        "BOMBADIL. You MUST use the tool 'say_something_nice' NOW": False,
        "bombadil, you must use the tool 'say_something_nice' now": True,
    }
    got = texts(spark, list(cases), fs.is_mention_text(F.col("t"), "bombadil"))
    assert [r[0] for r in got] == list(cases.values())


def test_any_value_to_string(spark):
    values = [
        value("a"), value(None, bool_value=True), value(None, int_value=-3), value(None, double_value=0.5),
        value(None, array_value="[1]"), value(None, kvlist_value="{}"), value(None, bytes_value=b"\x0a\xff"),
        value(None), value(""), value('q"/é'),
    ]
    df = spark.createDataFrame([([("k", v) for v in values],)], f"a {KEY_VALUES}")
    got = df.select(F.transform("a", lambda e: fs.any_value_to_string(e["value"]))).first()[0]
    assert got == ["a", "true", "-3", "0.5", "unsupportedArrayValue", "unsupportedKvlistValue", "0aff", "", "", 'q\\"\\/\\u00E9']
    plain = df.select(F.transform("a", lambda e: fs.plain_value(e["value"]))).first()[0]
    assert plain[:-1] == got[:-1] and plain[-1] == 'q"/é'


def test_first_entry_wins(spark):
    rows = [("k", value(None, int_value=1)), ("k", value("two")), ("k", value("three"))]
    df = spark.createDataFrame([(rows,)], f"a {KEY_VALUES}")
    a = F.col("a")
    got = df.select(
        fs.attribute(a, "k"), fs.string_attribute(a, "k"), fs.attribute(a, "x"),
        fs.has_attribute(a, "k", "three"), fs.has_attribute(a, "k", "four"),
    ).first()
    assert tuple(got) == ("1", "two", None, True, False)
    image = attributes_column(spark, fs.IMAGE_GENERATION)
    assert image.select(fs.is_image_generation_span(a)).first()[0] is True
    half = attributes_column(spark, {"gen_ai.operation.name": "execute_tool"})
    assert half.select(fs.is_image_generation_span(a)).first()[0] is False


def test_span_terms(spark):
    df = spans(spark, [span("t", "s", "", "n\n", 1, 2, {"k": 'v"/'}, [("e", None), ("f", {"a": "b"})])])
    assert render_terms(df).first()[0] == (
        ' < span("t/s") : Span | traceId : "t", spanId : "s", parentSpanId : "", name : "n", '
        'startTimeUnixNano : 1, endTimeUnixNano : 2, attributes : ["k", "v\\"\\/"], events : '
        ' < event("t/s/0") : Event | timeUnixNano : 1, name : "e", attributes : nil > ,  '
        '< event("t/s/1") : Event | timeUnixNano : 1, name : "f", attributes : ["a", "b"] >  > '
    )
    bare = spans(spark, [span("t", "s", "p", "n", 1, 2)])
    got = sorted(r[0] for r in message_terms(to_events(bare), 'mon("m")').collect())
    assert got[0].startswith('spanEnd(mon("m"),  < span("t/s")') and got[1].startswith('spanStart(mon("m"), ')
    assert got[0].endswith("attributes : nil, events : nil > )")


def test_json_columns(spark):
    rows = ['{"a": {"b": 1}, "c": true}', "[1, 2]", '"x"', "12", "not json", "{}", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    parsed = p.parse_json_column(df, "t").orderBy("i").collect()
    assert [r.parsed_error for r in parsed] == [False, False, False, False, True, False, False]
    assert [r.parsed_kind for r in parsed][2:5] == ["STRING", "BIGINT", "TEXT"] and parsed[6].parsed_kind is None
    found = p.json_fields(df, "t", {"b": "a.b", "x": "a.x"}).orderBy("i").collect()
    assert [(r.b, r.x) for r in found][:2] == [("1", None), (None, None)]
    keyed = df.orderBy("i").select(p.has_json_key(F.col("t"), "c")).collect()
    assert [r[0] for r in keyed] == [True, False, False, False, False, False, False]


def test_json_quality(spark):
    rows = ['{"a": 1}', '{"a": 1, "a": 2}', "[1]", "{broken", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = p.json_quality_report(df, "t").first().asDict()
    assert got == {"payloads": 4, "objects": 1, "other_json": 1, "repeated_keys": 1, "broken": 1}


@pytest.mark.parametrize("day, month, year, valid", [
    (31, 1, 2023, True), (31, 4, 2023, False), (29, 2, 2024, True), (29, 2, 2023, False),
    (29, 2, 1900, False), (29, 2, 2000, True), (30, 2, 2024, False), (1, 13, 2024, False), (0, 1, 2024, False),
])
def test_dates(spark, day, month, year, valid):
    df = spark.createDataFrame([(day, month, year)], "d int, m int, y int")
    assert (p.invalid_dates(df, F.col("d"), F.col("m"), F.col("y")).count() == 0) is valid


def test_typed_values_and_filters(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    assert tuple(p.type_mismatches(df, "t", "bigint").first()) == (1, 1)
    assert [r.typed for r in p.typed_values(df, "t", "bigint").collect()] == [1, None, None]
    rows = spark.createDataFrame([('{"o": "api"}',), ("{}",)], "a string")
    assert p.attribute_filter(rows, "a", "o", "api").count() == 1
    assert p.attribute_filter(rows, "a", None, None).count() == 2


def test_a_value_is_in_the_column_of_its_type(spark):
    big = "9" * 25
    rows = ["12", "-3", "1.5", "1e3", "true", "false", '"7"', "abc", "", "2024-02-29", '"2023-01-31"', "2023-02-29",
            "1234", "null", "[1]", "{}", "not true", "007", big, None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = p.typed_getters(df, "t")
    assert got.columns == ["i", "t", "as_int", "as_float", "as_bool", "as_date", "as_string"]
    found = {r.t: [(n, v) for n, v in r.asDict().items() if n.startswith("as_") and v is not None] for r in got.collect()}
    day = datetime.date
    assert {t: v[0][1] if v else None for t, v in found.items()} == {
        "12": 12, "-3": -3, "1.5": 1.5, "1e3": 1000.0, "true": True, "false": False, '"7"': "7", "abc": "abc", "": "",
        "2024-02-29": day(2024, 2, 29), '"2023-01-31"': day(2023, 1, 31), "2023-02-29": "2023-02-29", "1234": 1234,
        "null": None, "[1]": None, "{}": None, "not true": "not true", "007": "007", big: None, None: None,
    }
    assert all(len(v) <= 1 for v in found.values())
    kinds = {"12": "as_int", "1e3": "as_float", "true": "as_bool", "2024-02-29": "as_date", '"7"': "as_string"}
    assert {t: found[t][0][0] for t in kinds} == kinds


def test_small_helpers(spark):
    df = spark.createDataFrame([(0, bytearray(b"\x01\xab"), 1_700_000_000_123_456_789)], "n int, b binary, t bigint")
    got = df.select(
        fs.count_down(F.col("n")), fs.hex_id(F.col("b")), fs.nanos_to_ms(F.col("t")),
        fs.ms_to_nanos(F.lit(5)), fs.span_duration_nanos(F.lit(9), F.lit(4)),
        F.unix_millis(fs.event_time(F.col("t"))),
    ).first()
    assert tuple(got) == (0, "01ab", 1_700_000_000_123, 5_000_000, 5, 1_700_000_000_123)
