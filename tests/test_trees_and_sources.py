"""Span trees, simulation files, routing, requests, generated traces and sinks."""

import random
import json

import pytest
from pyspark.sql import functions as F

from samples import span, spans
from tracewarden.operators import metrics, routing, tree
from tracewarden.operators.sessions import multiple_root_errors, tumbling_letters
from tracewarden.settings import Job
from tracewarden.operators.properties import duration_safety
from tracewarden.sinks import text, verdicts
from tracewarden.sources import otlp, simspans, tables

PLAN = [
    ("trace1", "root1", None, 0, 1000), ("trace1", "child11", "root1", 0, 3000),
    ("trace1", "child111", "child11", 2500, 1000), ("trace1", "child12", "root1", 3000, 1000),
    ("trace2", "root2", None, 500, 2000),
]


def plan(spark, rows=PLAN):
    return spark.createDataFrame(
        [(t, s, p, s, "INTERNAL", o, d, {"bar": "baz"}) for t, s, p, o, d in rows],
        "trace_id string, span_id string, parent_id string, span_name string, span_kind string, "
        "start_offset_ms bigint, duration_ms bigint, attributes map<string,string>",
    )


def test_planned_timeline(spark):
    got = tree.effective_timeline(plan(spark), pad_ms=0)
    found = {r.span_id: (r.start_ms, r.end_ms) for r in got.collect()}
    assert found == {
        "child111": (2500, 3500), "child11": (0, 3500), "child12": (3000, 4000),
        "root1": (0, 4000), "root2": (500, 2500),
    }
    real = {r.span_id: r for r in tree.sim_to_spans(got, 10_000).collect()}
    assert real["child11"].start_time_unix_nano == 10_000_000_000
    assert real["child11"].attributes[0].value.string_value == "baz" and real["root1"].parent_span_id == ""


def test_late_children(spark):
    rows = [("t", "r", None, 2000, 10), ("t", "a", "r", 1400, 10), ("t", "b", "r", 1800, 0), ("t", "c", "r", 2000, 10)]
    got = tree.late_spans(tree.effective_timeline(plan(spark, rows)))
    assert {r.span_id: r.outcome for r in got.collect()} == {"a": "error", "b": "started at once"}
    assert [r.span_id for r in tree.no_time_spans(plan(spark, rows)).collect()] == ["b"]


@pytest.mark.parametrize("rows, error", [
    (PLAN, None),
    (PLAN[:1] + PLAN[:1], "duplicate span id"),
    ([("t", "a", "b", 0, 1), ("t", "b", "a", 0, 1)], "no root span"),
    ([("t", "a", None, 0, 1), ("t", "b", None, 0, 1)], "not a tree"),
    ([("t", "a", None, 0, 1), ("t", "b", "gone", 0, 1)], "not a tree"),
    ([("t", "a", None, 0, 1), ("t", "b", "c", 0, 1), ("t", "c", "b", 0, 1), ("t", "d", "c", 0, 1)], "not a tree"),
    ([("t", "a", None, 0, 1), ("t", "b", "b", 0, 1)], "not a tree"),
])
def test_tree_errors(spark, rows, error):
    assert [r.error for r in tree.tree_errors(plan(spark, rows)).collect()] == ([error] if error else [])


def test_deep_chain_and_wide_root(spark):
    rows = [("t", "n0", None, 0, 1)] + [("t", f"n{i}", f"n{i - 1}", 0, 1 + i % 7) for i in range(1, 70)]
    rows += [("w", "r", None, 5, 1)] + [("w", f"c{i}", "r", 0, i) for i in range(300)]
    df = plan(spark, rows)
    got = {(r.trace_id, r.span_id): r for r in tree.span_tree(df).collect()}
    assert len(got) == len(rows) and got[("t", "n69")].depth == 69
    assert got[("t", "n3")].path == "n0/n1/n2/n3"
    assert tree.tree_errors(df).count() == 0
    ends = {(r.trace_id, r.span_id): (r.start_ms, r.end_ms) for r in tree.effective_timeline(df, 0).collect()}
    assert ends[("w", "r")] == (5, 304) and ends[("w", "c0")] == (5, 5) and ends[("t", "n0")] == (0, 7)
    first = [r.span_id for r in tree.descendants(df).filter("trace_id = 't'").limit(3).collect()]
    assert first == ["n0", "n1", "n2"]


def odd_forest():
    """Small and larger traces with repeated and missing ids, cycles, orphans and several roots."""
    rng, rows = random.Random(5), []
    for t in range(40):
        size = rng.choice([1, 2, 5, 9, 30, 90])
        for i in range(size):
            parent = None if i == 0 or rng.random() < 0.03 else f"s{rng.randrange(max(0, i - 6), i)}"
            if rng.random() < 0.04:
                parent = rng.choice(["", "gone", f"s{rng.randrange(size)}"])
            name = None if t % 10 == 3 and rng.random() < 0.1 else f"s{i}"
            row = (f"t{t}" if t else None, name, parent, rng.choice([None, 0, 700, 2500]), rng.choice([None, 0, 40, 3000]))
            rows += [row] * (2 if t % 10 == 7 and rng.random() < 0.1 else 1)
    return rows


@pytest.mark.parametrize("tree_of", [
    tree.span_tree, lambda df: tree.preorder(df.dropDuplicates(["trace_id", "span_id"])),
    lambda df: tree.effective_timeline(df).drop("attributes"),
])
def test_traces_as_one_row_give_what_joins_give(spark, monkeypatch, tree_of):
    df = plan(spark, odd_forest())
    found = []
    for small in (0, 64):
        monkeypatch.setattr(tree, "SMALL", small)
        got = tree_of(df)
        found.append((got.columns, sorted(map(repr, got.collect()))))
    assert found[0] == found[1] and len(found[0][1]) > 300


@pytest.mark.parametrize("tree_of", [tree.span_tree, tree.preorder, tree.effective_timeline, tree.tree_errors])
def test_small_traces_are_not_joined_round_by_round(spark, monkeypatch, tree_of):
    written, freeze = [], tree.freeze
    monkeypatch.setattr(tree, "freeze", lambda df: written.append(df.columns) or freeze(df))
    rows = [("t", "n0", None, 0, 1)] + [("t", f"n{i}", f"n{i - 1}", 0, 1) for i in range(1, 40)]
    assert tree_of(plan(spark, rows)).count() == (0 if tree_of is tree.tree_errors else 40)
    assert len(written) == 3


def test_sim_files(spark, tmp_path):
    line = ('{"spanId":{"traceId":"trace1","spanId":"child11"},"parentId":"root1","spanName":"child11",'
            '"spanKind":"INTERNAL","startTimeOffsetMs":0,"durationMs":3000,"attributes":{"bar":"baz"}}')
    bare = '{"spanId":{"traceId":"trace1","spanId":"root1"},"spanName":"r","startTimeOffsetMs":1,"durationMs":2}'
    paths = []
    for i, lines in enumerate([[line, bare], [bare]]):
        path = tmp_path / f"sim {i}.jsonl"
        path.write_text("\n".join(lines))
        paths.append(str(path))
    got = simspans.read_sim_spans(spark, paths)
    found = {(r.trace_id, r.span_id): r for r in got.collect()}
    assert set(found) == {("trace1-0", "child11"), ("trace1-0", "root1"), ("trace1-1", "root1")}
    root = found[("trace1-0", "root1")]
    assert (root.parent_id, root.span_kind, root.attributes) == (None, "INTERNAL", {})
    text.write_sim_spans(simspans.read_sim_spans(spark, paths[:1], add_index=False), str(tmp_path / "out"))
    written = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert json.loads(line) in written
    for bad in ["{nope", '{"spanName": "x"}']:
        broken = tmp_path / "bad.jsonl"
        broken.write_text(bad)
        with pytest.raises(Exception):
            simspans.read_sim_spans(spark, [str(broken)]).collect()


def test_routing(spark):
    attributes = [("api", "1.0"), ("api", "2.0"), ("user", "3.0"), ("user", "3.0")]
    messages = spark.createDataFrame(
        [(i, "topic", json.dumps({"origin": o, "version": v})) for i, (o, v) in enumerate(attributes)],
        "msg_id bigint, topic string, attributes string",
    )
    subscriptions = spark.createDataFrame([("topic", "0"), ("topic", "1")], "topic string, subscription string")
    subscribers = spark.createDataFrame(
        [("0", "s0", "origin", "api"), ("0", "s1", "origin", "user"), ("1", "s2", "version", "1.0"), ("1", "s3", None, None)],
        "subscription string, subscriber string, filter_key string, filter_value string",
    )
    routed = routing.route(routing.fan_out(messages, subscriptions), subscribers)
    got = {}
    for r in routing.received(routed, chunks=3).orderBy("subscriber", "position").collect():
        got.setdefault(r.subscriber, []).append((r.position, r.msg_id))
    assert got == {
        "s0": [(1, 0), (2, 1)], "s1": [(1, 2), (2, 3)], "s2": [(1, 0)], "s3": [(1, 0), (2, 1), (3, 2), (4, 3)],
    }
    expected = spark.createDataFrame([("s0", 0), ("s2", 0), ("s2", 3)], "subscriber string, msg_id bigint")
    assert [tuple(r) for r in routing.undelivered(routed, expected).collect()] == [("s2", 3)]
    held = {r.subscriber: r.holds for r in routing.delivery_check(routed, expected).collect()}
    assert held == {"s0": True, "s2": False}


REQUEST = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]},
            "scopeSpans": [
                {
                    "scope": {"name": "lib"},
                    "spans": [
                        {
                            "traceId": "0AF7651916CD43DD8448EB211C80319C", "spanId": "B7AD6B7169203331", "name": "a",
                            "kind": 3, "startTimeUnixNano": "1700000000000000001", "endTimeUnixNano": "1700000000000000002",
                            "attributes": [{"key": "n", "value": {"intValue": "7"}},
                                           {"key": "l", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}],
                            "events": [{"timeUnixNano": "5", "name": "e"}], "status": {"code": 2},
                        }
                    ],
                    "schemaUrl": "s1",
                },
                {"scope": {"name": "empty"}},
            ],
            "schemaUrl": "r1",
        },
        {"resource": {}},
    ]
}


def test_requests(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text(json.dumps(REQUEST))
    batch = otlp.flatten_spans(otlp.read_otlp(spark, str(path)))
    (row,) = batch.collect()
    assert row.trace_id == "0af7651916cd43dd8448eb211c80319c" and row.parent_span_id == ""
    assert row.start_time_unix_nano == 1700000000000000001 and row.kind == 3 and row.status.code == 2
    assert row.attributes[0].value.int_value == 7 and "intValue" in row.attributes[1].value.array_value
    assert row.scope.name == "lib" and row.scope_schema_url == "s1" and row.resource_schema_url == "r1"
    assert row.events[0].name == "e" and row.links == []
    stream = otlp.flatten_spans(otlp.read_otlp(spark, str(path), streaming=True))
    query = stream.writeStream.format("memory").queryName("flat").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("flat").collect() == [row]
    (path / "b.json").write_text("{broken")
    with pytest.raises(Exception):
        otlp.flatten_spans(otlp.read_otlp(spark, str(path))).collect()


def test_job_from_settings(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text(json.dumps(REQUEST))
    job = Job.of({
        "job-name": "j", "source": {"path": str(path)}, "state-path": str(tmp_path / "state"),
        "sink": {"path": str(tmp_path / "out"), "terms-path": str(tmp_path / "terms")},
    })
    job.run(spark, duration_safety())
    (found,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (found.truthValue, found.propertyName) == ("True", "image generation safety")
    assert spark.read.text(str(tmp_path / "terms")).count() == 1


_VALUE = (
    "struct<string_value:string,bool_value:boolean,int_value:bigint,double_value:double,"
    "array_value:struct<values:array<struct<int_value:bigint>>>,bytes_value:binary>"
)
_ATTRIBUTES = f"attributes:array<struct<key:string,value:{_VALUE}>>,dropped_attributes_count:bigint"
DECODED = (
    f"r struct<resource_spans:array<struct<resource:struct<{_ATTRIBUTES}>,scope_spans:array<struct<"
    f"scope:struct<name:string,version:string,{_ATTRIBUTES}>,spans:array<struct<"
    "trace_id:binary,span_id:binary,trace_state:string,parent_span_id:binary,flags:bigint,name:string,kind:int,"
    f"start_time_unix_nano:bigint,end_time_unix_nano:bigint,{_ATTRIBUTES},"
    f"events:array<struct<time_unix_nano:bigint,name:string,{_ATTRIBUTES}>>,dropped_events_count:bigint,"
    f"links:array<struct<trace_id:binary,span_id:binary,trace_state:string,{_ATTRIBUTES},flags:bigint>>,"
    "dropped_links_count:bigint,status:struct<message:string,code:int>>>,schema_url:string>>,schema_url:string>>>"
)


def test_decoded_requests(spark):
    """A struct as the protobuf decoder gives it: descriptor names, binary ids."""
    trace, own = bytes.fromhex("0af7651916cd43dd8448eb211c80319c"), bytes.fromhex("b7ad6b7169203331")
    none = (None, None, None, None, None, None)
    entries = [("n", (None, None, 7, None, None, None)), ("l", (*none[:4], ([(1,)],), None)), ("b", (*none[:5], b"\x01\xff")), ("s", ("x", *none[1:]))]
    one = (trace, own, "", b"", 0, "a", 3, 1700000000000000001, 1700000000000000002, entries, 0,
           [(5, "e", entries[:1], 0)], 0, [(own, trace, "", [], 0, 1)], 0, ("", 2))
    request = ([((entries[3:], 0), [(("lib", "1", [], 0), [one], "s1"), (None, [], None)], "r1"), (None, [], None)],)
    decoded = spark.createDataFrame([(request,), (None,)], DECODED)
    (row,) = otlp.flatten_spans(otlp.decoded_requests(decoded, "r")).collect()
    assert (row.trace_id, row.span_id, row.parent_span_id) == (trace.hex(), own.hex(), "")
    assert row.start_time_unix_nano == 1700000000000000001 and row.kind == 3 and row.status.code == 2
    assert row.attributes[0].value.int_value == 7 and "1" in row.attributes[1].value.array_value
    assert bytes(row.attributes[2].value.bytes_value) == b"\x01\xff" and row.attributes[3].value.string_value == "x"
    assert row.events[0].name == "e" and row.links[0].span_id == trace.hex() and row.links[0].flags == 1
    assert row.scope.name == "lib" and row.scope_schema_url == "s1" and row.resource_schema_url == "r1"
    assert row.resource.attributes[0].value.string_value == "x"


def test_malformed_request_texts_fail(spark):
    rows = spark.createDataFrame([("{broken",), (json.dumps(REQUEST),)], "t string")
    with pytest.raises(Exception):
        otlp.flatten_spans(otlp.parse_requests(rows, "t")).collect()
    good = spark.createDataFrame([(json.dumps(REQUEST),), (None,)], "t string")
    assert otlp.flatten_spans(otlp.parse_requests(good, "t")).count() == 1


def test_rates_need_whole_steps(spark):
    rows = spark.createDataFrame([(1000, "a"), (16_000, "a")], "ms bigint, label string")
    with pytest.raises(ValueError):
        metrics.rate_by(rows, F.col("ms"), F.col("label"), 50, 15)
    got = metrics.rate_by(rows, F.col("ms"), F.col("label"), 30, 15).collect()
    assert {r.window_end_ms: r.per_second for r in got} == {15_000: 1 / 30, 30_000: 2 / 30, 45_000: 1 / 30}


def test_nested_paths_route(spark):
    messages = spark.createDataFrame(
        [(1, "t", '{"a":{"b":"x"},"c.d":"y"}'), (2, "t", '{"a":{"b":"z"}}'), (3, "t", "broken"), (4, "t", None)],
        "msg_id bigint, topic string, attributes string",
    )
    fanned = routing.fan_out(messages, spark.createDataFrame([("t", "s")], "topic string, subscription string"))
    subscribers = spark.createDataFrame(
        [("s", "x", "a.b", "x"), ("s", "z", "a.b", "z"), ("s", "none", "a.q", "x"), ("s", "all", None, None), ("o", "other", None, None)],
        "subscription string, subscriber string, filter_key string, filter_value string",
    )
    routed = routing.route(fanned, subscribers)
    got = sorted((r.subscriber, r.msg_id) for r in routed.collect())
    assert got == [("all", 1), ("all", 2), ("all", 3), ("all", 4), ("x", 1), ("z", 2)]


def test_letters_and_second_roots(spark):
    rows = [span("t", "r", "", "a", 10, 45), span("t", "x", "r", "b", 5, 100), span("t", "s", "", "a", 50, 60)]
    rows = [tuple(v * 1_000_000 if i in (7, 8) else v for i, v in enumerate(r)) for r in rows]
    df = spans(spark, rows).withColumn("key", F.col("trace_id"))
    got = tumbling_letters(df, 10, {"b": F.col("name") == "b"}).orderBy("letter").collect()
    assert [(r.letter, r.n_events, r.b) for r in got] == [
        (0, 1, False), (1, 0, False), (2, 0, False), (3, 1, False), (4, 1, False), (5, 1, False),
        (6, 0, False), (7, 0, False), (8, 0, False), (9, 1, True),
    ]
    assert [r.span_id for r in multiple_root_errors(df).collect()] == ["s"]


def test_verdict_tables(spark, tmp_path):
    found = spark.createDataFrame(
        [("k", 1000, 2000, "p", "True"), ("k", 86_400_000, 2000, "p", "False")],
        "key string, session_start bigint, session_end bigint, propertyName string, truthValue string",
    )
    docs = [verdicts.verdict_documents(found, F.timestamp_seconds(F.lit(s))) for s in (10, 20)]
    verdicts.write_verdict_batch(docs[0], 0, str(tmp_path / "b"))
    verdicts.write_verdict_batch(docs[1], 1, str(tmp_path / "b"))
    verdicts.write_verdict_batch(docs[1], 1, str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    assert stored.count() == 4
    last = verdicts.latest_verdicts(stored).collect()
    assert [(r.truthValue, int(r.evaluationDate.timestamp())) for r in last] == [("False", 20)]
    low, high = F.timestamp_seconds(F.lit(1)), F.timestamp_seconds(F.lit(86_400))
    assert verdicts.verdicts_in_range(stored, "p", low, high).count() == 4
    assert verdicts.verdicts_in_range(stored, "p", F.timestamp_seconds(F.lit(2)), high).count() == 2
    plan = verdicts.verdicts_in_range(stored, "p", low, high)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(propertyName" in plan


def walked(spans):
    """Pre-order of each trace by plain recursion with a stack: (depth, position, size)."""
    children, ids = {}, {(t, s) for t, s, _ in spans}
    for t, s, parent in spans:
        children.setdefault((t, parent or ""), []).append(s)
    found = {}
    for t in {t for t, _ in ids}:
        roots = children.get((t, ""), [])
        todo, order = [(min(roots), 0)] if roots else [], []
        while todo:
            s, depth = todo.pop()
            order.append((s, depth))
            todo += [(c, depth + 1) for c in sorted(children.get((t, s), []), reverse=True)]
        for i, (s, depth) in enumerate(order):
            size = next((k for k in range(i + 1, len(order)) if order[k][1] <= depth), len(order)) - i
            found[(t, s)] = (depth, i, size)
    return found


@pytest.mark.parametrize("chunk_bits", [18, 3])
def test_preorder_is_that_of_a_walk(spark, monkeypatch, chunk_bits):
    from tracewarden.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK_BITS", chunk_bits)
    rng = random.Random(12)
    spans = [("a", "root", None), ("a", "line1", "root"), ("a", "line1-2", "root"), ("a", "line2", "line1"), ("a", "z", "line1-2")]
    spans += [("wide", "r", "")] + [("wide", f"c{i}", "r") for i in range(300)]  # half of all spans under one parent
    spans += [("random", "n0", None)] + [("random", f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 120)]
    spans += [("two", "b", None), ("two", "a", None), ("two", "x", "b"), ("two", "y", "a")]
    spans += [("cycle", "r", None), ("cycle", "p", "q"), ("cycle", "q", "p"), ("cycle", "s", "p"), ("orphan", "o", "gone"), ("lone", "l", None)]
    table = spark.createDataFrame(spans, "trace_id string, span_id string, parent_id string").repartition(7)
    got = {(r.trace_id, r.span_id): (r.depth, r.position, r["size"]) for r in tree.preorder(table).collect()}
    assert got == walked(spans)
    assert [r.span_id for r in tree.descendants(table).filter("trace_id = 'a'").collect()] == ["root", "line1", "line2", "line1-2", "z"]
    assert tree.preorder(table.limit(0)).isEmpty()


def test_preorder_of_a_deep_chain(spark):
    deep = 10_000
    chain = spark.range(deep).select(
        F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"),
        F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"),
    )
    found = tree.preorder(chain)
    right = (F.col("depth") == F.col("span_id").cast("int")) & (F.col("position") == F.col("depth")) & (F.col("size") == deep - F.col("depth"))
    assert found.filter(right).count() == deep


def test_rate_of_a_counter_with_restarts_and_gaps(spark):
    draw, rows = random.Random(5), []
    for label in ("hot", "cold", None):
        ms, value = -40_000, 7.0
        for _ in range(600 if label == "hot" else 60):
            ms += draw.choice([0, 900, 2_500, 5_000, 15_000, 200_000 if draw.random() < 0.1 else 4_000])
            value = float(draw.randrange(3)) if draw.random() < 0.1 else value + draw.randrange(5)
            rows.append((label, ms, value))
    rows += [("cold", None, 1.0), ("cold", 5, None)]
    want = {}
    for label in ("hot", "cold", None):
        mine = sorted((m, v) for lab, m, v in rows if lab == label and m is not None and v is not None)
        for end in range(mine[0][0] // 15_000 * 15_000, mine[-1][0] + 75_000, 15_000):
            held = [(m, v) for m, v in mine if end - 60_000 < m <= end]
            if not held or held[0][0] == held[-1][0]:
                continue
            more = sum(v if v < u else v - u for (_, u), (_, v) in zip(held, held[1:]))
            seconds = (held[-1][0] - held[0][0]) / 1000
            mean = seconds / (len(held) - 1)
            ahead, behind = (held[0][0] - (end - 60_000)) / 1000, (end - held[-1][0]) / 1000
            if more > 0:
                ahead = min(ahead, seconds * held[0][1] / more)
            ahead, behind = (mean / 2 if gap >= mean * 1.1 else gap for gap in (ahead, behind))
            want[label, end] = (len(held), more, pytest.approx(more * (seconds + ahead + behind) / seconds / 60, rel=1e-9))
    df = spark.createDataFrame(rows, "label string, ms long, value double")
    found = metrics.counter_rate(df, F.col("ms"), F.col("value"), F.col("label"))
    got = {(r["label"], r["window_end_ms"]): (r["samples"], r["increase"], r["per_second"]) for r in found.collect()}
    assert got == want and len(got) > 100
    assert metrics.counter_rate(df.limit(0), F.col("ms"), F.col("value"), F.col("label")).collect() == []
    with pytest.raises(ValueError):
        metrics.counter_rate(df, F.col("ms"), F.col("value"), F.col("label"), 50, 15)


def test_planned_spans_of_repeated_and_incomplete_lines(spark, tmp_path):
    lines = [
        (1, 10, 1, 5.0), (1, 11, 1, 5.0), (1, 12, 2, 4.0), (1, 12, 2, 6.0), (1, 13, 4, 4.0), (2, 1, 3, 4.0),
        (None, 1, 1, 4.0), (None, 1, 2, 4.0), (3, 1, None, 4.0), (3, None, 1, None),
    ]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = tables.sim_spans_from_orders(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert sorted(map(repr, [(r.trace_id, r.span_id, r.parent_id) for r in got.collect()])) == sorted(map(repr, [
        ("order1", "root", None), ("order1", "line1", "root"), ("order1", "line1-2", "root"), ("order1", "line2", "line1"),
        ("order1", "line2-2", "root"), ("order1", "line4", "root"), ("order2", "line3", "root"),
        (None, "line1", "root"), (None, "line2", "root"), ("order3", None, "root"), ("order3", "line1", "root"),
    ]))


def test_packed_simulation_files_say_the_same_in_less(spark, tmp_path):
    rows = [("t", f"n{i}", "r" if i else None, 0, i) for i in range(500)]
    sizes, read = [], []
    for codec in (None, "gzip"):
        folder = tmp_path / str(codec)
        text.write_sim_spans(plan(spark, rows).coalesce(1), str(folder), codec, lines_per_file=200)
        files = list(folder.glob("part-*"))
        assert len(files) == 3
        sizes.append(sum(f.stat().st_size for f in files))
        read.append(sorted(map(repr, simspans.read_sim_spans(spark, [str(folder)]).collect())))
    assert read[0] == read[1] and len(read[0]) == 500 and sizes[1] * 5 < sizes[0]
