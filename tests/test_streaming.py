"""Streams give the verdicts a batch gives; late spans fire sessions again."""


import pytest
from pyspark.sql import functions as F

from samples import span, spans
from test_monitors import brute_sessions, hot_spans, state_monitor  # noqa: F401
from tracewarden.operators import metrics
from tracewarden.operators import monitor as m
from tracewarden.operators.properties import duration_safety
from tracewarden.operators.sessions import key_by_attribute, session_counters, sessionize
from tracewarden.schema import SPANS
from tracewarden.sources.otlp import with_event_time
from tracewarden.streaming.run import MonitorStream, run_monitor_stream, stream_dedupe, stream_rates, stream_session_counters

SEC = 1_000_000_000
FAR = 10**6 * SEC


def write_in_order(spark, rows, folder, parts):
    """Files of spans in event-time order, one per micro-batch."""
    rows = sorted(rows, key=lambda r: r[7])
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spans(spark, rows[i : i + size]).coalesce(1).write.mode("append").parquet(str(folder))
    return folder


def stream_of(spark, folder):
    return spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def far_span(key):
    return span("far", f"far-{key}", "", "step", FAR, FAR + 1, {"key": key})


@pytest.mark.parametrize("kind", ["sum", "states"])
def test_stream_equals_batch(spark, hot_spans, tmp_path, kind):
    rows = hot_spans[0]
    monitor = (
        state_monitor(ttl_ms=20_000) if kind == "states"
        else duration_safety(matches=F.col("name") == "rude", limit_nanos=400 * SEC, key_attribute="key", gap_ms=8_000)
    )
    folder = write_in_order(spark, rows + [far_span("end")], tmp_path / "in", 4)
    query = run_monitor_stream(
        stream_of(spark, folder), monitor, str(tmp_path / "out"), str(tmp_path / "state"), 500
    )
    query.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r.key, int(r.startDate.timestamp() * 1000), r.truthValue) for r in stored.collect())
    batch = m.run_monitor(spans(spark, rows), monitor).collect()
    assert got == sorted((r.key, r.session_start, r.truthValue) for r in batch)
    assert len({r.truthValue for r in batch}) > 1


def test_a_repeated_batch_replaces_itself(spark, hot_spans, tmp_path):
    rows = sorted(hot_spans[0], key=lambda r: r[7])
    work = MonitorStream(spark, state_monitor(), str(tmp_path / "s"), str(tmp_path / "o"))
    first, second = spans(spark, rows[:400]), spans(spark, rows[400:] + [far_span("end")])
    work.process(first, 0)
    work.process(second, 1)
    once = spark.read.parquet(str(tmp_path / "o")).select("key", "startDate", "truthValue", "batch_id").collect()
    work.process(second, 1)
    again = spark.read.parquet(str(tmp_path / "o")).select("key", "startDate", "truthValue", "batch_id").collect()
    assert sorted(once) == sorted(again)


def test_late_span_fires_again_from_the_state_before(spark, tmp_path):
    def one(own, at, length, key="a"):
        return span("t", own, "", "rude", at * SEC, (at + length) * SEC, {"key": key})

    monitor = duration_safety(
        matches=F.col("name") == "rude", limit_nanos=10 * SEC, key_attribute="key", gap_ms=5_000,
        lateness_ms=60_000,
    )
    work = MonitorStream(spark, monitor, str(tmp_path / "s"), str(tmp_path / "o"), 0)

    def fired(batch):
        try:
            rows = spark.read.parquet(f"{tmp_path}/o/batch_id={batch}").collect()
        except Exception as error:
            if "UNABLE_TO_INFER_SCHEMA" in str(error):
                return []
            raise
        return sorted((r.key, int(r.startDate.timestamp()), r.truthValue) for r in rows)

    # Two sessions of key a (4 s, then 4 s more); the clock key closes both.
    work.process(spans(spark, [one("1", 0, 4), one("2", 20, 4), one("c", 40, 0, "clock")]), 0)
    assert fired(0) == [("a", 0, "True"), ("a", 20, "True")]
    # A late span adds 4 s to the first session: both fire again, once folded.
    work.process(spans(spark, [one("3", 2, 4)]), 1)
    assert fired(1) == [("a", 0, "True"), ("a", 20, "False")]
    # Nothing new: nothing fires.
    work.process(spans(spark, [one("c2", 41, 0, "clock")]), 2)
    assert fired(2) == []
    # Past the lateness the span is dropped; a new session goes on from 12 s.
    work.process(spans(spark, [one("c3", 200, 0, "clock")]), 3)
    work.process(spans(spark, [one("4", 3, 50), one("5", 201, 0), one("c4", 400, 0, "clock")]), 4)
    assert ("a", 201, "False") in fired(4) and all(start > 40 for _, start, _ in fired(4))


def test_many_batches_keep_states(spark, tmp_path, monkeypatch):
    import tracewarden.streaming.run as run

    monkeypatch.setattr(run, "COMPACT", 2)
    monitor = duration_safety(matches=F.col("name") == "rude", limit_nanos=4 * SEC, key_attribute="key", gap_ms=5_000)
    work = MonitorStream(spark, monitor, str(tmp_path / "s"), str(tmp_path / "o"), 0)
    for i in range(6):
        at = i * 100
        rows = [span("t", f"{i}", "", "rude", at * SEC, (at + 1) * SEC, {"key": "a"}),
                span("t", f"c{i}", "", "step", (at + 50) * SEC, (at + 50) * SEC, {"key": "clock"})]
        work.process(spans(spark, rows), i)
    got = spark.read.parquet(str(tmp_path / "o")).filter("key = 'a'").orderBy("startDate").collect()
    assert [r.truthValue for r in got] == ["True"] * 3 + ["False"] * 3


def test_stream_counters_and_rates(spark, hot_spans, tmp_path):
    rows = hot_spans[0]
    far = [span("far", f"f{i}", "", "step", FAR * (i + 1), FAR * (i + 1), {"key": "end"}) for i in range(2)]
    folder = write_in_order(spark, rows + far, tmp_path / "in", 3)
    keyed = key_by_attribute(with_event_time(stream_of(spark, folder), "500 milliseconds"), "key")
    outputs = {
        "counted": stream_session_counters(keyed, "8 seconds"),
        "rated": stream_rates(with_event_time(stream_of(spark, folder))),
    }
    for name, df in outputs.items():
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    batch = spans(spark, rows)
    want = session_counters(sessionize(key_by_attribute(batch, "key"), 8_000))
    # A session of the stream ends when it was last extended, as in batch.
    columns = ["key", "session_start", "session_end", "n_spans"]
    got = spark.table("counted").filter("key <> 'end'").select(*columns)
    assert sorted(got.collect()) == sorted(want.select(*columns).collect())
    rates = metrics.per_minute(batch.withColumn("ms", F.expr("start_time_unix_nano div 1000000")), F.col("ms"))
    got = spark.table("rated").filter(F.col("start_ms") < FAR // 1_000_000 - 60_000).collect()
    assert sorted(got) == sorted(rates.select(F.col("minute_ms").alias("start_ms"), "n", "per_second").collect())


def test_observed_counts(spark, hot_spans):
    from pyspark.sql import Observation

    seen = Observation("seen")
    hot_spans[1].observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == len(hot_spans[0])
    assert metrics.observed(hot_spans[1], "x").count() == len(hot_spans[0])


def test_deduped_stream_with_repeated_and_late_spans(spark, tmp_path):
    """Copies in one batch, over batches and behind the newest span; one id in two traces."""
    step = lambda i, trace="t": span(trace, f"s{i}", "", "step", (1000 + i) * SEC, (1001 + i) * SEC)
    batches = [
        [step(i) for i in range(20)] + [step(3)] * 50 + [step(4, "u")],
        [step(i) for i in range(15, 40)] + [step(19), step(4, "u")],
        [step(25), step(38)] * 30 + [step(i) for i in range(36, 60)],
    ]
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spans(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
    timed = with_event_time(stream_of(spark, folder), "60 seconds")
    query = (
        stream_dedupe(timed).select("trace_id", "span_id").writeStream.format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = spark.read.schema(SPANS).parquet(str(folder)).select("trace_id", "span_id").distinct()
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 61
