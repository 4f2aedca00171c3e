"""Monitors over a stream of spans.

Each micro-batch is joined with the spans of sessions that are still open and
then goes through the same operators as a batch job, so that a key with a
large share of the stream is spread over the cluster just as in batch.  What
is kept between micro-batches are tables in the state folder:

``incoming``  this batch's spans, reduced to the monitor's features
``open``      spans of sessions that may still change
``states``    state of a key at the end of its last finished session
``progress``  batch number and watermark

Tables are written under the batch number (in a ring of folders, so that the
version before stays intact) and verdicts under ``batch_id``: a batch that is
repeated after a failure replaces exactly what it had written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewarden.functions.spans import nanos_to_ms
from tracewarden.operators.monitor import (
    Monitor,
    evaluate_narrow,
    narrowed,
    verdicts,
)
from tracewarden.operators.sessions import session_slices
from tracewarden.sinks.verdicts import verdict_documents, write_verdict_batch

RING = 3  # versions of the open spans that are kept
COMPACT = 16  # batches between two full copies of the state table
NEVER = -(2**62)  # a watermark before all times


@dataclass
class MonitorStream:
    """One monitor's work on a stream; ``process`` is the foreachBatch function."""

    spark: SparkSession
    monitor: Monitor
    state_path: str
    out_path: str
    max_out_of_orderness_ms: int = 500

    def _ring(self, table: str, batch_id: int) -> str:
        return f"{self.state_path}/{table}/slot={batch_id % RING}"

    def _progress(self, batch_id: int) -> int | None:
        """Watermark (ms) after a batch."""
        if batch_id < 0:
            return None
        row = self.spark.read.schema("batch bigint, watermark bigint").parquet(
            self._ring("progress", batch_id)
        ).first()
        if row is None or row["batch"] != batch_id:
            raise ValueError(f"state folder {self.state_path} does not hold batch {batch_id}")
        return row["watermark"]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        narrow = narrowed(batch, self.monitor)
        incoming = self._write(narrow, self._ring("incoming", batch_id))
        before = self._progress(batch_id - 1)
        newest = incoming.agg(F.max(nanos_to_ms(F.col("start_time_unix_nano")))).first()[0]
        reached = None if newest is None else newest - self.max_out_of_orderness_ms
        watermark = max((w for w in (before, reached) if w is not None), default=None)
        spans = incoming.withColumn("fresh", F.lit(True))
        if batch_id > 0:
            kept = self.spark.read.schema(spans.schema).parquet(self._ring("open", batch_id - 1))
            spans = spans.unionByName(kept)
        low = NEVER if before is None else before
        high = NEVER if watermark is None else watermark
        placed = self._placed(spans, low)
        self._fire(placed, incoming.columns, batch_id, low, high)
        open_spans = placed.filter(F.col("session_end") + self.monitor.lateness_ms > high)
        self._write(
            open_spans.select(*incoming.columns, F.lit(False).alias("fresh")),
            self._ring("open", batch_id),
        )
        progress = self.spark.range(1).select(
            F.lit(batch_id).cast("bigint").alias("batch"), F.lit(watermark).cast("bigint").alias("watermark")
        )
        self._write(progress, self._ring("progress", batch_id))

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _placed(self, spans: DataFrame, low: int) -> DataFrame:
        """Spans with their session; sessions that came too late are left out.

        ``changed`` tells whether new spans came into the session.
        """
        gap = self.monitor.gap_ms
        start = nanos_to_ms(F.col("start_time_unix_nano"))
        width = F.lit(gap).cast("bigint")
        in_slice = F.call_function("div", start - F.pmod(start, width), width)
        borders = session_slices(spans, gap)
        fresh = spans.withColumn("slice", in_slice).groupBy("key", "slice").agg(
            F.bool_or("fresh").alias("fresh_slice")
        )
        changed = (
            borders.join(fresh, ["key", "slice"])
            .groupBy("key", "session_start")
            .agg(F.bool_or("fresh_slice").alias("changed"))
        )
        marked = borders.join(changed, ["key", "session_start"]).filter(
            F.col("session_end") + self.monitor.lateness_ms > low
        )
        return spans.withColumn("slice", in_slice).join(
            marked.select("key", "slice", "session_start", "session_end", "changed"), ["key", "slice"]
        )

    def _fire(self, placed: DataFrame, columns: list[str], batch_id: int, low: int, high: int) -> None:
        """Judge closed sessions from the last finished state of their key.

        A session fires when the watermark passes its end, and again when a
        late span reaches it; sessions of the key behind it fire with it.  A
        key whose sessions become final is folded too, for the state to keep.
        """
        closed = placed.filter(F.col("session_end") <= high)
        fires = F.col("changed") | (F.col("session_end") > low)
        finishes = F.col("session_end") + self.monitor.lateness_ms <= high
        due = (
            closed.filter(fires | finishes)
            .groupBy("key")
            .agg(F.min(F.when(fires, F.col("session_start"))).alias("due_from"))
        )
        done = closed.join(due.select("key"), "key", "left_semi").select(*columns)
        states = self._states(batch_id - 1)
        starts = None
        if states is not None:
            starts = self._unexpired(states, done)
        evaluated = self._write(
            evaluate_narrow(done, self.monitor, starts), f"{self._ring('evaluated', batch_id)}"
        )
        fired = evaluated.join(due, "key").filter(F.col("session_start") >= F.col("due_from"))
        documents = verdict_documents(verdicts(fired, self.monitor))
        write_verdict_batch(documents, batch_id, self.out_path)
        self._store_states(evaluated, states, batch_id, high)

    def _unexpired(self, states: DataFrame, spans: DataFrame) -> DataFrame:
        """Stored states that the next session of the key may still use."""
        if self.monitor.ttl_ms is None:
            return states.select("key", "state")
        first = spans.groupBy("key").agg(
            F.min(nanos_to_ms(F.col("start_time_unix_nano"))).alias("next_start")
        )
        return (
            states.join(first, "key")
            .filter(F.col("next_start") - F.col("last_end") <= self.monitor.ttl_ms)
            .select("key", "state")
        )

    def _state_schema(self, state_type: str) -> str:
        return f"key string, state {state_type}, last_end bigint, batch bigint"

    def _states(self, batch_id: int) -> DataFrame | None:
        """Newest state per key as of a batch: the last full copy and what followed."""
        if batch_id < 0:
            return None
        full = batch_id - batch_id % COMPACT
        paths = [f"{self.state_path}/states/full={full // COMPACT % 2}"] + [
            self._log(b) for b in range(full + 1, batch_id + 1)
        ]
        return self._newest(self.spark.read.schema(self._schema).parquet(*paths))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("state", "last_end", "batch"), "batch").alias("s")
        return rows.groupBy("key").agg(newest).select("key", "s.*")

    def _log(self, batch_id: int) -> str:
        return f"{self.state_path}/states/log={batch_id % (2 * COMPACT)}"

    @property
    def _schema(self) -> str:
        one = self.spark.range(1).select(self.monitor.init.alias("state"))
        return self._state_schema(one.schema["state"].dataType.simpleString())

    def _store_states(self, evaluated: DataFrame, states: DataFrame | None, batch_id: int, high: int) -> None:
        """Record the state at the end of each key's last finished session."""
        finished = evaluated.filter(F.col("session_end") + self.monitor.lateness_ms <= high)
        last = F.max_by(F.struct("state", "session_end"), "session_start").alias("s")
        rows = finished.groupBy("key").agg(last).select(
            "key", F.col("s.state").alias("state"), F.col("s.session_end").alias("last_end"),
            F.lit(batch_id).cast("bigint").alias("batch"),
        )
        if batch_id % COMPACT:
            self._write(rows, self._log(batch_id))
            return
        if states is not None:
            rows = self._newest(states.unionByName(rows))
            if self.monitor.ttl_ms is not None:
                rows = rows.filter(F.col("last_end") + self.monitor.ttl_ms >= high)
        self._write(rows, f"{self.state_path}/states/full={batch_id // COMPACT % 2}")


def run_monitor_stream(
    spans: DataFrame,
    monitor: Monitor,
    out_path: str,
    state_path: str,
    max_out_of_orderness_ms: int = 500,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start judging a stream of spans; verdict documents appear in ``out_path``."""
    work = MonitorStream(
        spans.sparkSession, monitor, f"{state_path}/tables", out_path, max_out_of_orderness_ms
    )
    return (
        spans.writeStream.foreachBatch(work.process)
        .option("checkpointLocation", f"{state_path}/source")
        .queryName(monitor.name)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_dedupe(spans: DataFrame, by: tuple[str, ...] = ("trace_id", "span_id")) -> DataFrame:
    """The first row that comes of each span of a stream with a watermark.

    Copies are known as long as the watermark allows them to come: of rows whose
    event times lie no further apart than the allowed lateness one stays, whatever
    their order.  State is one row per span, dropped once the watermark passes it.
    Rows later than the watermark are left out, as in every stateful step.
    """
    return spans.dropDuplicatesWithinWatermark(list(by))


def stream_session_counters(keyed: DataFrame, gap: str) -> DataFrame:
    """Spans and roots per session of a keyed stream with a watermark on ``ts``.

    The session aggregate is incremental: it holds counts, not spans.
    """
    root = F.coalesce(F.col("parent_span_id"), F.lit("")) == ""
    return (
        keyed.groupBy("key", F.session_window("ts", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(root).alias("n_roots"))
        .select(
            "key",
            F.unix_millis("session.start").alias("session_start"),
            F.unix_millis("session.end").alias("session_end"),
            "n_spans",
            "n_roots",
        )
    )


def stream_rates(spans: DataFrame, width: str = "1 minute") -> DataFrame:
    """Spans per second of each window of a stream with a watermark on ``ts``."""
    seconds = (
        F.unix_millis("window.end") - F.unix_millis("window.start")
    ) / 1000
    return (
        spans.groupBy(F.window("ts", width).alias("window"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_millis("window.start").alias("start_ms"), "n", (F.col("n") / seconds).alias("per_second"))
    )
