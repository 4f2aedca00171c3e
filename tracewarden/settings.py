"""Monitor and job settings given as plain dicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewarden.operators.monitor import Monitor, run_monitor
from tracewarden.operators.sessions import older_than
from tracewarden.sinks.text import stream_span_terms, write_span_terms
from tracewarden.sinks.verdicts import verdict_documents, write_verdicts
from tracewarden.sources.otlp import flatten_spans, read_otlp
from tracewarden.streaming.run import run_monitor_stream


def _need(settings: dict, *names: str) -> list:
    missing = [n for n in names if n not in settings]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return [settings[n] for n in names]


def configured(monitor: Monitor, settings: dict, ignores: dict[str, Callable] | None = None) -> Monitor:
    """The monitor with the name, key, window and state settings applied.

    ``key-by`` is by trace id unless it names a string attribute.  ``ignores``
    are the key predicates a setting may refer to by name.
    """
    name, config = _need(settings, "name", "config")
    (gap,) = _need(config, "session-gap-seconds")
    key_by = settings.get("key-by", {"type": "by-trace-id"})
    if key_by["type"] == "by-trace-id":
        attribute = None
    elif key_by["type"] == "by-string-span-attribute":
        (attribute,) = _need(key_by, "key")
    else:
        raise ValueError(f"unknown key-by type: {key_by['type']}")
    state = settings.get("state-config")
    ttl_ms = ignore = None
    if state is not None:
        (ttl,) = _need(state, "ttl-seconds")
        ttl_ms = ttl * 1000
        if state.get("should-ignore-window"):
            ignore = (ignores or {})[state["should-ignore-window"]]
    return replace(
        monitor,
        name=name,
        key_attribute=attribute,
        gap_ms=gap * 1000,
        lateness_ms=config.get("allowed-lateness-seconds", 0) * 1000,
        ttl_ms=ttl_ms,
        ignore_key=ignore,
    )


def ignore_older_than_a_day(as_of: int) -> Callable[[Column], Column]:
    """Key predicate: the epoch second in the key is over a day before ``as_of``."""
    return lambda key: older_than(key, F.lit(as_of))


@dataclass(frozen=True)
class Job:
    """Where spans come from and verdicts go to."""

    name: str
    input_path: str
    output_path: str
    max_out_of_orderness_ms: int = 500
    terms_path: str | None = None
    state_path: str | None = None

    @staticmethod
    def of(settings: dict) -> "Job":
        name, source, sink = _need(settings, "job-name", "source", "sink")
        (input_path,) = _need(source, "path")
        (output_path,) = _need(sink, "path")
        return Job(
            name=name,
            input_path=input_path,
            output_path=output_path,
            max_out_of_orderness_ms=source.get("events-max-out-of-orderness-ms", 500),
            terms_path=sink.get("terms-path"),
            state_path=settings.get("state-path"),
        )

    def run(self, spark: SparkSession, monitor: Monitor) -> DataFrame:
        """Judge everything in the input once and append the documents."""
        spans = flatten_spans(read_otlp(spark, self.input_path))
        if self.terms_path:
            write_span_terms(spans, self.terms_path)
        return run_monitor(
            spans, monitor, lambda found: write_verdicts(verdict_documents(found), self.output_path)
        )

    def stream(self, spark: SparkSession, monitor: Monitor, trigger: dict | None = None) -> StreamingQuery:
        """Judge the input as it grows."""
        if self.state_path is None:
            raise ValueError("missing settings: state-path")
        spans = flatten_spans(read_otlp(spark, self.input_path, streaming=True))
        if self.terms_path:
            stream_span_terms(spans, self.terms_path, f"{self.state_path}/terms")
        return run_monitor_stream(
            spans, monitor, self.output_path, self.state_path, self.max_out_of_orderness_ms, trigger
        )
