"""Line-oriented outputs: span terms and simulation files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tracewarden.functions.terms import render_terms
from tracewarden.sources.simspans import sim_lines


def write_span_terms(spans: DataFrame, path: str, lines_per_file: int = 1_000_000) -> None:
    """One line per span, in files of bounded length."""
    render_terms(spans).write.mode("append").option("maxRecordsPerFile", lines_per_file).text(path)


def stream_span_terms(
    spans: DataFrame,
    path: str,
    checkpoint: str,
    trigger: str = "1 minute",
    lines_per_file: int = 1_000_000,
) -> StreamingQuery:
    """The same for a stream; files roll with every trigger and when full."""
    return (
        render_terms(spans)
        .writeStream.format("text")
        .option("maxRecordsPerFile", lines_per_file)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=trigger)
        .start()
    )


def write_sim_spans(
    sim_spans: DataFrame, path: str, codec: str | None = None, lines_per_file: int = 1_000_000
) -> None:
    """One line per span, in files of bounded length; ``codec`` packs them.

    Names repeat in every line, so ``gzip`` takes about a tenth of the disk.  A
    packed file is read by one task, which its length bounds.
    """
    lines = sim_lines(sim_spans).write.mode("overwrite").option("maxRecordsPerFile", lines_per_file)
    lines.text(path, compression=codec)
