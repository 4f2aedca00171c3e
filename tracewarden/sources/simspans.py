"""Simulation files: one planned span per JSON line."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.schema import SIM_SPANS


def sim_columns(rows: DataFrame, *others: str) -> DataFrame:
    """Flat columns with the defaults of the file format filled in."""
    return rows.select(
        F.col("spanId.traceId").alias("trace_id"),
        F.col("spanId.spanId").alias("span_id"),
        F.col("parentId").alias("parent_id"),
        F.col("spanName").alias("span_name"),
        F.coalesce("spanKind", F.lit("INTERNAL")).alias("span_kind"),
        F.col("startTimeOffsetMs").alias("start_offset_ms"),
        F.col("durationMs").alias("duration_ms"),
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        *others,
    )


def _bare(path: str) -> str:
    return re.sub(r"^[a-z0-9+.-]+:(//[^/]*)?", "", path).rstrip("/")


def read_sim_spans(spark: SparkSession, paths: list[str], add_index: bool = True) -> DataFrame:
    """Spans of several files; a malformed or incomplete line fails the load.

    With ``add_index`` the position of the file (or of its folder) in
    ``paths`` is appended to its trace ids, so that files with equal ids stay
    apart.  All files are one scan; the positions join in from the list.
    """
    rows = spark.read.schema(SIM_SPANS).option("mode", "FAILFAST").json(paths)
    file_path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "[+]", "%2B"))
    spans = sim_columns(rows.withColumn("file", F.regexp_replace(file_path, "^[a-z0-9+.-]+:(//[^/]*)?", "")), "file")
    required = ["trace_id", "span_id", "span_name", "start_offset_ms", "duration_ms"]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    spans = spans.withColumn(
        "trace_id",
        F.when(missing, F.raise_error(F.concat(F.lit("incomplete span in "), "file"))).otherwise(
            F.col("trace_id")
        ),
    )
    if not add_index:
        return spans.drop("file")
    places = spark.createDataFrame(
        [(_bare(path), f"-{i}") for i, path in enumerate(paths)], "file string, place string"
    )
    folders = places.select(F.col("file").alias("folder"), F.col("place").alias("folder_place"))
    inside = spans.withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    # One row per path the caller listed, so the size is that of the list.
    placed = inside.join(F.broadcast(places), "file", "left").join(
        F.broadcast(folders), "folder", "left"
    )
    place = F.coalesce(
        "place", "folder_place", F.raise_error(F.concat(F.lit("no listed file "), "file"))
    )
    return placed.withColumn("trace_id", F.concat("trace_id", place)).drop(
        "file", "place", "folder", "folder_place"
    )


def sim_lines(sim_spans: DataFrame) -> DataFrame:
    """Each span as the JSON object of a simulation file, in column ``value``."""
    return sim_spans.select(
        F.to_json(
            F.struct(
                F.struct(
                    F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId")
                ).alias("spanId"),
                F.col("parent_id").alias("parentId"),
                F.col("span_name").alias("spanName"),
                F.col("span_kind").alias("spanKind"),
                F.col("start_offset_ms").alias("startTimeOffsetMs"),
                F.col("duration_ms").alias("durationMs"),
                F.col("attributes"),
            )
        ).alias("value")
    )
