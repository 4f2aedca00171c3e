"""A corpus from raw documents to a training mix, in five stages.

Each stage gets what its predecessor kept, as a table, and returns a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm.decontaminate import decontaminated
from tracewarden.llm.langid import UNKNOWN, held_out, identify, train
from tracewarden.llm.mixing import mix
from tracewarden.llm.neardup import near_duplicates
from tracewarden.llm.secrets import redacted
from tracewarden.llm.steps import tidy
from tracewarden.session import freeze, shared_dir

#: A text whose best language is less likely than this has none.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a recognised language, whatever their label.

    Rejected are texts that are null or without letters, and those whose best
    language is not even half certain.
    """
    tidy(spark)
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    # The model's own columns; documents' columns of these names would clash.
    named = {"text": "text", **{c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}}
    found = identify(docs.select(*[F.col(c).alias(n) for c, n in named.items()]), model)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(named[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest ``doc_id`` of each group of near duplicates.

    Rows of one ``doc_id`` are one document: the one whose text sorts first
    stays.  Rows without a ``doc_id`` are in no group and all stay.
    """
    key, place = ("_".join([name, *docs.columns]) for name in ("key", "place"))  # no column's names
    found = near_duplicates(docs).filter("doc_id is not null").groupBy(F.col("doc_id").alias(key))
    # An id's rows are in one group, so they are kept or not together.
    found = freeze(found.agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("not kept or rows > 1").select(key, "kept"))
    same = docs["doc_id"] == F.col(key)
    once = docs.join(found.select(key), same, "left_anti")
    several = docs.join(freeze(found.filter("kept").select(key)), same, "left_semi")  # mostly few
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*docs.columns)))
    first = several.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return once.unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the benchmark does not contaminate."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with secrets replaced by a mark."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their texts and all their columns, and how
    many words of each it takes (``taken``; whole repeats of its ``size``)."""
    mixed = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True)
    return mixed.filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: Segmentations are summed by a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
