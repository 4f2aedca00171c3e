"""Ready-made monitors: total duration stays small; a mention gets a reaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.spans import (
    bot_message,
    is_image_generation_span,
    is_mention_span,
    is_root,
    span_duration_nanos,
)
from tracewarden.operators.monitor import Rule, StateMonitor, SumMonitor
from tracewarden.session import freeze

# Limits of the two properties (fixed values).
IMAGE_LIMIT_NANOS = 1_000_000_000
TURNS = 5
# Texts that a judge gets at once, and their bytes.
ASKED, ASKED_BYTES = 1000, 1 << 20
MENTION_WORD = "bombadil"


def duration_safety(
    name: str = "image generation safety",
    matches: Column | None = None,
    limit_nanos: int = IMAGE_LIMIT_NANOS,
    **settings,
) -> SumMonitor:
    """Total time of matching spans, counted at their ends, stays below the limit."""
    if matches is None:
        matches = is_image_generation_span(F.col("attributes"))
    length = span_duration_nanos(F.col("start_time_unix_nano"), F.col("end_time_unix_nano"))
    return SumMonitor.of(
        name,
        amount=F.when(F.col("is_end") & matches, length),
        verdict=lambda total: total < limit_nanos,
        rules={"start": ~F.col("is_end"), "end": F.col("is_end")},
        **settings,
    )


def mention_response(
    name: str = "mention gets a reaction",
    word: str = MENTION_WORD,
    turns: int = TURNS,
    judged: DataFrame | None = None,
    **settings,
) -> StateMonitor:
    """After a mention the bot reacts before ``turns`` root spans have ended.

    A state is (pending, turns left).  ``judged`` says which texts are
    impolite (columns ``text``, ``impolite``); without it the spans must
    bring a boolean column ``reaction``.
    """
    left = range(turns + 1)
    states = [(p, t) for p in (False, True) for t in left]
    ends, mention = F.col("is_end"), F.col("mention")
    reaction = F.coalesce(F.col("reaction"), F.lit(False))
    root = is_root(F.col("parent_span_id"))
    rules = [
        Rule("mention", ~ends & mention, {(False, t): (True, turns) for t in left}),
        Rule("reaction", ends & reaction, {(True, t): (False, t) for t in left if t > 0}),
        Rule("turn over", ends & ~reaction & root, {(True, t): (True, max(t - 1, 0)) for t in left}),
    ]
    verdicts = {
        (p, t): True if not p else (False if t == 0 else None) for p, t in states
    }

    def prepare(spans: DataFrame) -> DataFrame:
        marked = spans.withColumn(
            "mention", is_mention_span(F.col("parent_span_id"), F.col("events"), word)
        )
        if judged is None:
            return marked
        said = marked.withColumn("bot_text", bot_message(F.col("attributes"), F.col("events")))
        return classify_text(said.drop("attributes", "events"), "bot_text", judged).withColumnRenamed(
            "impolite", "reaction"
        )

    return StateMonitor.of(
        name, states, (False, turns), rules, verdicts, prepare=prepare, **settings
    )


def classify_text(df: DataFrame, column: str, judged: DataFrame, label: str = "impolite") -> DataFrame:
    """Add the judge's answer for each text; NULL where there is no answer.

    Texts are compared by their SHA-256 digest, so whole texts do not travel
    through the join.  Rows without a text get a key of their own each, as
    they would else all meet in one task.  ``judged`` holds one row per text,
    with the ``text`` or its ``digest``.
    """
    digest = F.col("digest") if "digest" in judged.columns else F.sha2("text", 256)
    marks = judged.select(digest.alias("_digest"), F.col(label))
    own = F.concat(F.lit("none "), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).cast("string"))
    keyed = df.withColumn("_digest", F.coalesce(F.sha2(column, 256), own))
    return keyed.join(marks, "_digest", "left").drop("_digest")


def _asked(judge: Callable[[pd.Series], pd.Series], kept: str, label: str):
    """Task that gives column ``kept`` and the answers to column ``text``.

    Texts reach the judge in bounded pieces, whatever the size of the batch;
    they are never held as Python strings all at once, nor written out anew.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, low = batch.column("text"), 0
            ends = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64").cumsum()
            while low < len(texts):
                limit = ASKED_BYTES + (ends[low - 1] if low else 0)
                high = min(low + ASKED, max(low + 1, int(ends.searchsorted(limit, "right"))))
                said = texts.slice(low, high - low).to_pandas().rename("text").to_frame()
                found = pa.Array.from_pandas(said.assign(answer=judge(said["text"]))["answer"], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(kept).slice(low, high - low), found], [kept, label])
                low = high

    return ask


def judge_texts(
    df: DataFrame, column: str, judge: Callable[[pd.Series], pd.Series], label: str = "impolite"
) -> DataFrame:
    """Ask a batch judge once per distinct text: columns ``text`` and the answer.

    Texts are told apart by their digest.
    """
    texts = df.select(F.col(column).alias("text")).dropna()
    texts = texts.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text")).select("text")

    return texts.mapInArrow(_asked(judge, "text", label), f"text string, {label} boolean")


ANSWERS = "digest string, answer boolean, judge string"


def known_answers(spark: SparkSession, path: str, name: str, label: str = "impolite") -> DataFrame:
    """``digest`` of each text that judge ``name`` has answered, and the answer.

    Runs side by side may both have asked a text; then one answer is taken, a
    ``false`` before a ``true``.
    """
    stored = spark.read.schema(ANSWERS).parquet(path).filter(F.col("judge") == name)
    return stored.groupBy("digest").agg(F.min("answer").alias(label))


def judge_new_texts(
    df: DataFrame,
    column: str,
    judge: Callable[[pd.Series], pd.Series],
    path: str,
    name: str,
    label: str = "impolite",
) -> DataFrame:
    """Ask a batch judge for the texts that table ``path`` has no answer to yet.

    Gives ``digest`` and ``label`` of all that judge ``name`` has answered by
    then, which ``classify_text`` takes as they are.  The answers are appended
    in one commit once all texts are asked, so a run that fails leaves none,
    and a repeated run asks nothing.  A text that the judge answers with null
    is not stored, and asked again by the next run.  Rows without a text are
    not asked.  Texts that are known travel as digests only.  Runs jobs.
    """
    spark = df.sparkSession
    spark.createDataFrame([], ANSWERS).write.mode("ignore").partitionBy("judge").parquet(path)
    said = df.select(F.col(column).alias("text")).dropna().withColumn("digest", F.sha2("text", 256))
    new = freeze(said.select("digest").distinct().join(known_answers(spark, path, name), "digest", "left_anti"))
    texts = said.join(new, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))

    answers = texts.mapInArrow(_asked(judge, "digest", "answer"), "digest string, answer boolean")
    answers = answers.dropna().withColumn("judge", F.lit(name))
    answers.write.mode("append").partitionBy("judge").parquet(path)
    return known_answers(spark, path, name, label)


def answer_is_yes(answer: Column) -> Column:
    """A judge's reply counts as yes when it contains ``yes``."""
    return F.contains(answer, F.lit("yes"))
