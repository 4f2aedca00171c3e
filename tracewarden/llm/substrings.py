"""Removal of passages that repeat across documents, by seed and extend.

Seeds: every run of ``length`` words holds ``length - seed + 1`` runs of
``seed`` words; the one of smallest hash (the rightmost of equals) is the
run's anchor.  Equal passages choose equal anchors, so passages of two
documents can only be equal around anchors that both have.  A join on the
anchors finds those.

Extend: around each shared anchor, the runs of ``length`` words that chose it
reach up to ``length - seed`` words to both sides.  They are compared by
128-bit hashes of their words, and the smallest document of each is found by
partial aggregates, so that an anchor of very many documents costs a row per
occurrence and no pairs.  Runs of a document that overlap make up its maximal
repeats, whose words are removed.

Documents of exactly the same words are settled by one print each, before any
run is compared.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.llm.words import NON_SPACE, Words, covered, grams, pieces, plain_strings, sequence_print, split_words
from tracewarden.session import freeze


def _anchors(found: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``seed`` words; the begins of all runs of
    ``length`` words within one document, the anchor of each, its document."""
    reach = length - seed + 1
    runs = len(found.hashes) - length + 1
    none = np.empty(0, np.int64)
    if runs <= 0:
        return np.empty(0, np.uint64), none, none, none
    small = grams(found.hashes, seed)
    best, place = small[:runs].copy(), np.arange(runs)
    for k in range(1, reach):
        here = small[k : runs + k]
        lower = here <= best
        best[lower] = here[lower]
        place[lower] = np.flatnonzero(lower) + k
    owner = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    begins = np.flatnonzero(owner[:runs] == owner[length - 1 :])
    return small, begins, place[begins], owner[begins]


def _scanned(work, schema: pa.Schema):
    """``work`` gets pieces of each batch and gives the columns of a table."""

    def task(batches):
        for batch in batches:
            texts = plain_strings(batch, "text")
            for low, high in pieces(texts):
                part = batch.slice(low, high - low)
                found = split_words(texts[low:high], NON_SPACE, fold=False)
                yield pa.RecordBatch.from_arrays(work(part, found), schema=schema)

    return task


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and its text's hash, as an id may repeat."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")


def _prints(docs: DataFrame) -> DataFrame:
    def work(part, found):
        texts = [found.hashes[found.of(i)] for i in range(len(part))]
        print_1, print_2 = (pa.array([sequence_print(t, seed) for t in texts], pa.int64()) for seed in (0, 1))
        return [part.column(0), part.column(1), pa.array(np.diff(found.bounds).astype(np.int64)), print_1, print_2]

    names = ["doc_id", "h", "n", "p1", "p2"]
    return docs.mapInArrow(
        _scanned(work, pa.schema([(c, pa.int64()) for c in names])), ", ".join(f"{c} long" for c in names)
    )


def _occurrences(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """``(anchor, doc_id, h)``, once for each place of an anchor."""

    def work(part, found):
        small, _, place, owner = _anchors(found, length, seed)
        place, at = np.unique(place, return_index=True)
        owner = owner[at]
        return [_signed(small[place]), pa.array(_column(part, "doc_id")[owner]), pa.array(_column(part, "h")[owner])]

    names = ["anchor", "doc_id", "h"]
    return docs.mapInArrow(
        _scanned(work, pa.schema([(c, pa.int64()) for c in names])), ", ".join(f"{c} long" for c in names)
    )


def _runs_at(seeded: DataFrame, length: int, seed: int) -> DataFrame:
    """``(w1, w2, doc_id, h, start)`` of the runs that chose a shared anchor."""

    def work(part, found):
        small, begins, place, owner = _anchors(found, length, seed)
        lists = part.column(part.schema.get_field_index("anchors"))
        wanted = np.zeros(len(begins), bool)
        first = np.searchsorted(owner, np.arange(len(part) + 1))
        for i in range(len(part)):
            mine = slice(first[i], first[i + 1])
            shared = lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            wanted[mine] = np.isin(small[place[mine]], shared)
        begins, owner = begins[wanted], owner[wanted]
        prints = [_signed(grams(found.hashes, length, k)[begins]) for k in (0, 1)]
        return [
            *prints,
            pa.array(_column(part, "doc_id")[owner]),
            pa.array(_column(part, "h")[owner]),
            pa.array((begins - found.bounds[owner]).astype(np.int32)),
        ]

    schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "doc_id", "h")] + [("start", pa.int32())])
    return seeded.select("doc_id", "h", "text", "anchors").mapInArrow(
        _scanned(work, schema), "w1 long, w2 long, doc_id long, h long, start int"
    )


def _cut(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def task(batches):
        for batch in batches:
            texts = plain_strings(batch, "text")
            for low, high in pieces(texts):
                part = batch.slice(low, high - low).to_pydict()
                rows = []
                for key, text, starts, whole in zip(part["doc_id"], part["text"], part["starts"], part["whole"], strict=True):
                    words = (text or "").encode().split()
                    n, gone = len(words), 0
                    if whole:
                        words, gone = [], n
                    elif starts:
                        out = covered(np.array(starts), length, n)
                        words, gone = list(compress(words, ~out)), int(out.sum())
                    rows.append({"doc_id": key, "n_words": n, "n_removed": gone, "kept_text": b" ".join(words).decode()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return task


def remove_repeats(docs: DataFrame, length: int = 13, seed: int = 5) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` for each row of
    ``docs(doc_id, text)``.

    Words run to ASCII white space and are compared as they are.  A word goes
    where a run of ``length`` words that covers it also begins in a document
    of smaller ``doc_id``; kept words are joined by one space.  Runs are judged
    on the input.  A null text has no words (kept text empty); a row without
    ``doc_id`` is returned whole and is no document for others.  Rows of one
    ``doc_id`` never remove each other's words, and equal rows give equal
    rows.  Other columns are not read.  Runs jobs and writes tables to the
    shared folder while it is built.
    """
    tidy(docs.sparkSession)
    docs = _keyed(docs)
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    prints = freeze(_prints(known).filter(F.col("n") >= length))
    firsts = prints.groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    copies = freeze(prints.join(firsts, ["p1", "p2", "n"]).filter("doc_id > lo").select("doc_id", "h").distinct())

    shared = (
        _occurrences(known, length, seed).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .filter("lo < hi").select("anchor")
    )
    shared = freeze(shared)
    seeds = freeze(
        _occurrences(known, length, seed).join(shared, "anchor", "left_semi")
        .join(copies, ["doc_id", "h"], "left_anti")
        .groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("anchors"))
    )
    runs = freeze(_runs_at(known.join(seeds, ["doc_id", "h"]), length, seed))
    earliest = freeze(
        runs.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .filter("lo < hi").select("w1", "w2", "lo")
    )
    starts = (
        runs.join(earliest, ["w1", "w2"]).filter("doc_id > lo")
        .groupBy("doc_id", "h").agg(F.collect_set("start").alias("starts"))
    )
    gone = starts.withColumn("whole", F.lit(False)).unionByName(
        copies.select("doc_id", "h", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    )
    return docs.join(freeze(gone), ["doc_id", "h"], "left").select("doc_id", "text", "starts", "whole").mapInArrow(
        _cut(length), "doc_id long, n_words long, n_removed long, kept_text string"
    )
