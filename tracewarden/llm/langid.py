"""Language of texts by unigrams over a fixed public vocabulary.

A word, ``_`` and its lower-case letters, can be cut into vocabulary pieces in
many ways.  A language gives each piece a probability; that of a word is the
sum over all its cuts, found by a forward pass over its letters.  Pieces are
matched by an automaton, so a pass only visits pieces that occur.

Training is expectation maximisation on distinct words with their counts, in
Spark tasks: each round adds up the expected uses of pieces by forward and
backward sums.  The words come from a bounded sample of labelled documents
(``SAMPLE`` documents expected per language); the vocabulary is a file of a
public tokenizer, which is read on the driver and sent with the model, whose
size depends on the vocabulary and the number of languages only.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.llm.words import plain_strings
from tracewarden.session import freeze

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents for training, expected for each language.
SAMPLE = 1500
ROUNDS = 2
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
#: Longer runs of letters are scored in parts of this length.
_LONGEST = 48
#: Words that a task keeps the scores of.
_CACHE = 100_000
_PART_CHARS = 1 << 20


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if _LETTERS.fullmatch(piece.removeprefix(_START)):
            found.add(piece)
    return sorted(found)


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, long ones in parts."""
    found = _LETTERS.findall(text.lower())
    if max(map(len, found), default=0) > _LONGEST:
        found = [w[i : i + _LONGEST] for w in found for i in range(0, len(w), _LONGEST)]
    return found


class Lattice:
    """All pieces in all cuts of some words."""

    def __init__(self, matcher, words: list[str], unknown: int):
        text = "".join(_START + w for w in words)
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        begins = np.concatenate(([0], np.cumsum(self.sizes)))
        self.begins = begins
        codes = np.fromiter((end << 24 | value for end, value in matcher.iter(text)), np.int64)
        # ``value`` holds a piece's number and length; single letters always match.
        ends, value = (codes >> 24) + 1, codes & 0xFFFFFF
        piece, starts = value >> 6, ends - (value & 63)
        every = np.arange(begins[-1])
        ends = np.concatenate((ends, every + 1))
        starts = np.concatenate((starts, every))
        piece = np.concatenate((piece, np.full(len(every), unknown)))
        word = np.searchsorted(begins, ends - 1, side="right") - 1
        inside = starts >= begins[word]
        ends, starts, piece, word = ends[inside], starts[inside], piece[inside], word[inside]
        at = ends - begins[word]
        order = np.lexsort((word, at))
        self.word, self.stop, self.piece = word[order], at[order], piece[order]
        self.start = self.stop - (ends - starts)[order]
        self.steps = np.searchsorted(self.stop, np.arange(1, self.sizes.max(initial=0) + 2))

    def forward(self, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all cuts up to each letter, scaled, and the logarithm of
        each word's probability under each language."""
        n, langs = len(self.sizes), rates.shape[1]
        sums = np.zeros((n, int(self.sizes.max(initial=0)) + 1, langs))
        sums[:, 0] = 1
        for k in range(len(self.steps) - 1):
            part = slice(self.steps[k], self.steps[k + 1])
            word = self.word[part]
            if not len(word):
                continue
            terms = sums[word, self.start[part]] * rates[self.piece[part]]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sums[word[first], k + 1] = np.add.reduceat(terms, first)
        whole = sums[np.arange(n), self.sizes]
        return sums, np.log(whole)

    def uses(self, rates: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` of each word."""
        sums, logs = self.forward(rates)
        back = np.zeros_like(sums)
        back[np.arange(len(self.sizes)), self.sizes] = 1
        for k in range(len(self.steps) - 2, -1, -1):
            part = slice(self.steps[k], self.steps[k + 1])
            terms = back[self.word[part], self.stop[part]] * rates[self.piece[part]]
            np.add.at(back, (self.word[part], self.start[part]), terms)
        out = np.zeros_like(rates)
        share = sums[self.word, self.start] * rates[self.piece] * back[self.word, self.stop]
        np.add.at(out, self.piece, share * (counts / np.exp(logs))[self.word])
        return out


def _matcher(pieces: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, piece in enumerate(pieces):
        out.add_word(piece, i << 6 | len(piece))
    out.make_automaton()
    return out


class Model:
    """Rates of pieces (rows; the last for unknown letters) by language."""

    def __init__(self, pieces: list[str], langs: list[str], rates: np.ndarray):
        self.pieces, self.langs, self.rates = pieces, langs, rates
        self._match, self._known = None, {}

    def __reduce__(self):
        return Model, (self.pieces, self.langs, self.rates)

    def lattice(self, words: list[str]) -> Lattice:
        self._match = self._match or _matcher(self.pieces)
        return Lattice(self._match, words, len(self.pieces))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities of distinct words, languages in columns."""
        known = self._known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > _CACHE:
            known.clear()
            new = words
        for low in range(0, len(new), 4096):
            part = new[low : low + 4096]
            known.update(zip(part, self.lattice(part).forward(self.rates)[1], strict=True))
        return np.array([known[w] for w in words]).reshape(len(words), len(self.langs))

    def text_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each text's words, and the number of its words."""
        found = [words_of(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        if sizes.any():
            flat = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
            codes, words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
            scores = np.concatenate([self.word_scores(words[i : i + _CACHE]) for i in range(0, len(words), _CACHE)])
            some = np.flatnonzero(sizes)
            begins = np.concatenate(([0], np.cumsum(sizes)))[some]
            out[some] = np.add.reduceat(scores[codes], begins)
        return out, sizes


def _parts(texts: list[str]):
    low, held = 0, 0
    for k, t in enumerate(texts):
        if k > low and held + len(t) > _PART_CHARS:
            yield low, k
            low, held = k, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


def train(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn from ``docs(text, lang)``; rows without either teach nothing."""
    spark = docs.sparkSession
    rows = docs.select("text", "lang").filter("text is not null and lang is not null")
    pieces = vocabulary(path)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    # A document is in the sample by the hash of its text.
    odds = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))) for lang, n in sizes.items()])
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < odds * (1 << 20))
    place = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(i)) for i, lang in enumerate(langs)])

    def cut(batches):
        for batch in batches:
            texts, who = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in _parts(texts):
                found = [(w, i) for t, i in zip(texts[low:high], who[low:high], strict=True) for w in words_of(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in found], pa.string()), pa.array([i for _, i in found], pa.int32())], names=["word", "lang"]
                )

    words = chosen.select("text", place.alias("lang")).mapInArrow(cut, "word string, lang int")
    # One row per word: its counts by language.
    words = freeze(words.groupBy("word").agg(*[F.sum((F.col("lang") == i).cast("long")).alias(f"c{i}") for i in range(len(langs))]))
    rates = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Model(pieces, langs, rates))

        def expect(batches, sent=sent):
            model = sent.value
            total = np.zeros_like(model.rates)
            for batch in batches:
                names = batch.column(0).to_pylist()
                counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float)
                for low in range(0, len(names), 4096):
                    part = slice(low, low + 4096)
                    total += model.lattice(names[part]).uses(model.rates, counts[part])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "uses"]
            )

        uses = np.zeros_like(rates)
        expected = words.mapInArrow(expect, "piece int, lang int, uses double")
        for r in expected.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"], r["lang"]] = r["uses"]
        rates = (uses + 0.01) / (uses.sum(axis=0) + 0.01 * len(uses))
        rates[-1] = rates[-1].min()  # an unknown letter tells languages nothing
    return Model(pieces, langs, rates)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from ``text`` alone.

    ``score`` is the posterior of the predicted language, all being equally
    likely before; equal ones are decided by name.  A null text or one without
    a letter is ``und`` with score 0, and so is every text under a model of no
    language.  Columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def task(batches):
        for batch in batches:
            model, texts = sent.value, plain_strings(batch, "text").fill_null("").to_pylist()
            names, scores = [], []
            for low, high in _parts(texts):
                logs, sizes = model.text_scores(texts[low:high])
                for row, n in zip(logs, sizes, strict=True):
                    if n == 0 or not model.langs:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(row.argmax())
                        names.append(model.langs[best])
                        scores.append(float(1 / np.exp(row - row[best]).sum()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"]
            )

    schema = docs.select(kept).limit(0).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    for field in schema.fields[-2:]:
        field.nullable = True
    return docs.mapInArrow(task, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: a fifth by the id's CRC-32."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def identified_languages(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of
    ``docs(doc_id, text, lang)``; see :func:`identify`.  Rows without
    ``doc_id`` are held out.  Runs jobs while it is built."""
    tidy(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))), path, sample)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
