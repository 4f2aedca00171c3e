"""Benchmark decontamination: word n-grams of test items found in documents.

The n-grams of the items are hashed into a set that every task gets, after a
check of its bytes.  Tasks slide over the words of whole documents, look the
windows' hashes up, and compare the words of each hit.  Nothing is shuffled.
A larger set stays a table: every task gets a bit filter of fixed size, the
windows that pass it are joined with the table, and the words of each hit are
compared where they stand.  Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.steps import tidy
from tracewarden.llm.words import ALNUM, covered, grams, pieces, plain_strings, split_words
from tracewarden.session import freeze

#: Most bytes of n-grams that are sent to every task, and what one takes there
#: beside its words and its item.
MAX_BYTES = 128 << 20
GRAM_BYTES = 600
#: Bits of the filter that every task gets where the n-grams are more than that.
FILTER_BITS = 1 << 27
FOUND = "n_words long, n_hit long, items array<string>, contaminated boolean"


def item_grams(benchmark: DataFrame, width: int = 13) -> DataFrame:
    """``(n, g1, g2, words, item_id)``: an item's windows of ``width`` words, or
    its only window of fewer.  Items without id or words have none."""
    schema = pa.schema(
        [("n", pa.int32()), ("g1", pa.int64()), ("g2", pa.int64()), ("words", pa.string()), ("item_id", pa.string())]
    )

    def task(batches):
        for batch in batches:
            texts, ids = plain_strings(batch, "text"), batch.column(0).to_pylist()
            found = split_words(texts, ALNUM, fold=True)
            rows = []
            for i, item in enumerate(ids):
                mine = found.of(i)
                hashes, starts, ends = found.hashes[mine], found.starts[mine], found.ends[mine]
                n = min(width, len(hashes))
                if n == 0:
                    continue
                one, two = grams(hashes, n).view(np.int64), grams(hashes, n, 1).view(np.int64)
                words = [found.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                for k in range(len(one)):
                    rows.append({"n": n, "g1": int(one[k]), "g2": int(two[k]), "words": b" ".join(words[k : k + n]).decode(), "item_id": item})
            yield pa.RecordBatch.from_pylist(rows, schema)

    named = benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null and text is not null")
    return named.mapInArrow(task, "n int, g1 long, g2 long, words string, item_id string").distinct()


class _Grams:
    """The n-grams by length: sorted hashes, and the words and items of each."""

    def __init__(self, rows):
        self.by_length: dict[int, tuple[np.ndarray, dict]] = {}
        held: dict[int, dict] = {}
        for n, g, words, item in rows:
            held.setdefault(n, {}).setdefault(g, {}).setdefault(words.encode(), []).append(item)
        for n, table in held.items():
            self.by_length[n] = (np.array(sorted(table), np.int64).view(np.uint64), table)
            self.by_length[n][0].sort()

    def hits(self, found, owner):
        """``(document, first word, words, items)`` of each occurrence."""
        for n, (known, table) in self.by_length.items():
            here = grams(found.hashes, n)
            if not len(here):
                continue
            at = np.minimum(np.searchsorted(known, here), len(known) - 1)
            for k in np.flatnonzero((known[at] == here) & (owner[: len(here)] == owner[n - 1 :])).tolist():
                words = b" ".join(found.data[a:b].tobytes() for a, b in zip(found.starts[k : k + n], found.ends[k : k + n], strict=True))
                items = table[int(here[k].view(np.int64))].get(words)
                if items:
                    yield int(owner[k]), k - int(found.bounds[owner[k]]), n, items


def _judged(n: int, spans: list, items, share: int) -> tuple[dict, np.ndarray]:
    out = np.zeros(n, bool)
    if spans:
        starts, lengths = np.array(spans).T
        out = covered(starts, lengths, n)
    hit = int(out.sum())
    return {"n_words": n, "n_hit": hit, "items": sorted(items, key=str.encode), "contaminated": hit > 0 and share * hit >= n}, out


def _without(text: str, starts, ends, out) -> str:
    """The text without the hit words; what lies between two of them goes too."""
    data, pieces_kept, last = text.encode(), [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        pieces_kept.append(data[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*pieces_kept, data[last:]]).decode()


def _carried(found, owner, near):
    """``_Grams.hits`` where each row brings the n-grams that may be its own."""
    for i, met in enumerate(near.to_pylist()):
        held = {}
        for one in met or ():
            held.setdefault((one["start"], one["n"], one["words"]), []).append(one["item_id"])
        for (start, n, words), items in held.items():
            k = int(found.bounds[i]) + start
            if words.encode() == b" ".join(found.data[a:b].tobytes() for a, b in zip(found.starts[k : k + n], found.ends[k : k + n], strict=True)):
                yield i, start, n, items


def _scan(hits, share: int, finish, schema):
    """``hits(found, owner, near)`` tells the occurrences in a piece of rows;
    ``finish(part, rows, cut)`` makes a batch of it, ``cut(i)`` is a text
    without its hit words.  Batches are of ``(row, near)``."""

    def task(batches):
        for batch in batches:
            whole = batch.column(0)
            batch, near = pa.RecordBatch.from_arrays(whole.flatten(), names=[f.name for f in whole.type]), batch.column(1)
            texts = plain_strings(batch, "text")
            for low, high in pieces(texts):
                part, here = batch.slice(low, high - low), texts[low:high]
                found = split_words(here, ALNUM, fold=True)
                sizes = np.diff(found.bounds)
                owner = np.repeat(np.arange(len(here)), sizes)
                spans, items = {}, {}
                for i, start, n, which in hits(found, owner, near[low:high]):
                    spans.setdefault(i, []).append((start, n))
                    items.setdefault(i, set()).update(which)
                judged = [_judged(int(n), spans.get(i, []), items.get(i, ()), share) for i, n in enumerate(sizes)]
                begin = np.concatenate(([0], np.cumsum([len((t or "").encode()) for t in here.to_pylist()])))

                def cut(i, here=here, found=found, begin=begin, judged=judged):
                    mine = found.of(i)
                    return _without(here[i].as_py(), found.starts[mine] - begin[i], found.ends[mine] - begin[i], judged[i][1])

                yield finish(part, [row for row, _ in judged], cut).cast(schema)

    return task


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _matched(docs: DataFrame, benchmark: DataFrame, width: int, max_bytes: int):
    """``(row, near)`` of each document and the ``hits`` that ``_scan`` takes."""
    spark = tidy(docs.sparkSession)
    found = freeze(item_grams(benchmark, width))
    held = F.octet_length("words") + F.octet_length("item_id") + GRAM_BYTES
    rows = docs.select(F.struct("*").alias("row"))
    if (found.agg(F.sum(held.cast("long"))).first()[0] or 0) > max_bytes:
        return _near(rows, found), _carried
    table = spark.sparkContext.broadcast(_Grams(found.select("n", "g1", "words", "item_id").collect()))
    return rows.withColumn("near", F.lit(None).cast("int")), lambda words, owner, near: table.value.hits(words, owner)


def _filter(found: DataFrame) -> np.ndarray:
    """Two bits for each n-gram, as bytes: at most ``FILTER_BITS`` in all."""
    slots = found.select(F.explode(F.array(*[F.pmod(g, F.lit(FILTER_BITS)) for g in ("g1", "g2")])).alias("slot"))
    bits = slots.groupBy(F.expr("slot div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("bits"))
    got = bits.toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[np.asarray(got["byte"])] = np.asarray(got["bits"])
    return out


def _near(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each row with the n-grams whose hashes its windows have, by a join."""
    keyed = rows.withColumn("h", F.xxhash64("row.text"))
    lengths = [r[0] for r in found.select("n").distinct().collect()]
    table = rows.sparkSession.sparkContext.broadcast(_filter(found))
    docs = keyed.select("row.doc_id", "h", "row.text")
    schema = pa.schema([("doc_id", _arrow(docs.schema).field("doc_id").type), ("h", pa.int64()), ("n", pa.int32()), ("g1", pa.int64()), ("g2", pa.int64()), ("start", pa.int64())])

    def passed(bits, grams_):
        slot = grams_ % np.uint64(FILTER_BITS)
        return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def windows(batches):
        for batch in batches:
            texts = plain_strings(batch, "text")
            for low, high in pieces(texts):
                part, words = batch.slice(low, high - low), split_words(texts[low:high], ALNUM, fold=True)
                owner = np.repeat(np.arange(high - low), np.diff(words.bounds))
                for n in lengths:
                    one, two = grams(words.hashes, n), grams(words.hashes, n, 1)
                    if not len(one):
                        continue
                    at = np.flatnonzero((owner[: len(one)] == owner[n - 1 :]) & passed(table.value, one) & passed(table.value, two))
                    who = pa.array(owner[at])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(who), part.column(1).take(who), pa.array(np.full(len(at), n, np.int32)), pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(at - words.bounds[owner[at]])],
                        schema=schema,
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.mapInArrow(windows, f"doc_id {kind}, h long, n int, g1 long, g2 long, start long")
    hits = cut.join(found, ["n", "g1", "g2"]).groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("start", "n", "words", "item_id")).alias("near")
    )
    same = F.col("k.row.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("k.h") == F.col("m.h"))
    return keyed.alias("k").join(hits.alias("m"), same, "left").select("k.row", "m.near")


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, contaminated)`` for each row of
    ``docs(doc_id, text)`` against ``benchmark(item_id, text)``.

    Words are ASCII letters (A-Z in lower case) and digits and all that is not
    ASCII.  A word is hit inside any occurrence of an item's window; a document
    is contaminated where at least one of ``share`` words is hit.  Null and
    empty texts have no words; items without id or words are not looked for;
    equal items are all named.  Other columns are not read.  The rows are the
    same whether the n-grams of the items take more than ``max_bytes`` or not.
    """
    matched, hits = _matched(docs.select("doc_id", "text"), benchmark, width, max_bytes)
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(FOUND).fields])
    arrow = _arrow(schema)

    def finish(part, rows, cut):
        new = pa.RecordBatch.from_pylist(rows, pa.schema(list(arrow)[1:]))
        return pa.RecordBatch.from_arrays([part.column(0), *new.columns], names=arrow.names)

    return matched.mapInArrow(_scan(hits, share, finish, arrow), schema)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, remove: str = "documents",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``docs`` with all its columns, without contaminated documents, or with
    the hit words cut out of all texts (``remove="spans"``).  Both as in
    ``contamination``, with n-grams of any size."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    matched, hits = _matched(docs, benchmark, width, max_bytes)
    arrow = _arrow(docs.schema)
    place = docs.columns.index("text")

    def finish(part, rows, cut):
        if remove == "documents":
            return part.filter(pa.array([not r["contaminated"] for r in rows], pa.bool_()))
        texts = [cut(i) if r["n_hit"] else part.column(place)[i].as_py() for i, r in enumerate(rows)]
        columns = list(part.columns)
        columns[place] = pa.array(texts, arrow.field(place).type)
        return pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return matched.mapInArrow(_scan(hits, share, finish, arrow), docs.schema)
