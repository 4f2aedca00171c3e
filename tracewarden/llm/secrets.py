"""Secrets in texts: named patterns, and stretches of high entropy.

Everything is a Column.  Candidate strings are scanned by a window that moves
one character at a time and keeps the count of each character in a few packed
longs.  Of the window's sum of ``c * log2(c)`` over these counts only two terms
change per move, that of the character that leaves and that of the one that
comes; the entropy is ``log2(w) - sum / w``.

All steps are linear in the text and in its matches: places come from running
sums taken in blocks, and pieces of a text from short blocks of it.
"""

from __future__ import annotations

import math
import operator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""((?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The characters of candidates, and so of what a window counts.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that look random but are no secrets: paths and links of words.
ALLOW = (r"^/?([A-Za-z]+[0-9]{0,4}[/_-]+)+[A-Za-z]*[0-9]{0,4}/?$",)
#: Parts that are no secrets wherever they stand: UUIDs, dates, runs of the digits
#: or the alphabet, placeholders.  Candidates are cut there; the rest is judged.
PARTS = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|0123456789|abcdefghij|example|placeholder|changeme|x{5,}"
)
#: The same patterns as Spark's engine runs them: it matches a repeated group by
#: recursion, as deep as the text has words, unless the group gives nothing back.
#: No part here can match what its successor needs, so nothing has to be given back.
ITERATIVE = {ALLOW[0]: r"^/?(?:[A-Za-z]++[0-9]{0,4}+[/_-]++)++[A-Za-z]*+[0-9]{0,4}+/?$"}


class Scan(NamedTuple):
    """Least entropy in bits of a window of ``window`` characters, for
    candidates that match ``like``; a candidate counts under the first."""

    like: str
    window: int
    bits: float


#: By character class: hexadecimal strings, letters of both cases with digits,
#: of one case with digits, and letters alone.  Digits alone are numbers.
SCANS = (
    Scan(r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 20, 3.0),
    Scan(r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 20, 3.7),
    Scan(r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=-]+$", 20, 3.7),
    Scan(r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9+/_=-]+$", 20, 3.7),
    Scan(r"^(?=.*[A-Za-z])[A-Za-z+/_=-]+$", 20, 4.0),
)
#: Terms of the sum are whole numbers of this fraction of a bit, so that it never drifts.
UNIT = 2**40
BLOCK = 64
PIECE = 1024


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, fold, levels: int = 3) -> Column:
    """What lies before each of an array of non-negative ints, folded by ``fold``
    (from 0): inside blocks of ``BLOCK``, and in turn over the blocks' totals."""

    def inside(block):
        empty = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            block,
            empty,
            lambda acc, v: F.struct(fold(acc["all"], v).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out")),
        )

    if levels == 1:
        return inside(values)["out"]

    def cut(array):
        count = F.ceil(F.size(array) / BLOCK).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda b: inside(F.slice(array, b * BLOCK + 1, BLOCK)))

    def joined(blocks):
        totals = _running(F.transform(blocks, lambda b: b["all"]), fold, levels - 1)
        return _let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda v: fold(F.get(t, i), v)))))

    return _let(values, lambda array: _let(cut(array), joined))


def _matches(text: Column, pattern: str) -> Column:
    """``array<(gap, found)>``: the leftmost matches that do not overlap, each
    after what lies before it; at last the rest of the text, null as found."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"))


def _places(text: Column, pattern: str) -> Column:
    """``array<(start, end, found)>`` of the leftmost matches that do not
    overlap, in code points.  What lies between them gives their places."""

    def placed(matches):
        lengths = F.transform(matches, lambda x: F.length(x["gap"]) + F.length(x["found"]))

        def one(x, starts, i):
            start = F.get(starts, i) + F.length(x["gap"])
            end = start + F.length(x["found"])
            return F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))

        return _let(_running(lengths, operator.add), lambda starts: F.transform(matches, lambda x, i: one(x, starts, i)))

    whole = _let(_matches(text, pattern), lambda m: placed(F.filter(m, lambda x: x["found"].isNotNull())))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), whole).otherwise(none)


def _blanked(text: Column, pattern: str, counts=None) -> Column:
    """The text with spaces in place of its matches, those that ``counts`` if given."""

    def one(x):
        blank = F.repeat(F.lit(" "), F.length(x["found"]))
        kept = blank if counts is None else F.when(counts(x["found"]), blank).otherwise(x["found"])
        return F.concat(x["gap"], F.coalesce(kept, F.lit("")))

    return F.when(text.rlike(pattern), F.array_join(F.transform(_matches(text, pattern), one), "")).otherwise(text)


def _named(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def _assigns(found: Column) -> Column:
    return F.length(F.regexp_extract(found, f"^{ASSIGN}$", 2)) >= 8


def _hot(found: Column, scan: Scan) -> Column:
    """``(first, last)``: ends of the first and last windows of high entropy."""
    w = scan.window
    bits = w.bit_length()
    each = 63 // bits
    terms = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("bigint") for c in range(w + 2)])
    most = round((w * (math.log2(w) - scan.bits) + 1e-9) * UNIT)
    # A character is the long that holds its count, and the count's lowest bit in it.
    slot = lambda code: F.floor(code / each).cast("int")
    unit = lambda code: F.get(F.array(*[F.lit(1 << (bits * k)).cast("bigint") for k in range(each)]), code % each)

    def step(acc, x):
        i, out, come = acc["i"] + 1, x["out"], x["come"]
        held = lambda c: F.call_function("div", F.get(acc["counts"], c["slot"]), c["unit"]).bitwiseAND(F.lit(2**bits - 1).cast("bigint")).cast("int")

        def counted(n):
            lost = F.coalesce(F.get(terms, n["out"]) - F.get(terms, n["out"] - 1), F.lit(0))
            total = acc["total"] - lost + F.get(terms, n["come"] + 1) - F.get(terms, n["come"])
            return F.when(out["code"].eqNullSafe(come["code"]), acc["total"]).otherwise(total)

        def moved(total):
            hot = (i >= w) & (total <= most)
            change = lambda c, k: F.when(c["slot"] == k, c["unit"]).otherwise(F.lit(0))
            return F.struct(
                i.alias("i"),
                F.transform(acc["counts"], lambda n, k: n + change(come, k) - change(out, k)).alias("counts"),
                total.alias("total"),
                F.when(hot & acc["first"].isNull(), i).otherwise(acc["first"]).alias("first"),
                F.when(hot, i).otherwise(acc["last"]).alias("last"),
            )

        both = F.struct(held(out).alias("out"), held(come).alias("come"))
        return _let(_let(both, counted), moved)

    begin = F.struct(
        F.lit(0).alias("i"),
        F.array(*[F.lit(0).cast("bigint")] * -(-len(ALPHABET) // each)).alias("counts"),
        F.lit(0).cast("bigint").alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    codes = F.transform(
        F.split(found, ""),
        lambda c: _let(F.instr(F.lit(ALPHABET), c) - 1, lambda n: F.struct(n.alias("code"), slot(n).alias("slot"), unit(n).alias("unit"))),
    )
    moves = _let(codes, lambda all_of: F.transform(all_of, lambda c, i: F.struct(c.alias("come"), F.get(all_of, i - w).alias("out"))))
    return F.aggregate(moves, begin, step)


def _cut_out(place: Column, scan: Scan) -> Column:
    """The stretch of a found string that is hot; null if none is."""

    def ends(hot):
        first, last = place["start"] + hot["first"] - scan.window, place["start"] + hot["last"]
        return F.when(hot["first"].isNotNull(), F.struct(first.alias("start"), last.alias("end")))

    return _let(_hot(place["found"], scan), ends)


def _random(text: Column, scans: tuple[Scan, ...], allow: tuple[str, ...], parts: str) -> Column:
    """Stretches of candidates whose windows reach their class's entropy.
    Candidates end where a pattern's span or an allowed part begins."""

    def judged(s):
        found = s["found"]
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | found.rlike(ITERATIVE.get(pattern, pattern))
        out = F.lit(None).cast("struct<start:int,end:int>")
        for scan in reversed(scans):
            out = F.when(found.rlike(scan.like), _cut_out(s, scan)).otherwise(out)
        return F.when(~allowed, out)

    def stretches(clear):
        in_class = lambda s: reduce(operator.or_, [s["found"].rlike(scan.like) for scan in scans])
        some = F.filter(_places(clear, CANDIDATE), in_class)
        return F.filter(F.transform(some, judged), lambda s: s.isNotNull())

    without = _let(_blanked(text, ASSIGN, _assigns), lambda t: _let(_blanked(t, ACCESS), lambda u: _blanked(u, HEX)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = _let(without, lambda t: F.when(t.rlike(CANDIDATE), _let(_blanked(t, parts), stretches)).otherwise(none))
    return F.when(text.rlike(CANDIDATE), found).otherwise(none)


def _with_spans(docs: DataFrame, name: str, scans: tuple[Scan, ...], allow: tuple[str, ...], parts: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = F.filter(_places(text, ASSIGN), lambda s: _assigns(s["found"]))
    found = F.concat(
        _named(assigned, "assign"),
        _named(_places(text, ACCESS), "access"),
        _named(_places(text, HEX), "hex"),
        _named(_random(text, scans, allow, parts), "entropy"),
    )
    return docs.withColumn(name, F.array_sort(found))


def find_secrets(
    docs: DataFrame, scans: tuple[Scan, ...] = SCANS, allow: tuple[str, ...] = ALLOW, parts: str = PARTS
) -> DataFrame:
    """``(doc_id, text, spans)`` for each row of ``docs(doc_id, text)``.

    ``spans`` is an array of ``(start, place, end, kind)`` in code points, end
    exclusive, by start and then kind: ``assign`` (a key word, a sign and a
    value of at least 8 characters; the whole match), ``access`` and ``hex`` of
    the patterns above, and ``entropy``.  For these, what ``assign`` matches is
    blanked, then ``access`` and ``hex`` in what is left, then ``parts``; the
    candidates that remain are judged by themselves, and those that match
    ``allow`` are left out.  An ``entropy`` span runs from the first to the last
    window of high entropy in a candidate.  A null text is empty.  Other columns
    are not read.
    """
    return _with_spans(docs.select("doc_id", "text"), "spans", scans, allow, parts)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, see
    :func:`find_secrets`."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return find_secrets(docs).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in blocks of ``PIECE``."""
    low, high = F.floor(start / PIECE).cast("int"), F.ceil(end / PIECE).cast("int")
    near = F.array_join(F.slice(blocks, low + 1, high - low), "")
    return F.when(end > start, F.substring(near, start - low * PIECE + 1, end - start)).otherwise(F.lit(""))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with all its columns, each span of :func:`find_secrets` in
    ``text`` replaced by ``mark`` (overlapping ones by one) and ``n_chars``,
    where there is such a column, counted anew.  A null text stays null."""
    text = F.col("text")
    name = "spans_" + "_".join(docs.columns)  # a name that no column has
    spans = F.col(name)

    def cleaned(blocks):
        def between(ends):
            # A span that begins before all earlier ones have ended is part of them.
            def one(s, i):
                at = F.get(ends, i)
                return F.when(s["start"] >= at, F.concat(_piece(blocks, at, s["start"]), F.lit(mark))).otherwise(F.lit(""))

            last = F.greatest(F.get(ends, F.size(spans) - 1), F.get(spans, F.size(spans) - 1)["end"])
            return F.concat(F.array_join(F.transform(spans, one), ""), _piece(blocks, last, F.length(text)))

        return _let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), between)

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    held = _with_spans(docs, name, SCANS, ALLOW, PARTS)
    held = held.withColumn("text", F.when(F.size(name) > 0, _let(blocks, cleaned)).otherwise(text)).drop(name)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        held = held.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return held.select(docs.columns)
