"""Formulas against their meaning on finite sequences, and over keys of any size."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import ordered
from tracewarden.operators.formulas import (
    FALSE, TRUE, always, atom, automaton, check_formulas, eventually, formula_monitor, next_row, next_row_if_any,
    release, response, together, until,
)
from tracewarden.operators.monitor import run_monitor

A, B = atom("a"), atom("b")
ROWS = [frozenset(), frozenset("a"), frozenset("b"), frozenset("ab")]


def holds(f, word, i=0):
    """What a formula means at row ``i`` of a whole word."""
    here = lambda g: holds(g, word, i)
    last = len(word)
    match f.kind:
        case "true" | "false":
            return f.kind == "true"
        case "atom":
            return f.name in word[i]
        case "not":
            return not here(f.parts[0])
        case "and":
            return here(f.parts[0]) and here(f.parts[1])
        case "or":
            return here(f.parts[0]) or here(f.parts[1])
        case "next":
            return i + 1 < last and holds(f.parts[0], word, i + 1)
        case "weak":
            return i + 1 == last or holds(f.parts[0], word, i + 1)
        case "until":
            return any(holds(f.parts[1], word, k) and all(holds(f.parts[0], word, j) for j in range(i, k)) for k in range(i, last))
        case "release":
            return all(holds(f.parts[1], word, k) or any(holds(f.parts[0], word, j) for j in range(i, k)) for k in range(i, last))
        case "soon":
            return any(holds(f.parts[0], word, k) for k in range(i, min(last, i + f.steps + 1)))
        case "while":
            return all(holds(f.parts[0], word, k) for k in range(i, min(last, i + f.steps + 1)))


FORMULAS = {
    "always": always(A),
    "eventually": eventually(A),
    "settles": eventually(always(~A)) & eventually(B),
    "response": response(A, B),
    "soon": response(A, B, within=2),
    "until": until(~A, B),
    "release": release(B, A),
    "nested": always(A >> until(~B, A & B)),
    "deep": always(eventually(A) >> next_row(eventually(B & next_row_if_any(~A)))),
    "alternating": always((A >> next_row_if_any(B)) & (B >> next_row_if_any(A))),
    "windows": eventually(always(A, within=2)),
    "trivial": until(TRUE, A) | ~until(TRUE, A),
    "empty": always(FALSE),
}


def run(a, word):
    state = 0
    for row in word:
        mask = sum(2**i for i, t in enumerate(a.tests) if t in row)
        state = a.moves[mask][state]
    return state


@pytest.mark.parametrize("name", sorted(FORMULAS))
def test_automata_mean_what_formulas_mean(name):
    f = FORMULAS[name]
    a = automaton(f, ["a", "b"])
    assert a.size <= 40
    for size in range(1, 6):
        for word in product(ROWS, repeat=size):
            state = run(a, word)
            assert a.closed[state] == holds(f, word)
    # No rows that follow change what is decided; some rows change the rest.
    for word in product(ROWS, repeat=2):
        state = run(a, word)
        ends = {holds(f, word + more) for size in range(4) for more in product(ROWS, repeat=size)}
        assert a.open[state] == (ends.pop() if len(ends) == 1 else None), word


def test_random_formulas():
    rng = random.Random(5)

    def grown(depth):
        if depth == 0:
            return rng.choice([A, B, ~A, TRUE])
        kind = rng.choice([always, eventually, next_row, next_row_if_any, until, release, "and", "or", "not", "soon"])
        if kind in (until, release):
            return kind(grown(depth - 1), grown(depth - 1))
        if kind in ("and", "or"):
            x, y = grown(depth - 1), grown(depth - 1)
            return x & y if kind == "and" else x | y
        inner = grown(depth - 1)
        return ~inner if kind == "not" else eventually(inner, within=rng.randint(0, 2)) if kind == "soon" else kind(inner)

    for _ in range(60):
        f = grown(3)
        a = automaton(f, ["a", "b"])
        for _ in range(60):
            word = tuple(rng.choice(ROWS) for _ in range(rng.randint(1, 9)))
            assert a.closed[run(a, word)] == holds(f, word), f


def test_sizes_are_small_and_bounded():
    sizes = {n: automaton(f, ["a", "b"]).size for n, f in FORMULAS.items()}
    assert sizes["trivial"] == 2 and sizes["empty"] == 1  # before any row nothing holds
    assert sizes["response"] == 3 and sizes["soon"] == 5
    with pytest.raises(ValueError, match="more than 20 states"):
        automaton(response(A, B, within=60), limit=20)
    with pytest.raises(ValueError, match="no test for"):
        automaton(always(atom("x")), ["a"])
    with pytest.raises(ValueError, match="at most"):
        automaton(TRUE, [f"t{i}" for i in range(11)])


def test_several_formulas_are_one_automaton():
    parts = [automaton(f, ["a", "b"]) for f in FORMULAS.values()]
    whole = together(parts)
    rng = random.Random(6)
    for _ in range(200):
        word = tuple(rng.choice(ROWS) for _ in range(rng.randint(1, 12)))
        state = run(whole, word)
        assert whole.closed[state] == tuple(a.closed[run(a, word)] for a in parts)
        assert whole.open[state] == tuple(a.open[run(a, word)] for a in parts)


@pytest.mark.parametrize("chunk_bits, chunks", [(18, None), (3, 7)])
def test_keys_of_any_size(spark, monkeypatch, chunk_bits, chunks):
    monkeypatch.setattr(ordered, "CHUNK_BITS", chunk_bits)
    rng = random.Random(7)
    words = {k: [rng.choice(ROWS) for _ in range(rng.randint(1, 12))] for k in range(40)}
    words[None] = [rng.choice(ROWS) for _ in range(5)]
    words[99] = [rng.choice([ROWS[0]] * 9 + ROWS) for _ in range(200)]  # half of all rows
    rows = [(k, i, True if "a" in row else None, "b" in row, 1) for k, word in words.items() for i, row in enumerate(word)]
    table = spark.createDataFrame(rows, "state int, letter int, x boolean, y boolean, mark int").repartition(5)
    found = check_formulas(table, ["state"], ["letter"], {"a": F.col("x"), "b": F.col("y")}, FORMULAS, chunks=chunks).collect()
    assert len(found) == len(words)
    for r in found:
        for name, f in FORMULAS.items():
            a = automaton(f, ["a", "b"])
            state = run(a, words[r["state"]])
            assert (r[f"{name}_closed"], r[f"{name}_open"]) == (holds(f, words[r["state"]]), a.open[state]), (name, r)


def test_no_rows_no_verdicts(spark):
    none = spark.createDataFrame([], "k int, i int, x boolean")
    assert check_formulas(none, ["k"], ["i"], {"a": F.col("x")}, {"f": always(A)}).isEmpty()


def test_formula_as_a_monitor_across_sessions(spark):
    from samples import span, spans

    second = 1_000_000_000
    rows = [
        span("t1", "s1", "", "open", 0, second), span("t1", "s2", "s1", "close", 100 * second, 101 * second),
        span("t2", "s3", "", "open", 0, second), span("t2", "s4", "s3", "open", 100 * second, 101 * second),
        span("t3", "s5", "", "other", 0, second),
    ]
    once = always(atom("open") >> next_row_if_any(always(~atom("open"))))
    begun = {"open": (F.col("name") == "open") & ~F.col("is_end")}
    m = formula_monitor("opened once", once, begun, gap_ms=10_000)
    found = {(r["key"].lstrip("0"), r["session_start"]): r["truthValue"] for r in run_monitor(spans(spark, rows), m).collect()}
    assert len(found) == 5
    by_trace = {}
    for (key, start), value in sorted(found.items()):
        by_trace.setdefault(key, []).append(value)
    assert by_trace == {"t1": ["Undecided", "Undecided"], "t2": ["Undecided", "False"], "t3": ["Undecided"]}
