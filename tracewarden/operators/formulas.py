"""Temporal formulas over the ordered rows of each key.

A formula says what holds at a row and from there to the last row of its key:

    error, paid = atom("error"), atom("paid")
    always(error >> eventually(paid)) & until(~error, atom("login"))

It becomes a finite automaton.  What is still owed after a row is a set of
alternatives, each a set of formulas that the next rows have to meet; reading a
row carries every one of them one row on.  Equal sets are one state, states
that no further rows can tell apart are merged, and the automaton runs as the
state monitor of :mod:`tracewarden.operators.monitor`.

A verdict is True or False once no further rows can change it; else it is
undecided while rows may come, and what the last row left when none will.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.monitor import StateMonitor, constants, fold
from tracewarden.operators.temporal import letters_of_first_session

#: Most tests that a formula may name, and most states that it may need.
MAX_ATOMS, MAX_STATES = 10, 512


@dataclass(frozen=True)
class Formula:
    """Made by the functions of this module, and by ``&``, ``|``, ``~``, ``>>``."""

    kind: str
    parts: tuple = ()
    name: str = ""
    steps: int = 0

    def __and__(self, other: Formula) -> Formula:
        return Formula("and", (self, other))

    def __or__(self, other: Formula) -> Formula:
        return Formula("or", (self, other))

    def __invert__(self) -> Formula:
        return Formula("not", (self,))

    def __rshift__(self, other: Formula) -> Formula:
        """Implication."""
        return ~self | other

    def atoms(self) -> list[str]:
        """Names of the tests, each once."""
        inner = [n for p in self.parts for n in p.atoms()]
        return sorted({self.name, *inner} - {""})


TRUE, FALSE = Formula("true"), Formula("false")


def atom(name: str) -> Formula:
    """The test of this name holds at the row."""
    return Formula("atom", name=name)


def next_row(f: Formula) -> Formula:
    """There is a next row, and ``f`` holds there."""
    return Formula("next", (f,))


def next_row_if_any(f: Formula) -> Formula:
    """``f`` holds at the next row, if there is one."""
    return Formula("weak", (f,))


def until(f: Formula, g: Formula) -> Formula:
    """``g`` holds at some row, and ``f`` at all before it."""
    return Formula("until", (f, g))


def release(f: Formula, g: Formula) -> Formula:
    """``g`` holds up to the row where ``f`` does too, or to the end."""
    return Formula("release", (f, g))


def eventually(f: Formula, within: int | None = None) -> Formula:
    """``f`` holds at some row, at most ``within`` rows on."""
    return until(TRUE, f) if within is None else Formula("soon", (f,), steps=within)


def always(f: Formula, within: int | None = None) -> Formula:
    """``f`` holds at every row, or at those up to ``within`` rows on."""
    return release(FALSE, f) if within is None else Formula("while", (f,), steps=within)


def response(f: Formula, g: Formula, within: int | None = None) -> Formula:
    """Every row with ``f`` has ``g`` at or after it."""
    return always(f >> eventually(g, within))


#: What a negation turns each kind into.
_DUAL = {
    "true": "false", "false": "true", "and": "or", "or": "and", "next": "weak", "weak": "next",
    "until": "release", "release": "until", "soon": "while", "while": "soon",
}
#: Kinds that are met where no more rows come; the others fail.
_MET_AT_END = {"weak", "release", "while"}


def plain(f: Formula, negated: bool = False) -> Formula:
    """The same formula with negations at tests only."""
    if f.kind == "not":
        return plain(f.parts[0], not negated)
    if f.kind == "atom":
        return Formula("not", (f,)) if negated else f
    kind = _DUAL[f.kind] if negated else f.kind
    return Formula(kind, tuple(plain(p, negated) for p in f.parts), steps=f.steps)


# Alternatives of obligations: {} is false, {{}} is true.
_NEVER: frozenset = frozenset()
_DONE = frozenset([frozenset()])


def _least(choices) -> frozenset:
    """Without alternatives that ask for more than another one."""
    kept: list[frozenset] = []
    for c in sorted(set(choices), key=len):
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept)


def _both(a: frozenset, b: frozenset) -> frozenset:
    return _least(x | y for x in a for y in b)


def _either(a: frozenset, b: frozenset) -> frozenset:
    return _least([*a, *b])


def after(f: Formula, row: frozenset) -> frozenset:
    """What ``f``, in plain form, asks of the rows after one with the tests ``row``."""
    ask = lambda g: frozenset([frozenset([g])])
    match f.kind:
        case "true" | "false":
            return _DONE if f.kind == "true" else _NEVER
        case "atom":
            return _DONE if f.name in row else _NEVER
        case "not":
            return _NEVER if f.parts[0].name in row else _DONE
        case "and":
            return _both(after(f.parts[0], row), after(f.parts[1], row))
        case "or":
            return _either(after(f.parts[0], row), after(f.parts[1], row))
        case "next" | "weak":
            return ask(Formula(f"{f.kind}_is", f.parts))
        case "next_is" | "weak_is":
            return after(f.parts[0], row)
        case "until":
            return _either(after(f.parts[1], row), _both(after(f.parts[0], row), ask(f)))
        case "release":
            return _both(after(f.parts[1], row), _either(after(f.parts[0], row), ask(f)))
    now = after(f.parts[0], row)
    if f.steps == 0:
        return now
    later = ask(Formula(f.kind, f.parts, steps=f.steps - 1))
    return _either(now, later) if f.kind == "soon" else _both(now, later)


def _met_at_end(state: frozenset) -> bool:
    return any(all(g.kind.removesuffix("_is") in _MET_AT_END for g in choice) for choice in state)


@dataclass(frozen=True)
class Automaton:
    """States are numbers, 0 the first; ``moves[row]`` lists where each state
    goes, with ``row`` a number whose bits are the tests that hold.  ``closed``
    holds the verdicts if no row follows, ``open`` those that no row changes."""

    tests: tuple
    moves: tuple
    closed: tuple
    open: tuple

    @property
    def size(self) -> int:
        return len(self.closed)

    def rows_that_move(self) -> tuple[list[tuple], list[int]]:
        """Distinct moves, that of moving nothing first, and each row's number
        among them."""
        kinds = {tuple(range(self.size)): 0}
        numbers = [kinds.setdefault(m, len(kinds)) for m in self.moves]
        return list(kinds), numbers


def _reachable(first, moved, rows: int, limit: int):
    """States from the first on, and where each goes by each row."""
    number, table, todo = {first: 0}, [], [first]
    while todo:
        state = todo.pop(0)
        to = []
        for row in range(rows):
            other = moved(state, row)
            if other not in number:
                if len(number) == limit:
                    raise ValueError(f"the formula needs more than {limit} states")
                number[other] = len(number)
                todo.append(other)
            to.append(number[other])
        table.append(to)
    return list(number), table


def _merged(table: list, verdicts: list) -> tuple[list, list]:
    """Number of each state among those that some rows tell apart, by its
    verdicts and by where it goes; the states' first members."""
    names = {v: i for i, v in enumerate(dict.fromkeys(verdicts))}
    group = [names[v] for v in verdicts]
    while True:
        signs = [(group[s], *[group[t] for t in table[s]]) for s in range(len(table))]
        names = {v: i for i, v in enumerate(dict.fromkeys(signs))}
        finer = [names[v] for v in signs]
        if len(names) == len(set(group)):
            return finer, [finer.index(i) for i in range(len(names))]
        group = finer


def _decided(table: list, closed: list) -> list:
    """Of each state: the verdict of all states it can reach, if they agree."""
    can = [{c} for c in closed]
    changed = True
    while changed:
        changed = False
        for s, to in enumerate(table):
            more = set().union(can[s], *[can[t] for t in to])
            changed |= more != can[s]
            can[s] = more
    return [next(iter(c)) if len(c) == 1 else None for c in can]


def automaton(f: Formula, tests: list[str] | None = None, limit: int = MAX_STATES) -> Automaton:
    """The automaton of a formula, over the tests it names or those given.

    Its states are at most ``limit``; a formula that needs more, or more than
    ``MAX_ATOMS`` tests, raises ``ValueError``.
    """
    tests = f.atoms() if tests is None else list(tests)
    if set(f.atoms()) - set(tests):
        raise ValueError(f"no test for {sorted(set(f.atoms()) - set(tests))}")
    if len(tests) > MAX_ATOMS:
        raise ValueError(f"{len(tests)} tests, at most {MAX_ATOMS}")
    rows = [frozenset(t for i, t in enumerate(tests) if mask >> i & 1) for mask in range(2 ** len(tests))]

    def moved(state, row):
        out = _NEVER
        for choice in state:
            met = _DONE
            for g in choice:
                met = _both(met, after(g, rows[row]))
            out = _either(out, met)
        return out

    first = frozenset([frozenset([Formula("next_is", (plain(f),))])])
    states, table = _reachable(first, moved, len(rows), limit)
    closed = [_met_at_end(s) for s in states]
    group, members = _merged(table, closed)
    table = [[group[t] for t in table[m]] for m in members]
    closed = [closed[m] for m in members]
    moves = tuple(tuple(to[row] for to in table) for row in range(len(rows)))
    return Automaton(tuple(tests), moves, tuple(closed), tuple(_decided(table, closed)))


def together(parts: list[Automaton], limit: int = MAX_STATES) -> Automaton:
    """One automaton for several over the same tests; verdicts are tuples."""
    rows = len(parts[0].moves)
    step = lambda state, row: tuple(a.moves[row][s] for a, s in zip(parts, state))
    states, table = _reachable(tuple(0 for _ in parts), step, rows, limit)
    closed = [tuple(a.closed[s] for a, s in zip(parts, state)) for state in states]
    open_ = [tuple(a.open[s] for a, s in zip(parts, state)) for state in states]
    group, members = _merged(table, list(zip(closed, open_)))
    moves = tuple(tuple(group[table[m][row]] for m in members) for row in range(rows))
    return Automaton(parts[0].tests, moves, tuple(closed[m] for m in members), tuple(open_[m] for m in members))


def _letter(tests: dict[str, Column], numbers: list[int]) -> Column:
    mask = F.lit(0)
    for i, test in enumerate(tests.values()):
        mask = mask + F.when(test, 2**i).otherwise(0)
    return F.get(constants(numbers, "int"), mask)


def _machine(name: str, a: Automaton, verdicts: list, tests: dict[str, Column], **settings) -> StateMonitor:
    kinds, numbers = a.rows_that_move()
    letter = _letter({t: tests[t] for t in a.tests}, numbers)
    return StateMonitor.of_table(name, list(range(a.size)), 0, kinds, letter, verdicts, **settings)


def formula_monitor(name: str, f: Formula, tests: dict[str, Column], **settings) -> StateMonitor:
    """A monitor that takes every event of a key as a row of the formula.

    ``tests`` are conditions on the span and ``is_end``; null counts as false.
    Its verdict is undecided as long as later events could change it.
    """
    a = automaton(f)
    return _machine(name, a, list(a.open), tests, **settings)


def formula_states(rows: DataFrame, keys: list[str], order: list[str], machine: StateMonitor, chunks: int | None = None) -> DataFrame:
    """``(keys, _state)`` after the last row of each key.

    Rows that move no state are dropped before the shuffle; stretches of rows
    become maps from state to state, so a key of any length is cut into chunks.
    """
    own_keys, own_order = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    named = [F.col(c).alias(n) for c, n in zip([*keys, *order], [*own_keys, *own_order])]
    needed = rows.select(*named, machine.features["letter"].alias("letter"), F.lit(False).alias("mark"))
    ends = needed.groupBy(*own_keys).agg(F.max(F.struct(*own_order)).alias("place"))
    marks = ends.select(*own_keys, "place.*", F.lit(0).alias("letter"), F.lit(True).alias("mark"))
    marked = needed.filter("letter > 0").unionByName(marks)
    found = fold(marked, own_keys, [*own_order, "mark"], ["letter"], machine, None, chunks, "mark")
    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, own_keys)], F.col("state").alias("_state"))


def check_formulas(
    rows: DataFrame, keys: list[str], order: list[str], tests: dict[str, Column], formulas: dict[str, Formula],
    limit: int = MAX_STATES, chunks: int | None = None,
) -> DataFrame:
    """One row per key with ``<name>_closed`` and ``<name>_open`` per formula.

    All formulas are judged in one pass over the rows.  ``order`` tells the rows
    of a key apart.  A null test counts as false; keys without rows do not
    appear.  ``limit`` bounds the states of each formula and of all together.
    Runs jobs while it is built.
    """
    parts = [automaton(f, list(tests), limit) for f in formulas.values()]
    whole = together(parts, limit)
    states = formula_states(rows, keys, order, _machine("formulas", whole, [None] * whole.size, tests), chunks)
    verdict = lambda column, i: F.get(constants([v[i] for v in column], "boolean"), F.col("_state"))
    judged = []
    for i, name in enumerate(formulas):
        judged += [verdict(whole.closed, i).alias(f"{name}_closed"), verdict(whole.open, i).alias(f"{name}_open")]
    return states.select(*keys, *judged)


def formulas_on_letters(
    spans: DataFrame, gap_ms: int, tick_ms: int, tests: dict[str, Column], formulas: dict[str, Formula]
) -> DataFrame:
    """Verdicts of formulas whose rows are the letters of each key's first
    session, the one that holds the root; a test holds at a letter if some event
    of its tick passes it."""
    letters = letters_of_first_session(spans, gap_ms, tick_ms, tests)
    return check_formulas(letters, ["key"], ["letter"], {t: F.col(t) for t in tests}, formulas)

