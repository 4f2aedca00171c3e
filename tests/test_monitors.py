"""Monitors: step-by-step cases, state across sessions, order and chunk invariance."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from samples import entries, span, spans
from tracewarden.functions import spans as fs
from tracewarden.operators import monitor as m, properties, sessions as ss
from tracewarden.operators.sessions import session_slices
from tracewarden.operators.properties import (
    answer_is_yes, classify_text, duration_safety, judge_new_texts, judge_texts, known_answers, mention_response,
)
from tracewarden.schema import KEY_VALUES
from tracewarden.session import freeze
from tracewarden.settings import Job, configured, ignore_older_than_a_day

IMAGE = {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.name": "generate_image"}
SEC = 1_000_000_000


def steps(df):
    return [(r.idx, r.state, r.truthValue) for r in df.orderBy("idx").collect()]


def test_duration_steps(spark):
    cases = [(False, {}, 0), (True, {}, 0), (True, IMAGE, 10), (False, IMAGE, 10), (True, IMAGE, 3 * SEC)]
    rows = [(i, e, entries(a), 0, n) for i, (e, a, n) in enumerate(cases)]
    events = spark.createDataFrame(
        rows,
        f"idx int, is_end boolean, attributes {KEY_VALUES}, start_time_unix_nano bigint, end_time_unix_nano bigint",
    )
    safety = duration_safety()
    items = events.withColumns(safety.features).agg(
        F.array_sort(F.collect_list(F.struct("idx", *safety.features))).alias("items")
    )
    got = steps(m.fold_sequences(items.withColumn("key", F.lit("k")), safety))
    assert got == [
        (0, 0, "True"), (1, 0, "True"), (2, 10, "True"), (3, 10, "True"), (4, 3 * SEC + 10, "False"),
    ]


def conversation(spark, turns, key="conv/1/5"):
    """Spans of one key; a turn is ('user' | 'bot' | 'other', text)."""
    rows = []
    for i, (who, text) in enumerate(turns):
        at = (i + 1) * 10 * SEC
        if who == "user":
            rows.append(span("t", f"{i:02}", "", "ask", at, at + SEC, {"chat": key},
                             [("gen_ai.user.message", {"content": '[{"text": "%s"}]' % text})]))
        elif who == "bot":
            rows.append(span("t", f"{i:02}", "00", "chat", at, at + SEC,
                             {"chat": key, "gen_ai.operation.name": "chat"},
                             [("gen_ai.choice", {"message": '[{"text": "%s"}]' % text})]))
        else:
            rows.append(span("t", f"{i:02}", "00", "step", at, at + SEC, {"chat": key}))
    return spans(spark, rows)


RUDE = "How dare you, Clown."


def mention(spark, **settings):
    judged = spark.createDataFrame([(RUDE, True), ("You are welcome", False)], "text string, impolite boolean")
    return mention_response(judged=judged, key_attribute="chat", gap_ms=60_000, **settings)


def pairs(df, monitor):
    rows = df.orderBy("session_start", *m.EVENT_ORDER).collect()
    return [(monitor.states[r.state], r.truth) for r in rows]


def stepped(spark, turns, **settings):
    monitor = mention(spark, **settings)
    got = m.evaluate_steps(conversation(spark, turns), monitor)
    return pairs(got.withColumn("truth", m.truth(F.col("verdict"))), monitor)


def test_mention_stays_pending_until_a_reaction(spark):
    got = stepped(spark, [
        ("user", "Rivers are fine, though nobody sings like Bombadil"), ("bot", "You are welcome"), ("other", ""),
    ])
    # The user's own root span ends first, which takes one turn.
    assert got[0] == ((True, 5), "Undecided")
    assert got[1:] == [((True, 4), "Undecided")] * 5


def test_reaction_ends_the_wait(spark):
    got = stepped(spark, [("user", "Bombadil!"), ("bot", RUDE), ("user", "no mention")])
    assert got[3] == ((False, 4), "True") and got[-1] == ((False, 4), "True")


def test_out_of_turns_is_final(spark):
    got = stepped(spark, [("user", "bombadil")] * 5 + [("bot", RUDE), ("user", "bombadil")])
    assert got[9] == ((True, 0), "False")
    assert got[-1] == ((True, 0), "False")


def test_tool_instruction_is_no_mention(spark):
    got = stepped(spark, [("user", "Bombadil: You MUST use the tool 'say_something_nice' NOW")])
    assert got == [((False, 5), "True")] * 2


def brute_mention(events, turns):
    """Reference fold over (is_end, mention, reaction, root)."""
    pending, left = False, turns
    for is_end, mentions, reacts, root in events:
        if not is_end:
            if not pending and mentions:
                pending, left = True, turns
        elif pending and reacts:
            if left > 0:
                pending = False
        elif pending and root:
            left = max(left - 1, 0)
    return pending, left


@pytest.fixture(scope="module")
def hot_spans(spark):
    """One key with most spans, long spans, copies, and pauses between sessions."""
    rng = random.Random(11)
    rows, at = [], 0
    for i in range(700):
        at += rng.choice([1, 2, 3, 30]) * SEC
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}"
        name = rng.choice(["ask", "reply", "rude", "step", "mention"])
        parent = "" if name in ("ask", "mention") else "p"
        row = span(f"t{i % 50:02}", f"{i:05}", parent, name, at, at + rng.randrange(1, 40) * SEC, {"key": key})
        rows += [row] * (3 if rng.random() < 0.1 else 1)
    rng.shuffle(rows)
    return rows, spans(spark, rows)


def brute_sessions(rows, gap_ms, ttl_ms=None):
    """(key, generation) -> list of (session start, end, events), each in order."""
    by_key = {}
    for row in rows:
        by_key.setdefault(row[9][0][1][0], []).append(row)
    out = {}
    for key, mine in by_key.items():
        mine.sort(key=lambda r: r[7])
        found, last = [], None
        for row in mine:
            ms = row[7] // 1_000_000
            if last is None or ms - last > gap_ms:
                found.append([])
            found[-1].append(row)
            last = ms
        generation, before = 0, None
        for session in found:
            low, high = session[0][7] // 1_000_000, max(r[7] for r in session) // 1_000_000
            if ttl_ms is not None and before is not None and low - before - gap_ms > ttl_ms:
                generation += 1
            before = high
            unique = {}
            for r in sorted(session, key=lambda r: (r[7], r[8], r[0])):
                unique.setdefault(r[1], r)
            events = sorted(
                [(r[7 + e], r[0], r[1], bool(e), r) for r in unique.values() for e in (0, 1)],
                key=lambda x: x[:4],
            )
            out.setdefault((key, generation), []).append((low, high + gap_ms, events))
    return out


def states_of(df):
    return {(r.key, r.session_start): r.state for r in df.select("key", "session_start", "state").collect()}


def state_monitor(**settings):
    base = mention_response(turns=3, key_attribute="key", gap_ms=8_000, **settings)
    def prepare(df):
        return df.withColumn("mention", F.col("name") == "mention").withColumn("reaction", F.col("name") == "rude")
    return replace(base, prepare=prepare)


@pytest.mark.parametrize("chunks", [1, 9, 60])
@pytest.mark.parametrize("ttl_ms", [None, 20_000])
def test_state_monitor_against_brute_force(hot_spans, chunks, ttl_ms):
    rows, df = hot_spans
    monitor = state_monitor(ttl_ms=ttl_ms)
    got = states_of(m.evaluate(df, monitor, chunks=chunks))
    want = {}
    for (key, _), found in brute_sessions(rows, 8_000, ttl_ms).items():
        seen = []
        for low, _, events in found:
            seen += [(e[3], e[4][5] == "mention", e[4][5] == "rude", e[4][2] == "") for e in events]
            want[(key, low)] = monitor.states.index(brute_mention(seen, 3))
    assert got == want


def test_state_monitor_over_bounded_chunks(hot_spans, monkeypatch):
    monkeypatch.setattr(m.ordered, "CHUNK_BITS", 4)
    _, df = hot_spans
    small = states_of(m.evaluate(df, state_monitor(), chunks=2))
    monkeypatch.undo()
    assert small == states_of(m.evaluate(df, state_monitor(), chunks=1))


@pytest.mark.parametrize("chunks", [1, 25])
def test_general_fold_against_brute_force(hot_spans, chunks):
    rows, df = hot_spans
    monitor = m.Monitor(
        name="mixed", init=F.lit(7).cast("bigint"),
        step=lambda s, e: (s * 31 + e["n"]) % 1_000_003,
        neutral=F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint")),
        lift=lambda e: F.array(F.lit(31).cast("bigint"), e["n"].cast("bigint")),
        merge=lambda a, b: F.array(a[0] * b[0] % 1_000_003, (a[1] * b[0] + b[1]) % 1_000_003),
        enter=lambda s, a: (s * a[0] + a[1]) % 1_000_003,
        verdict=lambda s: s > 500_000,
        features={"n": F.length("name") + F.when(F.col("is_end"), 1).otherwise(0)},
        key_attribute="key", gap_ms=8_000,
    )
    got = states_of(m.evaluate(df, monitor, chunks=chunks))
    want = {}
    for (key, _), found in brute_sessions(rows, 8_000).items():
        state = 7
        for low, _, events in found:
            for e in events:
                state = (state * 31 + len(e[4][5]) + e[3]) % 1_000_003
            want[(key, low)] = state
    assert got == want


def test_sum_monitor_against_brute_force(hot_spans):
    rows, df = hot_spans
    monitor = duration_safety(matches=F.col("name") == "rude", key_attribute="key", gap_ms=8_000)
    got = states_of(m.evaluate(df, monitor))
    want = {}
    for (key, _), found in brute_sessions(rows, 8_000).items():
        total = 0
        for low, _, events in found:
            total += sum(e[4][8] - e[4][7] for e in events if e[3] and e[4][5] == "rude")
            want[(key, low)] = total
    assert got == want


def test_stored_states_are_taken_up(spark, hot_spans):
    _, df = hot_spans
    monitor = duration_safety(matches=F.col("name") == "rude", key_attribute="key", gap_ms=8_000)
    starts = spark.createDataFrame([("hot", 1000)], "key string, state bigint")
    plain, started = states_of(m.evaluate(df, monitor)), states_of(m.evaluate(df, monitor, starts))
    assert all(started[k] - v == (1000 if k[0] == "hot" else 0) for k, v in plain.items())


def test_order_and_partitions_do_not_matter(spark, hot_spans):
    rows, df = hot_spans
    monitor = state_monitor()
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    other = spans(spark, shuffled).repartition(13)
    assert states_of(m.evaluate(other, monitor)) == states_of(m.evaluate(df, monitor))


def test_ignored_sessions_give_no_verdict_and_leave_the_state(hot_spans):
    rows, df = hot_spans
    monitor = state_monitor(ignore_session=F.col("n_distinct") < 4)
    got = states_of(m.evaluate(df, monitor, chunks=5))
    want = {}
    for (key, _), found in brute_sessions(rows, 8_000).items():
        seen = []
        for low, _, events in found:
            if len(events) < 8:
                continue
            seen += [(e[3], e[4][5] == "mention", e[4][5] == "rude", e[4][2] == "") for e in events]
            want[(key, low)] = monitor.states.index(brute_mention(seen, 3))
    assert got == want


def test_reaction_needs_a_text_and_a_rude_answer(spark):
    df = conversation(spark, [("bot", "You are welcome"), ("bot", RUDE), ("other", "")])
    judged = spark.createDataFrame([(RUDE, True), ("You are welcome", False)], "text string, impolite boolean")
    said = df.withColumn("text", fs.bot_message(F.col("attributes"), F.col("events")))
    got = classify_text(said, "text", judged).orderBy("span_id")
    assert [r.impolite for r in got.collect()] == [False, True, None]


def test_each_text_is_judged_once(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    got = judge_texts(df, "t", lambda texts: texts == "a")
    assert sorted((r.text, r.impolite) for r in got.collect()) == [("a", True), ("b", False)]
    answers = spark.createDataFrame([("yes, it is",), ("Yes",), ("no",)], "a string")
    assert [r[0] for r in answers.select(answer_is_yes(F.col("a"))).collect()] == [True, False, False]


def test_answers_are_kept(spark, tmp_path):
    path, asked = str(tmp_path / "answers"), spark.sparkContext.accumulator(0)

    def judge(texts):
        asked.add(len(texts))
        if (texts == "bad").any():
            raise RuntimeError("no answer")
        return texts.map({"a": True, "b": False, "c": None}).astype("boolean")

    def told(rows, name="j"):
        df = spark.createDataFrame([(r,) for r in rows], "t string")
        before, known = asked.value, judge_new_texts(df, "t", judge, path, name)
        count = asked.value - before
        said = classify_text(df, "t", known).select("t", "impolite").collect()
        return count, sorted(map(tuple, said), key=str)

    assert told([None, ""][:1]) == (0, [(None, None)])
    with pytest.raises(Exception, match="no answer"):
        told(["a", "bad"])
    assert known_answers(spark, path, "j").count() == 0
    assert told(["a", "a", None, "b"]) == (2, [("a", True), ("a", True), ("b", False), (None, None)])
    assert told(["b", "a"]) == (0, [("a", True), ("b", False)])
    # A text without an answer is asked again; other judges know nothing of these.
    assert told(["c", "a"])[0] == 1 and told(["c", "a"])[0] == 1
    assert told(["a"], "k/=2")[0] == 1 and told(["a"], "k/=2")[0] == 0
    twice = spark.createDataFrame([(r.digest, True, "j") for r in known_answers(spark, path, "j").collect()], "digest string, answer boolean, judge string")
    twice.write.mode("append").partitionBy("judge").parquet(path)
    assert told(["a", "b"]) == (0, [("a", True), ("b", False)])


def test_settings(spark):
    monitor = configured(duration_safety(), {"name": "safe", "config": {"session-gap-seconds": 300}})
    assert (monitor.name, monitor.key_attribute, monitor.gap_ms) == ("safe", None, 300_000)
    assert (monitor.lateness_ms, monitor.ttl_ms, monitor.ignore_key) == (0, None, None)
    monitor = configured(
        duration_safety(),
        {
            "name": "safe", "key-by": {"type": "by-string-span-attribute", "key": "chat"},
            "state-config": {"ttl-seconds": 30, "should-ignore-window": "old"},
            "config": {"session-gap-seconds": 5, "allowed-lateness-seconds": 2},
        },
        {"old": ignore_older_than_a_day(1_000_000)},
    )
    assert (monitor.key_attribute, monitor.ttl_ms, monitor.lateness_ms) == ("chat", 30_000, 2_000)
    assert monitor.ignore_key is not None
    with pytest.raises(ValueError):
        configured(duration_safety(), {"name": "safe", "config": {}})
    with pytest.raises(ValueError):
        Job.of({"job-name": "x"})
    job = Job.of({"job-name": "x", "source": {"path": "a"}, "sink": {"path": "b"}})
    assert job.max_out_of_orderness_ms == 500 and job.terms_path is None


def test_old_keys_are_ignored(spark):
    old = conversation(spark, [("user", "bombadil")], "conv/1/1000")
    new = conversation(spark, [("user", "bombadil")], "conv/2/990000")
    other = conversation(spark, [("user", "bombadil")], "conv/none")
    monitor = mention(spark, ignore_key=ignore_older_than_a_day(1_000_000))
    found = m.run_monitor(freeze(old.union(new).union(other)), monitor).collect()
    assert sorted(r.key for r in found) == ["conv/2/990000", "conv/none"]


@pytest.mark.parametrize("ttl", [None, 3_000])
def test_sessions_do_not_depend_on_the_blocks_they_are_found_in(spark, ttl):
    draw = random.Random(8)
    starts = [draw.randrange(-40_000, 400_000) for _ in range(600)]
    rows = [("hot" if draw.random() < 0.8 else draw.choice(["a", "b", None]), ms * 1_000_000) for ms in starts]
    spans = spark.createDataFrame(rows, "key string, start_time_unix_nano long")
    few, many = (session_slices(spans, 900, ttl, bits) for bits in (40, 1))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert few.select("session_start").distinct().count() > 20


def test_a_step_without_a_summary_is_refused_over_chunks(spark):
    bare = m.Monitor(name="bare", init=F.lit(0), step=lambda s, e: s, verdict=lambda s: s > 0)
    with pytest.raises(ValueError, match="lift, merge and enter"):
        bare.carries(None, ["key"], None)


def test_tables_of_a_monitor_are_constants(spark):
    got = spark.range(1).select(m.constants([1, None, 3], "int").alias("n"), m.constants([True, None], "boolean").alias("b"))
    assert got.first() == ([1, None, 3], [True, None])
    plan = spark.range(1).select(F.transform(F.array("id"), lambda i: F.get(m.constants([4, 5], "int"), i)))
    assert "[4,5]" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_judge_gets_bounded_pieces(spark):
    most = spark.sparkContext.accumulator(0)
    texts = [f"{i} " + "é" * 3000 for i in range(900)] + ["x" * (3 << 20), "", None]

    def judge(said):
        most.add(int(said.str.len().sum() > properties.ASKED_BYTES and len(said) > 1))
        return said.str.startswith("7 ")

    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = judge_texts(df, "t", judge).select(F.length("text").alias("n"), "impolite").collect()
    assert len(got) == 902 and [r.n for r in got if r.impolite] == [3002] and most.value == 0


@pytest.mark.parametrize("ttl", [None, 50])
def test_small_keys_are_shuffled_once(spark, monkeypatch, ttl):
    """The same as by slices and chunks, with repeated spans and ids that are missing."""
    rng, m_whole = random.Random(11), m.no_large_key
    rows = []
    for i in range(400):
        start = rng.choice([None, *range(0, 900, 7)])
        row = (rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, "x", "y"]), rng.choice([None, *(f"s{j}" for j in range(150))]),
               None if start is None else start * 1_000_000, rng.choice([None, 5, 9, 950]), rng.choice(["order", "ship"]))
        rows += [row] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(
        rows, "key string, trace_id string, span_id string, start_time_unix_nano bigint, end_ms bigint, name string"
    ).selectExpr("*", "end_ms * 1000000 as end_time_unix_nano", "'' as parent_span_id").drop("end_ms")
    rules = [m.Rule("o", ~F.col("is_end") & (F.col("name") == "order"), {"none": 0}), m.Rule("s", F.col("is_end"), {0: 1, 1: 2})]
    states = m.StateMonitor.of("m", ["none", 0, 1, 2], "none", rules, {2: True, "none": False}, gap_ms=30, ttl_ms=ttl)
    narrow = m._narrow(df, states.features)
    full = narrow.filter("key is not null and start_time_unix_nano is not null")
    apart = replace(states, across_sessions=False)
    found = []
    for small in (True, False):
        monkeypatch.setattr(m, "no_large_key", lambda spans, whole: small and m_whole(spans, whole))
        monkeypatch.setattr(ss, "no_large_key", lambda spans: small)
        got = [
            ss.session_sequence(df.drop("name"), 30),
            m.evaluate_narrow(full, states), m.evaluate_narrow(full, apart), m.evaluate_narrow(narrow, states),
            ss.sessionize_small(df, 30, ttl) if small else ss.sessionize(df, 30, ttl),
        ]
        found.append([(g.columns, sorted(map(repr, g.collect()))) for g in got])
    for (x, a), (y, b) in zip(*found):
        assert x == y and len(a) > 20
        assert (sorted(set(a) - set(b)), sorted(set(b) - set(a))) == ([], []) and a == b
