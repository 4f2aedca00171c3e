"""Vector codes, token counts of prefixes and conversation tries, against brute force."""

import hashlib
import math
import random
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewarden.llm.codes import codebooks, nearest, sequency_order, vector_codes, walsh, whole_numbers
from tracewarden.llm.tokens import (
    VOCABULARY, PrefixCounter, counter, fitting_chars, prefix_counts, prefix_tokens, truncated, within_budget,
)
from tracewarden.llm.tries import prefix_trie, rebuilt

VECTORS = "vec_id long, embedding array<double>, label int, code string, vector int, of string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], VECTORS)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(Fraction(x) * 256) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda: [[min((far(c[p], b), e) for e, b in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = find()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    found = find()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    return sorted(
        repr((i, "".join(f"{e:02x}" for _, e in f), fits(error), fits(by_label[label]), digest))
        for (i, _, label), f, error in zip(kept, found, errors)
    )


def coded(spark, rows, **given):
    found = vector_codes(vectors(spark, rows), **given).collect()
    return sorted(repr((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in found)


def test_transform_keeps_distances_and_goes_by_sign_changes():
    for size in (1, 2, 8, 32):
        basis = walsh(np.eye(size, dtype=np.int64)).T
        changes = [(np.diff(row) != 0).sum() for row in basis]
        assert changes == list(range(size)) and sorted(sequency_order(size)) == list(range(size))
    a = np.random.default_rng(1).integers(-500, 500, (40, 11))
    assert ((walsh(a) ** 2).sum(axis=1) == 16 * (a**2).sum(axis=1)).all()


def test_nearest_is_the_first_of_the_nearest():
    rng = np.random.default_rng(2)
    parts, entries = rng.integers(-4, 5, (500, 3)), rng.integers(-4, 5, (20, 3))
    codes, errors = nearest(parts, entries)
    far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (codes == far.argmin(axis=1)).all() and (errors == far.min(axis=1)).all()


def test_whole_numbers_are_exact():
    values = np.array([[0.1, -0.001, -0.0], [1e300, -(2.0**60), 3.99609375]])
    assert whole_numbers(values).tolist() == [[math.floor(Fraction(x) * 256) for x in v] for v in values.tolist()]


def test_codes_are_those_of_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(i + 1000, [0.25, -0.5, 0.0, 1.0, 2.0, -0.125], 3) for i in range(150)]  # a third are copies
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[9][1], None), (None, rows[9][1], None)]
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 5, 1), (-3, [float("nan")] * 6, 1), (-4, [float("inf")] * 6, 1)]
    want = brute_codes(rows, 3, 16, 2)
    assert coded(spark, rows, parts=3, entries=16) == want and len(want) == 454


def test_codes_of_huge_components_few_rows_and_none(spark):
    rows = [(1, [1e18, -1e18], 1), (2, [1e18, 5.0], 1), (3, [-3e9, 2.5], 2), (4, [0.0, 0.0], 2), (5, [1e200, 0.0], 3)]
    assert coded(spark, rows, parts=2, entries=4, rounds=1) == brute_codes(rows, 2, 4, 1)
    assert coded(spark, rows[3:4], parts=2) == brute_codes(rows[3:4], 2, 64, 2)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    assert [eval(r)[1:3] for r in coded(spark, [(1, [], 1)])] == [("00" * 16, 0)]


def test_codes_refuse_other_lengths(spark):
    for rows in ([(1, [1.0] * 15, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)]):
        with pytest.raises(ValueError):
            codebooks(vectors(spark, rows).withColumn("vector", F.col("embedding")))
    with pytest.raises(ValueError):
        vector_codes(vectors(spark, []), entries=257)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


HARD = [
    "", " ", "abc", "don't we'll 'LL 'l 're're", "x!!<|endoftext|>de <|EndOfText|> it's <|startoftext|><|endoftext|", "a</w>b </w>",
    "CIÓN ÑANDÚ ΑΣ ς été", "한국어 각 ไทย", "1234 5.6e-7\n\n\t tab", "😂😂😂😂 👩‍👩‍👧", "x" * 300, "　a b\x1c\x85c", "<|endoftext|>" * 3,
]


def test_every_prefix_counts_as_the_library_counts(library):
    rng = random.Random(4)
    alphabet = "aeiou'stlmrnd tion  ñé<|>1.\n"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(120)) for _ in range(25)]
    found = counter(VOCABULARY).texts(texts)
    for text, along in zip(texts, found, strict=True):
        prefixes = [text[:k] for k in range(1, len(text) + 1)]
        assert along.tolist() == [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)], text


def test_whole_texts_of_every_kind_of_letter(library):
    letters = [chr(x) for x in [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 331), 0xA7CB, 0xA7DC, 0x32808, 0x130, 0x1E9E]]
    texts = [f"a{x}b'{x}1 e{x}̣́" for x in letters]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    bad = [x for x, along, n in zip(letters, counter(VOCABULARY).texts(texts), want) if along[-1] != n]
    assert set(bad) <= {chr(0xA7CB), chr(0xA7DC)}  # letters newer than the pattern library's tables


def test_cuts_inside_a_letter_count_as_before_it(library):
    text = "éạ́ x"
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = [0, n(text[:2]), n(text[:2]), n(text[:2]), n(text[:5]), n(text[:6]), n(text)]
    assert counter(VOCABULARY).text(text).tolist() == want


def test_memory_stays_bounded(monkeypatch):
    from tracewarden.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY", 10)
    small, whole = PrefixCounter(VOCABULARY), counter(VOCABULARY)
    rng = random.Random(5)
    for _ in range(5):
        texts = ["".join(rng.choice("abcd ") for _ in range(200)) for _ in range(20)]
        assert [a.tolist() for a in small.texts(texts)] == [a.tolist() for a in whole.texts(texts)]
        assert len(small.known) <= 10 and len(small.stable) <= 40


def test_new_words_are_worked_out_together(library):
    """Calls of Python functions, which go by letter, are few for new words."""
    rng = random.Random(6)
    parts = ["an", "the", "ion", "é", "ung", "st", "re", "ß", "qu", "o", "ñ", "keit"]
    words = [["".join(rng.choice(parts) for _ in range(rng.randint(3, 6))) for _ in range(8000)] for _ in range(2)]
    count, calls = PrefixCounter(VOCABULARY), 0

    def called(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    count.texts([" ".join(words[0])])
    text = " ".join(words[1])
    sys.setprofile(called)
    try:
        [along] = count.texts([text])
    finally:
        sys.setprofile(None)
    assert calls < len(text) / 2
    for k in [*range(1, 3000, 7), len(text)]:
        assert along[k - 1] == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_words_with_other_white_space_are_known(library):
    count = PrefixCounter(VOCABULARY)
    for texts in (["wonderfully palabras"], ["palabras wonderfully\n"], ["wonderfully\t\tx 's", "palabras\n\n'll don't "], ["x" * 70 + "  'll " + "x" * 70]):
        for text, along in zip(texts, count.texts(texts), strict=True):
            want = library.encode_batch([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)
            assert along.tolist() == [len(e.ids) for e in want], text


def test_words_longer_and_shorter_than_those_taken_together(library, monkeypatch):
    from tracewarden.llm import tokens

    monkeypatch.setattr(tokens, "SHORT", 4)
    monkeypatch.setattr(tokens, "AT_ONCE", 12)
    monkeypatch.setattr(tokens, "PAIRS", 2)
    text = "é ésta está tion nation nations wwwwwww don't été ññññ the then 각각 x"
    want = [len(e.ids) for e in library.encode_batch([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)]
    assert PrefixCounter(VOCABULARY).texts([text])[0].tolist() == want


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        PrefixCounter("/opt/tokenizers/byte_bpe_50k.json")


def docs(spark, texts):
    rows = [(k, t, "x", 5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, counts string, n_tokens int")


def test_counts_of_tables(spark, library):
    long = "palabra larga " * 20000 + "z" * 100000
    texts = [*HARD, None, long, HARD[3], HARD[3]]
    found = prefix_counts(docs(spark, texts).repartition(3)).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], len(r["counts"])) == (len(text.encode()), n, len(text)), text[:50]
    assert prefix_counts(docs(spark, []).repartition(2)).isEmpty()


def test_questions_need_no_encoding(spark, library):
    texts = ["hello wonderful tokenization world", "", None, "antidisestablishmentarianism", "one two three"]
    counted = prefix_counts(docs(spark, texts))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for limit in (0, 1, 3, 100):
        for r in counted.select("text", truncated(F.col("text"), F.col("counts"), limit).alias("cut")).collect():
            text = r["text"] or ""
            assert r["cut"] == max((text[:k] for k in range(len(text) + 1) if n(text[:k]) <= limit), key=len)
    row = counted.filter("doc_id = 0").select(
        *[prefix_tokens(F.col("counts"), k).alias(f"c{k}") for k in (0, 5, 99)], fitting_chars(F.col("counts"), 2).alias("fit")
    ).first()
    assert (row["c0"], row["c5"], row["c99"]) == (0, n("hello"), n(texts[0])) and row["fit"] > 0
    budget = n(texts[0]) + 2
    fit = {r["doc_id"]: r["fit_chars"] for r in within_budget(counted, "doc_id", budget).collect()}
    edge = max(k for k in range(len(texts[3]) + 1) if n(texts[3][:k]) <= 2)
    assert fit == {0: len(texts[0]), 1: 0, 2: 0, 3: edge, 4: 0}


CHATS = "conv_id long, turn long, role string, text string, key string, depth int, words string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "k", 3, "w") for r in rows], CHATS)


def brute_trie(rows):
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            given.setdefault(c, []).append((turn is not None, turn or 0, digest[:32], role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in given.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        leaves, saved, todo = 0, 0, [path]
        while todo:
            p = todo.pop()
            leaves += p not in children
            saved += (len(members[p]) - 1) * (len(p[-1][1].split()) if p else 0)
            todo += children.get(p, [])
        return leaves, saved

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(cs), len(p), parent, len(cs), len(children.get(p, [])), *below(p), digest))
    return sorted(out, key=repr)


def trie(spark, rows, **given):
    found = prefix_trie(*rebuilt(chats(spark, rows)), **given)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == names
    return sorted((tuple(r) for r in found.collect()), key=repr)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, 60):
        size = rng.choice([1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice("ua"), rng.choice(["hi there", "so it is", "no"])) for t in range(size)]
    for c in range(1000, 1060):  # a third start alike, many of them copies
        rows += [(c, t, "u", "the same words") for t in range(6)] + [(c, 9, "a", "x y" if c % 3 else str(c))]
    rows += [(7, None, None, None), (7, None, "u", "first"), (7, 3, "u", "tie"), (7, 3, "a", "tie"), (7, 3, "a", "tie")]
    rows += [(None, 1, "u", "of nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("storey, size", [(256, 1 << 16), (3, 20), (2, 1), (5, 4)])
def test_trie_is_that_of_brute_force(spark, storey, size):
    rows = conversations(6)
    assert trie(spark, rows, storey=storey, size=size) == brute_trie(rows)


def test_trie_of_a_long_conversation(spark):
    rows = [(40, t, "u", f"turn {t % 7}") for t in range(700)] + [(60, t, "u", f"turn {t % 7}") for t in range(650)]
    rows += [(c, 0, "a", "short one") for c in range(41, 45)]
    assert trie(spark, rows, storey=64, size=100) == brute_trie(rows)


def test_trie_without_turns_or_conversations(spark):
    lone = [(c, 0, "u", "a b") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 4 and c % 20][:5]
    found = trie(spark, lone)
    assert found == brute_trie(lone) and [r[1] for r in found] == [0]
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "u", "x")]) == []
