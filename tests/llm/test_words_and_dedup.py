"""Word hashes, components, near duplicates and repeated passages, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tracewarden.llm.neardup import near_duplicates
from tracewarden.llm.steps import components
from tracewarden.llm.substrings import remove_repeats
from tracewarden.llm.words import ALNUM, NON_SPACE, grams, split_words

DOCS = "doc_id long, text string, n int, sketch string, lang string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", None) for i, t in rows], DOCS)


def test_words_are_those_of_python():
    texts = ["Ab  c d\x0be\tF", None, "", " \n", "Été x", "a" * 5000, "b a"]
    found = split_words(pa.array(texts), NON_SPACE, fold=True)
    words = [(t or "").encode().lower().split() for t in texts]
    for i, want in enumerate(words):
        part = found.of(i)
        got = [found.data[a:b].tobytes() for a, b in zip(found.starts[part], found.ends[part], strict=True)]
        assert got == want
    flat = [w for ws in words for w in ws]
    same = {}
    for w, h in zip(flat, found.hashes.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_words_of_a_slice_and_other_classes():
    texts = pa.array(["skip me", "A-b_c éè 9z", "x"]).slice(1)
    found = split_words(texts, ALNUM, fold=True)
    got = [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)]
    assert got == ["a", "b", "c", "éè", "9z", "x"]
    assert found.bounds.tolist() == [0, 5, 6]


def test_gram_seeds_differ():
    h = np.arange(20, dtype=np.uint64)
    assert len(set(grams(h, 3).tolist()) | set(grams(h, 3, 1).tolist())) == 36


def test_components_of_a_path_a_star_and_a_cycle(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1001 + i) for i in range(50)]
    cycle = [(2000, 2001), (2001, 2002), (2002, 2000), (2000, 2001), (2002, 2002)]
    found = components(spark.createDataFrame(path + star + cycle, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in found}
    assert len(got) == len(found) == 41 + 51 + 3
    assert all(got[i] == 0 for i in range(41)) and got[1049] == 1000 and got[2002] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def brute_groups(rows, percent=75, width=5):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(k for k in sets if k is not None)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, sets


def copies(seed, groups=12, size=9, words=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [draw.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(words)]
        for _ in range(draw.randint(1, size)):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            if draw.random() < 0.4:
                text[10:10] = shared
            rows.append((len(rows), " ".join(text)))
    # Documents that are mostly the shared passage, with ends of their own.
    for k in range(25):
        rows.append((len(rows), " ".join(shared + [f"own{k}x{j}" for j in range(draw.randint(0, 12))])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("long_list", [2, 64])
def test_near_duplicates_are_those_of_all_pairs(spark, seed, long_list):
    rows = copies(seed)
    want, sets = brute_groups(rows)
    got = near_duplicates(frame(spark, rows), long_list=long_list, block=8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]][0]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [
        (5, text), (3, text), (3, text), (9, None), (8, ""), (7, " \t "), (6, "Tiny TEXT"), (4, "tiny text"), (2, "tiny"),
        (None, text), (11, "a b c d e f g h i"), (11, text), (12, "A b c d e f g h i"),
    ]
    got = sorted(near_duplicates(frame(spark, rows)).collect(), key=str)
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["component_id"] == 3 and by_id[6]["component_id"] == 4 and by_id[2]["component_id"] == 2
    assert {by_id[i]["n_shingles"] for i in (7, 8, 9)} == {0} and all(by_id[i]["kept"] for i in (7, 8, 9))
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    # Both texts of document 11 link it, so all that they link is one group.
    assert by_id[12]["component_id"] == 3 and {r["component_id"] for r in got if r["doc_id"] == 11} == {3}
    assert near_duplicates(frame(spark, [])).collect() == []


def brute_kept(rows, length=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - length + 1):
                key = tuple(w[j : j + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for j in range(len(w) - length + 1):
                if first[tuple(w[j : j + length])] < i:
                    gone |= set(range(j, j + length))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_are_those_of_all_windows(spark, seed):
    draw = random.Random(seed)
    passages = [[f"p{k}_{draw.randrange(6)}" for _ in range(draw.randint(10, 40))] for k in range(6)]
    rows = []
    for _ in range(60):
        text = []
        for _ in range(draw.randint(0, 6)):
            part = draw.choice(passages)
            low = draw.randrange(len(part))
            text += part[low : low + draw.randint(5, 40)] if draw.random() < 0.6 else [f"x{draw.randrange(4)}" for _ in range(draw.randint(1, 20))]
        rows.append((draw.randrange(1000), draw.choice([" ", "\n", "  "]).join(text)))
    rows += [(1, None), (2, ""), (None, rows[0][1]), (2000, rows[0][1]), (2000, rows[0][1]), (2000, rows[1][1]), (3, "same " * 50), (4, "same " * 60)]
    got = [
        (str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest())
        for r in remove_repeats(frame(spark, rows)).collect()
    ]
    assert sorted(got) == brute_kept(rows)


def test_repeats_of_an_empty_table(spark):
    assert remove_repeats(frame(spark, [])).collect() == []
