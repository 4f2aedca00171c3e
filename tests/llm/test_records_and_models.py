"""Archives, vectors, language models, URL filters and the pipeline."""

import base64
import hashlib
import itertools
import math
import random
import re

import numpy as np
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewarden.llm.langid import UNKNOWN, Model, identified_languages, identify, train, vocabulary, words_of
from tracewarden.llm.urls import PLAIN, RULES, SEEDS, Segmenter, _words, judged_urls, rule_of, segmented_hosts, url_parts, word_counts
from tracewarden.llm.vectors import near_duplicate_vectors, quantised, upper_bounds
from tracewarden.llm.warc import archived, read_warc, write_warc


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a/WARC/1.1", "plain"),
    (2, "http://b\r\nWARC/1.1\r\n", "x\n" + FAKE + FAKE + "WARC/1.0\r\n\r\n"),
    (3, None, None),
    (4, "http://c", ""),
    (5, "http://d", "WARC/\nWARC/\nWARC/WARC/1.1\r\nContent-Length: 5\r\n\r\n"),
    (6, "http://e", "plain"),
    (7, "http://f", "é\U0001f600\r\n\r\n\r\n"),
    (8, "http://g", "\nWARC/1.1\r\nContent-Length: 99999999999999999999999\r\n\r\n"),
    (9, "http://h", "\r\n\r\n" + FAKE * 30),
    (6, "http://e", "plain"),
    (None, "http://n", "plain"),
    (None, "http://n", "only null"),
    (1, "http://a", "plain"),
]
SCHEMA = "page_id long, url string, html string"


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        at = first.get(data, i) if len(data) >= least else i
        out.append((str(i), len(data), digest(data), "response" if at == i else "revisit", str(at) if at != i else None))
    return sorted(out, key=str)


def page(ref):
    return None if ref is None else (re.fullmatch("<urn:page:(.*)>", ref)[1] or "None")


@pytest.mark.parametrize("least", [0, 6])
@pytest.mark.parametrize("split", ["128m", "300b"])
def test_archives_read_back(spark, least, split):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], SCHEMA + ", payload string, first int").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = archived(pages, least).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = [(page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in got]
    assert sorted(rows, key=str) == expected(PAGES, least)
    held = {page(r["record_id"]): bytes(r["payload"]) for r in got if r["record_type"] == "response" and r["record_id"] != "<urn:page:>"}
    assert all(held[str(i)] == (html or "").encode() for i, _, html in PAGES if str(i) in held)
    assert all(r["header_digest"] == r["payload_digest"] for r in got)
    assert {page(r["record_id"]): r["uri"] for r in got}["2"] == "http://b%0D%0AWARC/1.1%0D%0A"


def test_a_broken_archive_raises(spark, tmp_path):
    path = str(tmp_path / "whole")
    write_warc(spark.createDataFrame(PAGES[:5], SCHEMA).coalesce(1), path)
    [part] = [p for p in (tmp_path / "whole").iterdir() if p.name.startswith("part")]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(part.read_bytes()[:-40])
    with pytest.raises(PySparkException, match="chain ends early"):
        read_warc(spark, str(tmp_path / "cut")).collect()
    (tmp_path / "old").mkdir()
    old = b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length:  4 \r\nContent-Type: text/plain\r\n\r\nWARC\r\n\r\n"
    (tmp_path / "old" / "a.warc").write_bytes(old * 3)
    (tmp_path / "old" / "empty.warc").write_bytes(b"")
    got = read_warc(spark, str(tmp_path / "old")).collect()
    assert [(r["record_type"], bytes(r["payload"]), r["payload_bytes"]) for r in got] == [("resource", b"WARC", 4)] * 3


def test_archives_of_an_empty_table(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds_hold_for_every_pair():
    draw = np.random.default_rng(3)
    unit = draw.normal(size=(300, 17)) * draw.choice([1, 1e-3, 50], size=(300, 17))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    coded = quantised(unit)
    assert (upper_bounds(coded, coded) >= unit @ unit.T - 1e-12).all()


@pytest.mark.parametrize("block", [7, 2048])
def test_vectors_link_as_all_pairs_do(spark, block):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(12, 16))
    rows = [(int(i), (base[i % 12] + draw.normal(scale=0.12, size=16)).astype(np.float32).tolist()) for i in draw.permutation(80)]
    rows += [(100 + i, rows[0][1]) for i in range(9)] + [(200, [x * 3.0 for x in rows[0][1]]), (201, [1e-30] * 16), (202, [3e-30] * 16)]
    odd = [(300, None), (301, []), (302, [0.0] * 16), (303, [math.nan] + [1.0] * 15), (304, [None] + [1.0] * 15), (305, [math.inf] * 16), (306, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, n int, code string")
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicate_vectors(df, block=block).collect()}
    ids = [i for i, _ in rows] + [306]
    vectors = [np.array(v, np.float32).astype(float) for _, v in rows]
    links = {i: set() for i in ids}
    for (i, v), (j, w) in itertools.combinations(zip(ids, vectors), 2):
        if v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.95:
            links[i].add(j)
            links[j].add(i)
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen), min(seen) == i)
    assert all(got[i] == (0, i, True) for i in range(300, 307)) and got[None] == (0, None, True)
    assert len(got) == len(rows) + len(odd)
    assert near_duplicate_vectors(df.limit(0)).collect() == []


def cuts(word):
    for k in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), k):
            yield [word[a:b] for a, b in zip((0, *at), (*at, len(word)))]


def test_forward_pass_sums_all_segmentations():
    pieces = ["▁a", "ab", "b", "▁ab", "ba", "a", "abab"]
    draw = np.random.default_rng(1)
    rates = draw.random((len(pieces) + 1, 3))
    model = Model(pieces, ["x", "y", "z"], rates)
    at = {p: i for i, p in enumerate(pieces)}
    words = ["abab", "a", "baab", "aqb"]
    for word, got in zip(words, model.word_scores(words)):
        want = np.zeros(3)
        for cut in cuts("▁" + word):
            # A letter is also an unknown piece of its own.
            ways = [[at[p] for _ in range(p in at)] + [len(pieces)] * (len(p) == 1) for p in cut]
            for way in itertools.product(*ways):
                want += rates[list(way)].prod(axis=0)
        assert np.exp(got) == pytest.approx(want)
    # Expected uses are those of the segmentations' posterior.
    uses = model.lattice(["aab"]).uses(rates, np.ones((1, 3)))
    want, whole = np.zeros_like(rates), np.zeros(3)
    for cut in cuts("▁aab"):
        for way in itertools.product(*[[at[p] for _ in range(p in at)] + [len(pieces)] * (len(p) == 1) for p in cut]):
            p = rates[list(way)].prod(axis=0)
            whole += p
            for i in way:
                want[i] += p
    assert uses == pytest.approx(want / whole)


def test_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = identified_languages(docs, sample=60).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog with words", "en"), ("der hund und die katze nicht", "de"), (None, "en"), ("123 !?", "de"), ("text", None)] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = train(docs)
    texts = ["", None, " 12 ", "DER HUND", "the dog", "x" * 3000, "漢字", "e\u0301" * 50]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "n int, text string, lang_pred string")
    got = identify(df, model)
    assert got.columns == ["n", "text", "lang_pred", "score"]
    by = {r["n"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == UNKNOWN and by[i]["score"] == 0 for i in (0, 1, 2))
    assert by[3]["lang_pred"] == "de" and by[4]["lang_pred"] == "en" and all(by[i]["lang_pred"] in ("de", "en") for i in (5, 6, 7))
    nothing = identify(df, train(docs.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {UNKNOWN}
    assert identify(df.limit(0), model).collect() == []
    assert words_of("Ab1c_d é") == ["ab", "c", "d", "é"] and len(vocabulary()) > 10_000


URLS = [
    "HTTP://WWW.Example.ORG/es/1?x#y", "x://example.org/en/1", "x://example.org/en/2", "x://org/", "x://notorg/", "x://a.org", "a.org/es/",
    None, "", "://", "x://a.com/fr/", "x://a.com/FR/", "x://a.com/de/a://b", "x://a.com?/de/", "x://a.com#/de/", "x://h\n/de/", "x://Éa.com/de/", "x://sub.example.org/es/",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = url_parts(F.col("url"))
    df = df.select("url", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path")))
    for r in df.collect():
        assert (r["host"], r["path"], r["rule"]) == judged(r["url"])[:3]


def test_names_are_cut_at_their_most_probable_words():
    counts = {"cheap": 5, "pills": 4, "chea": 1, "p": 30, "online": 9, "on": 50, "line": 20, "a": 40}
    cutter = Segmenter(counts)
    total = sum(counts.values())
    cost = lambda w: -math.log(counts[w] / total) if w in counts else (math.log(total) + math.log(26) if len(w) == 1 else math.inf)
    for name in ["cheappills", "online", "onlinea", "xcheapx", "", "pppp", "linepills"]:
        assert "".join(cutter.split(name)) == name
        if name:
            assert sum(map(cost, cutter.split(name))) == pytest.approx(min(sum(map(cost, c)) for c in cuts(name)))


def test_urls_are_judged(spark):
    draw = random.Random(4)
    good = ["garden", "river", "music", "school"]
    pages = [(i, f"http://{draw.choice(good)}{draw.choice(good)}.example.net/en/{i}", "<p>garden river music school cheap pills</p>") for i in range(60)]
    pages += [(100 + i, f"http://cheap{draw.choice(['pills', 'casino'])}.example.net/buy/{i}", None) for i in range(20)]
    pages += [(200, "http://cheapdeals.example.net/buy/9", ""), (201, "http://riverschool.example.net/en/3", "")]
    pages += [(300 + i, u, None) for i, u in enumerate(URLS)] + [(0, pages[0][1], None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, rule string")
    got = judged_urls(df).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["verdict"] == "allow" for i in range(60)) and by[201]["verdict"] == "allow"
    assert all(by[100 + i]["verdict"] == "block" for i in range(20)) and by[200]["verdict"] == "block"
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judged(u)
        assert (by[300 + i]["host"], by[300 + i]["path"], by[300 + i]["rule"]) == (host, path, rule)
        assert verdict in (None, by[300 + i]["verdict"])
    assert judged_urls(df.limit(0)).collect() == [] and "www" in PLAIN
    assert {r["verdict"] for r in judged_urls(df.filter("page_id < 60")).collect()} == {"allow"}


def test_rare_words_cut_hosts(spark):
    """Words count however many are more frequent; hosts are cut as by the whole list."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    common = spark.range(55_000).select(F.udf(name, "string")("id").alias("w"))
    common = common.select(F.concat_ws(" ", F.array_repeat("w", 2)).alias("html"))
    common = common.unionByName(spark.createDataFrame([("zebrafish quokka",), (None,)], "html string"))
    counts = {r["word"]: r["n"] for r in word_counts(common).collect()}
    assert len(counts) == 55_002 and counts["zebrafish"] == 1
    hosts = ["zebrafishquokka.example.net", "www.quokka-zebrafish.com", "cheapquokka.org", "1.2.3", "", "qx.example.net"]
    df = spark.createDataFrame([(h,) for h in [*hosts, hosts[0]]], "host string")
    got = {r["host"]: r["names"] for r in segmented_hosts(df, word_counts(common)).collect()}
    assert got[hosts[0]][:2] == ["zebrafish", "quokka"] and got[hosts[1]] == ["quokka", "zebrafish"]
    assert got[hosts[2]] == ["cheap", "quokka"] and "1.2.3" not in got and "" not in got
    whole = Segmenter(counts | {s: 1 for s in SEEDS if s not in counts})
    for host, names in got.items():
        labels = [x for x in re.split("[^a-z]+", host) if x and x not in PLAIN]
        assert names == [w for x in labels for w in _words(whole.split(x))]


def test_scores_are_those_of_the_tokens_themselves(spark):
    """No two tokens share a count, also where there are more than 2^18."""
    n = 300_000
    slug = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    base = spark.range(n).select(F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("http://garden.net/"), slug).alias("url"))
    few = [(1, "http://cheap.net/buy/deal"), (2, "http://cheap.net/buy"), (3, "http://garden.net/buy"), (4, "http://x"), (1, "http://cheap.net/buy/deal"), (5, None)]
    df = base.unionByName(spark.createDataFrame(few, "page_id long, url string")).withColumn("html", F.lit("garden"))
    got = judged_urls(df)
    assert got.count() == n + len(few)
    blocked, allowed = Counter(), Counter({f"slug{i}": 1 for i in range(n)})
    allowed.update({"h:garden": n + 1, "p:buy": 1, "h:x": 1})
    blocked.update({"h:cheap": 3, "p:buy": 3, "p:deal": 2})
    seen = len(set(blocked) | set(allowed))
    rate = lambda c, t: math.log((c[t] + 1) / (sum(c.values()) + seen))
    tokens = {1: ["h:cheap", "p:buy", "p:deal"], 2: ["h:cheap", "p:buy"], 3: ["h:garden", "p:buy"], 4: ["h:x"], 5: []}
    for r in got.filter("page_id is not null").collect():
        logit = math.log(4) - math.log(n + 3 + 1) + sum(rate(blocked, t) - rate(allowed, t) for t in tokens[r["page_id"]])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-9)


def test_pipeline_stages_keep_their_promises(spark, folder):
    import corpus_pipeline as pipeline
    from tracewarden.llm.decontaminate import contamination
    from tracewarden.llm.neardup import near_duplicates
    from tracewarden.llm.secrets import find_secrets
    from tracewarden.session import freeze

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, freeze(stage(spark, docs, folder))
        kept[name] = docs.count()
        if name != "source_mix":
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").isEmpty()
        if name == "near_dedup":
            assert near_duplicates(docs).filter("not kept").isEmpty()
            assert near_duplicates(before).filter("kept").count() == docs.count()
        if name == "decontamination":
            assert contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).filter("contaminated").isEmpty()
        if name == "secret_scan":
            assert docs.count() == before.count() and find_secrets(docs).filter("size(spans) > 0").isEmpty()
        if name == "source_mix":
            assert docs.columns[: len(columns)] == columns and docs.filter("text is null or taken = 0").isEmpty()
            assert docs.select(columns).exceptAll(before).isEmpty()
    assert kept["language_id"] > 0.9 * spark.read.parquet(f"{folder}/documents.parquet").count() and 0 < kept["source_mix"] <= kept["secret_scan"]
    assert sorted(map(tuple, pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_near_dedup_of_repeated_rows_and_clashing_names(spark, folder):
    import corpus_pipeline as pipeline

    words = lambda a, b: " ".join(f"word{i}" for i in range(a, b))
    rows = [
        (1, words(0, 60), "a"), (1, words(0, 60), "a"), (1, words(0, 60), "b"), (2, words(0, 61), "c"),
        (3, words(100, 160), "d"), (3, words(200, 260), "e"), (4, "", "f"), (4, "", "f"), (5, None, None),
        (None, words(0, 60), "g"), (None, words(0, 60), "g"), (6, words(300, 330), "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string").withColumn("kept", F.lit(1))
    got = pipeline.near_dedup(spark, docs, folder)
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"] or 0), r["text"] or "", r["gone"] or "") for r in got.collect())
    assert left == sorted(
        [(1, words(0, 60), "a"), (3, words(100, 160), "d"), (4, "", "f"), (5, "", "")] + [(0, words(0, 60), "g")] * 2 + [(6, words(300, 330), "h")]
    )
    assert pipeline.near_dedup(spark, docs.limit(0), folder).collect() == []
