"""URL filters: explicit rules, then naive Bayes over segmented names.

Host names run words together.  A unigram model of words, counted over the
pages' own texts, splits each label of a host at its most probable cuts
(Viterbi).  A multinomial naive Bayes model then scores the words of host and
path.  It is trained on all pages: those whose segmented host holds a seed word
are examples to block, the rest to allow.

All words count, however rare.  No task holds the list: each distinct label
gets those words that occur in it by a join on its substrings.  Naive Bayes
keeps its counts as a table of tokens, joined with the tokens of the pages.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.session import freeze

# Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of hosts that are examples to block.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "doubleclick", "gambling", "loan", "loans",
    "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "track", "tracker",
    "viagra", "warez", "xxx",
)
#: Labels and path words that tell nothing.
PLAIN = ("www", "m", "com", "net", "org", "html", "htm", "php", "index")
#: Letters of the words of texts.
SHORTEST, LONGEST = 2, 24


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, see :func:`judged_urls`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule, as text, that fits; null if none does."""
    out = F.lit(None).cast("string")
    for _, name, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)
        out = F.when(fits, name + begin).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """``(word, n)``: the words of the pages' visible texts."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z]+;", " ")
    words = F.split(F.lower(text), r"[^a-z]+")
    counts = pages.select(F.explode(words).alias("word")).filter(F.length("word").between(SHORTEST, LONGEST))
    return counts.groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Cuts names at their most probable words.

    A letter run that is no word costs as much as its letters, each rarer than
    the rarest word.  Of equal cuts, the one of the longer last word wins.
    ``total`` is the sum of all counts, where ``counts`` has a part of them.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.letter = math.log(total) + math.log(26)
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[name] = self._split(name)
        return self.known[name]

    def _split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            costs = [
                (best[start] + self.cost.get(name[start:end], self.letter if end - start == 1 else math.inf), start)
                for start in range(max(0, end - self.longest), end)
            ]
            cost, start = min(costs)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def _labels(host: Column) -> Column:
    """Runs of ASCII letters of a host's labels that tell something."""
    return F.filter(F.split(host, "[^a-z]+"), lambda w: (w != "") & ~w.isin(*PLAIN))


def _words(pieces: list[str]) -> list[str]:
    """Neighbouring single letters are one unknown word."""
    out, loose = [], ""
    for piece in pieces:
        if len(piece) == 1:
            loose += piece
            continue
        if loose:
            out.append(loose)
            loose = ""
        out.append(piece)
    return [*out, loose] if loose else out


def _parts(batches):
    """Adds ``word``, the substrings of ``label`` that may be words."""
    for batch in batches:
        labels = batch.column(0).to_pylist()
        parts = [
            {x[at : at + n] for n in range(SHORTEST, LONGEST + 1) for at in range(len(x) - n + 1)} for x in labels
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(list, parts), pa.list_(pa.string()))], names=["label", "word"])


def _pieces(total: int):
    """Cuts ``label`` at its most probable words of ``known``."""

    def task(batches):
        for batch in batches:
            labels, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [_words(Segmenter({k["word"]: k["n"] for k in ks}, total).split(x)) for x, ks in zip(labels, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], names=["label", "pieces"])

    return task


def segmented_hosts(hosts: DataFrame, counts: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(host, names)`` of each distinct host: the words of its labels.

    ``counts(word, n)`` are all words of the texts.  Seeds that texts lack
    count as often as the rarest word.
    """
    spark = hosts.sparkSession
    sums = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least")).first()
    least = max(1, sums["least"] or 1)
    known = {r["word"] for r in counts.filter(F.col("word").isin(*seeds)).select("word").collect()}
    lacking = [(seed, least) for seed in dict.fromkeys(seeds) if seed not in known]
    total = (sums["total"] or 0) + least * len(lacking)
    words = counts.select("word", "n").unionByName(spark.createDataFrame(lacking, "word string, n long"))
    labels = hosts.select(F.explode(_labels(F.col("host"))).alias("label")).distinct()
    parts = labels.mapInArrow(_parts, "label string, word array<string>")
    found = parts.select("label", F.explode("word").alias("word")).join(words, "word")
    found = found.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    nothing = F.array().cast("array<struct<word:string,n:bigint>>")
    each = labels.join(found, "label", "left").select("label", F.coalesce("known", nothing).alias("known"))
    pieces = each.mapInArrow(_pieces(total), "label string, pieces array<string>")
    placed = hosts.select("host").distinct().select("host", F.posexplode(_labels(F.col("host"))).alias("at", "label"))
    cut = placed.join(pieces, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "pieces"))).alias("cut"))
    return cut.select("host", F.flatten("cut.pieces").alias("names"))


def _tokens() -> Column:
    """Host words and path words; runs of digits are one word."""
    path = F.filter(
        F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*PLAIN)
    )
    return F.concat(
        F.transform("names", lambda w: F.concat(F.lit("h:"), w)), F.transform(path, lambda w: F.concat(F.lit("p:"), w))
    )


def token_gains(rows: DataFrame) -> DataFrame:
    """``(token, gain)`` of ``rows(bad, token)``, one row per use of a token:
    by how much it speaks for blocking, a logarithm of rates smoothed by one."""
    counts = freeze(
        rows.groupBy("token").agg(F.count_if("bad").alias("blocked"), F.count_if(~F.col("bad")).alias("allowed"))
    )
    sums = counts.agg(F.count("*").alias("seen"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")).first()
    seen = max(1, sums["seen"])
    rate = lambda c: F.log(F.col(c) + 1.0) - math.log((sums[c] or 0) + seen)
    # Decimals add up to the same in any order.
    return counts.select("token", (rate("blocked") - rate("allowed")).cast("decimal(20,15)").alias("gain"))


def judged_urls(pages: DataFrame, rules=RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, names, score)`` for each row of
    ``pages(page_id, url, html)``.

    The host lies between the first ``://`` and ``/``, ``?``, ``#`` or the end,
    with A-Z in lower case; the path follows up to ``?``, ``#`` or the end.  A
    null url or one without ``://`` has empty ones.  A rule fits its host and
    all subdomains where the path starts with the rule's; the longest wins and
    decides.  Else ``score``, the probability to block by naive Bayes, decides
    at one half; with no example of either verdict all pages are allowed.
    Rows are independent; null html has no words.  Other columns are not read.
    Runs jobs and writes tables to the shared folder while it is built.
    """
    spark = tidy(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    hosts = freeze(rows.select("host").distinct())
    named = freeze(segmented_hosts(hosts, freeze(word_counts(pages.select("html"))), seeds))
    names = F.coalesce("names", F.array().cast("array<string>")).alias("names")
    rows = rows.join(named, "host", "left").select("page_id", "host", "path", "rule", names)
    rows = freeze(rows.withColumn("row", F.monotonically_increasing_id()))
    bad = F.exists("names", lambda w: w.isin(*seeds))
    sizes = rows.groupBy(bad.alias("bad")).agg(F.count("*").alias("n")).collect()
    pages_of = {r["bad"]: r["n"] for r in sizes}
    prior = math.log(pages_of.get(True, 0) + 1) - math.log(pages_of.get(False, 0) + 1)
    logit = F.lit(-700.0)
    if pages_of.get(True) and pages_of.get(False):
        used = rows.select("row", bad.alias("bad"), F.explode(_tokens()).alias("token"))
        gained = used.select("row", "token").join(token_gains(used), "token").groupBy("row").agg(F.sum("gain").alias("gain"))
        rows = rows.join(gained, "row", "left")
        logit = F.greatest(F.least(F.coalesce(F.col("gain").cast("double"), F.lit(0.0)) + prior, F.lit(700.0)), F.lit(-700.0))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-logit)))
    named = {name + begin: verdict for verdict, name, begin in rules}
    by_rule = F.coalesce(*[F.when(F.col("rule") == rule, verdict) for rule, verdict in named.items()], F.lit(None).cast("string"))
    verdict = F.coalesce(by_rule, F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "names", "score")
