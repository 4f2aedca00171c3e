"""Token counts of every prefix of a text, by dynamic programming.

A text is cut into words as the tokenizer cuts it.  Inside a word, merges never
cross a border of the final tokens, so the tokens of ``w[:i]`` are the tokens of
``w[:i - len(t)]`` and one last token ``t``.  ``t`` is the longest vocabulary
entry that ends at ``i`` and is *stable* behind the token before it: the merges
of the two together give just these two.  One step per character thus gives the
exact count at every prefix.  A word's last symbol bears the end mark, so there
are two tables: one for what goes on, one for what ends here.

New words are worked out together, letter by letter of all words at once, as
numpy columns.  Vocabulary entries lie in a trie read backwards, so those that
end at a letter are one node and its ancestors; whether two tokens stay apart is
remembered by pair.

Cutting, budgets and truncation are then look-ups; nothing is encoded again.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.llm.words import pieces, plain_strings
from tracewarden.operators.ordered import running_sums

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LIMIT = 2048
#: Pieces remembered by a task (twice so many at most), and their longest.
MEMORY, MEMORABLE = 1 << 19, 64
#: Words of at most so many bytes are worked out together, and so many bytes of
#: them at once; places for remembered pairs of tokens.
SHORT, AT_ONCE, PAIRS = 64, 1 << 20, 1 << 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Letters that a normal form may join to what is before them, and the one
#: letter that becomes two in lower case.
_UNSTEADY = r"\p{NFC_QC=N}\p{NFC_QC=M}\P{ccc=0}İ"
#: Letters that the two libraries' versions of Unicode may class differently.
_FOREIGN = r"[\p{Cn}\U00030000-\U0010FFFF]"
_STEPS = np.dtype("i")
_WIDTH = _STEPS.itemsize


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself
    if it can be printed, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Endings:
    """What tokens end at the letters of many words, by columns.

    Nodes of a trie of the tokens' bytes read backwards; a token is the number
    of its node, 0 is none.  ``kinds`` are the tokens that go on and those that
    end a word; ``stays(kind, before, token)`` says if two stay two.
    """

    def __init__(self, kinds: tuple[set[str], set[str]], stays):
        codes = {letter: byte for byte, letter in _byte_letters().items()}
        edges: dict[int, int] = {}
        above, sizes = [0], [0]
        self.names, self.stays = {}, stays
        own: list[set[int]] = [set(), set()]
        for kind, tokens in enumerate(kinds):
            for token in tokens:
                if not all(c in codes for c in token):
                    continue
                node = 0
                for c in reversed(token):
                    key = node << 8 | codes[c]
                    below = edges.get(key)
                    if below is None:
                        below = edges[key] = len(above)
                        above.append(node)
                        sizes.append(sizes[node] + 1)
                    node = below
                self.names[node] = token
                own[kind].add(node)
        #: Of each node and kind: the longest token at or above it, and above it.
        self.longest, self.shorter = [], []
        for nodes in own:
            found = [0] * len(above)
            for node in range(1, len(above)):  # a node comes after the one above
                found[node] = node if node in nodes else found[above[node]]
            self.longest.append(np.array(found, np.int64))
            self.shorter.append(self.longest[-1][above])
        self.sizes = np.array(sizes, np.int64)
        keys, below = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        used, column = np.unique(keys & 255, return_inverse=True)
        inner, row = np.unique(keys >> 8, return_inverse=True)
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        self.row = np.full(len(above), len(inner), np.int64)
        self.row[inner] = np.arange(len(inner))
        self.below = np.zeros((len(inner) + 1, len(used) + 1), np.int32)
        self.below[row, column + 1] = below
        self.pairs, self.apart = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _fits(self, kind: int, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Does each token stay behind the one before it, if there is one?"""
        out = before == 0
        at = np.flatnonzero(before)
        n = len(self.sizes)
        keys = (before[at] + kind * n) * n + token[at]
        slots = ((keys.view(np.uint64) * _SPREAD) >> np.uint64(40)).view(np.int64) % PAIRS
        held = self.pairs[slots] == keys
        out[at[held]] = self.apart[slots[held]]
        if not held.all():
            new, where = np.unique(keys[~held], return_inverse=True)
            names, left, right = self.names, (new // n - kind * n).tolist(), (new % n).tolist()
            apart = np.array([self.stays(kind, names[x], names[y]) for x, y in zip(left, right)])[where]
            out[at[~held]] = apart
            # Of pairs for one place the last is remembered, in both columns.
            self.pairs[slots[~held]], self.apart[slots[~held]] = keys[~held], apart
        return out

    def _last(self, kind: int, at: np.ndarray, ends: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """The last token of what ends at each place: the longest that stays."""
        token = self.longest[kind][ends]
        left = np.arange(len(at))
        while len(left):
            tried = token[left]
            if not tried.all():
                raise ValueError("no token ends a word")
            left = left[~self._fits(kind, lasts[at[left] - self.sizes[tried]], tried)]
            token[left] = self.shorter[kind][token[left]]
        return token

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each prefix that ends with a code point, word by word."""
        raw = np.frombuffer(b"\0" + b"\0".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        heads = np.cumsum(sizes + 1) - sizes - 1  # the place before each word
        letters = self.column[raw]
        letters[heads] = 0
        ends = self.below[self.row[0], letters]
        alive, back = np.flatnonzero(ends), 0
        while len(alive):
            back += 1
            found = self.below[self.row[ends[alive]], letters[alive - back]]
            alive, found = alive[found > 0], found[found > 0]
            ends[alive] = found
        lasts, counts = np.zeros(len(raw), np.int64), np.zeros(len(raw), _STEPS)
        order = np.argsort(-sizes, kind="stable")
        longer, places = -sizes[order], heads[order]
        for size in range(1, int(sizes.max())):
            at = places[: np.searchsorted(longer, -size)] + size
            token = self._last(0, at, ends[at], lasts)
            lasts[at], counts[at] = token, counts[at - self.sizes[token]] + 1
        whole = np.ones(len(raw), bool)  # the last byte of a code point
        whole[:-1] = (raw[1:] & 0xC0) != 0x80
        whole[heads] = False
        at = np.flatnonzero(whole)
        return counts[at - self.sizes[self._last(1, at, ends[at], lasts)]] + 1


class PrefixCounter:
    """Counts for one vocabulary file of the ``tokenizers`` library.

    Known are merges over byte letters, words cut by a pattern of plain strings
    and letter classes, and a normal form of NFC, white space and lower case;
    another file raises ``ValueError``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"] or ""
        self._read_merges(model)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        self._read_pattern(spec)
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.unsteady = regex.compile(f"[{_UNSTEADY}]")
        self.foreign = regex.compile(_FOREIGN)
        self.cluster = regex.compile(f"(?s:.)[{_UNSTEADY}--\\u0130]*", regex.V1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._library = None
        self.path = path
        #: A shorter string is not such a word cut short, but other words.
        self.fixed: dict[str, bytes] = {}
        for word in sorted(self.literals, key=len):
            steps = [int(self.text(word[:k])[-1]) for k in range(1, len(word))]
            self.fixed[word] = array("i", steps).tobytes() + self._along([word])[word][-_WIDTH:]

    def _read_pattern(self, spec: dict) -> None:
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cutter, letters = ((spec["pre_tokenizer"] or {}).get("pretokenizers", []) + [{}, {}])[:2]
        plain = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and cutter.get("type") == "Split" and cutter["behavior"] == "Removed" and cutter["invert"]
            and letters.get("type") == "ByteLevel" and not letters["use_regex"] and not letters["add_prefix_space"]
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
            and not spec["model"].get("ignore_merges") and not spec["model"]["continuing_subword_prefix"]
        )
        source = cutter["pattern"]["Regex"] if plain else ""
        parts = regex.findall(r"\[[^\]]*\]\+?|[^|\[\]]+", source)
        self.literals = {p for p in parts if not p.startswith("[")}
        if "|".join(parts) != source or not source or any(regex.search(r"[\\().*+?^$]", p) for p in self.literals):
            raise ValueError("a tokenizer of another kind")
        source = source.replace(r"\s", r"\p{White_Space}")
        self.word = regex.compile(source)
        self.cut = regex.compile(rf"(?:{source})\p{{White_Space}}*|\p{{White_Space}}+|(?s:.)")

    def _read_merges(self, model: dict) -> None:
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.made = {a + b: (a, b) for a, b in pairs}
        order = {whole: self.ranks[pair] for whole, pair in self.made.items()}
        if len(order) < len(pairs) or any(max(order.get(a, -1), order.get(b, -1)) > r for (a, b), r in self.ranks.items()):
            raise ValueError("merges that do not follow their parts")
        self.edges: tuple[dict, dict] = ({}, {})
        self.stable: dict[tuple[str, str], bool] = {}
        #: Letters of tokens that go on and of those that end a word, and the
        #: lengths of longer ones by their last three letters, longest first.
        marked = {t[: -len(self.mark)] for t in model["vocab"] if self.mark and t.endswith(self.mark)} - {""}
        self.tokens = {"": set(model["vocab"]) - {m + self.mark for m in marked}, self.mark: marked or set(model["vocab"])}
        self.sizes = {}
        for mark, tokens in self.tokens.items():
            ends: dict[str, set[int]] = {}
            for t in tokens:
                if len(t) > 2:
                    ends.setdefault(t[-3:], set()).add(len(t))
            self.sizes[mark] = {end: sorted(sizes, reverse=True) for end, sizes in ends.items()}
        self.near: dict[str, dict[str, list[int]]] = {mark: {} for mark in self.tokens}
        marks = ("", self.mark)
        self.endings = Endings(
            tuple(self.tokens[mark] for mark in marks), lambda kind, before, token: self._stays(before, token + marks[kind])
        )

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at the left (0) or right (1) edge of a token while it is
        merged: from its letter to itself, each with the rank that ends it."""
        found = self.edges[side].get(token)
        if found is None:
            found, own, until = [], token, float("inf")
            while own:
                found.insert(0, (own, until))
                parts = self.made.get(own)
                own, until = (parts[side], self.ranks[parts]) if parts else ("", 0)
            self.edges[side][token] = found
        return found

    def _stays(self, before: str, token: str) -> bool:
        """Do two neighbouring tokens stay two when their letters are merged?

        Merges go by rank, then from the left: what stands at the edges is
        merged across only where that comes before either edge grows.
        """
        left, right = self._edge(before, 1), self._edge(token, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _finder(self, mark: str):
        """Function for the letters of the last token of ``word[:end]``, which
        goes on or bears the mark; ``lasts`` are those that go on."""
        tokens, longer, near, stable, stays = self.tokens[mark], self.sizes[mark], self.near[mark], self.stable, self._stays

        def last(word: str, end: int, lasts: list[str]) -> str:
            tail = word[end - 3 : end] if end > 2 else word[:end]
            sizes = near.get(tail)
            if sizes is None:
                sizes = near[tail] = longer.get(tail, []) + [k for k in (2, 1) if k <= end and tail[-k:] in tokens]
            for size in sizes:
                letters = word[end - size : end] if size <= end else ""
                if letters in tokens:
                    before = lasts[end - size]
                    if not before:
                        return letters
                    key = before, letters + mark
                    fits = stable.get(key)
                    if fits is None:
                        fits = stable[key] = stays(*key)
                    if fits:
                        return letters
            raise ValueError(f"no token ends {word[:end]!r}")

        return last

    def _along(self, words: Iterable[str]) -> dict[str, bytes]:
        """Tokens of each prefix of some words, by code points, as the bytes of
        an array."""
        coded = [(word, word.encode()) for word in words]
        out = self._along_long([word for word, code in coded if len(code) > SHORT])
        coded = [(word, code) for word, code in coded if 0 < len(code) <= SHORT]
        for low in range(0, len(coded), AT_ONCE // SHORT):
            part = coded[low : low + AT_ONCE // SHORT]
            steps, start = self.endings.counts([code for _, code in part]).tobytes(), 0
            for word, _ in part:
                stop = start + _WIDTH * len(word)
                out[word] = steps[start:stop]
                start = stop
        return out

    def _along_long(self, words: list[str]) -> dict[str, bytes]:
        """:meth:`_along` of long words, letter by letter.

        Words are taken in order, so that what two neighbours begin with in
        common is worked out once.
        """
        table = self.letters
        coded = sorted(
            (w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(table), w) for w in words
        )
        lasts, counts, ended, held, out = [""], [0], [0], "", {}
        going, ending = self._finder(""), self._finder(self.mark)
        for letters, word in coded:
            same = 0
            for x, y in zip(held, letters):
                if x != y:
                    break
                same += 1
            del lasts[min(same + 1, max(1, len(held))) :], ended[same + 1 :]
            del counts[len(lasts) :]
            for end in range(len(lasts), len(letters)):
                token = going(letters, end, lasts)
                lasts.append(token)
                counts.append(counts[end - len(token)] + 1)
            for end in range(len(ended), len(letters) + 1):
                ended.append(counts[end - len(ending(letters, end, lasts))] + 1)
            held = letters
            if len(word) == len(letters):
                out[word] = array("i", ended[1:]).tobytes()
            else:
                out[word] = array("i", [ended[k] for k in accumulate(len(c.encode()) for c in word)]).tobytes()
        return out

    def _learn(self, found: set[str]) -> dict[str, bytes]:
        """Counts along pieces: words with the white space behind them.

        Short ones are remembered, and those in use longer than others."""
        known, older, ends, along, learned = self.known, self.older, {}, {}, {}
        for piece in found.difference(known):
            if piece in older:
                known[piece] = older[piece]
                continue
            held = self.word.match(piece)
            end = ends[piece] = held.end() if held else 0
            word = piece[:end]
            # Often the word is known, but with other white space behind it.
            steps = known.get(word) or known.get(word + " ")
            if steps and end:
                along[word] = steps[: _WIDTH * end]
        new = {p[:end] for p, end in ends.items() if end}
        along |= self._along(new.difference(self.literals, along))
        for piece, end in ends.items():
            kept = known if len(piece) <= MEMORABLE else learned
            kept[piece] = self._padded(piece, end, along)
        return learned

    def _padded(self, piece: str, end: int, along: dict[str, bytes]) -> bytes:
        word = piece[:end]
        if not word:
            return bytes(_WIDTH * len(piece))
        steps = self.fixed[word] if word in self.literals else along[word]
        return steps + steps[-_WIDTH:] * (len(piece) - end)

    def _plain(self, text: str) -> np.ndarray:
        """Counts along a text that is in normal form."""
        if not text:
            return np.empty(0, _STEPS)
        if not text.isascii() and self.foreign.search(text):
            words = [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(text)]
            stops = [start for start, _ in words[1:]] + [len(text)]
            along = self._along({text[start:end] for start, end in words} - self.literals)
            head = text[: words[0][0]] if words else text
            found = [self._padded(head, 0, along)]
            for (start, end), stop in zip(words, stops):
                found.append(self._padded(text[start:stop], end - start, along))
            return self._joined(found)
        return self._of_parts(self.cut.findall(text))

    def _of_parts(self, parts: list[str]) -> np.ndarray:
        long = self._learn(set(parts))
        out = self._joined([self.known.get(p) or long[p] for p in parts])
        self._forget()
        return out

    def _forget(self) -> None:
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        for table in (self.stable, *self.near.values()):
            if len(table) > 4 * MEMORY:
                table.clear()

    @staticmethod
    def _joined(found: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // _WIDTH
        out = np.frombuffer(b"".join(found), _STEPS)
        sizes = sizes[sizes > 0]
        totals = out[np.cumsum(sizes) - 1]
        return out + np.repeat(np.cumsum(totals, dtype=_STEPS) - totals, sizes)

    def _unmarked(self, text: str) -> np.ndarray:
        """Counts along a text in which special strings are ordinary."""
        if text.isascii():
            return self._plain(text.lower())
        if not self.unsteady.search(text):
            return self._plain(text.replace("Σ", "σ").lower())  # else some become ς
        clusters = self.cluster.findall(text)
        normal = [self._normalised(c) for c in clusters]
        along = np.concatenate([np.zeros(1, _STEPS), self._plain("".join(normal))])
        ends = along[np.cumsum([len(n) for n in normal])]
        sizes = np.array([len(c) for c in clusters])
        # A cut inside a cluster counts as the cut before it.
        out = np.repeat(np.concatenate([np.zeros(1, _STEPS), ends[:-1]]), sizes)
        out[np.cumsum(sizes) - 1] = ends
        return out

    def _normalised(self, cluster: str) -> str:
        if len(cluster) == 1 and cluster.isascii():
            return cluster.lower()
        return self.library.normalizer.normalize_str(cluster)

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """:meth:`text` of each; what their words have in common is done once."""
        parts, found = {}, set()
        for k, text in enumerate(texts):
            steady = text.isascii() or not (self.unsteady.search(text) or self.foreign.search(text))
            if steady and not self.special.search(text):
                parts[k] = self.cut.findall(text.replace("Σ", "σ").lower())
                found.update(parts[k])
        long, known = self._learn(found), self.known
        known.update(long)  # until all are looked up
        out = iter([self._joined(list(map(known.__getitem__, p))) for p in parts.values()])
        for piece in long:
            del known[piece]
        self._forget()
        return [next(out) if k in parts else self.text(text) for k, text in enumerate(texts)]

    def text(self, text: str) -> np.ndarray:
        """Tokens of ``text[:1]``, ``text[:2]``, ..., the whole text.

        Exact at every prefix that does not cut a letter from the combining
        marks behind it; such a cut counts as the one before the letter.
        """
        at, base, out = 0, 0, []
        for special in self.special.finditer(text):
            # Until it is whole, a special string is ordinary text.
            along = self._unmarked(text[at : special.end() - 1]) + base
            size = special.start() - at
            base = (int(along[size - 1]) if size else base) + 1
            out += [along, np.array([base], _STEPS)]
            at = special.end()
        rest = self._unmarked(text[at:])
        return np.concatenate([*out, rest + np.array(base, _STEPS)]) if out else rest


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each file in a Python worker."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``counts``, from ``text``.

    ``counts`` holds the number of tokens of the first 1, 2, ... code points,
    as the library gives them without added tokens; special strings inside a
    text are one token each.  It is exact at every cut between letters; see
    :meth:`PrefixCounter.text`.  A null or empty text has no bytes, no tokens
    and an empty ``counts``.  Rows stay as they are, repeated ones too; columns
    of the three names are replaced.  ``path`` must be readable on every
    executor.
    """
    tidy(docs.sparkSession)
    own = ("n_bytes", "n_tokens", "counts")
    kept = [c for c in docs.columns if c not in own]

    def task(batches):
        count = counter(path)
        for batch in batches:
            texts = plain_strings(batch, text).cast(pa.large_string()).fill_null("")
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            for low, high in pieces(texts):
                part = texts.slice(low, high - low).to_pylist()
                along = count.texts(part)
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in along])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(along)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(low, high - low) for c in columns],
                        pa.array([len(t.encode()) for t in part], pa.int64()),
                        pa.array([int(a[-1]) if len(a) else 0 for a in along], pa.int64()),
                        lists,
                    ],
                    names=[*kept, *own],
                )

    added = {"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "counts": F.array(F.lit(0))}
    schema = docs.select(kept).limit(0).withColumns(added).schema
    return docs.mapInArrow(task, schema)


def prefix_tokens(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points; of the whole text beyond it."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts))
    return F.when(at < 1, F.lit(0)).otherwise(F.get(counts, at - 1))


def fitting_chars(counts: Column, limit: Column | int) -> Column:
    """Length of the longest prefix of at most ``limit`` tokens."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    from_end = F.array_position(F.reverse(F.transform(counts, lambda c: c <= limit)), True)
    return F.when(from_end > 0, F.size(counts) - from_end + 1).otherwise(F.lit(0)).cast("int")


def truncated(text: Column, counts: Column, limit: Column | int) -> Column:
    """The longest prefix of ``text`` of at most ``limit`` tokens; null: empty."""
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), fitting_chars(counts, limit))


def within_budget(counted: DataFrame, key: str, budget: int) -> DataFrame:
    """Rows of :func:`prefix_counts` with ``fit_chars``: what fits of each into
    ``budget`` tokens, in the order of ``key``.

    Rows before the edge fit whole, the one at the edge up to its longest
    fitting prefix, those after it not at all.  Equal keys follow ``n_tokens``;
    equal rows in any order.  Sums run over ranges of all rows, never in one
    task.  Runs jobs while it is built.
    """
    rows = counted.withColumn("_row", F.monotonically_increasing_id())
    sums = running_sums(
        rows.select(F.lit(0).alias("_all"), key, "n_tokens", "_row"), ["_all"], [key, "n_tokens", "_row"], {"_end": F.col("n_tokens")}
    )
    left = F.lit(budget) - F.col("_end") + F.col("n_tokens")
    fit = F.when(left < 0, F.lit(0)).when(F.col("n_tokens") <= left, F.size("counts"))
    joined = rows.join(sums.select("_row", "_end"), "_row")
    return joined.withColumn("fit_chars", fit.otherwise(fitting_chars(F.col("counts"), left))).drop("_row", "_end")
