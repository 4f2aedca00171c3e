"""Words of Arrow text columns as 64-bit hashes, without a string object per word.

Helpers for tasks: they see one Arrow batch, cut it into pieces of bounded
bytes, and hash all its words with a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that run to the next white space.
NON_SPACE = ~_SPACE
#: Bytes of words of ASCII digits, lower-case letters and anything not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_SAME = np.arange(256, dtype=np.uint8)

_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_GRAM_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
PIECE_BYTES = 1 << 20


class Words(NamedTuple):
    """Words of some documents: hashes, byte ranges, and each document's range."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def of(self, k: int) -> slice:
        return slice(int(self.bounds[k]), int(self.bounds[k + 1]))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer text."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > limit:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def split_words(texts: pa.Array, word_bytes: np.ndarray, fold: bool) -> Words:
    """The words of each text; a null has none.  ``fold`` lower-cases A-Z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, held = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[places[0] : places[-1]] if held else np.empty(0, np.uint8)
    places = places - places[0]
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64), data)
    data = (_FOLD if fold else _SAME)[data]
    inside = word_bytes[data]
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[places] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first_of_text[1:n]
    stops[:-1] &= ~inside[1:] | first_of_text[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64) * _BYTE[7])
    return Words(hashes, starts, ends, np.searchsorted(starts, places), data)


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of ``n`` words; different seeds are independent."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    step = _GRAM_STEPS[seed]
    terms = mixed(hashes + step) if seed else hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * step + terms[k : len(hashes) - n + 1 + k]
    return mixed(out + np.uint64(n))


def sequence_print(hashes: np.ndarray, seed: int = 0) -> int:
    """A hash of a whole sequence of words, as a signed number."""
    terms = mixed(hashes + _GRAM_STEPS[seed]) if seed else hashes
    total = (terms * _power_tables(len(hashes))[0]).sum(dtype=np.uint64)
    return int(mixed(np.array([total], np.uint64) + np.uint64(len(hashes))).view(np.int64)[0])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of ``n`` words, sorted; a shorter text is one run.

    Hashes keep 63 bits, so that signed and unsigned order agree.
    """
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    return np.unique(grams(hashes, min(n, len(hashes))) >> np.uint64(1))


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run that begins at ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges)[:n] > 0


def plain_strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
