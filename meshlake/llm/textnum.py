"""Words and hashes of many texts at once, as NumPy arrays over code points.

A batch of texts is one array of code points.  Pieces of it (words, pre-tokens) are
numbered by their text: a prefix hash proposes which pieces are equal, and every piece is
then compared, character by character, with the first of its number.  Across batches a
piece is known by 128 bits that are not a polynomial of its characters (a chain of mixing
steps, or BLAKE2), made once for each distinct piece; runs of words are hashed by doubling,
in two lanes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U64 = np.uint64
#: Characters handled at once; a longer text is a batch of its own.
BATCH_CHARS = 400_000
#: Pieces of at most so many characters are hashed in step.
CHAINED = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept up to the size of a usual batch."""
    found = _tables.get(base)
    if found is None or len(found) < n:
        size = max(n, BATCH_CHARS + 2)
        found = np.ones(size, U64)
        have = 1
        while have < size:
            step = min(have, size - have)
            found[have : have + step] = found[:step] * U64(pow(base, have, 1 << 64))
            have += step
        if size <= 4 * BATCH_CHARS:
            _tables[base] = found
    return found[:n]


def _symbol_table() -> np.ndarray:
    if "cp" not in _tables:
        _tables["cp"] = mix(np.arange(1, 0x110001, dtype=U64))
    return _tables["cp"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Prefix:
    """64-bit hashes of pieces of some characters: equal for equal pieces, seldom for others.  Never proof of equality."""

    def __init__(self, cp: np.ndarray):
        n = len(cp)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_symbol_table()[cp] * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def piece(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        many = np.asarray(size).astype(U64) * U64(0x632BE59BD9B4E019)
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + many)

    def windows(self, size: int) -> np.ndarray:
        """``piece`` for every place with ``size`` characters, one or more, from it on."""
        out = self.sums[size:] - self.sums[:-size]
        out *= self.inverse[: len(out)]
        out += U64(size * 0x632BE59BD9B4E019 % (1 << 64))
        return mix(out)


def proposals(cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return Prefix(cp).piece(start, size)


def positions(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all characters of the pieces, in a row."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return np.repeat(start - (stop - size), size) + np.arange(total)


def numbered(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each piece, equal if and only if the pieces' characters are, and the first piece of each number."""
    size = end - start
    code, found = pd.factorize(proposals(cp, start, size))
    code = code.astype(np.int64)
    where = np.empty(len(found), np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    first = where[code]
    later = np.flatnonzero(first != np.arange(len(code)))
    wrong = size[first[later]] != size[later]
    same = later[~wrong]
    at = positions(start[same], size[same])
    differs = cp[at] != cp[at + np.repeat(start[first[same]] - start[same], size[same])]
    if wrong.any() or differs.any():
        owner = np.repeat(np.arange(len(same)), size[same])
        bad = np.union1d(later[wrong], same[np.unique(owner[differs])])
        new: dict[bytes, int] = {}
        more = where.tolist()
        for i in bad.tolist():
            key = cp[start[i] : end[i]].tobytes()
            if key not in new:
                new[key] = len(more)
                more.append(i)
            code[i] = new[key]
        where = np.array(more, np.int64)
    return code, where


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of ordered pairs; a bijection in either part."""
    return mix(mix(a + U64(salt)) ^ (b * U64(0xD1342543DE82EF95)))


def digests(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each piece: chained over its characters, all pieces in step;
    a long piece gets those of its BLAKE2 digest."""
    size = end - start
    out = np.zeros((len(size), 2), U64)
    short = np.flatnonzero(size <= CHAINED)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left = start[short], size[short]
    many = np.searchsorted(-left, -np.arange(1, CHAINED + 1), side="right")
    for lane in (0, 1):
        state = mix(left.astype(U64) + U64(0x9E3779B97F4A7C15 * (lane + 1) % (1 << 64)))
        for j, m in enumerate(many.tolist()):
            if not m:
                break
            state[:m] = pair(state[:m], _symbol_table()[cp[at[:m] + j]], 2 * j + lane)
        out[short, lane] = state
    for i in np.flatnonzero(size > CHAINED).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(cp[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out


class Sequence:
    """Hashes of runs of a sequence of 64-bit values, by doubling."""

    def __init__(self, values: np.ndarray, salt: int = 0):
        self.levels, self.salt = [values], salt

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(pair(last[: max(len(last) - half, 0)], last[half:], self.salt + len(self.levels)))
        return self.levels[k]

    def runs(self, start: np.ndarray, length: int) -> np.ndarray:
        """Of the runs of one length: two runs of a power of two cover each."""
        k = length.bit_length() - 1
        level = self._level(k)
        return pair(level[start], level[start + length - (1 << k)], self.salt + (length << 8))

    def piece(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), U64)
        for n in np.unique(length).tolist():
            own = length == n
            out[own] = self.runs(start[own], n)
        return out


def solid_runs(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of true values that cross no bound."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[bounds] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Words:
    """The words (runs of characters other than space and tab to return) of some texts.

    ``start`` and ``end`` are places in ``text``, the texts in a row; text i has the
    words ``first[i]`` to ``first[i + 1] - 1``.  ``code`` numbers the distinct words,
    ``where`` has a word of each number.
    """

    def __init__(self, texts: list[str], lower: bool = False):
        self.text = "".join(texts)
        cp = code_points(self.text)
        if lower and len(cp):
            cp = cp + (((cp >= 65) & (cp <= 90)).astype("<u4") << 5)
            self.text = cp.tobytes().decode("utf-32-le")
        self.doc = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.doc[1:])
        self.start, self.end = solid_runs(~((cp == 32) | ((cp >= 9) & (cp <= 13))), self.doc)
        self.first = np.searchsorted(self.start, self.doc)
        self.cp = cp
        self.code, self.where = numbered(cp, self.start, self.end)

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """Both numbers of each word."""
        own = digests(self.cp, self.start[self.where], self.end[self.where])
        return own[self.code, 0], own[self.code, 1]

    def words(self, i: int) -> list[str]:
        a, b = self.first[i], self.first[i + 1]
        return [self.text[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


def runs(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of rows whose texts have ``limit`` characters together, about."""
    at, run, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py() or ""
        if run and size + len(text) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield at, run


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
