"""The byte-level BPE pre-tokens of many texts at once, and their ids.

The pre-token pattern (``public_tokenizers.PATTERN``) is a union of runs of one
character class with an optional space before, contractions, and white space that
leaves its last character to what follows.  So pre-token starts follow from the
classes of neighbouring characters and are found for a whole batch with array
operations; equal pre-tokens of a batch, compared by their text, are looked up once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import tiktoken

from .textnum import code_points, numbered, proposals

#: Pre-tokens a worker remembers; later ones are looked up again in each batch.
REMEMBERED = 250_000
#: Characters whose pre-tokens are looked up together: the more, the fewer distinct ones.
TOGETHER = 800_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of every code point, read off the library that defines the ids, so
    that both know the same version of Unicode: its encoding by single bytes of all
    characters gives those that match a class."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        bytes_only = {bytes([i]): i for i in range(256)}
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            probe = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
            found = bytes(probe.encode_ordinary(every)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
        _classes.append(table)
    return _classes[0]


class PreTokens:
    """``start`` and ``end`` of all pre-tokens in ``text``, the texts in a row; text i
    has those from ``first[i]`` to ``first[i + 1] - 1``."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        cp = code_points(self.text)
        doc = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=doc[1:])
        n = len(cp)
        kind = _class_table()[cp]
        edge = np.zeros(n + 1, bool)
        edge[doc] = True
        head = edge[:-1].copy()  # starts of runs of one class
        head[1:] |= kind[1:] != kind[:-1]
        white, blank = kind == SPACE, cp == 32
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1] & ~edge[1:-1]
        before_solid = np.zeros(n, bool)
        before_solid[:-1] = ~white[1:] & ~edge[1:-1]
        start = head & (white | ~after_blank)
        start |= white & before_solid
        self._contractions(cp, kind, edge, start, head & ~after_blank)
        self.start = np.flatnonzero(start)
        self.end = np.append(self.start[1:], n) if len(self.start) else self.start
        self.first = np.searchsorted(self.start, doc)
        self.code, self.where = numbered(cp, self.start, self.end)
        #: A hash of each distinct pre-token, to be confirmed by its text.
        self.hash = proposals(cp, self.start, self.end - self.start)[self.where]

    @staticmethod
    def _contractions(cp, kind, edge, start, free) -> None:
        """'s 't 'm 'd 're 've 'll are pre-tokens where an apostrophe starts one; letters go on behind them."""
        at = np.flatnonzero((cp == 39) & free)
        at = at[at + 1 < len(cp)]
        at = at[~edge[at + 1]]
        if not len(at):
            return
        one = np.isin(cp[at + 1], [ord(c) for c in "stmd"])
        two = np.zeros(len(at), bool)
        wide = (at + 2 < len(cp)) & ~edge[np.minimum(at + 2, len(cp))]
        for a, b in ("re", "ve", "ll"):
            two[wide] |= (cp[at[wide] + 1] == ord(a)) & (cp[at[wide] + 2] == ord(b))
        for found, size in ((at[one], 2), (at[two & ~one], 3)):
            start[found + 1] = False
            stop = found + size
            stop = stop[stop < len(cp)]
            # A space behind the letters starts a pre-token or not by its own rule, any other character does.
            start[stop[kind[stop] != SPACE]] = True


def expand(values: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``values[first[p]:first[p + 1]]`` for each p of ``pick`` in a row, and their ends."""
    size = first[pick + 1] - first[pick]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return values[np.repeat(first[pick] - (stop - size), size) + np.arange(total)], stop


class Encoder:
    """Ids of texts.  ``whole`` resolves distinct pre-tokens at once (hash, texts -> id or
    -1) and may be absent; ``rest`` gives the ids of each of a list of pre-tokens.

    ``known`` numbers the remembered pre-tokens; the ids of number i are ``values`` from
    ``bounds[i]`` to ``bounds[i + 1]``.  Behind them stand those of the batch at hand."""

    def __init__(self, rest: Callable[[list[str]], list[list[int]]], whole: Callable | None = None, remembered: int = REMEMBERED):
        self._rest, self._whole, self._known, self._remembered = rest, whole, {}, remembered
        self._values, self._bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _number(self, pieces: list[str]) -> np.ndarray:
        """The numbers of the pre-tokens; they hold until the next call."""
        known = self._known
        number = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        short = np.fromiter((len(pieces[i]) <= 64 for i in missing.tolist()), bool, len(missing))
        missing = np.concatenate([missing[short], missing[~short]])
        asked = [pieces[i] for i in missing.tolist()]
        found = self._rest(asked)
        old = len(known)
        number[missing] = np.arange(old, old + len(asked))
        stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + self._bounds[old]
        self._bounds = _longer(self._bounds, old + 1, len(stop))
        self._bounds[old + 1 : old + 1 + len(stop)] = stop
        begin, end = int(self._bounds[old]), int(stop[-1])
        self._values = _longer(self._values, begin, end - begin)
        self._values[begin:end] = np.fromiter(chain.from_iterable(found), np.uint32, end - begin)
        keep = min(int(short.sum()), self._remembered - old)
        known.update(zip(asked[:keep], range(old, old + keep)))
        return number

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the place where each text's begin (and the last one's end)."""
        pre = PreTokens(texts)
        code, where = pre.code, pre.where
        if not len(where):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        text = pre.text
        pieces = [text[s:e] for s, e in zip(pre.start[where].tolist(), pre.end[where].tolist())]
        if self._whole is None:
            number = self._number(pieces)
            first = np.append(0, np.cumsum(self._bounds[number + 1] - self._bounds[number]))
            flat, _ = expand(self._values, self._bounds, number)
        else:
            rank = np.asarray(self._whole(pre.hash, pieces), np.int64)
            parts = rank < 0
            number = self._number([pieces[i] for i in np.flatnonzero(parts).tolist()])
            size = np.ones(len(rank), np.int64)
            size[parts] = self._bounds[number + 1] - self._bounds[number]
            first = np.append(0, np.cumsum(size))
            flat = np.repeat(rank, size).astype(np.uint32)
            flat[np.repeat(parts, size)] = expand(self._values, self._bounds, number)[0]
        out, stop = expand(flat, first, code)
        bounds = np.append(0, stop)
        return out, bounds[pre.first]


def _longer(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array with room for ``more`` values behind those used."""
    if used + more <= len(array):
        return array
    out = np.zeros((used + more) * 3 // 2, array.dtype)
    out[:used] = array[:used]
    return out
