"""Runs: stretches of words that repeat with a period, found with suffix trees.

A stretch's longest common extension forwards is the depth of a lowest common ancestor in
its suffix tree, backwards that in the tree of its reversal.  The trees are built online
(Ukkonen); a tour around each, kept as the least depth between neighbouring leaves,
answers ancestors in constant time from a table of minima over powers of two.  Every run
has a Lyndon word at its root, under the order of the words or under its reverse, and the
longest Lyndon word from a place ends where the next suffix in that order is less; so each place
gives two candidates, which are extended both ways.  All runs are found among them.

A sieve goes before: a run of period q, ``TIMES`` periods long, has words that equal those
q before for 3 q places in a row; beyond ``SMALL`` words of period it repeats all pieces of
``SMALL`` words at a distance of at most q.  Stretches where neither happens hold no run and get no tree; a stretch
that passes is widened so that it holds any such run whole, with its neighbours.  Stretches
share a tree until they have ``TOGETHER`` words, each ended by a symbol of its own.

A run here is maximal, has its smallest period q and is at least ``TIMES`` q and ``LEAST``
words long.  Runs may overlap.

Cases: a null text has no words; a text without words, and one without a run, has no run
and keeps its words; rows that repeat are handled each; rows without doc_id get no
planted period; an empty table gives no rows; further columns pass through ``collapse``.
A long text is one batch: about 60 bytes a character, and about 1 kB for each word of a
stretch that passes the sieve.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import Sequence, Words, runs

LEAST = 6
TIMES = 4
#: Periods up to this many words are sieved one by one, longer ones by pieces of this many words.
SMALL = 8
#: Words of stretches that share a tree, about.
TOGETHER = 20_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_tree(symbols: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """The tree of a sequence whose last symbol occurs once.

    Edges map (inner node, first symbol), packed as node * width + symbol, to an inner node or,
    complemented, to the leaf of a suffix; inner node v is reached by symbols start[v] to end[v].
    """
    width = max(symbols) + 1
    edges: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    leaves: list[int] = []  # where the edge to each leaf begins
    node = edge = length = left = 0
    for i, symbol in enumerate(symbols):
        left += 1
        fresh = 0
        while left:
            if not length:
                edge = i
            key = node * width + symbols[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = ~len(leaves)
                leaves.append(i)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                if child >= 0:
                    first = start[child]
                    size = end[child] - first
                    if length >= size:
                        node = child
                        length -= size
                        edge += size
                        continue
                else:
                    first = leaves[~child]
                there = symbols[first + length]
                if there == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(start)
                start.append(first)
                end.append(first + length)
                link.append(0)
                edges[key] = inner
                edges[inner * width + symbol] = ~len(leaves)
                leaves.append(i)
                if child >= 0:
                    start[child] = first + length
                else:
                    leaves[~child] = first + length
                edges[inner * width + there] = child
                if fresh:
                    link[fresh] = inner
                fresh = inner
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return edges, start, end, width


class Extensions:
    """Common extensions of the suffixes of a sequence, and the suffixes' order."""

    def __init__(self, symbols: list[int]):
        edges, start, end, width = suffix_tree(symbols)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        child = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        first = np.searchsorted(keys[order], np.arange(len(start) + 1) * width).tolist()
        depth = [0] * len(start)
        leaves, between = [], []  # the tour: leaves in order, and the least depth before each
        low = 0
        stack = [(0, first[0], first[1])]
        while stack:
            node, at, stop = stack.pop()
            if at == stop:
                continue
            if at > first[node]:
                low = depth[node]
            stack.append((node, at + 1, stop))
            below = child[at]
            if below < 0:
                leaves.append(~below)
                between.append(low)
                low = depth[node]
            else:
                depth[below] = depth[node] + end[below] - start[below]
                stack.append((below, first[below], first[below + 1]))
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        minima = [np.array(between, np.int32)]
        step = 1
        while 2 * step <= len(leaves):
            last = minima[-1]
            minima.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        self.minima = minima

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the suffixes at a and at b, different ones, agree."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.minima[k][low[own]], self.minima[k][high[own] + 1 - (1 << k)])
        return out


def next_less(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value; the length if there is none."""
    out, stack = [len(rank)] * len(rank), []
    for i, value in enumerate(rank):
        while stack and rank[stack[-1]] > value:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def find_runs(symbols: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of the runs of a sequence whose last symbol occurs once."""
    n = len(symbols)
    forward = Extensions(symbols.tolist())
    ends = int(symbols.max()) + 1
    backward = Extensions([*symbols[::-1].tolist(), ends])
    rank = forward.rank.tolist()
    found = []
    for order in (rank, [-r for r in rank]):
        root = next_less(order)
        at = np.flatnonzero(root < n)
        root = root[at]
        right = forward.common(at, root)
        left = np.zeros(len(at), np.int64)
        inner = at > 0
        left[inner] = backward.common(n - at[inner], n - root[inner])
        found.append(np.stack([at - left, root + right, root - at], axis=1))
    every = np.concatenate(found)
    size = every[:, 1] - every[:, 0]
    return np.unique(every[size >= np.maximum(least, times * every[:, 2])], axis=0)


def _long(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place, exclusive, of the runs of at least so many true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def sieve(code: np.ndarray, doc: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the words of some texts outside of which no run lies, in order; ``doc`` is each
    word's text and ``first`` the texts' first words, and where the last one ends."""
    n = len(code)
    spans = []
    for q in range(1, min(SMALL, n - 1) + 1):
        same = np.zeros(n, bool)
        same[q:] = (code[q:] == code[:-q]) & (doc[q:] == doc[:-q])
        start, end = _long(same, max(LEAST - q, (TIMES - 1) * q))
        spans.append((start - q, end))
    if n > TIMES * SMALL:
        pieces = Sequence(code.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32))).runs(np.arange(n - SMALL + 1), SMALL)
        order = np.argsort(pieces, kind="stable")
        apart = np.full(n, n, np.int64)
        twin = pieces[order[1:]] == pieces[order[:-1]]
        apart[order[1:][twin]] = (order[1:] - order[:-1])[twin]
        reach = 2 * SMALL
        while reach // 2 < n // TIMES:
            start, end = _long(apart <= reach, (TIMES - 1) * (reach // 2 + 1) - SMALL + 1)
            spans.append((start - reach, end + SMALL - 1))
            if not len(start) and not (apart > reach)[apart < n].any():
                break
            reach *= 2
    start, end = (np.concatenate([s[k] for s in spans]) if spans else np.zeros(0, np.int64) for k in (0, 1))
    owner = doc[np.minimum(end - 1, n - 1)] if len(end) else end
    low, high = np.maximum(start - 1, first[owner]), np.minimum(end + 1, first[owner + 1])
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist())):
        if out and a < out[-1][1] and doc[a] == doc[out[-1][0]]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def runs_of(code: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of the texts' words, by text, start and period."""
    out, batch, size = [], [], 0

    def flush() -> None:
        starts = np.array([a for a, _ in batch])
        lengths = np.array([b - a for a, b in batch])
        places = np.concatenate([np.arange(a, b) for a, b in batch])
        known, symbols = np.unique(code[places], return_inverse=True)
        ended = np.insert(symbols, np.cumsum(lengths), len(known) + np.arange(len(batch)))
        found = find_runs(ended.astype(np.int64))
        base = np.cumsum(lengths + 1) - lengths - 1
        which = np.searchsorted(base, found[:, 0], side="right") - 1
        found[:, :2] += (starts - base)[which][:, None]
        out.append(found)

    for a, b in sieve(code, doc, first):
        batch.append((a, b))
        size += b - a
        if size >= TOGETHER:
            flush()
            batch, size = [], 0
    if batch:
        flush()
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the period that the check plants in every tenth document, about."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _places(words: Words, ids: list[int | None] | None) -> tuple[np.ndarray, set[int]]:
    """The word that stands at each place, and the texts with a planted period."""
    place, changed = np.arange(len(words.code)), set()
    for i, doc_id in enumerate(ids or ()):
        a, b = int(words.first[i]), int(words.first[i + 1])
        plan = planted(doc_id, b - a)
        if plan:
            from_, period = plan
            place[a + from_ : b] = a + from_ + np.arange(b - a - from_) % period
            changed.add(i)
    return place, changed


def _batches(batch: pa.RecordBatch, ids: list[int | None] | None):
    """(row, texts, words, places, texts changed by planting, runs, first run of each text) of some texts at a time."""
    for row, texts in runs(batch):
        words = Words(texts)
        place, changed = _places(words, None if ids is None else ids[row : row + len(texts)])
        doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        found = runs_of(words.code[place], doc, words.first) if len(place) else np.zeros((0, 3), np.int64)
        yield row, texts, words, place, changed, found, np.searchsorted(found[:, 0], words.first)


def _collapsed(text: str, i: int, words: Words, place: np.ndarray, changed: bool, own: np.ndarray) -> str:
    """The words of text i that stay, joined by spaces; ``own`` are its runs, by its own words."""
    if not changed and not len(own):
        return " ".join(_WORD.findall(text))
    a, b = int(words.first[i]), int(words.first[i + 1])
    stay = place[a:b][kept_words(own, b - a)]
    return " ".join([words.text[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period (in words) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, texts, words, _, _, found, at in _batches(batch, None):
                owner = np.repeat(np.arange(len(texts)), np.diff(at))
                columns = [ids.take(pa.array(row + owner)), pa.array(found[:, 0] - words.first[owner]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "period"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """The rows with one period of every run; texts with a run become their kept words joined by spaces, others stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("text").to_pylist()
            for row, texts, words, place, _, found, at in _batches(batch, None):
                for i in np.flatnonzero(np.diff(at)).tolist():
                    mine = found[at[i] : at[i + 1]] - np.array([words.first[i], words.first[i], 0])
                    own[row + i] = _collapsed(texts[i], i, words, place, False, mine)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(own, pa.string())], ["doc", "text"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    out = packed.mapInArrow(run, f"doc {packed.schema['doc'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and
    collapsed_sha256 of every row, after a period was planted in every tenth document."""
    names = ["start", "length", "period", "exponent_milli"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n_runs, longest, runs_sha, text_sha = [], [], [], []
            for _, texts, words, place, changed, found, at in _batches(batch, ids):
                for i, text in enumerate(texts):
                    own = found[at[i] : at[i + 1]]
                    if len(own):
                        own = own - np.array([words.first[i], words.first[i], 0])
                        told = [(a, b - a, q) for a, b, q in own.tolist()]
                        a, size, q = min(told, key=lambda r: (-r[1], r[0], r[2]))
                        longest.append((a, size, q, 1000 * size // q))
                    else:
                        told = []
                        longest.append((None,) * 4)
                    n_runs.append(len(own))
                    runs_sha.append(hashlib.sha256("".join(f"{a},{size},{q}\n" for a, size, q in told).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(_collapsed(text, i, words, place, i in changed, own).encode()).hexdigest())
            columns = [pa.array(n_runs, pa.int64()), *[pa.array([r[k] for r in longest], pa.int64()) for k in range(4)], pa.array(runs_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_runs", *names, "runs_sha256", "collapsed_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_runs long, {', '.join(f'{c} long' for c in names)}, runs_sha256 string, collapsed_sha256 string")
