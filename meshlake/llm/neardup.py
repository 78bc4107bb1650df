"""MinHash near-duplicates with circulant permutations.

A document is the set of its distinct word shingles.  One permutation scatters
shingles over a ring, a second one labels the ring's places, and coordinate k of
the signature is the least label of the shingles' places after turning the ring k
steps: two permutations give all coordinates (a slice of the label ring for each
shingle).  Coordinates are cut into ``BANDS`` bands of ``ROWS``; documents that
agree on a band are candidates.  A pair of similarity 0.8 is missed with
probability (1 - 0.8^ROWS)^BANDS, 3e-7 here.

Links are confirmed on full sets, whose shingles are compared word by word.  Sets of one
128-bit digest are one node: a sum over the shingles' own 128 bits, which are made of the
words' characters (``textnum``).  Candidates of a band aren't expanded into pairs: see
``linking``; inside the buckets that it leaves open, bitmaps of the sets rule pairs out,
never a link.  A set of much more than 2^20 shingles fills the ring: such documents are
candidates of each other, and the bitmaps and the check decide.

Cases: a text without words, or null, has an empty set, links with nothing and is
its own component; null ids sort before all others and lose to them as
``component_id``; rows that repeat doc_id and text are one document; a doc_id with
different texts is one node for each text; an empty table gives no rows; further
columns pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import bit_matches, classes, crowded_members
from .textnum import Sequence, Words, mix, runs, signed
from .workspace import Workspace

SHINGLE = 5
PERCENT = 80
ROWS, BANDS = 7, 64
COORDINATES = ROWS * BANDS
RING_BITS = 20
_NULL_ID = -(1 << 63)
_ring: list[np.ndarray] = []


def _labels() -> np.ndarray:
    """Row p: the labels that coordinates 0, 1, ... see for a shingle at place p."""
    if not _ring:
        n = 1 << RING_BITS
        order = np.argsort(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable").astype(np.uint32)
        _ring.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:COORDINATES]]), COORDINATES))
    return _ring[0]


class Sets:
    """The sets of distinct shingles of some texts; a text of fewer than k words is one shingle.

    Text i has the shingles ``first[i]`` to ``first[i + 1] - 1``; ``number`` tells shingles
    of these texts apart exactly, in ascending order inside a text.  ``lanes`` are two hashes.
    """

    def __init__(self, texts: list[str], k: int):
        words = Words(texts, lower=True)
        size = np.diff(words.first)
        full = size >= k
        many = np.where(full, size - k + 1, np.minimum(size, 1))
        first = np.cumsum(many) - many
        text = np.repeat(np.arange(len(texts)), many)
        start = words.first[text] + np.arange(len(text)) - first[text]
        # Numbers of runs of 1, 2, ... words: the number of all but the last and the last word's code.
        code, width = words.code, len(words.where)
        name = code
        for more in range(1, k):
            name = pd.factorize(name[: len(name) - 1] * width + code[more:])[0].astype(np.int64) if len(code) > more else name[:0]
        long, short = np.flatnonzero(full[text]), np.flatnonzero(~full[text])
        number = np.empty(len(text), np.int64)
        number[long] = name[start[long]]
        known: dict[tuple, int] = {}  # texts shorter than a shingle: numbers below 0
        for i in short.tolist():
            own = tuple(code[words.first[text[i]] : words.first[text[i] + 1]].tolist())
            number[i] = -1 - known.setdefault(own, len(known))
        # One key of text and number: both are below the number of words of the batch.
        low = -len(known)
        order = np.unique(text * (len(code) + len(known) + 1) + number - low, return_index=True)[1]
        self.number, self._start, self._full = number[order], start[order], full[text[order]]
        self._words, self._size, self._k = words, size[text[order]], k
        self.first = np.searchsorted(text[order], np.arange(len(texts) + 1))

    def lanes(self) -> list[np.ndarray]:
        out = []
        for lane, values in enumerate(self._words.lanes()):
            sequence, hashes = Sequence(values, salt=101 + lane), np.zeros(len(self.number), np.uint64)
            hashes[self._full] = sequence.runs(self._start[self._full], self._k)
            hashes[~self._full] = sequence.piece(self._start[~self._full], self._size[~self._full])
            out.append(hashes)
        return out

    def of(self, values: np.ndarray, i: int) -> np.ndarray:
        return values[self.first[i] : self.first[i + 1]]


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text."""
    sets = Sets(texts, k)
    hashes = sets.lanes()[0]
    return [sets.of(hashes, i) for i in range(len(texts))]


def digests(sets: Sets, lanes: list[np.ndarray]) -> list[np.ndarray]:
    """128 bits of each set, as two numbers."""
    out = []
    for lane in (0, 1):
        total = np.append(np.uint64(0), np.cumsum(mix(lanes[lane] ^ mix(lanes[1 - lane] + np.uint64(lane + 7)))))
        out.append(mix(total[sets.first[1:]] - total[sets.first[:-1]] + np.diff(sets.first).astype(np.uint64)))
    return out


def signature(found: np.ndarray) -> np.ndarray:
    labels, places = _labels(), (mix(found) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(out, labels[places[i : i + 2048]].min(axis=0), out=out)
    return out


_WEIGHTS = mix(np.arange(77, 77 + ROWS, dtype=np.uint64)) | np.uint64(1)
_SALTS = mix(np.arange(9001, 9001 + BANDS, dtype=np.uint64))


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in runs(batch):
                sets = Sets(texts, k)
                lanes = sets.lanes()
                sketches = np.stack([signature(sets.of(lanes[0], i)) for i in range(len(texts))]).astype(np.uint64).reshape(len(texts), BANDS, ROWS)
                bands = mix((mix(sketches + np.uint64(1)) * _WEIGHTS).sum(axis=2, dtype=np.uint64) + _SALTS)
                flat = pa.array(signed(bands).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(texts)),
                        batch.column("h").slice(row, len(texts)),
                        pa.array(np.diff(sets.first), pa.int64()),
                        *[pa.array(signed(x)) for x in digests(sets, lanes)],
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * BANDS + 1, BANDS), pa.int32()), flat),
                    ],
                    ["doc_id", "h", "n", "k1", "k2", "bands"],
                )

    return run


def _texts_of(k: int):
    """Keeps the rows whose set has the wanted digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, texts in runs(batch):
                sets = Sets(texts, k)
                own = digests(sets, sets.lanes())
                good = np.ones(len(texts), bool)
                for column, values in zip(("k1", "k2"), own):
                    good &= batch.column(column).slice(row, len(texts)).to_numpy() == signed(values)
                keep.append(row + np.flatnonzero(good))
            yield batch.select(["k", "text"]).take(pa.array(np.concatenate(keep) if keep else [], pa.int64()))

    return run


def bitmap(found: np.ndarray) -> bytes:
    """The size of a set, and a bit for each shingle's place among 8 to 16 times as many."""
    bits = 1 << max(6, int(8 * len(found) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(found) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return len(found).to_bytes(8, "little") + np.packbits(out).tobytes()


def _bitmaps(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in runs(batch):
                sketches = [bitmap(s) for s in shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(row, len(texts)), pa.array(sketches, pa.binary())], ["k", "sketch"])

    return run


def _may_link(percent: int):
    """Pairs of bitmaps that differ in few enough bits.

    Similarity p means that the sets differ in at most (1 - p) / (1 + p) of their sizes'
    sum, and bitmaps never differ in more places than the sets.  A bitmap of twice the
    width is folded first; sets whose widths are further apart are too unequal in size.
    """

    def run(sketches: list[bytes], stop: int) -> Iterator[tuple[int, np.ndarray]]:
        size = np.array([int.from_bytes(x[:8], "little") for x in sketches], np.int64)
        width = np.array([len(x) - 8 for x in sketches])
        for w in np.unique(width).tolist():
            rows = np.flatnonzero((width == w) | (width == 2 * w))
            wider = width[rows] > w
            flat = [np.frombuffer(sketches[i], np.uint8, offset=8) for i in rows.tolist()]
            matrix = np.stack([m if len(m) == w else m[:w] | m[w:] for m in flat])
            sizes = size[rows]
            most = lambda x, later, sizes=sizes: (sizes[later] + sizes[x]) * (100 - percent) // (100 + percent)
            for x, hit in bit_matches(matrix, int((rows < stop).sum()), most):
                hit = hit[~wider[hit]] if wider[x] else hit  # two wide ones meet at their own width
                if len(hit):
                    yield int(rows[x]), rows[hit]

    return run


def _similar(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, good = batch.column("b_text"), np.zeros(batch.num_rows, bool)
            keys = batch.column("b").to_pylist()
            for row, texts in runs(batch, "a_text"):
                place, more = {}, []
                for i, key in enumerate(keys[row : row + len(texts)]):
                    if key not in place:
                        place[key] = len(texts) + len(more)
                        more.append(centres[row + i].as_py())
                sets = Sets(texts + more, k)
                size = np.diff(sets.first)
                for i in range(len(texts)):
                    c = place[keys[row + i]]
                    both = len(np.intersect1d(sets.of(sets.number, i), sets.of(sets.number, c), assume_unique=True))
                    good[row + i] = 100 * both >= percent * (size[i] + size[c] - both)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _PAIR], pa.array(good)], [*_PAIR, "ok"])

    return lambda pairs: pairs.mapInArrow(run, ", ".join(f"{c} long" for c in _PAIR) + ", ok boolean")


_PAIR = ("a", "b", "ra", "rb")


def _known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID).cast("long"))


def _text_hash() -> Column:
    """Finds a text again among those of its doc_id; the digest of its set confirms it."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _classes(ws: Workspace, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that share a band with another."""
    members = crowded_members(ws, nodes.select("k", F.col("n").alias("about"), F.explode(F.array_distinct("bands")).alias("bucket")))
    wanted = members.where("head").select(F.col("k").alias("_k"))
    owners = nodes.join(wanted.hint("merge"), F.col("k") == F.col("_k"), "left_semi").select("k", "k1", "k2", "owner.d", "owner.h")
    owners = ws.save(owners, "owners")
    once = Window.partitionBy("d", "h", "k", F.sha2("text", 256)).orderBy("k")
    found = docs.select(_known_id().alias("d"), _text_hash().alias("h"), "text").join(owners.hint("merge"), ["d", "h"])
    found = found.withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    texts = ws.save(found.select("k", "k1", "k2", "text").mapInArrow(_texts_of(k), "k long, text string"), "texts")
    ws.release()
    near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return classes(ws, members, texts, near, _bitmaps(k), _may_link(percent), _similar(k, percent))


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, k1, k2) of all rows, and (k1, k2, component_id) of all nodes with a set."""
    ws = Workspace(docs.sparkSession, "neardup")
    sketches = ws.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h"), "text").mapInArrow(
            _sketch(k), "doc_id long, h long, n long, k1 long, k2 long, bands array<long>"
        ),
        "sketches",
    )
    nodes = (
        sketches.where("n > 0")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct(_known_id().alias("d"), "h")).alias("owner"), F.min("doc_id").alias("d"), F.first(F.struct("n", "bands")).alias("of"))
        .select("k1", "k2", "owner", "d", "of.n", "of.bands", F.monotonically_increasing_id().alias("k"))
    )
    nodes = ws.save(nodes, "nodes")
    roots = _classes(ws, nodes, docs, k, percent)
    ws.keep_only(sketches, nodes, roots)
    found = nodes.join(roots.hint("merge"), F.col("k") == F.col("node"), "left").select("k1", "k2", "d", F.coalesce("root", "k").alias("root"))
    found = ws.save(found, "nodes-in-classes")
    least = ws.save(found.groupBy("root").agg(F.min("d").alias("component_id")), "components")
    found = ws.save(found.join(least.hint("merge"), "root").select("k1", "k2", "component_id"), "known")
    rows = sketches.select("doc_id", "n", "k1", "k2")
    ws.keep_only(sketches, found)
    return rows, found


def report(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows, found = _grouped(docs, k, percent)
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = (
        rows.where("n > 0")
        .join(found.hint("merge"), ["k1", "k2"])
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
    return linked.unionByName(alone)


def deduplicate(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows that ``report`` keeps, one for each doc_id, with their own columns.

    The ids that go are the small side; texts are shuffled once, by id.
    """
    out = report(docs, k, percent).groupBy(_known_id().alias("_kept_id")).agg(F.max("kept").alias("_kept")).where("not _kept").select("_kept_id")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _known_id().alias("_kept_id"))
    return packed.join(out, "_kept_id", "left_anti").select("_doc.*")
