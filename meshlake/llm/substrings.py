"""Substring dedup: documents factored against the first occurrences in their corpus.

The method is a variant of relative Lempel-Ziv parsing.  A literal parse, which seeks the
longest match of a document at every place of every reference block, would put each
document beside the whole corpus.  Here the corpus cuts itself into phrases, and phrases
are matched as a whole:

* In every window of ``WINDOW`` words the least hash of its ``GRAM``-word pieces is an
  anchor, and the windows with one anchor make a phrase, ``WINDOW`` words or longer.
  Anchors depend on the words alone, so equal windows have equal anchors wherever they
  stand.  Phrases are indexed in reference blocks by their anchor (the hash partitions of
  the index); each block keeps the first occurrence of every phrase.
* A phrase that the index has from an earlier place is copied from there.
* At phrase boundaries: where an anchor is known in several surroundings, a phrase that is
  not itself known can still share some of its windows with them.  Those windows are
  looked up one by one; first occurrences of distinct phrases suffice, as every later
  occurrence of a phrase is copied already.

Left to right, what touches and runs on in one source is one factor: the longest that
these copies give, not the longest match of the corpus.  What the factors cover is exactly
what the windows of the definition cover.  Anchors that occur once, most of a corpus, drop
out after one count.

Phrases and windows are compared by 128 bits made of their words' characters
(``textnum``).  No step gathers a group: repeated phrases meet their index entry in a join
whose large side Spark can split, and first occurrences are partial minima.

Cases: a null text has no words; a document of fewer than ``WINDOW`` words has no
window; of equal windows the first by (doc_id, start) stays, null ids before all
others; rows that repeat doc_id and text are one document: each gets its result;
rows that share a doc_id with different texts are documents at one place, neither
earlier than the other at equal starts; an empty table gives no rows; further
columns pass through ``remove`` untouched.  A document is held in memory at about 60 bytes
a character while it is handled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import Sequence, Words, runs, signed
from .workspace import Workspace

WINDOW = 20
GRAM = 8
#: A place packs start and the phrase's length in words.
_SPAN_BITS = 6
_NULL_ID = -(1 << 63)


def _phrases(words: Words, first_lane: Sequence) -> tuple[np.ndarray, ...]:
    """Anchor hash, first word and length in words of all phrases, and the text each is in."""
    n, span = len(words.code), WINDOW - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty.astype(np.uint64), empty, empty, empty
    gram = first_lane.runs(np.arange(n - GRAM + 1), GRAM)
    best = np.lib.stride_tricks.sliding_window_view(gram, span).argmin(axis=1) + np.arange(n - WINDOW + 1)
    text = np.searchsorted(words.first, np.arange(n - WINDOW + 1), side="right") - 1
    inside = np.arange(n - WINDOW + 1) + WINDOW <= words.first[text + 1]
    at, best, text = np.flatnonzero(inside), best[inside], text[inside]
    if not len(at):
        return empty.astype(np.uint64), empty, empty, empty
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    length = at[tail] - at[head] + WINDOW
    return gram[best[head]], at[head], length, text[head]


def _sequences(words: Words) -> list[Sequence]:
    return [Sequence(lane, salt=11 + i) for i, lane in enumerate(words.lanes())]


def _emit_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = batch.column("d").to_numpy(), batch.column("t").to_numpy()
        for row, texts in runs(batch):
            words = Words(texts)
            lanes = _sequences(words)
            anchor, first, length, text = _phrases(words, lanes[0])
            if len(anchor):
                yield _places(anchor, *[x.piece(first, length) for x in lanes], ids[row + text], tags[row + text], (first - words.first[text]) << _SPAN_BITS | length)


def _places(h, u, w, d, t, q) -> pa.RecordBatch:
    columns = [pa.array(signed(x)) for x in (h, u, w)] + [pa.array(x, pa.int64()) for x in (d, t, q)]
    return pa.RecordBatch.from_arrays(columns, ["h", "u", "w", "d", "t", "q"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of every window of the listed phrases, with its place."""
    for batch in batches:
        ids, tags, asked = batch.column("d").to_numpy(), batch.column("t").to_numpy(), batch.column("qs")
        for row, texts in runs(batch):
            words, starts, owner, place = Words(texts), [], [], []
            for i in range(len(texts)):
                q = np.asarray(asked[row + i].values)
                many = (q & ((1 << _SPAN_BITS) - 1)) - WINDOW + 1
                own = np.repeat((q >> _SPAN_BITS) - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                own = own[own + WINDOW <= words.first[i + 1] - words.first[i]]
                starts.append(own + words.first[i])
                place.append(own << _SPAN_BITS | WINDOW)
                owner.append(np.full(len(own), row + i))
            at, rows = np.concatenate(starts), np.concatenate(owner)
            if len(at):
                u, w = (x.runs(at, WINDOW) for x in _sequences(words))
                yield _places(np.zeros(len(at), np.uint64), u, w, ids[rows], tags[rows], np.concatenate(place))


_PLACES = "h long, u long, w long, d long, t long, q long"


def _key(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID).cast("long"))


def _text_hash() -> Column:
    """Tells apart texts that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _copied(occurrences: DataFrame, first: DataFrame) -> DataFrame:
    """(d, t, q, rd, rq): occurrences and the earlier place they repeat."""
    index = first.select("u", "w", F.col("first.d").alias("rd"), F.col("first.q").alias("rq"))
    start = lambda q: F.shiftright(q, _SPAN_BITS)
    later = (F.col("d") > F.col("rd")) | (start("q") > start("rq"))
    return occurrences.select("u", "w", "d", "t", "q").join(index.hint("merge"), ["u", "w"]).where(later).select("d", "t", "q", "rd", "rq")


def _first(occurrences: DataFrame, *more: Column) -> DataFrame:
    return occurrences.groupBy("u", "w").agg(F.min(F.struct("d", "q", "t")).alias("first"), F.count("*").alias("n"), *more)


def factors(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(d, t, q, rd, rq): the repeated phrases and windows of every document and their sources."""
    ws = ws or Workspace(docs.sparkSession, "substrings")
    texts = docs.select(_key(docs).alias("d"), _text_hash().alias("t"), F.col("text"))
    phrases = texts.mapInArrow(_emit_phrases, _PLACES)
    several = (F.min("u") != F.max("u")) | (F.min("w") != F.max("w"))
    anchors = ws.save(phrases.groupBy("h").agg(F.count("*").alias("n"), several.alias("mixed")).where("n > 1").select("h", "mixed"), "anchors")
    ws.release()
    known = ws.save(phrases.join(anchors.hint("merge"), "h").select("u", "w", "d", "t", "q", "mixed"), "repeated")
    ws.release()
    ws.drop(anchors)
    index = ws.save(_first(known, F.max("mixed").alias("mixed")), "index")
    whole = ws.save(_copied(known, index.where("n > 1")), "whole")
    ws.release()
    ws.drop(known)
    asked = index.where("mixed").groupBy(F.col("first.d").alias("d"), F.col("first.t").alias("t")).agg(F.collect_set("first.q").alias("qs"))
    windows = ws.save(texts.join(asked.hint("merge"), ["d", "t"]).select("d", "t", "text", "qs").mapInArrow(_emit_windows, _PLACES).drop("h"), "windows")
    ws.release()
    firsts = ws.save(_first(windows).where("n > 1"), "window-index")
    edges = ws.save(_copied(windows, firsts), "edges")
    ws.release()
    ws.drop(windows, firsts, index)
    return whole.unionByName(edges)


def _decode(found: list[dict] | None) -> list[tuple[int, int, int, int]]:
    """Start, length and source of a document's factors, merged where they run on."""
    out: list[list[int]] = []
    own = [(f["q"] >> _SPAN_BITS, f["q"] & ((1 << _SPAN_BITS) - 1), f["rd"], f["rq"] >> _SPAN_BITS) for f in found or ()]
    for start, length, doc, source in sorted(own):
        last = out[-1] if out else None
        if last and last[2] == doc and start <= last[0] + last[1] and source - start == last[3] - last[0]:
            last[1] = max(last[1], start + length - last[0])
        else:
            out.append([start, length, doc, source])
    return [tuple(x) for x in out]


def _covered(parse: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for start, length, _, _ in parse:
        step[min(start, n)] += 1
        step[min(start + length, n)] -= 1
    return np.cumsum(step)[:n] > 0


def _with_factors(docs: DataFrame, extra: list[Column]) -> DataFrame:
    ws = Workspace(docs.sparkSession, "substrings")
    found = factors(docs, ws).groupBy("d", "t").agg(F.collect_set(F.struct("q", "rd", "rq")).alias("found"))
    return docs.select(_key(docs).alias("d"), _text_hash().alias("t"), F.col("text"), *extra).join(found.hint("merge"), ["d", "t"], "left")


def _removed(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, int, list, np.ndarray]]:
    found = batch.column("found")
    for row, texts in runs(batch):
        words = Words(texts)
        for i in range(len(texts)):
            parse = _decode(found[row + i].as_py())
            yield row + i, words, i, parse, _covered(parse, int(words.first[i + 1] - words.first[i]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, sha, parses = [], [], [], []
        for _, words, i, parse, covered in _removed(batch):
            kept = [w for w, c in zip(words.words(i), covered.tolist()) if not c]
            total.append(len(covered))
            gone.append(int(covered.sum()))
            sha.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
            parses.append(len(parse))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(parses, pa.int64())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"],
        )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the number of merged factors of every document."""
    rows = _with_factors(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    return rows.select("doc_id", "text", "found").mapInArrow(
        _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long"
    )


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), []
        for row, _, _, parse, _ in _removed(batch):
            rows += [(ids[row], s, n, None if d == _NULL_ID else d, r) for s, n, d, r in parse]
        names = ["doc_id", "start", "length", "ref_doc_id", "ref_start"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)


def spans(docs: DataFrame) -> DataFrame:
    """The parse: (doc_id, start, length, ref_doc_id, ref_start), in words."""
    rows = _with_factors(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    return (
        rows.where("found is not null")
        .select("doc_id", "text", "found")
        .mapInArrow(_parse_rows, "doc_id long, start long, length long, ref_doc_id long, ref_start long")
    )


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for row, words, i, _, covered in _removed(batch):
            if covered.any():
                texts[row] = " ".join(w for w, c in zip(words.words(i), covered.tolist()) if not c)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])


def remove(docs: DataFrame) -> DataFrame:
    """The documents without their repeated words; untouched texts keep their white space."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = _with_factors(docs, [packed.alias("doc")]).select("doc", "text", "found")
    kind = rows.schema["doc"].dataType.simpleString()
    cut = rows.mapInArrow(_rest, f"doc {kind}, text string")
    return cut.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
