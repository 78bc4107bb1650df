"""Fuzzy line dedup: SimHash blocks and MinHash bands of normalised lines, edit similarity.

A line is compared in its normal form: lower case (characters whose lower case is one
character), decimal digits as 0, every run of other characters than letters and digits as
one space.  Lines of equal normal form, by 128 bits of its characters (``textnum``), are
one node; nodes that meet in a bucket and whose normal forms have an edit similarity of
``PERCENT`` or more are linked.  No signature rules out a link: the edit check alone
decides on nodes that meet.  Buckets are

* the ``BLOCKS`` blocks of the SimHash (64 bits, over pairs of words: long lines of a language have its
  frequent words in common, but hardly their neighbours),
* MinHash bands of character n-grams, for each of the ``SHINGLES`` a range of lengths,
* for forms of at most ``TINY`` characters all that up to two deletions make of them (one below 10
  characters), which finds every similar pair of them.

An n-gram joins two forms only at places that an alignment with so few edits can bring together: the
lengths before it and behind it differ by no more than the edits that the pair may have.  A longer pair is
missed only if no bucket holds both and no chain of links joins them.  SimHash blocks alone find few of the
pairs near the threshold: an edit of one word in five changes more bits than blocks of a selective width
leave alone.  Of every class of linked lines the first occurrence, by doc_id and line, stays.

Cases: a null text has one empty line; lines without a letter or digit have no
normal form and always stay; rows that repeat doc_id and text are one document and
each gets its result; rows that share a doc_id with different texts are documents at
one place, and their equal first lines both stay; an empty table gives no rows;
further columns pass through ``remove`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import linked
from .textnum import U64, Prefix, code_points, mix, numbered, positions, runs, signed, solid_runs
from .workspace import Workspace

#: Two forms whose SimHashes differ in fewer bits than there are blocks share one.
BLOCKS, BLOCK_BITS = 2, 32
PERCENT = 80
#: Words of a piece that the SimHash counts.
WORDS = 2
#: Characters of an n-gram, values of a band, bands, least and most characters of a form.
SHINGLES = ((5, 2, 10, 10, 40), (12, 2, 12, 32, None))
TINY = 14
#: Counters of the characters and of the character pairs of a form, by which pairs are ruled out.
BINS, PAIR_BINS = 32, 128
_NULL_ID = -(1 << 63)
#: Characters of texts handled at once.
_RUN_CHARS = 200_000
#: Bits of a place in a form.
_PLACE = 28
#: An entry of a bucket: the rest of its key, a form, its length and the place of the n-gram.  Entries travel
#: in ``_PARTS`` parts by key, so many of a task in one go, and are sorted so many at once.
_ENTRY = np.dtype([("key", "<u4"), ("form", "<i8"), ("size", "<u4"), ("place", "<u4")])
_PARTS, _HELD, _SORTED = 4096, 1_000_000, 4_000_000
#: Entries of a group that are paired one by one.
_PAIRED = 64
#: Words that one byte-wide counter can count.
_LANE = 255
#: Pairs whose distances are computed together, the widest band, in words, for that, and characters held for it.
_TOGETHER, _LANES, _CHECKED_CHARS = 2000, 16, 6_000_000
#: Fewer pairs of a width wait for those of the next; a step of a band takes as long as one of so many pairs one by one, and a fifth more a word.
_FEW, _ALONE = 256, 20
_tables: dict[str, np.ndarray] = {}


def _folded() -> np.ndarray:
    """The normal form of every character; a space for what is neither letter nor digit."""
    if "fold" not in _tables:

        def fold(c: int) -> int:
            low = chr(c).lower()
            low = low if len(low) == 1 else chr(c)
            return 48 if low.isdecimal() else ord(low) if low.isalnum() else 32

        _tables["fold"] = np.fromiter(map(fold, range(0x110000)), np.uint32, 0x110000)
    return _tables["fold"]


def normal(line: str) -> str:
    folded = _folded()[code_points(line)].tobytes().decode("utf-32-le")
    return " ".join(x for x in folded.split(" ") if x)


class Forms:
    """The normal forms of the lines of some texts.

    ``text`` and ``line`` say where each form stands; ``code`` numbers the distinct forms,
    which are ``cp`` from ``bounds[i]`` to ``bounds[i + 1]``.
    """

    def __init__(self, texts: list[str]):
        cp = code_points("\n".join(texts))
        if "lines" not in _tables:
            _tables["lines"] = _folded().copy()
            _tables["lines"][10] = 10
        folded = _tables["lines"][cp]
        breaks = np.flatnonzero(cp == 10)
        bounds = np.concatenate([[0], breaks + 1, [len(cp) + 1]])  # of lines, with their newline
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        opens = np.cumsum(size + 1) - size - 1  # where each text begins
        keep = (folded != 32) & (folded != 10)
        start, end = solid_runs(keep, bounds[:-1])
        line_of = np.searchsorted(bounds, start, side="right") - 1
        # A form is its line's words with a space behind each but the last.
        joined = np.flatnonzero(line_of[1:] == line_of[:-1])
        keep[end[joined]] = True
        own = np.flatnonzero(keep)
        lines = np.unique(line_of)
        first = np.searchsorted(own, bounds[lines])
        last = np.searchsorted(own, bounds[lines + 1])
        flat = folded[own]
        self.code, where = numbered(flat, first, last)
        self.text = np.searchsorted(opens, bounds[lines], side="right") - 1
        self.line = lines - (np.searchsorted(bounds, opens, side="right") - 1)[self.text]
        kept = [flat[a:b] for a, b in zip(first[where].tolist(), last[where].tolist())]
        self.cp = np.concatenate(kept) if kept else flat
        self.bounds = np.append(0, np.cumsum(last[where] - first[where]))


def digests(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each form, as two numbers."""
    whole = memoryview(cp.astype("<u4").tobytes())
    edges = (4 * bounds).tolist()
    return np.frombuffer(b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(edges, edges[1:])), "<u8").reshape(-1, 2)


def simhash(cp: np.ndarray, bounds: np.ndarray, prefix: Prefix, run: int = 1) -> np.ndarray:
    """The SimHash of each form: a bit is set if more of the hashes of its runs of ``run`` words (all its words,
    if they are fewer) have it than not.  A byte of a hash becomes eight counters of a byte each, in one number."""
    start, end = solid_runs(cp != 32, bounds[:-1])
    if not len(start):
        return np.zeros(len(bounds) - 1, np.uint64)
    if "spread" not in _tables:
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
        _tables["spread"] = np.ascontiguousarray(bits).view(np.uint64).ravel()
    first = np.searchsorted(start, bounds)
    words = np.diff(first)
    if run > 1:
        last, words = first[1:] - 1, np.maximum(words - run + 1, np.minimum(words, 1))
        own = positions(first[:-1], words)
        start, end = start[own], end[np.minimum(own + run - 1, np.repeat(last, words))]
        first = np.append(0, np.cumsum(words))
    parts = (words + _LANE - 1) // _LANE
    opens = np.cumsum(parts) - parts
    at = np.repeat(first[:-1] - opens * _LANE, parts) + np.arange(int(parts.sum())) * _LANE
    hashes = prefix.piece(start, end - start).astype(">u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(words), 64), np.int64)
    for byte in range(8):
        sums = np.add.reduceat(_tables["spread"][hashes[:, byte]], at).view(np.uint8).reshape(-1, 8)
        out[:, 8 * byte : 8 * byte + 8] = sums if len(at) == len(words) else np.add.reduceat(sums, opens, axis=0, dtype=np.int64)
    return np.packbits((2 * out > words[:, None]).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def _minhashes(prefix: Prefix, bounds: np.ndarray, which: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """``m`` MinHashes over the character n-grams of the forms ``which``, of n characters or more, and the
    place in its form of the n-gram of each."""
    grams = bounds[which + 1] - bounds[which] - n + 1
    if 2 * int(grams.sum()) > len(prefix.sums):  # those across two forms are left out
        hashes, places = np.append(prefix.windows(n), U64(0)), np.arange(len(prefix.sums) - n + 1)
        edges, step = np.stack([bounds[which], bounds[which] + grams], axis=1).ravel(), 2
    else:
        places = positions(bounds[which], grams)
        hashes = prefix.piece(places, n)
        edges, step = np.cumsum(grams) - grams, 1
    # The n-gram whose hash is nearest to a number, of numbers that differ first in their highest bits.
    low = U64((1 << _PLACE) - 1)
    own = hashes & ~low | places.astype(np.uint64) & low
    out, held = np.empty((len(which), m), np.uint64), np.empty_like(own)
    for i, a in enumerate((mix(np.arange(1, m + 1, dtype=np.uint64)) & ~low).tolist()):
        np.bitwise_xor(own, U64(a), out=held)
        out[:, i] = np.minimum.reduceat(held, edges)[::step] ^ U64(a)
    return out >> U64(_PLACE), out - bounds[which].astype(np.uint64)[:, None] & low


def _shorter(form: str) -> set[str]:
    """What up to two deletions, or one from a form below 10 characters, make of a form."""
    out = {form} | {form[:j] + form[j + 1 :] for j in range(len(form))}
    return out if len(form) < 10 else out | {x[:j] + x[j + 1 :] for x in out if len(x) < len(form) for j in range(len(x))}


def bucket_places(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all buckets of all forms, the form of each, and the place of the n-gram that it stands for, or 0."""
    size = np.diff(bounds)
    prefix = Prefix(cp)
    sim, every = simhash(cp, bounds, prefix, WORDS), np.arange(len(size))
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    keys = [mix(mix((sim >> np.uint64(i * BLOCK_BITS)) & mask | np.uint64(i << BLOCK_BITS))) for i in range(BLOCKS)]
    forms = [every] * BLOCKS
    places = [np.zeros(len(size), np.uint64)] * BLOCKS
    for number, (n, rows, bands, least, most) in enumerate(SHINGLES):
        which = np.flatnonzero((size >= least) & (size <= (most or size)))
        if not len(which):
            continue
        values, place = (x.reshape(len(which), bands, rows) for x in _minhashes(prefix, bounds, which, n, rows * bands))
        band = mix(np.arange(bands, dtype=np.uint64) + np.uint64((number + 1) << 56))[None, :]
        for r in range(rows):
            band = mix(band ^ values[:, :, r])
        keys.append(band.ravel())
        forms.append(np.repeat(which, bands))
        places.append(place[:, :, 0].ravel())
    for i in np.flatnonzero(size <= TINY).tolist():
        less = _shorter(cp[bounds[i] : bounds[i + 1]].tobytes().decode("utf-32-le"))
        keys.append(np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in less], np.uint64))
        forms.append(np.full(len(less), i))
        places.append(np.zeros(len(less), np.uint64))
    return np.concatenate(keys), np.concatenate(forms), np.concatenate(places)


def bucket_keys(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all buckets of all forms, and the form of each."""
    return bucket_places(cp, bounds)[:2]


_LINES = "k1 long, k2 long, n long, d long, t long, q long, part int, entries binary"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with a normal form.  In a run of texts the first line of a form, by doc_id and
    line, has how often the form is there.  Further rows have the forms' entries, by part."""
    names = [c.split(" ")[0] for c in _LINES.split(", ")]
    held: list[tuple[np.ndarray, ...]] = []
    many = 0
    for batch in batches:
        ids, tags = batch.column("d").to_numpy(), batch.column("t").to_numpy()
        for row, texts in runs(batch, limit=_RUN_CHARS):
            forms = Forms(texts)
            if not len(forms.code):
                continue
            own = signed(digests(forms.cp, forms.bounds))
            keys, owner, place = bucket_places(forms.cp, forms.bounds)
            held.append((keys, own[owner, 0], np.diff(forms.bounds)[owner].astype(np.uint32), place.astype(np.uint32)))
            many += len(keys)
            d, t = ids[row + forms.text], tags[row + forms.text]
            order = np.lexsort((t, forms.line, d, forms.code))
            leads = np.zeros(len(order), bool)
            leads[order[np.append(True, np.diff(forms.code[order]) > 0)]] = True
            n = np.where(leads, np.bincount(forms.code)[forms.code], 0)
            columns = [own[forms.code, 0], own[forms.code, 1], n, d, t, forms.line]
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *none], names)
            if many > _HELD:
                yield _by_part(held, names)
                held, many = [], 0
    if held:
        yield _by_part(held, names)


def _by_part(held: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    """A row for each part, with its entries."""
    keys, form, size, place = (np.concatenate(x) for x in zip(*held))
    part = (keys >> U64(48)).astype(np.uint16) % np.uint16(_PARTS)
    order = np.argsort(part, kind="stable")
    part, entries = part[order], np.empty(len(order), _ENTRY)
    for name, values in (("key", keys.astype(np.uint32)), ("form", form), ("size", size), ("place", place)):
        entries[name] = values[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    offsets = (_ENTRY.itemsize * np.append(first, len(part))).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(entries.tobytes())])
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(first), pa.int64())] * 6, pa.array(part[first], pa.int32()), packed], names)


def _behind(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of both."""
    batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
    return batch if held is None else pa.concat_batches([held, batch])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of form and place, the first of each form, with the sum of ``n``."""
    held = None  # the last form so far
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _behind(held, batch)
        k1, k2 = rows["k1"].to_numpy(), rows["k2"].to_numpy()
        first = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        n = np.add.reduceat(rows["n"].to_numpy(), first)
        rows = rows.take(pa.array(first))
        rows = rows.set_column(rows.schema.get_field_index("n"), "n", pa.array(n, pa.int64()))
        held = rows.slice(rows.num_rows - 1)
        yield rows.slice(0, rows.num_rows - 1)
    if held is not None:
        yield held


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and entries, of rows in order of part: small parts together, large ones in ranges of keys."""
    held: list[tuple[int, np.ndarray]] = []
    many, last = 0, None

    def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ranges = many // _SORTED + 1
        for r in range(ranges):
            own = [(part, x[x["key"] % ranges == r] if ranges > 1 else x) for part, x in held]
            yield np.concatenate([x["key"].astype(np.int64) | part << 32 for part, x in own]), np.concatenate([x for _, x in own])

    for batch in batches:
        for part, entries in zip(batch.column("part").to_pylist(), batch.column("entries")):
            if part != last and many > _TOGETHER * 100:
                yield from whole()
                held, many = [], 0
            last = part
            held.append((part, np.frombuffer(entries.as_buffer(), _ENTRY)))
            many += len(held[-1][1])
    if held:
        yield from whole()


_MET = "bucket long, k1 long, size long, place long, crowd long"


def _met(percent: int):
    """The forms of each bucket, with their length, the place of its n-gram and how many it has.  Of the
    forms that share a key those are one bucket whose n-grams stand at like places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, entries in _parts(batches):
            order = np.argsort(key)
            dealt = pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(order)], ["bucket", "row"])
            kept = pa.Table.from_batches(_repeated(iter([dealt])), dealt.schema)
            key, rows = kept["bucket"].to_numpy(), entries[kept["row"].to_numpy()]
            order = np.lexsort((rows["form"], key))
            key, rows = key[order], rows[order]
            # Entries of one form, of several runs of texts, are one.
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (rows["form"][1:] != rows["form"][:-1])
            at, group = at_like_places(key[new], rows["size"][new], rows["place"][new], percent)
            key, rows = key[new][at], rows[new][at]
            bucket = key << 12 | np.minimum(group - group[np.searchsorted(key, key)], 4095)  # of groups far on some go together
            crowd = np.unique(bucket, return_counts=True, return_inverse=True)
            columns = [bucket, rows["form"], rows["size"], rows["place"], crowd[2][crowd[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [c.split(" ")[0] for c in _MET.split(", ")])

    return run


def at_like_places(key: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in order of key the rows, in that order too, of those that can be aligned with another of their key,
    and the group of each: two can be aligned if the lengths before and behind their n-grams differ by at most the
    edits that a similar pair may have.  Entries that no chain of such pairs joins are several groups; among more
    than ``_PAIRED`` of a key, gaps between their places tell them apart."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, group = np.arange(len(key)), np.cumsum(np.append(False, key[1:] != key[:-1]))
    size, before = size.astype(np.int64), place.astype(np.int64)
    for ends in (False, True, False):
        at = size - before if ends else before
        order = np.lexsort((at, group))
        rows, group, size, before, at = rows[order], group[order], size[order], before[order], at[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        most = np.repeat((100 - percent) * np.maximum.reduceat(size, first) // 100, np.diff(np.append(first, len(rows))))
        group = np.cumsum(np.append(False, (group[1:] != group[:-1]) | (np.diff(at) > most[1:])))
    crowd = np.bincount(group)[group]
    own, good = np.arange(len(rows)), crowd > _PAIRED
    meet, about = _at_like_places(percent)[1], np.stack([size, before], axis=1)
    own[good] = np.searchsorted(group, group[good])
    edges = []
    at = np.flatnonzero((crowd > 1) & ~good)
    for step in range(1, _PAIRED):
        at = at[at + step < len(rows)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            break
        meets = meet(about[at], about[at + step])
        edges.append(np.stack([at[meets], at[meets] + step]))
    x, y = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    good[x] = good[y] = True
    while (own[x] != own[y]).any():
        least = np.minimum(own[x], own[y])
        np.minimum.at(own, own[x], least)
        np.minimum.at(own, own[y], least)
        own = own[own]
    rows, own = rows[good], own[good]
    order = np.argsort(own, kind="stable")
    return rows[order], own[order]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their bucket, those whose bucket has more than one."""
    held, met = None, False  # the last row so far, and whether the row before it has its bucket
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _behind(held, batch)
        bucket = rows.column("bucket").to_numpy()
        same = bucket[1:] == bucket[:-1]
        keep = np.append(met, same)
        keep[:-1] |= same
        held, met = rows.slice(rows.num_rows - 1), bool(keep[-1])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
    if met:
        yield held


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, text): the normal forms at the wanted places, if they have the wanted digest."""
    for batch in batches:
        keys, forms, own = [], [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
            lines = (text.as_py() or "").split("\n")
            for w in wanted:
                if w["q"] < len(lines):
                    keys.append(w["k"])
                    own.append((w["k1"], w["k2"]))
                    forms.append(normal(lines[w["q"]]))
        size = np.fromiter(map(len, forms), np.int64, len(forms))
        found = digests(code_points("".join(forms)), np.append(0, np.cumsum(size)))
        good = np.flatnonzero((signed(found) == np.array(own, np.int64).reshape(-1, 2)).all(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in good], pa.int64()), pa.array([forms[i] for i in good], pa.string())], ["k", "text"])


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or some number above ``most`` if it is larger.  What both begin and
    end with is left out; a column of the table is two bit vectors, a bit for each character of a."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if a == b:
        return 0
    x, y = code_points(a), code_points(b)
    head = x[: len(y)] != y
    begin = int(head.argmax()) if head.any() else len(y)
    tail = (x[len(x) - len(y) + begin :] != y[begin:])[::-1]
    end = int(tail.argmax()) if tail.any() else len(y) - begin
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        match = places.get(c, 0)
        across = (((match & up) + up) ^ up) | match | down
        rise = down | ~(across | up) & full
        fall = up & across
        score += bool(rise & top) - bool(fall & top)
        if score - left > most:
            return most + 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up = fall | ~((match | down) | rise) & full
        down = rise & (match | down)
    return score


def aligned(a: str, b: str, most: int, hold: int = 6, reach: int = 24) -> int:
    """The cost of one alignment, never below the edit distance: along equal characters, and
    from a difference on to the next place, at most ``reach`` on, where ``hold`` characters of both
    are equal again.  Some number above ``most`` if it doesn't go on or costs more."""
    i = j = cost = 0
    while cost <= most:
        while a[i : i + 16] == b[j : j + 16] and i < len(a) and j < len(b):
            i, j = min(i + 16, len(a)), min(j + 16, len(b))
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i >= len(a) - hold or j >= len(b) - hold:
            return cost + max(len(a) - i, len(b) - j)
        far = min(most - cost + 1, reach)
        for skip in range(min(far, len(a) - i - hold) + 1):
            found = b.find(a[i + skip : i + skip + hold], j, j + far + hold)
            if found >= 0:
                cost += max(skip, found - j)
                i, j = i + skip, found
                break
        else:
            return most + 1
    return cost


def similar(a: str, b: str, percent: int = PERCENT) -> bool:
    """100 * (1 - distance / longer length) >= percent."""
    most = (100 - percent) * max(len(a), len(b)) // 100
    return aligned(a, b, most) <= most or edit_distance(a, b, most) <= most


def all_similar(pairs: list[tuple[str, str]], percent: int = PERCENT) -> np.ndarray:
    """``similar`` for many pairs: those of bands of like width step through their tables together."""
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    most = (100 - percent) * size[:, 0] // 100
    out = np.zeros(len(pairs), bool)
    near = size[:, 0] - size[:, 1] <= most
    lanes = most // 64 + 1  # a path of cost ``most`` stays on most + 1 diagonals
    left = np.flatnonzero(near)
    for words in range(1, _LANES + 1):
        which = left[lanes[left] <= words]
        # A few go on to the next width; a step takes the same time for one pair as for a hundred.
        if len(which) < _FEW and words < _LANES and len(which) < len(left) or not len(which):
            continue
        # As long a part of them, the shortest first, as saves most steps against one by one.
        which = which[np.argsort(size[which, 1], kind="stable")]
        saved = np.cumsum(size[which, 1]) - _ALONE * (1 + words / 5) * size[which, 1]
        which = which[: len(which) - int(saved[::-1].argmax())] if saved.max() >= 0 else which[:0]
        for at in range(0, len(which), _TOGETHER):
            part = which[at : at + _TOGETHER]
            out[part] = _in_band([pairs[i] for i in part.tolist()], size[part], most[part], words)
        left = np.setdiff1d(left, which)
    for i in left.tolist():
        out[i] = similar(*pairs[i], percent)
    return out


def _in_band(pairs: list[tuple[str, str]], size: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
    """Whether the distance of each pair is at most ``most`` (Hyyro's bit vectors in a band along the diagonal).

    Bit t of a column stands for the diagonal t - low, row j - low + t of column j; the rows up to 0
    continue the table's first row.  The end lies on the diagonal len(a) - len(b), whose values never
    fall: a pair is given up when one is above ``most``."""
    longer, shorter = size[:, 0], size[:, 1]
    low, bits = (most - (longer - shorter)) // 2, 64 * words
    texts = [code_points("".join(pair[side] for pair in pairs)) for side in (0, 1)]
    used = np.zeros(max(int(t.max(initial=0)) for t in texts) + 1, bool)
    for t in texts:
        used[t] = True
    number = np.cumsum(used) + 1  # 0 and 1 fill the rows behind, and never meet
    kind = np.uint8 if number[-1] < 256 else np.uint32
    columns = int(shorter.max())
    x = np.zeros((len(pairs), max(columns + bits + 16, int((low + longer).max()))), kind)
    y = np.ones((len(pairs), columns), kind)
    for table, text, shift, many in ((x, texts[0], low, longer), (y, texts[1], np.zeros_like(low), shorter)):
        flat, at = number.astype(kind)[text], 0
        for i, (begin, n) in enumerate(zip(shift.tolist(), many.tolist())):
            table[i, begin : begin + n] = flat[at : at + n]
            at += n
    y = np.ascontiguousarray(y.T)
    one = U64(1)
    # Rows above the table fall by one a row, those inside rise.  Bit t of the first column is row 1 - low + t.
    inside = np.packbits(np.arange(bits)[None, :] >= low[:, None], axis=1, bitorder="little").view(np.uint64)
    rise, fall = inside, ~inside
    end = low + longer - shorter
    ends = np.where(end[:, None] // 64 == np.arange(words), (one << (end % 64).astype(np.uint64))[:, None], U64(0))
    score, length, alive, out = longer - shorter, shorter, np.arange(len(pairs)), np.zeros(len(pairs), bool)
    for j in range(columns):
        if j % 16 == 0:
            done = length <= j
            stay = ~done & (score <= most[alive])
            out[alive[done]] = score[done] <= most[alive[done]]
            if not stay.all():
                alive, score, length = alive[stay], score[stay], length[stay]
                rise, fall, ends = rise[stay], fall[stay], ends[stay]
                if not len(alive):
                    return out
        if j % 16 == 0:
            window = x[alive, j : j + bits + 16]
        part = window[:, j % 16 : j % 16 + bits]
        match = np.packbits((part == y[j, alive][:, None]).ravel(), bitorder="little").view(np.uint64).reshape(-1, words)
        total = (match & rise) + rise
        over = total < rise
        for w in range(1, words):
            carry, word = over[:, w - 1], total[:, w]
            word += carry
            over[:, w] |= carry & (word == 0)
        same = (total ^ rise) | match | fall  # diagonal steps without cost
        up, down = fall | ~(same | rise), same & rise  # rows that rise and fall from the last column on
        shifted = same >> one
        shifted[:, :-1] |= same[:, 1:] << U64(63)
        rise = down | ~(shifted | up)
        fall = shifted & up
        free = np.bitwise_or.reduce(same & ends, axis=1) if words > 1 else (same & ends)[:, 0]
        score += (free == 0) & (length > j)
    out[alive] = score <= most[alive]
    return out


def counters(texts: list[str]) -> np.ndarray:
    """A row a text: its length in four bytes, and how often it has characters and character
    pairs, in counters up to 255."""
    cp = code_points("".join(texts)).astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    form = np.repeat(np.arange(len(texts)), size)
    ones = np.bincount(form * BINS + cp % BINS, minlength=len(texts) * BINS).reshape(len(texts), BINS)
    inside = np.flatnonzero(form[1:] == form[:-1])
    both = ((cp[inside] * 0x9E3779B1 + cp[inside + 1] * 0x85EBCA77) >> 11) % PAIR_BINS
    twos = np.bincount(form[inside] * PAIR_BINS + both, minlength=len(texts) * PAIR_BINS).reshape(len(texts), PAIR_BINS)
    counts = np.minimum(np.concatenate([ones, twos], axis=1), 255).astype(np.uint8)
    return np.concatenate([size.astype("<u4").view(np.uint8).reshape(-1, 4), counts], axis=1)


def may_be_similar(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether counters leave a pair of rows possible: an edit adds at most one to the characters
    that either side has more of, and changes at most four character pairs."""
    sizes = [np.ascontiguousarray(x[..., :4]).view("<u4")[..., 0].astype(np.int64) for x in (a, b)]
    most = (100 - percent) * np.maximum(*sizes) // 100
    differ = b[..., 4 : 4 + BINS].astype(np.int16) - a[..., 4 : 4 + BINS].astype(np.int16)
    more = np.maximum(differ, 0).sum(axis=-1, dtype=np.int64)
    good = np.maximum(more, more - differ.sum(axis=-1, dtype=np.int64)) <= most
    twos = np.abs(b[..., 4 + BINS :].astype(np.int16) - a[..., 4 + BINS :].astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return good & (np.abs(sizes[0] - sizes[1]) <= most) & (twos <= 4 * most)


_PAIR = ("a", "b", "ra", "rb")


def _similar_pairs(percent: int):
    """``similar`` for many pairs: by alignments, then by counters, then by distances together."""

    def run(pairs: list[tuple[str, str]]) -> np.ndarray:
        most = [(100 - percent) * max(len(a), len(b)) // 100 for a, b in pairs]
        good = np.array([aligned(a, b, m) <= m for (a, b), m in zip(pairs, most)], bool)
        left = np.flatnonzero(~good)
        may = [left[:0]]
        for at in range(0, len(left), _TOGETHER):
            part = left[at : at + _TOGETHER]
            a, b = (counters([pairs[i][side] for i in part.tolist()]) for side in (0, 1))
            may.append(part[may_be_similar(a, b, percent)])
        left = np.concatenate(may)
        good[left] = all_similar([pairs[i] for i in left.tolist()], percent)
        return good

    return run


def _check(percent: int):
    similar_pairs = _similar_pairs(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, good = batch.column("b_text"), np.zeros(batch.num_rows, bool)
            for row, own in runs(batch, "a_text", _CHECKED_CHARS // 2):
                good[row : row + len(own)] = similar_pairs(list(zip(own, others.slice(row, len(own)).to_pylist())))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _PAIR], pa.array(good, pa.bool_())], [*_PAIR, "ok"])

    return lambda pairs: pairs.mapInArrow(run, ", ".join(f"{c} long" for c in _PAIR) + ", ok boolean")


def _at_like_places(percent: int):
    """Whether two n-grams, given as lengths and places, can be aligned: the lengths before and behind them differ
    by at most the edits that a similar pair may have."""

    def near(a: Column, b: Column) -> Column:
        behind = (a["size"] - a["place"]) - (b["size"] - b["place"])
        return (F.abs(a["place"] - b["place"]) + F.abs(behind)) * 100 <= F.greatest(a["size"], b["size"]) * (100 - percent)

    def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = a - b
        return (np.abs(differ[..., 1]) + np.abs(differ[..., 0] - differ[..., 1])) * 100 <= np.maximum(a[..., 0], b[..., 0]) * (100 - percent)

    return near, meet


def _known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID).cast("long"))


def _text_hash() -> Column:
    """Tells apart texts that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _removed_lines(docs: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """(d, t, removed): for documents that lose lines, the places of these."""
    texts = docs.select(_known_id().alias("d"), _text_hash().alias("t"), "text")
    whole = ws.save(texts.mapInArrow(_emit, _LINES), "lines")
    # Most entries are alone in their bucket: they are left out as they come, before anything is joined.
    packed = whole.where("part is not null").select("part", "entries").repartition("part").sortWithinPartitions("part")
    met = ws.save(packed.mapInArrow(_met(percent), _MET), "met")
    lines = ws.save(whole.where("part is null").select("k1", "k2", "n", "d", "t", "q"), "places")
    ws.drop(whole)
    ws.release()
    # A form has one row here for each run of texts that it is in, so even those of a very common line are few.
    leads = lines.where("n > 0").repartition("k1").sortWithinPartitions("k1", "k2", "d", "q", "t")
    nodes = ws.save(leads.mapInArrow(_distinct, "k1 long, k2 long, n long, d long, t long, q long").withColumn("k", F.monotonically_increasing_id()), "nodes")
    # Forms that share the first half of their digest share buckets too.
    crowds = met.groupBy("k1").agg(F.sum("crowd").alias("crowd"))
    owners = ws.save(nodes.join(crowds.hint("merge"), "k1"), "owners")
    members = met.drop("crowd").join(owners.select("k1", "k", "crowd").hint("merge"), "k1")
    members = ws.save(members.select("bucket", "k", F.struct("size", "place").alias("about"), "crowd"), "members")
    ws.drop(met)
    ws.release()
    wanted = owners.groupBy("d", "t").agg(F.collect_list(F.struct("k", "k1", "k2", "q")).alias("wanted"))
    wanted = ws.save(wanted, "wanted")
    # Rows that repeat an id and a text give their forms once.
    same = Window.partitionBy("d", "t", "text").orderBy("d")
    once = texts.join(wanted.hint("merge"), ["d", "t"]).withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    forms = ws.save(once.select("text", "wanted").mapInArrow(_lines_of, "k long, text string"), "forms")
    ws.drop(wanted)
    ws.release()
    near, meet = _at_like_places(percent)
    may = lambda a, b: may_be_similar(a, b, percent)
    roots = linked(ws, owners.select("k"), members, forms, near, _check(percent), meet, counters, may, _similar_pairs(percent))
    ws.keep_only(nodes, owners, lines, roots)
    first = F.struct("d", "q", "t").alias("first")
    in_class = ws.save(owners.select("k", "k1", "k2", first, "n").join(roots.hint("merge"), F.col("k") == F.col("node")), "in-class")
    stays = ws.save(in_class.groupBy("root").agg(F.min("first").alias("stay"), F.sum("n").alias("all")).where("all > 1"), "stays")
    of_class = in_class.join(stays.hint("merge"), "root").select("k1", "k2", "stay")
    alone = nodes.where("n > 1").select("k1", "k2", F.struct("d", "q", "t").alias("stay"))
    keep = of_class.union(alone).groupBy("k1", "k2").agg(F.min("stay").alias("stay")).select("k1", "k2", F.col("stay.d").alias("rd"), F.col("stay.q").alias("rq"))
    keep = ws.save(keep, "keep")
    gone = lines.select("k1", "k2", "d", "t", "q").join(keep.hint("merge"), ["k1", "k2"]).where((F.col("d") > F.col("rd")) | (F.col("q") > F.col("rq")))
    return gone.groupBy("d", "t").agg(F.collect_set("q").alias("removed"))


def _kept(text: str, removed: list[int] | None) -> tuple[list[str], int]:
    lines = text.split("\n")
    if not removed:
        return lines, 0
    gone = set(removed)
    return [x for i, x in enumerate(lines) if i not in gone], len(gone)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, sha = [], [], []
        for text, removed in zip(batch.column("text"), batch.column("removed")):
            kept, lost = _kept(text.as_py() or "", removed.as_py())
            n.append(len(kept) + lost)
            gone.append(lost)
            sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_lines", "n_removed", "kept_sha256"],
        )


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed, and the SHA-256 of the lines that stay, joined by newlines."""
    ws = Workspace(docs.sparkSession, "lines")
    removed = ws.save(_removed_lines(docs, ws, percent), "removed")
    ws.keep_only(removed)
    rows = docs.select(_known_id().alias("d"), _text_hash().alias("t"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(removed.hint("merge"), ["d", "t"], "left")
    return rows.select("doc_id", "text", "removed").mapInArrow(
        _digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string"
    )


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            texts.append(text if not removed else "\n".join(_kept(text or "", removed)[0]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])


def remove(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without their repeated lines."""
    ws = Workspace(docs.sparkSession, "lines")
    removed = ws.save(_removed_lines(docs, ws, percent), "removed")
    ws.keep_only(removed)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(_known_id().alias("d"), _text_hash().alias("t"), "text", packed.alias("doc")).join(removed.hint("merge"), ["d", "t"], "left").select("doc", "text", "removed")
    cut = rows.mapInArrow(_rest, f"doc {rows.schema['doc'].dataType.simpleString()}, text string")
    return cut.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
