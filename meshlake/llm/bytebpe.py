"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Encoding gives the ids of the tiktoken library for the same ranks and pattern,
without special tokens; decoding joins the ids' bytes.  Ranks are read from the
vocabulary file on the driver once and travel with the tasks' closure.

Cases: a null text counts as empty and has no ids; repeated rows get equal ids; an
empty table gives no rows; further columns pass through ``encode`` and ``decode``
untouched, but for a column of the name that the output has: it is replaced, as
``withColumn`` would.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import TOGETHER, Encoder
from .textnum import code_points, mix, positions, proposals, runs

#: Ids that are decoded together.
DECODED = 500_000
_models: dict = {}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks have no gaps."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Hash and displace: n keys to 0..n-1 without gaps.

    Keys fall into n / 4 buckets; large buckets first, each tries displacements until
    its keys land on free slots.  A bucket of one key keeps its slot itself, as a
    negative number.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key, self.value = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        for b in np.argsort(cuts[:-1] - cuts[1:], kind="stable").tolist():
            own = order[cuts[b] : cuts[b + 1]]
            if len(own) > 1:
                slots = self._displace(keys[own], b, taken)
            elif len(own):
                break
            else:
                continue
            taken[slots] = True
            self.key[slots], self.value[slots] = keys[own], own
        single = np.flatnonzero(cuts[1:] - cuts[:-1] == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        own = order[cuts[single]]
        self.shift[single] = -free - 1
        self.key[free], self.value[free] = keys[own], own

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def _displace(self, keys: np.ndarray, bucket: int, taken: np.ndarray) -> np.ndarray:
        tried = 0
        while True:
            shift = np.arange(tried, tried + 64)
            slots = self._slots(keys[None, :], shift[:, None])
            ordered = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                row = int(good.argmax())
                self.shift[bucket] = tried + row
                return slots[row]
            tried += 64

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 for a key that isn't one."""
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slots(keys, np.maximum(shift, 0)))
        return np.where(self.key[slot] == keys, self.value[slot], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if middle < 0 or middle >= n or after[middle] != end:
            continue  # one of the two has been merged with another meanwhile
        after[i], after[middle] = end, -1
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Model:
    """The two tiers over a list of tokens by rank."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        texts = []
        for i, token in enumerate(tokens):
            try:
                texts.append((token.decode(), i))
            except UnicodeDecodeError:  # part of a character: never a pre-token
                pass
        self.whole = [t for t, _ in texts]
        self.rank = np.array([i for _, i in texts], np.int64)
        hashes = np.concatenate([_hashes(self.whole[i : i + 4096]) for i in range(0, len(self.whole), 4096)])
        self.table = PerfectHash(hashes)
        self.encoder = Encoder(self._rest, self._find)
        self.numbers = [b"%d" % i for i in range(len(tokens))]

    def _find(self, hashes: np.ndarray, pieces: list[str]) -> list[int]:
        found, whole = self.table.find(hashes), self.whole
        ranks = np.where(found >= 0, self.rank[found], -1)
        return [r if f >= 0 and whole[f] == p else -1 for r, f, p in zip(ranks.tolist(), found.tolist(), pieces)]

    def _rest(self, pieces: list[str]) -> list[list[int]]:
        return [merge(p.encode(), self.ranks) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _hashes(texts: list[str]) -> np.ndarray:
    """The hash that ``PreTokens`` gives a pre-token of this text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return proposals(code_points("".join(texts)), np.cumsum(size) - size, size)


def model(tokens: list[bytes]) -> Model:
    """The worker's model of these tokens, made once."""
    key = (len(tokens), hashlib.blake2b(b"".join(tokens)).digest())
    if key not in _models:
        _models.clear()
        _models[key] = Model(tokens)
    return _models[key]


class Speller:
    """Bytes of ids, cut from the tokens in a row."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The bytes of each of the lists that begin at ``first`` (and where the last one ends)."""
        ends = np.append(0, np.cumsum(self.size[ids]))[first]
        data = self.blob[positions(self.start[ids], self.size[ids])]
        return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _encode(tokens: list[bytes], spelled: list[bytes] | None = None):
    """Rows with ids and, given the tokens to spell them with, their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(tokens)
        speller = None if spelled is None else Speller(spelled)
        for batch in batches:
            for row, texts in runs(batch, limit=TOGETHER):
                flat, first = own.encoder.ids(texts)
                ids = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.astype(np.int32)))
                columns = [batch.column("doc").slice(row, len(texts)), ids]
                if speller is not None:
                    columns.append(speller.texts(flat, first))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "ids", "decoded"][: len(columns)])

    return run


def _packed(docs: DataFrame) -> tuple[DataFrame, str]:
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))
    return packed, packed.schema["doc"].dataType.simpleString()


def encode(docs: DataFrame, tokens: list[bytes], output: str = "ids") -> DataFrame:
    """The rows with the ids of their text, an array of int."""
    packed, kind = _packed(docs)
    out = packed.mapInArrow(_encode(tokens), f"doc {kind}, ids array<int>")
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != output.lower()], F.col("ids").alias(output))


def round_trip(docs: DataFrame, tokens: list[bytes], output: str = "ids", spelled: list[bytes] | None = None) -> DataFrame:
    """The rows with the ids of their text and, as ``text``, what these ids spell (null stays null).

    Encoding and decoding share a worker; ``spelled`` are the tokens to decode with, if they differ.
    """
    packed, kind = _packed(docs)
    out = packed.mapInArrow(_encode(tokens, spelled or tokens), f"doc {kind}, ids array<int>, decoded binary")
    text = F.when(F.col("doc.text").isNotNull(), F.col("decoded").cast("string")).alias("text")
    columns = [text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != output.lower()]
    return out.select(*columns, F.col("ids").alias(output))


def _decode(tokens: list[bytes]):
    """Adds the bytes of ids, of some ``DECODED`` ids at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(tokens)
        for batch in batches:
            many = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy()
            upto, first = np.cumsum(many), 0
            while first < len(many):
                last = max(first + 1, int(np.searchsorted(upto, upto[first] - many[first] + DECODED, side="right")))
                part = batch.column("ids").slice(first, last - first)
                texts = speller.texts(part.flatten().to_numpy(), np.append(0, np.cumsum(many[first:last])))
                texts = pc.if_else(part.is_valid(), texts, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, last - first), texts], ["row", "decoded"])
                first = last

    return run


def decode(rows: DataFrame, tokens: list[bytes], ids: str = "ids", output: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids (null for null)."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{ids}`").alias("ids"))
    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(_decode(tokens), f"row {kind}, decoded binary")
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns if c.lower() != output.lower()], F.col("decoded").alias(output))


def _digest(tokens: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(tokens)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, texts in runs(batch, limit=TOGETHER):
                flat, first = own.encoder.ids(texts)
                flat, first = flat.tolist(), first.tolist()
                for a, b in zip(first, first[1:]):
                    ids = flat[a:b]
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join(map(own.numbers.__getitem__, ids))).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def report(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digest(tokens), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
