"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Writing takes two passes over the ids.  Documents are tokenised once and written as
plain ids; their counts, summed by Spark, give one code for the whole file set
(package-merge, at most ``MAX_LENGTH`` bits, canonical order: the lengths alone are
stored).  Then the ids are range-partitioned by doc_id, sorted, and packed in
blocks.

File format, one folder:

* ``codes``: ``(id int, length int)``, the code table.
* ``blocks``: ``shard``, ``block``, the ids of the documents in the block and how
  many ids each has, ``payload`` (the bit stream, most significant bit first) and
  ``checkpoints`` (the bit offset of every ``STRIDE``-th symbol).  A block holds
  whole documents and is decoded on its own; its checkpoints are entry points
  inside it.
* ``manifest``: ``(shard, start)``, how many ids all shards before have.

Shards are in ascending doc_id order, so are documents inside.  Decoding is driven
by a table of 2^MAX_LENGTH entries (symbol and length of the code that a window of
bits starts with); all checkpoints of a run of blocks step together.

Cases: a null text counts as empty and gives the end id alone; null ids come first;
rows that share a doc_id are ordered by their ids' checksum and size, rows that
repeat fully are interchangeable; one block holds a document however long; an empty
table gives an empty file set; further columns of the input are not stored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .pretokens import TOGETHER, Encoder
from .textnum import runs
from .workspace import Workspace

MAX_LENGTH = 20
STRIDE = 128
BLOCK_IDS = 1 << 17
END_ID = 0
#: Pre-tokens a worker remembers, some 150 bytes each.
REMEMBERED = 600_000
#: The characters that byte-level vocabularies write for bytes: printable ones for themselves, further ones for the rest.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - _PRINTABLE))}
_encoders: dict = {}
_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


# Tokens


class _Tokens:
    """The library's ids of texts.  BPE never crosses a pre-token, so distinct pre-tokens are
    encoded once; a text that spells an added token goes to the library whole."""

    def __init__(self, spec: str):
        tokenizer = Tokenizer.from_str(spec)
        self.library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.model = tokenizer.model
        self.model._resize_cache(0)  # a pre-token is asked for once, so the model's own memory of them costs more than it gives
        self.encoder = Encoder(self._pieces, remembered=REMEMBERED)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pre-tokens, which need no splitting: the library's model gets them as its byte-level
        step would hand them over."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(_BYTE_LEVEL))] for p in pieces]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the place where each text's begin (and the last one's end)."""
        whole = [i for i, text in enumerate(texts) if any(a in text for a in self.added)]
        if not whole:
            return self.encoder.ids(texts)
        rest = list(texts)
        for i in whole:
            rest[i] = ""
        flat, first = self.encoder.ids(rest)
        pieces = np.split(flat, first[1:-1])
        for i, ids in zip(whole, self.library([texts[i] for i in whole])):
            pieces[i] = np.array(ids, np.uint32)
        return np.concatenate(pieces), np.append(0, np.cumsum([len(p) for p in pieces]))


def _encoder(spec: str) -> _Tokens:
    key = str(hash(spec))
    if key not in _encoders:
        _encoders[key] = _Tokens(spec)
    return _encoders[key]


def _tokenise(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine's cores already
        encoder = _encoder(spec)
        for batch in batches:
            for row, texts in runs(batch, limit=TOGETHER):
                flat, first = encoder.ids(texts)
                full = np.insert(flat, first[1:], END_ID).astype("<u4")
                first = first + np.arange(len(first))
                data = pa.py_buffer(full.astype("<u2").tobytes()) if not len(full) or full.max() < 1 << 16 else None
                width = 2 if data is not None else 4
                data = data or pa.py_buffer(full.tobytes())
                ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((first * width).astype(np.int32)), data])
                crc = [zlib.crc32(full[a:b]) for a, b in zip(first.tolist(), first.tolist()[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(texts)),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(texts), width), pa.int32()),
                        ids,
                    ],
                    ["doc_id", "n", "crc", "width", "ids"],
                )

    return run


_TOKENS = "doc_id long, n long, crc long, width int, ids binary"


def _read(ids: pa.Array, width: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), f"<u{w.as_py()}").astype(np.uint32) for v, w in zip(ids, width)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for own in _read(batch.column("ids"), batch.column("width")):
            count = np.bincount(own, minlength=len(total))
            count[: len(total)] += total
            total = count
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


# The code


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.float64) if counts.sum() >= 1 << 62 else counts[order].astype(np.int64)
    rows, packed = [], weight[:0]
    for _ in range(limit):
        both = np.concatenate([weight, packed])
        place = np.argsort(both, kind="stable")
        rows.append(place < n)
        both = both[place]
        packed = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(rows):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of symbols in order: shorter first, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    sizes = np.bincount(lengths)
    at = 0
    for size, many in enumerate(sizes.tolist()):
        code <<= size - last
        last = size
        codes[order[at : at + many]] = code + np.arange(many)
        code += many
        at += many
    return codes


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of the ids, and the bit offset of every ``STRIDE``-th."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = length[ids]
    start = np.cumsum(size) - size
    word, shift = start >> 5, 64 - (start & 31) - size
    bits = code[ids].astype(np.uint64) << shift.astype(np.uint64)
    head = np.flatnonzero(np.diff(word, prepend=-1))  # codes are shorter than a word: one starts in every word
    high, low = np.add.reduceat(bits >> np.uint64(32), head), np.add.reduceat(bits & np.uint64(0xFFFFFFFF), head)
    out = np.zeros(len(head) + 1, np.uint64)
    out[:-1] += high
    out[1:] += low
    end = int(start[-1] + size[-1])
    return out.astype(">u4").tobytes()[: (end + 7) // 8], start[::STRIDE]


def decoder(lengths: np.ndarray, codes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next ``MAX_LENGTH`` bits."""
    symbol, size = np.zeros(1 << MAX_LENGTH, np.uint32), np.zeros(1 << MAX_LENGTH, np.uint8)
    order = np.argsort(codes << (MAX_LENGTH - lengths), kind="stable")
    span = np.left_shift(1, MAX_LENGTH - lengths[order])
    end = int(span.sum())
    symbol[:end], size[:end] = np.repeat(symbols[order], span), np.repeat(lengths[order], span)
    return symbol, size


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int], symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of some blocks in a row; all checkpoints are entered and stepped together."""
    data = b"".join(p + b"\0" * 8 for p in payloads)
    base = np.cumsum([0] + [len(p) + 8 for p in payloads[:-1]]) * 8 if payloads else np.zeros(0, np.int64)
    at = np.concatenate([c + b for c, b in zip(checkpoints, base)]) if payloads else np.zeros(0, np.int64)
    lanes = [np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) for n in counts]
    left = np.concatenate(lanes) if lanes else np.zeros(0, np.int64)
    out = np.zeros((len(at), STRIDE), np.uint32)
    stream = np.frombuffer(data, np.uint8)
    words = (stream[:-3].astype(np.uint32) << 24) | (stream[1:-2].astype(np.uint32) << 16) | (stream[2:-1].astype(np.uint32) << 8) | stream[3:] if len(stream) else stream
    shift = np.uint32(32 - MAX_LENGTH)
    for step in range(STRIDE):
        # 32 bits from the byte at hand hold the 7 bits passed and the MAX_LENGTH wanted.
        window = ((words[at >> 3] << (at & 7).astype(np.uint32)) >> shift).astype(np.int64)
        out[:, step] = symbol[window]
        at = at + np.where(step < left, size[window], 0)
    return out[np.arange(STRIDE)[None, :] < left[:, None]]


# Blocks


def _shards(table: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = (np.frombuffer(x, np.int64) for x in (table[: len(table) // 2], table[len(table) // 2 :]))
        width = int(ids.max()) + 1 if len(ids) else 0
        code, length = np.zeros(width, np.int64), np.zeros(width, np.int64)
        code[ids], length[ids] = canonical(lengths), lengths
        block, shard, docs, own, size = 0, None, [], [], 0

        def close():
            flat = np.concatenate(own)
            payload, marks = pack(flat, code, length)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in own]], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                    pa.array([marks.astype("<i8").tobytes()], pa.binary()),
                ],
                ["shard", "block", "doc_ids", "sizes", "payload", "checkpoints"],
            )

        for batch in batches:
            for doc_id, here, x in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), _read(batch.column("ids"), batch.column("width"))):
                if own and (shard != here or size + len(x) > BLOCK_IDS):
                    yield close()
                    block, docs, own, size = block + 1, [], [], 0
                shard = here
                docs.append(doc_id)
                own.append(x)
                size += len(x)
        if own:
            yield close()

    return run


_BLOCKS = "shard int, block long, doc_ids array<long>, sizes array<long>, payload binary, checkpoints binary"


def write(docs: DataFrame, spec: str, path: str) -> None:
    """Tokenises the texts and writes the file set.  ``spec`` is the tokenizer's JSON."""
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    tokens = ws.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(spec), _TOKENS), "ids"
    )
    counts = (
        tokens.select("width", "ids")
        .mapInArrow(_count, "id long, n long")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
        .orderBy("id")
        .collect()  # at most one row for each id of the vocabulary
    )
    ids = np.array([r["id"] for r in counts], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in counts], np.int64))
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("n")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = ranged.select("doc_id", "width", "ids", F.spark_partition_id().alias("shard")).mapInArrow(
        _shards(ids.tobytes() + lengths.tobytes()), _BLOCKS
    )
    blocks.write.parquet(f"{path}/blocks")
    sizes = (
        read_blocks(spark, path)
        .groupBy("shard")
        .agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
        .orderBy("shard")
        .collect()  # one row for each shard, at most the number of shuffle partitions
    )
    starts, total = [], 0
    for r in sizes:
        starts.append((r["shard"], total))
        total += r["n"]
    spark.createDataFrame(starts, "shard int, start long").coalesce(1).write.parquet(f"{path}/manifest")
    ws.drop(tokens)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def read_codes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.schema("id int, length int").parquet(f"{path}/codes").orderBy("id").collect()
    return np.array([r["id"] for r in rows], np.int64).tobytes() + np.array([r["length"] for r in rows], np.int64).tobytes()


def _decoding(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    if table not in _tables:
        ids, lengths = (np.frombuffer(x, np.int64) for x in (table[: len(table) // 2], table[len(table) // 2 :]))
        _tables.clear()
        _tables[table] = decoder(lengths, canonical(lengths), ids)
    return _tables[table]


def _blocks_of(batch: pa.RecordBatch, table: bytes) -> Iterator[tuple[int, np.ndarray]]:
    symbol, size = _decoding(table)
    for i in range(batch.num_rows):
        n = sum(batch.column("sizes")[i].as_py())
        marks = np.frombuffer(batch.column("checkpoints")[i].as_py(), "<i8")
        yield i, unpack([batch.column("payload")[i].as_py()], [marks], [n], symbol, size)


def _documents(table: bytes, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, flat in _blocks_of(batch, table):
                docs, sizes = batch.column("doc_ids")[i].as_py(), np.array(batch.column("sizes")[i].as_py(), np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                flat = flat.astype("<u4")
                columns = [
                    pa.array([batch.column("shard")[i].as_py()] * len(docs), pa.int32()),
                    pa.array([batch.column("block")[i].as_py()] * len(docs), pa.int64()),
                    pa.array(docs, pa.int64()),
                    pa.array(first[:-1], pa.int64()),
                    pa.array(sizes, pa.int64()),
                ]
                if whole:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.astype(np.int32))))
                else:
                    columns.append(pa.array([zlib.crc32(flat[a:b]) for a, b in zip(first.tolist(), first.tolist()[1:])], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "doc_id", "at", "n_tokens", "ids" if whole else "ids_crc32"])

    return run


def _read_documents(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """Documents of the files with the place of their first id in all ids."""
    last = "ids array<int>" if whole else "ids_crc32 long"
    docs = read_blocks(spark, path).mapInArrow(
        _documents(read_codes(spark, path), whole), f"shard int, block long, doc_id long, at long, n_tokens long, {last}"
    )
    sizes = read_blocks(spark, path).select(
        "shard", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    )
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema("shard int, start long").parquet(f"{path}/manifest")
    places = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(manifest, "shard")
    return docs.join(places.select("shard", "block", (F.col("start") + F.col("before")).alias("base")), ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", last.split()[0]
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in the files."""
    return _read_documents(spark, path, True)


def report(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written and read back."""
    path = f"{Workspace(docs.sparkSession, 'token-files').path}/files"
    write(docs, spec, path)
    return _read_documents(docs.sparkSession, path, False)


def entropy_bound(counts: dict[int, int]) -> int:
    """Bits of an unlimited Huffman code of these counts, the least any prefix code takes."""
    heap = sorted(counts.values())
    total = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total
