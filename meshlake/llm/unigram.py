"""Token counts: a Viterbi pass that keeps scores and counts only.

The vocabulary is a list of (piece, score).  A text is cut before every space (or
U+2581), spaces become U+2581, one is put in front; each piece of text is segmented
on its own, as the tokenizers library does for a Unigram model with a Metaspace
pre-tokenizer.  An Aho-Corasick automaton gives the vocabulary pieces that end at
each character, longest first.  For every character the best score and the number
of tokens of the best segmentation are kept; nothing is traced back.

Ties as in the library: of equal scores the segmentation whose last piece starts
first wins.  A character that isn't a piece scores the least score minus 10 and
counts as its bytes if the vocabulary has all byte pieces; else a run of such
characters counts as one token.

Cases: a null text counts as empty, and empty texts have no tokens; repeated rows
get equal counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import code_points, numbered, runs

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pieces of text a worker remembers; later ones are counted again in each batch.
REMEMBERED = 250_000
_models: dict = {}


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of one piece of text."""
        n = len(text)
        best, tokens = [0.0] * (n + 1), [0] * (n + 1)
        reached, run = [True] + [False] * n, [False] * (n + 1)
        at = 0

        def unknown(end: int) -> None:
            """The character before ``end`` as unknown; the last candidate there, as its start is the last."""
            score = best[end - 1] + self.unknown
            if not reached[end] or score > best[end]:
                more = len(text[end - 1].encode()) if self.bytes else int(not run[end - 1])
                best[end], tokens[end], reached[end], run[end] = score, tokens[end - 1] + more, True, True

        single = False
        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            while at + 1 < end:  # characters where no piece ends
                at += 1
                if not single:
                    unknown(at)
                single = False
            start = end - size
            total = best[start] + score
            if not reached[end] or total > best[end]:
                best[end], tokens[end], reached[end], run[end] = total, tokens[start] + 1, True, False
            single = single or size == 1
        while at < n:
            at += 1
            if not single:
                unknown(at)
            single = False
        return tokens[n]

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; equal pieces of a batch are counted once."""
        joined = "".join(texts)
        cp = code_points(joined)
        doc = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=doc[1:])
        begins = np.zeros(len(cp) + 1, bool)
        begins[:-1] = (cp == 32) | (cp == 0x2581)
        begins[doc] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(cp))
        code, where = numbered(cp, start, end)
        counts = []
        for s, e in zip(start[where].tolist(), end[where].tolist()):
            piece = joined[s:e]
            piece = MARK + (piece[1:] if piece[0] in " ▁" else piece)
            found = self.known.get(piece)
            if found is None:
                found = self.count(piece)
                if len(self.known) < REMEMBERED and len(piece) <= 64:
                    self.known[piece] = found
            counts.append(found)
        sums = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[code])]) if len(code) else np.zeros(1, np.int64)
        first = np.searchsorted(start, doc)
        return (sums[first[1:]] - sums[first[:-1]]).tolist()


def counter(pieces: list[tuple[str, float]]) -> Counter:
    """The worker's counter of these pieces, made once."""
    key = hashlib.blake2b(repr(pieces).encode()).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Counter(pieces)
    return _models[key]


def _counts(pieces: list[tuple[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(pieces)
        for batch in batches:
            counts = [n for _, texts in runs(batch) for n in own.texts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def report(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id and n_tokens of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counts(pieces), "doc_id long, n_tokens long")
