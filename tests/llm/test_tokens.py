"""Token files by round trip, token counts against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from meshlake.llm import pretokens, tokenfile, unigram

SPEC = open(public_tokenizers.path("byte_bpe_50k.json")).read()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60), st.integers(6, 20), st.randoms())
def test_code(counts, limit, rng):
    lengths = tokenfile.code_lengths(np.array(counts, np.int64), limit)
    assert lengths.max() <= limit and (2.0 ** -lengths).sum() <= 1
    if limit == 20:
        assert int((lengths * counts).sum()) == max(tokenfile.entropy_bound(dict(enumerate(counts))), counts[0] * (len(counts) == 1))
    codes = tokenfile.canonical(lengths)
    words = sorted(f"{c:0{n}b}" for c, n in zip(codes.tolist(), lengths.tolist()))
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))
    ids = np.array(rng.choices(range(len(counts)), k=rng.randrange(700)), np.int64)
    data, marks = tokenfile.pack(ids, codes, lengths)
    symbol, size = tokenfile.decoder(lengths, codes, np.arange(len(counts)))
    back = tokenfile.unpack([data, data], [marks, marks], [len(ids)] * 2, symbol, size)
    assert back.tolist() == ids.tolist() * 2


def test_length_limit_is_optimal():
    """Fibonacci counts make an unlimited code deep; the limited one is no worse than any by brute force on few symbols."""
    counts = np.array([1, 1, 2, 3, 5, 8], np.int64)
    tables = [[x + 1 for x in lens] for lens in np.ndindex(*[3] * 6)]
    best = min(sum(c * n for c, n in zip(counts, lens)) for lens in tables if sum(2.0**-n for n in lens) <= 1)
    assert int((tokenfile.code_lengths(counts, 3) * counts).sum()) == best


def want(docs, tokenizer):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files(spark, sf_dir, tmp_path, monkeypatch):
    tokenizer = Tokenizer.from_str(SPEC)
    odd = [(None, "first"), (1, None), (2, ""), (3, "!!! <|endoftext|> !"), (7, "<|endoftext|>"), (8, "a <|endoftext|>b<|endoftext|><|endoftext|> c <|endoftext|"), (4, "é" * 3000 + " 😀" * 300), (-5, "x")]
    odd_docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (table, limit) in enumerate([(docs, 1 << 17), (docs, 1000), (odd_docs, 1 << 17), (odd_docs.where("doc_id = 1"), 10)]):
        monkeypatch.setattr(tokenfile, "BLOCK_IDS", limit)
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = tokenfile.report(table, SPEC)
        assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want(rows, tokenizer)
    tokenfile.write(odd_docs, SPEC, f"{tmp_path}/files")
    back = {r.doc_id: r.ids for r in tokenfile.read(spark, f"{tmp_path}/files").collect()}
    assert back == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in odd}
    assert tokenfile.report(docs.limit(0), SPEC).count() == 0


def test_pieces_as_the_library_has_them():
    """A worker remembers few pre-tokens or many, long ones among them: the ids are the library's on whole texts."""
    tokenizer = Tokenizer.from_str(SPEC)
    odd = ["".join(map(chr, range(0x180))), "a" * 500 + " ü" * 70 + "\u3000\n\n x", "it's 12345 😀\t ok\x00\x7f\xad"]
    texts = odd + [f"wörd{i} x{i * i} Queoule{i % 7}" for i in range(300)] + odd
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (0, 5, 1000):
        tokens = tokenfile._Tokens(SPEC)
        tokens.encoder = pretokens.Encoder(tokens._pieces, remembered=remembered)
        asked = []
        rest = tokens.encoder._rest
        tokens.encoder._rest = lambda pieces, asked=asked, rest=rest: asked.append(len(pieces)) or rest(pieces)
        for _ in range(3):
            flat, first = tokens.ids(texts)
            assert [x.tolist() for x in np.split(flat, first[1:-1])] == want
        assert len(tokens.encoder._known) <= remembered
        if remembered == 1000:
            assert asked[1:] == [2, 2]  # the two of more than 64 letters, which are not remembered


@pytest.fixture(scope="module")
def pieces():
    return unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def library(pieces):
    fallback = any(p == "<0x00>" for p, _ in pieces)
    out = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    out.pre_tokenizer = pre_tokenizers.Metaspace()
    return out


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abcdetn '\n▁梦é😀<unk>0x", max_size=60)))
def test_counts(pieces, text):
    tokenizer = _cached(pieces)
    assert unigram.counter(pieces).texts(["a", text, ""]) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in ("a", text, "")]


_made = []


def _cached(pieces):
    if not _made:
        _made.append(library(pieces))
    return _made[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -1.5])), min_size=1, max_size=10), st.text("abc ", max_size=25))
def test_ties_and_unknown_runs(vocabulary, text):
    own = [("<unk>", 0.0), *dict(vocabulary).items()]
    assert unigram.Counter(own).texts([text]) == [len(library(own).encode(text, add_special_tokens=False).ids)]


def test_count_query(spark, sf_dir, pieces):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (None, " "), (3, "a b"), (3, "a b")], "doc_id long, text string")
    for table in (docs, odd, odd.limit(0)):
        expect = sorted((str(r.doc_id), len(_cached(pieces).encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
        assert sorted((str(r.doc_id), r.n_tokens) for r in unigram.report(table, pieces).collect()) == expect
