"""Byte-level BPE against the libraries that define it."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlake.llm import bytebpe
from meshlake.llm.pretokens import PreTokens

RULE = regex.compile(public_tokenizers.PATTERN)
TRICKY = st.text(st.sampled_from(list("abstvelmrd'' \n\t 12é²Ⅷ。 　\x1c\x85​!-") + ["😀", "ﬁ", "́"]), max_size=40)


@pytest.fixture(scope="module")
def tokens():
    return bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def pieces(texts):
    pre = PreTokens(texts)
    all_ = [pre.text[s:e] for s, e in zip(pre.start.tolist(), pre.end.tolist())]
    return [all_[a:b] for a, b in zip(pre.first.tolist(), pre.first.tolist()[1:])]


#: Characters that every library's version of Unicode has assigned.
ASSIGNED = st.text(st.characters(exclude_categories=["Cn", "Cs"], max_codepoint=0x1F000), max_size=20)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(TRICKY, ASSIGNED), max_size=5))
def test_pre_tokens(texts):
    assert pieces(texts) == [RULE.findall(t) for t in texts]


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        table = bytebpe.PerfectHash(keys)
        assert table.find(keys).tolist() == list(range(len(keys)))
        assert sorted(table.value.tolist()) == list(range(len(keys)))
        assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


@settings(max_examples=150, deadline=None)
@given(st.one_of(TRICKY, st.text(max_size=30), st.text("ab", min_size=30, max_size=300)))
def test_ids(tokens, library, text):
    flat, first = bytebpe.model(tokens).encoder.ids(["x", text, ""])
    ids = flat[first[1] : first[2]].tolist()
    assert ids == library.encode_ordinary(text)
    assert bytebpe.model(tokens).decode(ids) == text.encode()


def test_queries(spark, sf_dir, tokens, library):
    odd = [(1, None), (2, ""), (3, "<|endoftext|>"), (3, "<|endoftext|>"), (None, "a" * 200_000), (5, " \n\n  x")]
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.createDataFrame(odd, "doc_id long, text string")):
        want = []
        for r in docs.collect():
            ids = library.encode_ordinary(r.text or "")
            sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            want.append((r.doc_id, len(ids), sha, hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(str, map(tuple, bytebpe.report(docs, tokens).collect()))) == sorted(map(str, want))
        encoded = bytebpe.encode(docs, tokens)
        assert encoded.columns == [*docs.columns, "ids"]
        assert all(bytes(r.decoded).decode() == (r.text or "") for r in bytebpe.decode(encoded, tokens).collect())
    assert bytebpe.report(docs.limit(0), tokens).count() == 0


def test_decode_in_parts(spark, tokens, monkeypatch):
    rows = [(i, None if i % 5 == 0 else list(range(i * 7, i * 7 + i % 13)) if i % 11 else []) for i in range(200)]
    for limit in (1, 20, 10**6):
        own = list(bytebpe._decode(tokens)(iter(batches(rows, limit, monkeypatch))))
        found = [v for b in own for v in b.column("decoded").to_pylist()]
        assert found == [None if ids is None else b"".join(tokens[t] for t in ids) for _, ids in rows]
        assert [v for b in own for v in b.column("row").to_pylist()] == [i for i, _ in rows]


def batches(rows, limit, monkeypatch):
    monkeypatch.setattr(bytebpe, "DECODED", limit)
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["row", "ids"])
    return [whole.slice(0, 90), whole.slice(90)]


def test_merge_order(tokens, library):
    rng = random.Random(2)
    ranks = {t: i for i, t in enumerate(tokens)}
    for _ in range(300):
        word = "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 60)))
        assert bytebpe.merge(word.encode(), ranks) == library.encode_ordinary(word)
