"""Substring dedup against a direct reading of its rule."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hard_texts import thue_morse

from meshlake.llm import substrings
from meshlake.llm.textnum import Sequence, Words, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, n_words, n_removed, sha) by sets of windows, rows with ids of their own."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r)[:4] for r in substrings.report(docs).collect()), key=str)


def test_words():
    texts = ["", " a\tb ", "éa 😀\x0bz", "x" * 5, "\n\n"]
    words = Words(texts)
    assert [words.words(i) for i in range(len(texts))] == [WORD.findall(t) for t in texts]
    same = Words(["aB c", "ab C c"], lower=True)
    h = same.lanes()[0].tolist()
    assert same.code.tolist() == [0, 1, 0, 1, 1]
    assert h[0] == h[2] and h[1] == h[3] == h[4] and h[0] != h[1]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 9, "c"])], ["text"])
    assert [(r, len(t)) for r, t in runs(batch, limit=6)] == [(0, 2), (2, 1), (3, 1)]


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_shared_passages(spark):
    """Passages in many surroundings, small vocabularies, periodic texts and copies."""
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(15, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            kind = rng.random()
            if kind < 0.5:
                words = rng.choice(passages).split()
                a = rng.randrange(len(words))
                parts.append(" ".join(words[a : a + rng.randrange(5, 60)] if rng.random() < 0.5 else words))
            elif kind < 0.6:
                parts.append(" ".join(["x y", "x", "p q r"][rng.randrange(3)].split() * rng.randrange(5, 30)))
            else:
                parts.append(" ".join(str(rng.randrange(30)) for _ in range(rng.randrange(30))))
        rows.append((i * 3 - 60, " ".join(parts)))
    rows += [(9000 + i, rows[i][1]) for i in range(10)] + [(None, rows[3][1]), (9990, None), (9991, ""), (9992, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs) == brute(rows)


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in substrings.report(docs).collect()) == [(1, 40, 0), (1, 40, 0), (2, 40, 0), (2, 40, 40), (3, 40, 40)]
    assert substrings.report(docs.limit(0)).count() == 0


def test_spans_and_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, f"x  y {a}", 5, "k"), (2, f"p q {a} r", 6, None), (3, "few  words", 7, "z")], "doc_id long, text string, h int, d string"
    )
    parse = [tuple(r) for r in substrings.spans(docs).collect()]
    assert parse == [(2, 2, 60, 1, 2)]
    left = {r.doc_id: r for r in substrings.remove(docs).collect()}
    assert substrings.remove(docs).columns == docs.columns
    assert left[2].text == "p q r" and left[2].h == 6 and left[2].d is None
    assert left[1].text == f"x  y {a}" and left[3].text == "few  words"


def test_run_hashes():
    words = Words(["the same words here", "here the same words"])
    for n in (1, 2, 3):
        runs_of = Sequence(words.lanes()[0]).runs(np.array([0, 5]), n)
        assert runs_of[0] == runs_of[1] != Sequence(words.lanes()[0]).runs(np.array([1]), n)[0]
    mixed = Sequence(words.lanes()[1]).piece(np.array([0, 5, 0]), np.array([2, 2, 3]))
    assert mixed[0] == mixed[1] != mixed[2]


def test_no_hash_decides(spark):
    """Words and word sequences that polynomial hashes take for one stay apart."""
    one, other = thue_morse(11, "a", "b")
    rows = [(1, " ".join(["w"] * 0 + [f"x{i}" for i in range(19)] + [one])), (2, " ".join([f"x{i}" for i in range(19)] + [other]))]
    rows += [(i + 3, t) for i, t in enumerate(thue_morse(6, "a ", "b "))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_null_ids(spark):
    """Texts without an id are met by their text: each gets its own result."""
    rng = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [" ".join(f"{rng.randrange(10**6)}" for _ in range(30)) + (" " + shared if i % 3 else "") for i in range(60)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(5, shared)], "doc_id long, text string").repartition(4)
    result = substrings.report(docs).collect()
    assert sorted(r.n_words for r in result) == sorted(len(t.split()) for t in [*texts, shared])
    assert {r.n_removed for r in result if r.doc_id == 5} == {40} and all(r.n_removed <= 40 for r in result)
