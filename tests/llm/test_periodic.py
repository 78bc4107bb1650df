"""Runs of words against a plain reading of their rule."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlake.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, end, period): for each period, stretches of words equal to those before by it; smallest periods only."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            a, b = i - q, j
            if b - a >= max(6, 4 * q):
                # A multiple of a period with the same stretch is not the smallest.
                best.setdefault((a, b), q)
            i = j
    return sorted((a, b, q) for (a, b), q in best.items())


def brute(rows):
    out = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        n = len(w)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        gone = set()
        for a, b, q in found:
            gone.update(range(a + q, b))
        told = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(found, key=lambda r: (r[0], r[2])))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        top = min(((a, b - a, q) for a, b, q in found), key=lambda r: (-r[1], r[0], r[2]), default=None)
        out.append((doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else [None] * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in periodic.report(docs).collect()), key=str)


def periodic_words(rng, symbols):
    out = []
    for _ in range(rng.randrange(1, 6)):
        base = [rng.randrange(symbols) for _ in range(rng.randrange(1, 25))]
        if rng.random() < 0.3:
            base = base[:3] * rng.randrange(1, 5) + base[:1]
        out += base * rng.randrange(1, 8) + base[: rng.randrange(len(base) + 1)]
    return out


def test_runs_of_several_texts():
    rng = random.Random(3)
    for _ in range(300):
        texts = [periodic_words(rng, rng.choice([1, 2, 3, 50])) if rng.random() < 0.9 else [] for _ in range(rng.randrange(1, 6))]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        code = np.array([c for t in texts for c in t], np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        want = [(a + first[i], b + first[i], q) for i, t in enumerate(texts) for a, b, q in brute_runs(t)]
        assert sorted(map(tuple, periodic.runs_of(code, doc, first).tolist())) == sorted(want)


@given(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(2, 4), st.integers(2, 8))
@settings(max_examples=300, deadline=None)
def test_trees_find_all_runs(symbols, times, least):
    """Without the sieve, and for other bounds."""
    n, best = len(symbols), {}
    for q in range(1, n // times + 1):
        for a in range(n):
            b = a + q
            while b < n and symbols[b] == symbols[b - q]:
                b += 1
            if b - a >= max(least, times * q) and (a == 0 or symbols[a - 1] != symbols[a - 1 + q]):
                best.setdefault((a, b), q)
    found = periodic.find_runs(np.array([*symbols, 3]), times, least)
    assert sorted(map(tuple, found.tolist())) == sorted((a, b, q) for (a, b), q in best.items())


@given(st.lists(st.integers(0, 1), min_size=2, max_size=30), st.data())
@settings(max_examples=200, deadline=None)
def test_common_extensions(symbols, data):
    e = periodic.Extensions([*symbols, 2])
    a, b = data.draw(st.lists(st.integers(0, len(symbols)), min_size=2, max_size=2, unique=True))
    whole, n = [*symbols, 2], 0
    while max(a, b) + n < len(whole) and whole[a + n] == whole[b + n]:
        n += 1
    assert e.common(np.array([a]), np.array([b])).tolist() == [n]


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert sum(r[1] for r in want) > 0


def test_hard_texts(spark):
    rng = random.Random(9)
    texts = [None, "", " \t", "a", "a " * 5, "a\ta\na a a  a", "é 😀 " * 9, "x y z " * 4 + "x", "x y z " * 3 + "x y", "ab " * 7 + "cd " * 9]
    texts += [" ".join(map(str, periodic_words(rng, 4))) for _ in range(60)]
    texts.append(" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(9_000)))
    texts.append(" ".join(f"w{i % 1500}" for i in range(20_000)))
    rows = [(i, t, 1, 2, "v") for i, t in enumerate(texts)] + [(None, texts[6], 1, 2, None), (7, texts[7], 1, 2, "v"), (7, texts[7], 1, 2, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, period int, source string").repartition(3)
    assert got(docs) == brute([r[:2] for r in rows])
    assert got(docs.limit(0)) == [] and periodic.find(docs.limit(0)).count() == 0
    spans = sorted(tuple(r) for r in periodic.find(docs.where("doc_id is not null")).collect())
    assert spans == sorted((r[0], a, b - a, q) for r in rows if r[0] is not None for a, b, q in brute_runs(WORD.findall(r[1] or "")))
    out = periodic.collapse(docs)
    assert out.columns == docs.columns
    texts_now = {r.doc_id: r.text for r in out.collect()}
    assert texts_now[7] == "x y z" and texts_now[8] == "x y z " * 3 + "x y" and texts_now[9] == "ab cd" and texts_now[0] is None


def test_a_very_long_text(spark):
    """A million words without a run, and half as many words of one."""
    rng = random.Random(4)
    plain = [f"v{rng.randrange(50_000)}" for _ in range(1_000_000)]
    tail = [f"t{i}" for i in range(60_000)] * 5
    docs = spark.createDataFrame([(1, " ".join(plain)), (2, " ".join(plain[:1000] + tail))], "doc_id long, text string")
    found = [tuple(r) for r in periodic.find(docs).collect()]
    assert found == [(2, 1000, 300_000, 60_000)]
