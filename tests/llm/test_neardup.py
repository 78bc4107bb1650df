"""Near-duplicates against all pairs."""

import random
import re
from collections import Counter

import numpy as np
from hard_texts import thue_morse

from meshlake.llm import neardup
from meshlake.llm.graph import components
from meshlake.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    by = {}
    for i, s in enumerate(distinct):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(distinct):
        for j, both in Counter(j for x in s for j in by[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(distinct[j]) - both):
                root[find(s)] = find(distinct[j])
    least = {}
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            r = find(s)
            least[r] = min(least.get(r, d), d)
    out = []
    for (d, _), s in zip(rows, sets):
        c = least.get(find(s)) if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=str)


def got(docs, k):
    return sorted((tuple(r) for r in neardup.report(docs, k).collect()), key=str)


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, 2) == brute(rows, 2)


def test_chains_groups_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "ONE two"), (None, "one TWO"), (None, None), (7, "É é"), (8, "é é")]
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    for i in range(60):  # a chain: neighbours are alike, ends aren't
        base[rng.randrange(60)] = f"c{i}"
        rows.append((100 + i, " ".join(base)))
    stem = [f"s{i}" for i in range(80)]
    for i in range(80):  # copies with an edit each
        copy = list(stem)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(copy)))
    rows += [(300, rows[-1][1]), (300, rows[-1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs, 2) == brute(rows, 2)
    assert neardup.report(docs.limit(0)).count() == 0


def test_default_is_five_words(spark):
    text = " ".join(f"a{i}" for i in range(200))
    rows = [(5, text), (3, text + " tail"), (9, text.replace("a100 ", "")), (4, "else " * 10)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _kept_id string, k int")
    left = neardup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 400).astype(np.uint64)
        n = int(400 * (1 - share) / share / 2)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, n).astype(np.uint64)]) for _ in range(2))
        got = (neardup.signature(a) == neardup.signature(b)).mean()
        assert abs(got - share) < 0.08


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_blocks_lose_no_pair():
    """Bitmaps in blocks of mixed widths, classes and parts find every similar pair across classes."""
    from meshlake.llm import linking

    rng = np.random.default_rng(7)
    sets, base = [], rng.integers(0, 2**63, 130).astype(np.uint64)
    for i in range(80):
        own = base[: 118 + i % 12].copy()
        own[rng.integers(0, len(own), i % 14)] = rng.integers(0, 2**63, i % 14).astype(np.uint64)
        sets.append(np.unique(own))
    roots = [0 if i % 3 else i for i in range(80)]
    rows = [(5, 0, 0, i, roots[i], -1 if roots[i] == 0 else 0, None, neardup.bitmap(s)) for i, s in enumerate(sets)]
    found = set()
    import pyarrow as pa

    names = ["bucket", "i", "j", "k", "root", "own", "asked", "sketch"]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows]) for c in range(8)], names)
    for out in linking._pairs_in_blocks(neardup._may_link(80), False)(iter([batch.slice(0, 30), batch.slice(30)])):
        found |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))
    want = set()
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if roots[i] != roots[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
    assert want and want <= found and len({len(r[7]) for r in rows}) > 1


def test_parts_of_large_buckets(spark, monkeypatch):
    """Small blocks give the links that one block gives."""
    from meshlake.llm import linking

    rng = random.Random(9)
    stem = [f"s{i}" for i in range(80)]
    rows = []
    for i in range(120):
        copy = list(stem)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(copy)))
    monkeypatch.setattr(linking, "BLOCK", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs, 2) == brute(rows, 2)


def test_no_hash_decides(spark):
    one, other = thue_morse(11, "a", "b")
    x, y = thue_morse(11, "a ", "b ")
    rows = [(1, one), (2, other), (3, x), (4, y), (5, one), (6, f"{one} {other}"), (7, f"{other} {one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 2) == brute(rows, 2)
    assert got(docs, 5) == brute(rows, 5)


def test_null_ids_and_repeats(spark):
    """Null ids and a repeated id with many texts are met by their text, not by their id alone."""
    texts = [" ".join(f"w{(7 * i + j) % 50}" for j in range(30)) for i in range(4)]
    rows = [(None, t) for t in texts for _ in range(5)] + [(3, t + " more") for t in texts for _ in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs, 2) == brute(rows, 2)
