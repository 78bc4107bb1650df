"""Merkle manifest against a plain reading of its rule."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from meshlake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text=None):
    return h(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"] if text is None else text)])


def tree(nodes):
    """Root, and each node's siblings on its way up."""
    levels, paths = [list(nodes)], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        for i in range(len(nodes)):
            at = i // 8 ** (len(levels) - 1)
            first = at // 8 * 8
            paths[i].append((last[first:at], last[at + 1 : first + 8]))
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels[-1][0], paths


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = (own, *tree([leaf(r) for r in own]))
    root, tops = tree([trees[x][1] for x in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path = path + top
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            now = leaf(r, text)
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*[x for a, b in path for x in a + b]), now, now == root))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted((tuple(r) for r in merkle.report(docs, **options).collect()), key=str)


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute(docs.collect())
    assert got(docs) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("every", [1, 2, 3])
def test_sizes(spark, every):
    """Trees of 0, 1, 7 to 9, 64, 65, 513 and 600 leaves; more than 64 trees; repeated and null ids, nulls in every column."""
    rows = []
    for lang, n in (("a", 1), ("b", 7), ("c", 8), ("d", 9), ("é", 64), ("zz", 65), ("B", 513), (None, 600)):
        rows += [(i, f"Text {i}" if i % 5 else None, lang, "s" if i % 3 else None, i if i % 4 else None, 1, "v") for i in range(n)]
    rows += [(i, "X", f"l{i:03d}", "", 0, None, None) for i in range(70)]
    rows += [(3, "", "b", None, None, 1, "v"), (3, "-", "b", None, None, 1, "v"), (None, "N", "b", None, None, 1, "v"), *[(5, "same", "c", "s", 1, 1, "v")] * 9]
    rows.append((77, " ".join(f"W{i}" for i in range(300_000)), "a", "s", 1, 1, "v"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(docs, every=every) == brute([r.asDict() for r in docs.collect()])
    assert got(docs.limit(0), every=every) == []


def test_one_row(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None, 1, None)], SCHEMA)
    (row,) = got(docs)
    assert row[1] == row[2] == row[3] == row[5] and row[6] and row[4] == h()


def test_proofs_hold_for_one_state(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de", "s", i, 1, "v") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stored = merkle.proofs(docs)
    assert {r.verified for r in merkle.verify(docs, stored).collect()} == {True}
    changed = docs.where("doc_id != 7").withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text")))
    assert sorted(r.doc_id for r in merkle.verify(changed, stored).collect() if not r.verified) == [5, 7]
