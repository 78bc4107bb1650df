"""Sharding, exact dedup, mixing and quality rules against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meshlake.llm import exact, mixing, quality, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "a", 7),
    (2, "", None, 7),
    (3, " \t\r\n", "b", 7),
    (4, "one two three", "a", 7),
    (4, "one two three", "a", 7),
    (5, "one two three", None, 8),
    (None, "one two three", "b", 9),
    (None, None, "c", 9),
    (6, LONG, "b", None),
    (7, "a\nb c d e f\nb c d e f\n\n \nx a\n", "c", 1),
    (8, "Ünï 😀 # $ é", "é", 1),
    (9, "a b c d e f g a b c d e f g", "a", 1),
]
SCHEMA = "doc_id long, text string, source string, _h int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tables(request_docs, odd):
    return [request_docs, odd, odd.limit(0), odd.where("doc_id = 6")]


def test_sharding(docs, odd):
    for table in tables(docs, odd):
        rows, given = shards.shard(table).collect(), table.collect()
        n = len(given)
        sizes = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given)
        assert sorted((r.size, r.text_crc32) for r in rows) == sizes
        assert sorted(r.row_no for r in rows) == list(range(n))
        slots = defaultdict(list)
        for r in rows:
            assert (r.shard, r.slot) == shards.place(r.row_no, n)
            assert r.law == "rows" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[i]) for i in range(8)]
        assert max(counts) - min(counts) <= 1
        key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
        assert [key(r) for r in sorted(rows, key=lambda r: r.row_no)] == sorted(map(key, rows))


def test_place_is_a_permutation():
    for n in (1, 2, 3, 4, 5, 7, 10, 99, 1000, 4097):
        seen = {shards.place(i, n) for i in range(n)}
        assert len(seen) == n
    moved = sum(shards.place(i, 5000) != (i % 8, i // 8) for i in range(5000))
    assert moved > 4900


def test_exact_dedup(docs, odd):
    for table in tables(docs, odd):
        given = table.collect()
        groups = defaultdict(list)
        for r in given:
            groups[r.text or ""].append(r.doc_id)
        want = []
        for r in given:
            ids = groups[r.text or ""]
            keep = max((i for i in ids if i is not None), default=None)
            want.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [tuple(r) for r in exact.report(table).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        order = lambda t: tuple(map(str, t))
        assert sorted(got, key=order) == sorted(want, key=order)
        kept = exact.deduplicate(table)
        assert kept.columns == table.columns
        assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)
        assert all(r.doc_id == max((i for i in groups[r.text or ""] if i is not None), default=None) for r in kept.collect())


def test_filter_beyond_capacity_changes_nothing(docs, monkeypatch):
    want = sorted(map(tuple, exact.report(docs).collect()))
    monkeypatch.setattr(exact, "MAX_BITS", 64)
    monkeypatch.setattr(exact, "MIN_BITS", 64)
    assert sorted(map(tuple, exact.report(docs).collect())) == want


def want_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, active, target = 1.5 * sum(sizes.values()), set(order), {}
    while active:
        level = left / sum(weight[s] for s in active)
        full = {s for s in active if weight[s] * level >= 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in active}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        active -= full
    return target


def test_mixing(docs, odd):
    for table in tables(docs, odd):
        given = [(r, len(WORD.findall(r.text or ""))) for r in table.collect()]
        sizes = Counter()
        for r, n in given:
            sizes[r.source] += n
        target = want_targets(dict(sizes))
        placed = mixing.plan(table).collect()
        assert Counter((r.doc_id, r.source, r["size"]) for r in placed) == Counter((r.doc_id, r.source, n) for r, n in given)
        taken = Counter()
        for r in placed:
            assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
            assert r.target == pytest.approx(target[r.source])
            taken[r.source] += r.taken
            assert all(c.take == 0 or 0 <= c.position <= 1 for c in r.copies)
        for s, n in taken.items():
            assert abs(n - target[s]) <= 1
        again = mixing.plan(table.repartition(5)).collect()
        assert sorted(map(str, again)) == sorted(map(str, placed))
        mixed = mixing.mix(table)
        assert mixed.columns == table.columns
        out, whole = Counter(), Counter()
        for r in placed:
            for c in r.copies:
                if c.take and 2 * c.take >= r["size"]:
                    whole[r.source] += r["size"]
        texts = {(r.doc_id, r.text) for r, _ in given}
        for r in mixed.collect():
            assert (r.doc_id, r.text) in texts
            out[r.source] += len(WORD.findall(r.text))
        assert +out == +whole
        for s in taken:
            assert abs(out[s] - taken[s]) <= max(n for r, n in given if r.source == s) / 2


def test_curriculum_follows_the_schedule(docs):
    """By time t a source has given about the integral of its schedule up to t."""
    placed = mixing.plan(docs).collect()
    order = sorted({r.source for r in placed})
    for s in order[:6]:
        g, rows = mixing.SLOPES[order.index(s) % 3], [r for r in placed if r.source == s]
        given = sum(c.take for r in rows for c in r.copies if c.take and c.position < 0.5)
        want = rows[0].target * ((1 - g) * 0.5 + g * 0.25)
        assert abs(given - want) <= max(r["size"] for r in rows)
    report = mixing.report(docs)
    positions = [r.position for r in report.collect() if r.position is not None]
    assert positions == sorted(positions)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_statistics(spark, docs, odd, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for table in tables(docs, odd):
        rows = quality.report(table, labels).collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == Counter((r.doc_id, *base(r.text)) for r in table.collect())
        assert all(not (r.base_failed and r.kept) for r in rows)
        assert quality.keep_good(table, labels).count() == sum(r.kept for r in rows)


def test_quality_held_out(spark):
    """Rules learned on some labels agree with labels they never saw."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    assert rules
    seen = (
        quality.statistics(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"))
        .where(~quality.base_failed(F.col("_stats")))
        .select(F.col("_doc.quality").alias("q"), quality.verdict(rules, F.col("_stats")).alias("kept"))
        .groupBy("q", "kept")
        .count()
        .collect()
    )
    n = {(r.q, r.kept): r["count"] for r in seen}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n[(0, False)] >= 0.9 * (n[(0, False)] + n.get((0, True), 0))


def test_no_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, empty) == []
    assert quality.learn([]) == []


def test_slot_is_long(docs):
    assert dict(shards.shard(docs).dtypes)["slot"] == "bigint"
