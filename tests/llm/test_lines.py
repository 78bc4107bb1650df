"""Fuzzy line dedup against all pairs of distinct lines, by edit similarity alone."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from hard_texts import thue_morse
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlake.llm import lines
from meshlake.llm.workspace import Workspace


def levenshtein(a, b):
    """Bit-parallel: the column of the table as two bit vectors."""
    if not a or not b:
        return max(len(a), len(b))
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        match = places.get(c, 0)
        across = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(across | up) & full, up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~((match | down) | rise) & full, rise & (match | down)
    return score


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_the_yardstick(a, b):
    assert levenshtein(a, b) == plain_levenshtein(a, b)


@settings(max_examples=400, deadline=None)
@given(st.text("abc ", max_size=60), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "x", "ab"])), max_size=8))
def test_alignments(a, edits):
    b = a
    for at, new in edits:
        b = b[:at] + new + b[at + 1 :]
    assert lines.aligned(a, b, 1000) >= levenshtein(a, b) and lines.aligned(a, a, 0) == 0
    assert lines.similar(a, b) == (levenshtein(a, b) * 5 <= max(len(a), len(b)))
    want, most = levenshtein(a, b), len(a) // 5
    got = lines.edit_distance(a, b, most)
    assert got == want if want <= most else got > most


def test_many_pairs_are_checked_together(monkeypatch):
    """Pairs just below, at and above the limit, of all lengths and alphabets, none of them one by one."""
    rng = random.Random(5)
    pairs = []
    for n in [0, 1, 4, 5, 9, 10, 40, 63, 64, 65, 319, 320, 321, 700, 1500] * 8:
        alphabet = rng.choice(["ab", "abcdefgh ", "".join(map(chr, range(200, 900)))])
        a = "".join(rng.choice(alphabet) for _ in range(n))
        b = list(a)
        for _ in range(n // 5 + rng.choice([-n // 20, -1, 0, 1, 2, n // 4])):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "x", alphabet[0]])
        pairs += [(a, "".join(b)), ("".join(b), a), (a, "".join(rng.choice(alphabet) for _ in range(n)))]
    want = [levenshtein(a, b) * 5 <= max(len(a), len(b)) for a, b in pairs]
    assert 50 < sum(want) < len(want) - 50
    assert lines.all_similar(pairs).tolist() == want
    monkeypatch.setattr(lines, "_ALONE", 0)
    monkeypatch.setattr(lines, "edit_distance", None)
    for few, together in ((1, 2000), (256, 7), (10**9, 2000)):
        monkeypatch.setattr(lines, "_FEW", few)
        monkeypatch.setattr(lines, "_TOGETHER", together)
        assert lines.all_similar(pairs).tolist() == want
    assert lines.all_similar([]).tolist() == [] and lines.all_similar([("", "")]).tolist() == [True]


def similar(a, b):
    longer = max(len(a), len(b))
    if abs(len(a) - len(b)) * 5 > longer:
        return False
    count = lambda x: np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % 64, minlength=64)
    return np.maximum(count(a) - count(b), 0).sum() * 5 <= longer and levenshtein(a, b) * 5 <= longer


def plain_normal(line):
    out = []
    for c in line:
        low = c.lower() if len(c.lower()) == 1 else c
        out.append("0" if low.isdecimal() else low if low.isalnum() else " ")
    return " ".join("".join(out).split(" ")).strip() if not out else " ".join(x for x in "".join(out).split(" ") if x)


def entries_of(rows):
    entries = []  # (doc_id, line, form)
    for d, text in rows:
        entries += [(d, i, form) for i, x in enumerate((text or "").split("\n")) if (form := plain_normal(x))]
    return sorted(entries, key=lambda e: (e[0] is not None, e[0] or 0, e[1]))


def brute_gone(rows):
    """(doc_id, line) of the lines that go, and the number of similar pairs of distinct forms."""
    entries = entries_of(rows)
    forms = list(dict.fromkeys(e[2] for e in entries))
    root = list(range(len(forms)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(len(forms)):
        for j in range(i):
            if similar(forms[i], forms[j]):
                root[find(i)] = find(j)
                pairs += 1
    at, seen, gone = {f: i for i, f in enumerate(forms)}, set(), set()
    for d, i, form in entries:
        r = find(at[form])
        if r in seen:
            gone.add((d, i))
        seen.add(r)
    return gone, pairs


def rest(rows, gone):
    out = []
    for d, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for i, x in enumerate(all_) if (d, i) not in gone]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in lines.report(docs).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aB1 _-\nÉ²٣İß\t.")), max_size=30), min_size=1, max_size=5))
def test_forms(texts):
    forms = lines.Forms(texts)
    found = [forms.cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(forms.bounds, forms.bounds[1:])]
    own = [(int(t), int(q), found[c]) for t, q, c in zip(forms.text, forms.line, forms.code)]
    assert own == [(t, q, f) for t, text in enumerate(texts) for q, x in enumerate(text.split("\n")) if (f := plain_normal(x))]
    assert all(lines.normal(x) == plain_normal(x) for text in texts for x in text.split("\n"))
    assert len(set(found)) == len(found)


def test_simhash():
    rng = random.Random(2)
    forms = [" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in (1, 3, 254, 255, 256, 700)]
    cp = np.frombuffer("".join(forms).encode("utf-32-le"), "<u4")
    bounds = np.append(0, np.cumsum([len(f) for f in forms]))
    from meshlake.llm.textnum import Prefix, proposals

    together = lines.simhash(cp, bounds, Prefix(cp))

    for i, form in enumerate(forms):
        own = np.frombuffer(form.encode("utf-32-le"), "<u4")
        ends = np.array([j for j in range(len(form) + 1) if j == len(form) or form[j] == " "])
        starts = np.append(0, ends[:-1] + 1)
        hashes = proposals(own, starts, ends - starts).tolist()
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(together[i]) == want


def test_tables(spark, sf_dir):
    """No line goes that all pairs would keep, and at least 0.9 of the lines that they would take go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gone, pairs = brute_gone(rows)
    ws = Workspace(spark, "t")
    found = {(r.d, q) for r in lines._removed_lines(docs, ws, lines.PERCENT).collect() for q in r.removed}
    assert pairs > 30 and found <= gone and len(found) >= 0.9 * len(gone)
    assert got(docs) == rest(rows, found)


def test_near_lines(spark):
    rng = random.Random(4)
    stems = [[f"{rng.choice('abcdefg')}{rng.choice('hijkl')}{rng.choice('mnop')}{rng.choice('xyz')}" for _ in range(40)] for _ in range(4)]
    rows = [(None, "Only - this!\n\n--"), (1, None), (2, ""), (3, "only THIS\n--"), (4, "a1\na2\nb"), (None, "only this"), (None, "only that line")]
    for i in range(60):
        own = []
        for _ in range(3):
            words = list(rng.choice(stems))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(40)] = rng.choice("xyz") * 2
            own.append(" ".join(words) + rng.choice(["", ".", " !"]))
        rows.append((10 + i, "\n".join(own)))
    x, y = thue_morse(11, "a", "b")
    rows += [(200, x), (201, y), (201, y), (202, "x" * 3000 + " " + x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    result = got(docs)
    first_null = [r for r in rows if r[0] is not None]  # null ids share a place: lines of theirs are compared apart
    gone, _ = brute_gone(first_null)
    want = {r[0]: r for r in rest(first_null, gone | {(3, 0)})}
    assert {r[0]: r for r in result if r[0] is not None} == want
    assert sorted(r[2] for r in result if r[0] is None) == [0, 0, 0]
    assert sum(r[2] for r in result) > 100
    assert lines.report(docs.limit(0)).count() == 0


def test_remove_keeps_columns(spark):
    docs = spark.createDataFrame([(2, "Page 12\nx", 1, "a"), (1, "page 34\ny\n", 2, None)], "doc_id long, text string, d int, k string")
    left = {r.doc_id: r for r in lines.remove(docs).collect()}
    assert lines.remove(docs).columns == docs.columns
    assert left[2].text == "x" and left[1].text == "page 34\ny\n" and left[2].k == "a"


def test_edits_alone_decide(spark):
    """Changed words and letters, lines without spaces and tiny lines: at least 0.9 of the similar pairs are found, no other."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(120):
        kind = i % 4
        if kind == 0:  # one word replaced
            a = [word() for _ in range(rng.randrange(10, 60))]
            b = list(a)
            b[rng.randrange(len(b))] = word()
            a, b = " ".join(a), " ".join(b)
        else:  # letters replaced: in words, without spaces, in a tiny line
            a = " ".join(word() for _ in range(25)) if kind == 1 else "".join(word() for _ in range(20)) if kind == 2 else word() + "qrs"
            b = list(a)
            for at in rng.sample(range(len(a)), max(1, len(a) // 40)):
                b[at] = "z"
            b = "".join(b)
        rows += [(2 * i, a), (2 * i + 1, b)]
    gone, pairs = brute_gone(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.d, q) for r in lines._removed_lines(docs, Workspace(spark, "t"), lines.PERCENT).collect() for q in r.removed}
    assert pairs > 90 and found <= gone and len(found) >= 0.9 * len(gone)


def test_unrelated_lines_seldom_meet():
    """Long lines of one language, with its frequent words and syllables in common, share hardly a bucket; near copies do."""
    rng = random.Random(6)
    syllables = [a + b for a in "thraeiosn" for b in "eatnrs"]
    words = ["the", "of", "and", "to", "in"] * 12 + ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    forms = [" ".join(rng.choice(words) for _ in range(rng.choice([60, 150]))) for _ in range(1500)]
    for form in forms[:100]:
        own = form.split(" ")
        for _ in range(3):
            own[rng.randrange(len(own))] = rng.choice(words)
        forms.append(" ".join(own))
    cp = np.frombuffer("".join(forms).encode("utf-32-le"), "<u4")
    keys, owner = lines.bucket_keys(cp, np.append(0, np.cumsum([len(f) for f in forms])))
    held = {}
    for key, form in zip(keys.tolist(), owner.tolist()):
        held.setdefault(key, set()).add(form)
    pairs = {(a, b) for own in held.values() for a in own for b in own if a < b}
    copies = {(i, 1500 + i) for i in range(100)}
    assert len(pairs & copies) >= 95 and len(pairs - copies) < 3000


def test_rows_across_batches():
    """Repeated buckets are kept, and forms are counted once, wherever batches end."""
    rng = random.Random(1)
    for _ in range(100):
        key = sorted(rng.randrange(12) for _ in range(rng.randrange(1, 25)))
        cuts = sorted([0, len(key), *(rng.randrange(len(key) + 1) for _ in range(3))])
        table = pa.table({"bucket": key, "k1": [x // 3 for x in key], "k2": key, "n": [2] * len(key), "at": range(len(key))})
        cut = lambda: iter([b for x, y in zip(cuts, cuts[1:]) for b in table.slice(x, y - x).to_batches()])
        assert [i for b in lines._repeated(cut()) for i in b.column("at").to_pylist()] == [i for i, x in enumerate(key) if key.count(x) > 1]
        got = [row for b in lines._distinct(cut()) for row in zip(*(b.column(c).to_pylist() for c in ("k2", "n", "at")))]
        assert got == [(x, 2 * key.count(x), key.index(x)) for x in sorted(set(key))]


def test_edited_lines_share_a_bucket():
    """Similar lines with a word in ten replaced meet, nearly all; short ones with two characters gone always do."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    pairs = []
    for _ in range(600):
        a = [word() for _ in range(rng.randrange(15, 60))]
        b = [word() if rng.random() < 0.1 else x for x in a]
        pairs.append((" ".join(a), " ".join(b)))
    short = []
    for _ in range(100):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randrange(10, 15)))
        b = list(a)
        for _ in range(2):
            b[rng.randrange(len(b))] = rng.choice(["", "x"])
        short.append((a, "".join(b)))
    met = []
    for own in (pairs, short):
        own = [(a, b) for a, b in own if a != b and levenshtein(a, b) * 5 <= max(len(a), len(b))]
        forms = [x for pair in own for x in pair]
        cp = np.frombuffer("".join(forms).encode("utf-32-le"), "<u4")
        keys, owner = lines.bucket_keys(cp, np.append(0, np.cumsum([len(f) for f in forms])))
        held = [set(keys[owner == i].tolist()) for i in range(len(forms))]
        met.append(np.mean([bool(held[i] & held[i + 1]) for i in range(0, len(forms), 2)]))
        assert len(own) > 60
    assert met[0] >= 0.96 and met[1] == 1


def test_entries_at_like_places():
    """Entries that can be aligned stay in one group, whatever else has their key; those alone go."""
    rng = np.random.default_rng(3)
    meet = lines._at_like_places(80)[1]
    for n in (1, 2, 30, 400):
        key = np.sort(rng.integers(0, max(1, n // 6), n)).astype(np.int64)
        size = rng.integers(10, 200, n)
        place = rng.integers(0, size)
        rows, group = lines.at_like_places(key, size, place, 80)
        of = dict(zip(rows.tolist(), group.tolist()))
        about = np.stack([size, place], axis=1)
        for i in range(n):
            partners = [j for j in range(n) if j != i and key[i] == key[j] and meet(about[i], about[j])]
            assert (i in of) == bool(partners) and all(of[i] == of[j] for j in partners)
        assert (np.diff(key[rows]) >= 0).all() and len({(key[r], g) for r, g in of.items()}) == len(set(of.values()))


def test_open_buckets_give_links_only():
    """In a large bucket all similar lines end in one class, and no more rows come out than join classes."""
    from meshlake.llm import linking

    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    texts = []
    for i in range(150):
        own = list(stems[i % 12])
        for _ in range(rng.randrange(10)):
            own[rng.randrange(60)] = rng.choice("xyz")
        texts.append("".join(own))
    meet, may = lines._at_like_places(80)[1], lambda a, b: lines.may_be_similar(a, b, 80)
    columns = {"bucket": [5] * 150, "i": [0] * 150, "j": [0] * 150, "k": range(150), "root": range(150), "own": [0] * 149 + [-1], "asked": [None] * 150}
    table = pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()} | {"text": texts, "size": [60] * 150, "place": [0] * 150})
    out = linking._joined(meet, lines.counters, may, lines._similar_pairs(80))(iter([b for x in (0, 40) for b in table.slice(x, 40 if x == 0 else 110).to_batches()]))
    links = [row for b in out for row in zip(*(c.to_pylist() for c in b.columns))]
    root = list(range(150))

    def classes(pairs):
        at = list(root)
        for a, b in pairs:
            low, high = sorted((at[a], at[b]))
            at = [low if x == high else x for x in at]
        return at

    want = classes([(a, b) for a in range(150) for b in range(a) if levenshtein(texts[a], texts[b]) * 5 <= 60])
    assert classes(links) == want and len(links) == 150 - len(set(want)) > 100
