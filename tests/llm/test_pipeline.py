"""The pipeline: every stage against a brute-force version on its own input."""

import re
from collections import Counter

import public_tokenizers
import tiktoken
from test_native import base
from test_neardup import brute

import corpus_pipeline
from meshlake.llm import bytebpe, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == (columns if n < 4 else [*columns, "ids"]), name
        seen.append(docs.collect())
    given, good, distinct, apart, mixed, encoded = seen

    rules = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = {r._doc.doc_id: r._stats for r in quality.statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    bad = lambda d: any(all(c.holds(stats[d].asDict()) for c in rule) for rule in rules)
    assert {r.doc_id for r in good} == {r.doc_id for r in given if not base(r.text)[-1] and not bad(r.doc_id)}

    last = {}
    for r in good:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in distinct) == sorted(last.values())

    near = brute([(r.doc_id, r.text) for r in distinct], 5)
    assert sorted(r.doc_id for r in apart) == sorted(d for d, _, _, kept in near if kept)

    size = lambda r: len(WORD.findall(r.text))
    whole = {r.doc_id: r for r in apart}
    words = Counter()
    for r in mixed:
        words[r.doc_id] += size(r)
        assert r.text == whole[r.doc_id].text and r.n_chars == whole[r.doc_id].n_chars
    assert all(n <= 2 * size(whole[d]) for d, n in words.items())
    largest = {}
    for r in apart:
        largest[r.source] = max(largest.get(r.source, 0), size(r))
    assert abs(sum(words.values()) - 1.5 * sum(map(size, apart))) <= sum(largest.values()) / 2 + len(largest)

    tokens = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert Counter((r.doc_id, r.text) for r in encoded) == Counter((r.doc_id, r.text) for r in mixed)
    assert all(list(r.ids) == library.encode_ordinary(r.text) for r in encoded)


def test_last_stage_decodes(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(1, " Ab é\n😀 12"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.byte_bpe(spark, docs, sf_dir).orderBy("doc_id").collect()] == [tuple(r) for r in docs.collect()]
    own = bytebpe.round_trip
    monkeypatch.setattr(bytebpe, "round_trip", lambda rows, tokens: own(rows, tokens, spelled=[b"?" for _ in tokens]))
    changed = corpus_pipeline.byte_bpe(spark, docs, sf_dir).where("doc_id = 1").first()
    assert changed.text == "?" * len(changed.ids)
