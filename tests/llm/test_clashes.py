"""Further columns with the names that operators use inside, nulls, repeated rows and empty tables, for every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from meshlake.llm import bytebpe, exact, lines, mixing, neardup, quality, shards, substrings, tokenfile, unigram

NAMES = "_id _h _k _doc _sha _hit _stats _size _c _pos _kept_id _text ids decoded doc row found k k1 k2 d t q u w h n about bucket root node size shard slot words".split()


@pytest.fixture(scope="module")
def clashing(spark):
    text = " ".join(f"Word{i} lorem" for i in range(30))
    texts = [text, text, text + " more", None, "", "x", "a b\nc d e\nA, b"]
    rows = [(i, t, "en", "s" if i % 2 else None, 7, *["v"] * len(NAMES)) for i, t in enumerate(texts)]
    rows += [rows[0], (None, text, None, None, None, *[None] * len(NAMES)), (2, "other text", "de", "s", 1, *["v"] * len(NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i % 6, i % 2, 0, "v") for i in range(12)] + [(None, 1, 0, "v"), (3, None, 0, "v")], "doc_id long, quality int, toxic int, _id string")


def test_reports(clashing, labels, spark):
    plain = clashing.select("doc_id", "text", "source")
    pieces = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    tokens = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    spec = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    reports = [
        lines.report,
        lambda x: unigram.report(x, pieces),
        lambda x: tokenfile.report(x, spec),
        substrings.report,
        lambda x: bytebpe.report(x, tokens),
        mixing.report,
        neardup.report,
        shards.shard,
        exact.report,
        lambda x: quality.report(x, labels),
    ]
    for report in reports:
        own = sorted(map(str, map(tuple, report(clashing).collect())))
        assert own == sorted(map(str, map(tuple, report(plain).collect()))) and len(own) == plain.count()
        assert report(clashing.limit(0)).count() == 0


def test_forms_that_return_documents(clashing, labels):
    tokens = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for form in (lines.remove, substrings.remove, mixing.mix, neardup.deduplicate, exact.deduplicate, lambda x: quality.keep_good(x, labels)):
        out = form(clashing)
        assert out.columns == clashing.columns
        assert {r["_doc"] for r in out.collect()} <= {"v", None}
        assert form(clashing.limit(0)).count() == 0
    coded = bytebpe.encode(clashing, tokens)
    assert sorted(coded.columns) == sorted(clashing.columns) and dict(coded.dtypes)["ids"] == "array<int>"
    back = bytebpe.decode(coded, tokens)
    assert all(r.text is None or bytes(r.decoded).decode() == r.text for r in back.collect())
    assert bytebpe.decode(bytebpe.encode(clashing, tokens, "coded"), tokens, "coded", "bytes").columns == [*clashing.columns, "coded", "bytes"]


def test_stages(spark, clashing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert sorted(docs.columns) == sorted(clashing.columns), name
