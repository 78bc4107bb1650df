"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, exact, lines, merkle, mixing, neardup, periodic, quality, secrets, shards, substrings, tokenfile, unigram


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram.report(_table(spark, sf_dir, "documents"), pieces)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    return tokenfile.report(_table(spark, sf_dir, "documents"), spec)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bytebpe.report(_table(spark, sf_dir, "documents"), tokens)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links two-word shingle sets of similarity 0.8 or more."""
    return neardup.report(_table(spark, sf_dir, "documents"), k=2)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# The remainders of all bytes, which CRC-32 is made from, and the CRC-32 of an ASCII text by them.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda s, n: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) AS t)"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: xor(s >> 8, t[(xor(s, c) & 255) + 1])), 4294967295)"


def _merkle_sql(levels: int = 7) -> str:
    """Trees of up to 8 ** levels leaves, built and climbed a level at a time."""

    def leaf(text: str) -> str:
        parts = {c: c for c in merkle.FIELDS} | {"text": text}
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END" for c, v in parts.items()) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        CRC_TABLE,
        f"""d AS (SELECT doc_id, lang AS g, {leaf("text")} AS h, CASE WHEN {CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS f,
              row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents, crc)""",
        "a0 AS (SELECT g, pos, h, n FROM d)",
        "c0 AS (SELECT doc_id, g, h AS leaf, pos, f, '' AS s FROM d)",
    ]

    def climb(tree: str, way: str) -> None:
        for k in range(levels):
            out.append(f"{tree}r{k} AS (SELECT g, pos // 8 AS pos, list(h ORDER BY pos) AS r, any_value(n) AS n FROM {tree}{k} WHERE n > 1 GROUP BY ALL)")
            out.append(f"{tree}{k + 1} AS (SELECT g, pos, sha256(array_to_string(r, '')) AS h, (n + 7) // 8 AS n FROM {tree}r{k})")
            left, right = "array_to_string(r[1:w.pos % 8], '')", "array_to_string(r[w.pos % 8 + 2:], '')"
            out.append(f"""{way}{k + 1} AS (SELECT w.* REPLACE (w.pos // 8 AS pos, CASE WHEN r IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN r IS NULL THEN s ELSE s || {left} || {right} END AS s)
              FROM {way}{k} w LEFT JOIN {tree}r{k} x ON w.g IS NOT DISTINCT FROM x.g AND w.pos // 8 = x.pos)""")

    climb("a", "c")
    ends = " UNION ALL ".join(f"SELECT g, h FROM a{k} WHERE n = 1" for k in range(levels + 1))
    out.append(f"e AS ({ends})")
    out.append("t AS (SELECT g AS lang, 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM e)")
    out.append("b0 AS (SELECT g, pos, h, n FROM t)")
    out.append(f"v0 AS (SELECT doc_id, leaf, t.h AS subroot, t.g, t.pos, f, s FROM c{levels} c JOIN t ON c.g IS NOT DISTINCT FROM t.lang)")
    climb("b", "v")
    tops = " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE n = 1" for k in range(levels + 1))
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, sha256(s) AS proof_sha256, f AS folded_root, f = root AS verified FROM v{levels}, ({tops})"


# Documents have ids of their own in these tables.
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
        k AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM s),
        f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM k),
        c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS pos FROM f WHERE nth > 1),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
        r AS (SELECT doc_id, count(c.pos) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE c.pos IS NULL) AS kept FROM x LEFT JOIN c USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
    """,
    "op7_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM d),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
              GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
        m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op12_periodic_runs": f"""
        WITH {CRC_TABLE},
        d AS (SELECT doc_id, w, len(w) AS n, h, CAST(floor(h / 10) AS BIGINT) AS g FROM (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w, {CRC.format("doc_id::VARCHAR")} AS h FROM documents, crc)),
        m AS (SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM d),
        x AS (SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM m)),
        e AS (SELECT a.doc_id, a.i - b.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i < a.i WHERE 4 * (a.i - b.i) <= a.n),
        s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
        t AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY doc_id, start, length),
        o AS (SELECT doc_id, count(*) AS n_runs, first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY doc_id),
        c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= start + period AND x.i < start + length) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
          sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op13_merkle_manifest": _merkle_sql(),
}
