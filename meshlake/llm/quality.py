"""Quality rules: learned decision lists over text statistics.

Statistics of a document are DataFrame expressions.  From the statistics of
labelled documents, sequential covering learns an ordered list of threshold
conjunctions that describe bad documents: a rule is grown condition by condition
(information gain) on two thirds of the labels, pruned on the rest, kept if it is
precise enough both there and on all labels left, and the documents it covers are taken
out before the next one.  The list becomes one ordered ``CASE`` expression; it has at most
``MAX_RULES`` rules of ``MAX_CONDITIONS`` conditions.

The list is learned from at most ``LABEL_ROWS`` labelled documents, those with the
least hash of their id; everything else covers all documents.

Cases: a null or blank text has no words and fails the base rule; labels that are
null, or without a document, teach nothing; of documents that share a labelled id the
text that sorts first teaches; without labels of both kinds the list is empty and the base rule decides; equal rows get equal verdicts; an empty table
gives no rows; further columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_ROWS = 3000
MIN_PRECISION = 0.97
MAX_RULES = 16
MAX_CONDITIONS = 4
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
NOT_WORD = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
FEATURES = ("n_words", "mean_word", "symbol_share", "capital_share", "mark_share", "dup_line_share", "repeat_share")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that the text holds at least twice.

    Windows are compared by a 64-bit hash.  Distinct windows, the usual case, are
    recognised without sorting; otherwise equal neighbours in hash order give the
    repeated windows and their starts in text order give the words covered.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(
                starts,
                lambda s, i: F.when(i == F.size(starts) - 1, 5).otherwise(F.least(F.lit(5), F.get(starts, i + 1) - s)),
            ),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twin = lambda p, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == p["h"])) | ((j < last) & (F.get(pairs, j + 1)["h"] == p["h"]))
        return _let(F.sort_array(F.transform(F.filter(pairs, twin), lambda p: p["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, repeated))

    starts = F.sequence(F.lit(0), F.size(words) - 5)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(_let(hashes, windows))


def _count(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``_doc``, with their ``_stats``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, NOT_WORD), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_word = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    raw = F.struct(
        by_word.alias("w"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _count(text, "[A-Z]").alias("n_capitals"),
        _count(text, "[!?.,;:]").alias("n_marks"),
    )
    share = lambda a, b: a / F.greatest(b, F.lit(1)).cast("double")

    def flat(r: Column) -> Column:
        w = r["w"]
        return F.struct(
            w["n_words"].alias("n_words"),
            w["word_chars"].alias("word_chars"),
            r["n_symbols"].alias("n_symbols"),
            r["lines"]["dup"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            share(w["word_chars"], w["n_words"]).alias("mean_word"),
            share(r["n_symbols"], w["word_chars"]).alias("symbol_share"),
            share(r["n_capitals"], w["word_chars"]).alias("capital_share"),
            share(r["n_marks"], w["word_chars"]).alias("mark_share"),
            share(r["lines"]["dup"], r["lines"]["n"]).alias("dup_line_share"),
            share(w["n_repeat_words"], w["n_words"]).alias("repeat_share"),
        )

    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _let(raw, flat).alias("_stats")
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, stats: Column) -> Column:
        return stats[self.feature] > F.lit(self.threshold) if self.above else stats[self.feature] <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(bad: list[dict], good: list[dict]) -> Condition | None:
    """The threshold with the most information gain; ties go to the first feature and the least threshold."""
    best, found = 1e-9, None
    for feature in FEATURES:
        points = sorted([(r[feature], 1) for r in bad] + [(r[feature], 0) for r in good])
        below_bad = below_good = 0
        for (value, kind), (following, _) in zip(points, points[1:]):
            below_bad, below_good = below_bad + kind, below_good + 1 - kind
            if value == following:
                continue
            cut = (value + following) / 2
            if cut >= following:  # the two are neighbouring numbers
                cut = value
            for above, p, n in ((False, below_bad, below_good), (True, len(bad) - below_bad, len(good) - below_good)):
                if (gain := _gain(len(bad), len(good), p, n)) > best:
                    best, found = gain, Condition(feature, above, cut)
    return found


def _grow(bad: list[dict], good: list[dict]) -> Rule:
    rule: list[Condition] = []
    while good and bad and len(rule) < MAX_CONDITIONS:
        condition = _best_condition(bad, good)
        if condition is None:
            break
        rule.append(condition)
        bad, good = [r for r in bad if condition.holds(r)], [r for r in good if condition.holds(r)]
    return tuple(rule)


def _worth(rule: Rule, bad: list[dict], good: list[dict]) -> float:
    p, n = sum(_covers(rule, r) for r in bad), sum(_covers(rule, r) for r in good)
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """The prefix of the rule that is worth most on labels it wasn't grown on; the shortest of equals."""
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, bad, good), -len(r)), default=rule)


def _precise(rule: Rule, bad: list[dict], good: list[dict], least: int) -> bool:
    p, n = sum(_covers(rule, r) for r in bad), sum(_covers(rule, r) for r in good)
    return p >= least and p / (p + n) >= MIN_PRECISION


def learn(rows: list[dict]) -> list[Rule]:
    """Sequential covering.  Rows have the features and ``bad`` (bool); their order doesn't matter."""
    rows = sorted(rows, key=lambda r: (r["order"], [r[f] for f in FEATURES]))
    bad, good = [r for r in rows if r["bad"]], [r for r in rows if not r["bad"]]
    rules: list[Rule] = []
    while bad and good and len(rules) < MAX_RULES:
        parts = [[r for i, r in enumerate(x) if (i % 3 == 2) == held] for held in (False, True) for x in (bad, good)]
        rule = _prune(_grow(parts[0], parts[1]), parts[2], parts[3])
        if not rule or not _precise(rule, parts[2], parts[3], 1) or not _precise(rule, bad, good, 2):
            break
        rules.append(rule)
        bad = [r for r in bad if not _covers(rule, r)]
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """False for a document that a rule describes, rules tried in order; else true."""
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        test = rule[0].column(stats)
        for condition in rule[1:]:
            test = test & condition.column(stats)
        chain = F.when(test, False) if chain is None else chain.when(test, False)
    return chain.otherwise(True)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABEL_ROWS) -> list[Rule]:
    """The decision list of the labelled documents (quality 0: bad)."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 0).alias("bad"))
        .orderBy(F.xxhash64("_id"), "_id", "bad")
        .limit(limit)
    )
    # One text for each labelled id, at most ``limit``; ids are few, so their broadcast is bounded too.
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(sample.select("_id").distinct()), "_id", "left_semi")
        .groupBy("_id")
        .agg(F.min("text").alias("text"))
    )
    found = statistics(texts).select("_doc._id", "_stats").join(F.broadcast(sample), "_id")
    # The base rule is a column, not a filter: Spark would move a filter on statistics below
    # the join and compute them for every document.
    rows = found.select(
        F.xxhash64("_id").alias("order"), "bad", base_failed(F.col("_stats")).alias("failed"), *[F.col(f"_stats.{f}").cast("double").alias(f) for f in FEATURES]
    ).collect()  # at most ``limit`` rows
    return learn([r.asDict() for r in rows if not r["failed"]])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row."""
    stats = F.col("_stats")
    rules = fit(docs, labels)
    return statistics(docs).select(
        F.col("_doc.doc_id").cast("long").alias("doc_id"),
        *[F.col(f"_stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(stats).alias("base_failed"),
        (~base_failed(stats) & verdict(rules, stats)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the base rule and the learned list let pass."""
    stats = F.col("_stats")
    rules = fit(docs, labels)
    return statistics(docs).where(~base_failed(stats) & verdict(rules, stats)).select("_doc.*")
