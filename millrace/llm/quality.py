r"""Quality rules: a learned decision list over native text statistics.

Statistics of every whole text come from DataFrame functions only: words `[^\x20\x09-\x0D]+`, their characters,
symbols, repeated lines, words in repeated 3-word windows, capitals, exclamation marks, short lines.  Sequential
covering learns conjunctions of thresholds on them from labelled rows: grow the rule that best separates low
quality on two thirds of the rows still uncovered, prune it on the last third, keep it if precise enough, remove
what it covers, go on.  The list becomes one Spark conditional expression.

Learning takes at most MOST_LABELLED labelled rows, the first by a hash of the id (a parameter); all texts are
judged.  The base rule comes first: fewer than 50 words, or over half of the words in repeated windows.

Edge cases: null or empty text has no words and fails the base rule; null labels and ids are not learned from; a
repeated label counts once (the lowest); without labels of both kinds the list is empty and only the base
rule judges; repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import first_by_hash

MOST_LABELLED = 20_000
LEAST_WORDS, MOST_REPEATED = 50, 50
MOST_RULES, MOST_CONDITIONS, QUANTILES = 8, 3, 40
LEAST_PRECISION, LEAST_COVER = 0.9, 20
#: Fixed characters of the contract.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "exclaim_share", "line_words", "n_words")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often it is referred to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more among the words."""

    def count(hashes: Column) -> Column:
        n = F.size(hashes)

        def covered(places: Column) -> Column:
            start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
            return F.aggregate(places, start, lambda a, p: F.struct((a.getField("n") + F.least(F.lit(3), p - a.getField("last"))).alias("n"), p.alias("last")), lambda a: a.getField("n"))

        def some(twice: Column) -> Column:
            few = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(twice, F.get(hashes, i)))
            # many: by sorted (hash, place), so that very long repetitive texts stay n log n
            pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            many = let(pairs, lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1).getField("h") == x.getField("h")) | (F.get(s, k + 1).getField("h") == x.getField("h")), x.getField("i"))), lambda i: i.isNotNull()), lambda i: i)))
            return F.when(F.size(twice) == 0, 0).when(F.size(twice) <= 12, covered(few)).otherwise(let(many, covered))

        def twice(s: Column) -> Column:
            return F.array_distinct(F.filter(F.transform(s, lambda h, k: F.when(F.get(s, k - 1) == h, h)), lambda h: h.isNotNull()))

        return F.when(n < 2, 0).otherwise(let(let(F.sort_array(hashes), twice), some))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, count)).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the contract's counts and the features, for every row; `keep` names further columns to carry."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"), *keep)
    words = F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    bare = F.length(F.translate("_t", BLANKS, ""))
    rows = rows.select(
        "doc_id", *keep, counted.alias("_w"), lined.alias("_l"), bare.cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long").alias("n_exclaims"),
    )
    return rows.select("doc_id", *keep, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_capitals", "n_exclaims")


def features() -> dict[str, Column]:
    """The numbers that rules test; 0 where there is nothing to divide by."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "capital_share": share("n_capitals", "word_chars"), "exclaim_share": share("n_exclaims", "n_words"),
        "line_words": share("n_words", "n_lines"), "n_words": F.col("n_words").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= F.lit(self.threshold) if self.above else of[self.feature] < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.mask(x)
    return out


def _grow(x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """Adds the condition with the best FOIL gain until only low-quality rows are covered."""
    rule: Rule = ()
    on = np.ones(len(low), bool)
    while len(rule) < MOST_CONDITIONS and on.any() and not low[on].all():
        p0, n0 = low[on].sum(), on.sum()
        best, gain = None, 1e-9
        for f in FEATURES:
            for t in np.unique(np.quantile(x[f][on], np.linspace(0.02, 0.98, QUANTILES))):
                for above in (True, False):
                    c = Condition(f, above, float(t))
                    new = on & c.mask(x)
                    p, n = low[new].sum(), new.sum()
                    if p and n < n0:
                        g = p * (np.log2(p / n) - np.log2(max(p0, 1e-9) / n0))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        rule += (best,)
        on &= best.mask(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], low: np.ndarray) -> float:
    on = _covers(rule, x, len(low))
    p = low[on].sum()
    return float((2 * p - on.sum()) / on.sum()) if on.any() else -1.0


def learn_rules(x: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """Sequential covering: an ordered list of conjunctions that say "low quality"."""
    rules: list[Rule] = []
    left = np.ones(len(low), bool)
    third = np.arange(len(low)) % 3 == 2
    while len(rules) < MOST_RULES and low[left].sum() >= LEAST_COVER:
        grow, prune = left & ~third, left & third
        take = lambda m: {f: v[m] for f, v in x.items()}
        rule = _grow(take(grow), low[grow])
        if not rule:
            break
        xs, ls = take(prune), low[prune]
        while len(rule) > 1:  # drop last conditions that don't pay on rows not grown from
            if _worth(rule[:-1], xs, ls) < _worth(rule, xs, ls):
                break
            rule = rule[:-1]
        on = _covers(rule, x, len(low)) & left
        if on.sum() < LEAST_COVER or low[on].mean() < LEAST_PRECISION or (on & third).sum() and low[on & third].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~on
    return rules


def train(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from docs(doc_id, text) and labels(doc_id, quality: 0 is low)."""
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    sample = first_by_hash(sample, "doc_id", MOST_LABELLED).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    wanted = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))  # MOST_LABELLED rows at most
    wanted = wanted.groupBy("doc_id", "_quality").agg(F.min("text").alias("text"))  # one text of an id, however many rows repeat it
    rows = statistics(wanted, "_quality").filter(~base_failed())
    got = rows.select("doc_id", "_quality", *[c.alias(f"f{i}") for i, c in enumerate(features().values())]).collect()
    got.sort(key=lambda r: tuple(r))
    if not got:
        return []
    x = {f: np.array([r[i + 2] for r in got], float) for i, f in enumerate(features())}
    # thirds are dealt by a hash of the order, not by id ranges
    by = np.random.Generator(np.random.PCG64(5)).permutation(len(got))
    return learn_rules({f: v[by] for f, v in x.items()}, np.array([r["_quality"] == 0 for r in got])[by])


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    of = features()
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test = test & c.column(of)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The contract's counts, base_failed, kept and the rule that dropped a document, for every row of docs."""
    rules = train(docs, labels) if rules is None else rules
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
