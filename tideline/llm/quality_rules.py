"""Quality rules: a decision list learned by sequential covering.

A rule is a conjunction of thresholds over document statistics. Rules that find
low quality are grown one test at a time by FOIL gain on two thirds of a bounded
labelled sample, pruned on the last third, and kept while they stay precise; the
documents a rule covers leave the sample before the next one is grown. The list
is emitted as one ordered ``CASE WHEN`` of Spark columns.

Defined cases: null and empty texts have no words, so they fail the base rules; a
very long text is judged whole, in memory of a small multiple of its size. Without
labels no rule is learned and the base rules alone decide; empty tables give empty
results. Only id and text are read, so other columns may have any name; repeated
rows are judged one by one, and learned from once; a tie of gains goes to the first
statistic; null ids pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import map_chunks
from tideline.llm.common import in_one_task, table
from tideline.llm.doc_stats import SCHEMA, batch_statistics
from tideline.llm.labelled import training_labels
from tideline.llm.quality_gbt import FEATURES, sample_arrays, sample_statistics

#: Labelled documents that rules are learned from, at most.
TRAIN_ROWS = 20_000
#: A rule must cover so many documents and be right about this share of them.
LEAST_COVER, LEAST_PRECISION, MOST_RULES, MOST_TESTS, EDGES = 8, 0.9, 12, 3, 48
BASE_LEAST_WORDS, BASE_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for t in self.tests:
            out &= t.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the test of most FOIL gain until only bad documents are covered."""
    tests: list[Test] = []
    cover = np.ones(len(x), bool)
    while len(tests) < MOST_TESTS and (~bad[cover]).any():
        xs, bs = x[cover], bad[cover]
        before = np.log2(max(bs.mean(), 1e-9))
        best: tuple[float, Test | None] = (1e-9, None)
        for j, name in enumerate(FEATURES):
            cuts = np.unique(np.quantile(xs[:, j], np.linspace(0, 1, EDGES)))
            key = np.searchsorted(cuts, xs[:, j], side="left")
            p, n = (np.bincount(key[k], minlength=len(cuts) + 1) for k in (bs, ~bs))
            low_p, low_n = p.cumsum()[:-1], n.cumsum()[:-1]
            for above, pos, neg in ((False, low_p, low_n), (True, p.sum() - low_p, n.sum() - low_n)):
                gain = np.where(pos >= LEAST_COVER, pos * (np.log2(np.maximum(pos, 1e-9) / np.maximum(pos + neg, 1)) - before), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), Test(name, above, float(cuts[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        cover &= best[1].holds(x)
    return Rule(tuple(tests))


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = rule.holds(x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop final tests while that does not make the rule worse on rows it wasn't grown on."""
    while len(rule.tests) > 1 and _worth(shorter := Rule(rule.tests[:-1]), x, bad) >= _worth(rule, x, bad):
        rule = shorter
    return rule


def learn(x: np.ndarray, good: np.ndarray) -> list[Rule]:
    """Ordered rules for low quality."""
    bad, rules = good < 0.5, []
    prune_on = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and (bad & left & ~prune_on).sum() >= LEAST_COVER:
        grow, prune = left & ~prune_on, left & prune_on
        rule = _prune(_grow(x[grow], bad[grow]), x[prune], bad[prune])
        hit = rule.holds(x) & left
        if not rule.tests or hit.sum() < LEAST_COVER or bad[hit].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, else 0: an ordered conditional."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = rule.tests[0].column()
        for t in rule.tests[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < BASE_LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> list[Rule]:
    return in_one_task(sample_statistics(docs, training_labels(labels, label, most)), lambda rows: learn(*sample_arrays(rows)))


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All statistics of every document, base_failed, the rule that fired (0: none) and kept."""
    stats = map_chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), batch_statistics, SCHEMA)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
