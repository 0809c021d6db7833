"""Learned decision lists for document quality.

Sequential covering on labelled statistics: a rule grows by the threshold condition of largest information gain
until it covers no good rows or nothing gains, is pruned back on rows it didn't grow on, and joins the list if it is
precise there; the bad rows it covers leave and the next rule grows. The list becomes one ordered Spark conditional
expression over statistics that are Spark expressions too, so no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import COUNTS, FEATURES, collected, labelled_sample, with_statistics


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``<=`` where ``above`` is false."""

    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = F.col(f"f_{self.feature}")
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.4g}"


def _covered(rule: tuple[Condition, ...], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    got = np.ones(n, bool)
    for c in rule:
        got &= c.holds(table)
    return got


def _grow(table, bad, thresholds, most: int) -> tuple[Condition, ...]:
    """Add the condition of largest gain, p1 * (log2(p1/(p1+n1)) - log2(p/(p+n))), until only bad rows are covered."""
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        base, best = math.log2(p / (p + n)), (0.0, None, None)
        for name, cuts in thresholds.items():
            x = table[name][inside]
            own = bad[inside]
            for above in (True, False):
                for cut in cuts:
                    got = x >= cut if above else x <= cut
                    p1 = int((own & got).sum())
                    if p1 < 3:
                        continue
                    gain = p1 * (math.log2(p1 / int(got.sum())) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, float(cut)), None)
        if best[1] is None:
            break
        rule += (best[1],)
        inside = _covered(rule, table, len(bad))
    return rule


def _worth(rule, table, bad) -> float:
    got = _covered(rule, table, len(bad))
    p, n = int((bad & got).sum()), int((~bad & got).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4, cuts: int = 48) -> list[tuple[Condition, ...]]:
    """An ordered list of rules, each a conjunction, that cover bad rows; every third row is kept for pruning."""
    rules, left = [], np.ones(len(bad), bool)
    aside = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules:
        grow, prune = left & ~aside, left & aside
        if (bad & grow).sum() < 8 or (bad & prune).sum() < 3:
            break
        own = {k: v[grow] for k, v in table.items()}
        levels = np.concatenate((np.linspace(0, 1, cuts), 1 - np.geomspace(0.001, 0.1, 8), np.geomspace(0.001, 0.1, 8)))
        rule = _grow(own, bad[grow], {k: np.unique(np.quantile(v, levels)) for k, v in own.items()}, most_conditions)
        held = {k: v[prune] for k, v in table.items()}
        tries = [rule[:k] for k in range(len(rule), 0, -1)]
        if not tries:
            break
        rule = max(tries, key=lambda r: (_worth(r, held, bad[prune]), -len(r)))
        got = _covered(rule, held, int(prune.sum()))
        p, n = int((bad[prune] & got).sum()), int((~bad[prune] & got).sum())
        if p < 3 or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~_covered(rule, table, len(bad))
    return rules


def rules_column(rules: list[tuple[Condition, ...]]) -> Column:
    """The list as one conditional: number of the first rule that holds, null if none does."""
    out = None
    for k, rule in enumerate(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def fit_quality_rules(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 20_000, **learning) -> list[tuple[Condition, ...]]:
    """Rules from at most ``fit_rows`` labelled documents (the bound on what reaches the driver: ten numbers a row).

    Without labels of both kinds the list is empty.
    """
    stats = with_statistics(labelled_sample(docs, labels, "quality", fit_rows))
    values = collected(stats.where(~base_failed()))
    if not len(values):
        return []
    return learn_rules({f: values[:, k + 1] for k, f in enumerate(FEATURES)}, values[:, 0] == 0, **learning)


def base_failed() -> Column:
    """Too short, or mostly made of repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 20_000, **learning) -> DataFrame:
    """``docs`` with the counts, base_failed, rule (number of the rule that rejects, else null) and kept.

    Null and empty texts have no words, fail the base and aren't kept. Rows stay as they are, repeated ids and null
    ids included; an empty table gives no rows; columns named like the new ones are replaced.
    """
    rules = fit_quality_rules(docs, labels, fit_rows=fit_rows, **learning)
    out = with_statistics(docs).withColumns({"base_failed": base_failed(), "rule": rules_column(rules)})
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.drop(*[f"f_{f}" for f in FEATURES])


def columns() -> list[str]:
    return ["doc_id", *COUNTS, "base_failed", "kept", "rule"]
