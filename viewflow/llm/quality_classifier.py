"""A quality score by Bradley-Terry ranking.

Every pair of a good and a bad labelled document is a preference; each document's strength is a sum of weights over
binned text statistics, and the weights maximise the likelihood of all preferences, a logistic loss on differences. All
labelled rows are learned from: their binned statistics stay distributed, in blocks. The pairs are not gone through one
by one: each round sums the rows of each small interval of strengths by bin, in the blocks, and what an interval's rows
add to the gradient follows from how many rows of the other kind every other interval has. What reaches the driver are
these sums, whose size does not depend on the number of rows. The threshold is that of fewest errors over all learning
rows' strengths, and scores are strengths on a logistic scale on which it lies at ``cut``. Statistics and scores are
Spark expressions.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, remove, write_table
from .text_stats import FEATURES, labelled_rows, with_statistics


_TASKS = 64


@dataclass(frozen=True)
class Ranking:
    """Steps (feature, bound, weight gained at or above it), the threshold strength and the score it stands for."""

    steps: tuple[tuple[str, float, float], ...]
    threshold: float
    cut: float

    def strength(self) -> Column:
        total = F.lit(0.0)
        for feature, bound, gain in self.steps:
            total = total + F.when(F.col(f"f_{feature}") >= F.lit(bound), F.lit(gain)).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        shift = math.log(self.cut / (1 - self.cut))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(self.strength() - F.lit(self.threshold) + F.lit(shift))))


def _bounds(table: DataFrame, bins: int) -> list[np.ndarray]:
    """Each feature's quantiles over all rows, as its values to nine bits: counted, so exact to these, in any order."""
    found = table.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"f_{f}") + F.lit(0.0)).alias("x")) for k, f in enumerate(FEATURES)])).alias("e")).select("e.*")
    power = F.floor(F.log2(F.greatest(F.abs("x"), F.lit(2.0**-40))))
    unit = F.pow(F.lit(2.0), power - 9)
    counted = found.groupBy("k", (F.floor(F.col("x") / unit) * unit).alias("x")).count().collect()  # some thousands a feature
    out = []
    for k in range(len(FEATURES)):
        own = sorted((r["x"], r["count"]) for r in counted if r["k"] == k)
        x, n = np.array([v for v, _ in own]), np.cumsum([n for _, n in own])
        at = np.minimum(np.searchsorted(n, np.linspace(0, 1, bins + 1)[1:] * n[-1]), len(x) - 1)
        out.append(np.unique(x[at]))
    return out


def _blocks(table: DataFrame, bounds: list[np.ndarray]) -> DataFrame:
    """(good, rows): the number of bounds that each feature of each labelled row reaches, a byte for each, many rows a block."""

    def pack(batches):
        held = {True: [], False: []}

        def full(least):
            for good, parts in held.items():
                if sum(map(len, parts)) > least:
                    yield pa.RecordBatch.from_pydict({"good": pa.array([good]), "rows": pa.array([np.concatenate(parts).tobytes()], pa.binary())})
                    held[good] = []

        for b in batches:
            good = b.column("_label").to_numpy(zero_copy_only=False) == 1
            reached = np.column_stack([np.searchsorted(own, b.column(f"f_{f}").to_numpy(zero_copy_only=False), "right") for f, own in zip(FEATURES, bounds, strict=True)]).astype(np.uint8)
            for kind in held:
                held[kind].append(reached[good == kind])
            yield from full(1 << 18)
        yield from full(0)

    return map_arrow(table.select("_label", *[f"f_{f}" for f in FEATURES]), pack, "good boolean, rows binary")


def _sums(blocks: DataFrame, weights: list[np.ndarray], cells: int, by_bin: bool) -> np.ndarray:
    """(kind, interval, 1 + bins): the rows of each interval of strengths, shared between the nearest two, and with
    ``by_bin`` how many of them lie in each feature's bins."""
    low, high = _range(weights)
    starts = np.cumsum([0, *map(len, weights)])
    columns = 1 + (int(starts[-1]) if by_bin else 0)

    def add(batches):
        total = np.zeros((2, cells, columns))
        for b in batches:
            for good, raw in zip(b.column("good").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rows = np.frombuffer(raw, np.uint8).reshape(-1, len(weights))
                s = sum(w[rows[:, k]] for k, w in enumerate(weights))
                x = np.clip((s - low) / (high - low) * (cells - 1), 0, cells - 1)
                cell = np.minimum(x.astype(np.int64), cells - 2)
                for at, share in ((cell, 1 - (x - cell)), (cell + 1, x - cell)):
                    total[int(good), :, 0] += np.bincount(at, share, cells)
                    for k in range(len(weights) if by_bin else 0):
                        n = len(weights[k])
                        total[int(good), :, 1 + starts[k] : 1 + starts[k + 1]] += np.bincount(at * n + rows[:, k], share, cells * n).reshape(cells, n)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = sorted(r.sums for r in map_arrow(blocks, add, "sums binary").collect())  # one for each of at most _TASKS tasks
    return sum(np.frombuffer(x) for x in parts).reshape(2, cells, columns)


def _range(weights: list[np.ndarray]) -> tuple[float, float]:
    """The least and the largest strength that any row can have."""
    low, high = sum(float(w.min()) for w in weights), sum(float(w.max()) for w in weights)
    return low, max(high, low + 1e-6)


def fit_ranking(table: DataFrame, *, cut: float = 0.7, bins: int = 24, rounds: int = 80, decay: float = 1e-3, cells: int = 256) -> Ranking:
    """Bradley-Terry weights by accelerated gradient steps on all preferences among the rows (_label, FEATURES)."""
    kinds = {r["_label"]: r["count"] for r in table.groupBy("_label").count().collect()}
    if len(kinds) < 2:
        return Ranking((), 0.0 if 1 in kinds or not kinds else 1.0, cut)
    bounds = _bounds(table, bins)
    blocks, path = write_table(_blocks(table, bounds), "statistics")
    blocks = blocks.coalesce(min(_TASKS, -(-sum(kinds.values()) // (1 << 18))))
    sizes = [len(b) for b in bounds]
    ends = np.cumsum([0, *sizes])
    gains = lambda w: [np.concatenate(([0.0], np.cumsum(w[a:b]))) for a, b in itertools.pairwise(ends)]
    w, v, rate = np.zeros(ends[-1]), np.zeros(ends[-1]), None
    for step in range(rounds):
        ahead = w + step / (step + 3) * v
        weights = gains(ahead)
        sums = _sums(blocks, weights, cells, True)
        bad, good = sums[0, :, 0], sums[1, :, 0]
        at = np.linspace(*_range(weights), cells)
        miss = 1 / (1 + np.exp(at[:, None] - at[None, :]))  # of a good row there and a bad one here: how far from certain
        push = (miss @ bad / bad.sum())[:, None] * sums[1, :, 1:] / good.sum() - (good / good.sum() @ miss)[:, None] * sums[0, :, 1:] / bad.sum()
        in_bin, reach = push.sum(axis=0), np.empty(ends[-1])
        for k, n in enumerate(sizes):  # a row gains a bound's weight in every bin from it on
            own = in_bin[ends[k] + k : ends[k + 1] + k + 1]
            reach[ends[k] : ends[k + 1]] = own[::-1].cumsum()[::-1][1 : n + 1]
        if rate is None:
            share = []
            rows = sums[:, :, 1:].sum(axis=(0, 1)) / (bad.sum() + good.sum())
            for k in range(len(sizes)):
                share.append(rows[ends[k] + k : ends[k + 1] + k + 1][::-1].cumsum()[::-1][1:])
            share = np.concatenate(share)
            rate = 4.0 / max(1.0, float((share * (1 - share)).sum() * 2))
        new = ahead + rate * (reach - decay * ahead)
        w, v = new, new - w
    weights = gains(w)
    sums = _sums(blocks, weights, 1 << 15, False)[:, :, 0]
    remove(table.sparkSession, path)
    # a threshold between two intervals errs on the good rows below and the bad ones above
    errors = np.concatenate(([0.0], np.cumsum(sums[1]))) + sums[0].sum() - np.concatenate(([0.0], np.cumsum(sums[0])))
    best = np.flatnonzero(errors <= errors.min() + 1e-6)
    low, high = _range(weights)
    threshold = low + (high - low) * (best[len(best) // 2] - 0.5) / ((1 << 15) - 1)
    return Ranking(tuple((f, float(b), float(g)) for f, own, a in zip(FEATURES, bounds, ends, strict=False) for b, g in zip(own, w[a : a + len(own)], strict=True)), float(threshold), cut)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: a quarter, by the CRC-32 of the id as text; null ids aren't."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_classifier(docs: DataFrame, labels: DataFrame, *, cut: float = 0.7) -> Ranking:
    """A ranking learned from all labelled rows outside held_out(), one for each id."""
    rows, path = write_table(with_statistics(labelled_rows(docs, labels, "quality", ~held_out())).select("_label", *[f"f_{f}" for f in FEATURES]), "labelled")
    ranking = fit_ranking(rows, cut=cut)
    remove(docs.sparkSession, path)
    return ranking


def quality_classifier(docs: DataFrame, labels: DataFrame, *, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``cut`` on) for every row of ``docs``.

    Labels come from all labelled rows that are not held out; nothing but the text is looked at. Null and empty texts are
    scored by their statistics, zeros; without labels of both kinds every score is that of the kind there is; rows of equal
    or null id each get a row; an empty table gives none.
    """
    ranking = fit_classifier(docs, labels, cut=cut)
    out = with_statistics(docs.select("doc_id", "text")).withColumn("score", ranking.score())
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
