"""Additive attributions of scores, exact against a complete training background.

Linear: weight times distance from the background mean. Trees: interventional Shapley values. For
one leaf and one (row, background row) pair only two bit patterns matter - which of the path's
features the row satisfies, and which the background row does - so the background is reduced, in
one distributed pass, to counts of patterns per leaf (at most 2**depth each). From those, the
contribution of every path feature is tabulated per row pattern, and explaining a row is a lookup
per leaf, whatever the size of the background. Features that no tree reads have no contribution, so
attributions can be kept for the features read alone, whose number does not grow with the categories.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.models import BoostedModel, LogisticModel, Tree

FIDELITY = 1e-8


@dataclass
class LeafPath:
    """A leaf's value and its conditions low < x[feature] <= high, one interval per distinct feature."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: float

    def patterns(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.features]
        ok = (v > self.low) & (v <= self.high)
        return ok @ (1 << np.arange(len(self.features)))


def all_patterns(paths: Sequence[LeafPath], x: np.ndarray) -> Iterator[np.ndarray]:
    """The patterns of every path; a comparison that several paths share is made once."""
    columns, above, upto = np.ascontiguousarray(x.T), {}, {}
    for p in paths:
        out = np.zeros(len(x), np.uint8 if len(p.features) <= 8 else np.int64)
        for i, (f, low, high) in enumerate(zip(p.features, p.low, p.high, strict=True)):
            if (f, low) not in above:
                above[f, low] = columns[f] > low
            if (f, high) not in upto:
                upto[f, high] = columns[f] <= high
            out |= (above[f, low] & upto[f, high]).astype(out.dtype) << i
        yield out


def leaf_paths(tree: Tree) -> list[LeafPath]:
    out, todo = [], [(0, {})]
    while todo:
        at, limits = todo.pop()
        f = int(tree.feature[at])
        if f < 0:
            names = sorted(limits)
            out.append(LeafPath(np.array(names, np.int64), np.array([limits[n][0] for n in names]), np.array([limits[n][1] for n in names]), float(tree.value[at] * tree.weight)))
            continue
        low, high = limits.get(f, (-np.inf, np.inf))
        t = float(tree.threshold[at])
        todo.append((int(tree.left[at]), {**limits, f: (low, min(high, t))}))
        todo.append((int(tree.right[at]), {**limits, f: (max(low, t), high)}))
    return out


def pattern_table(path: LeafPath, counts: np.ndarray) -> np.ndarray:
    """Contribution of each path feature by the row's pattern, averaged over the background's patterns."""
    m = len(path.features)
    table, total = np.zeros((1 << m, m)), counts.sum()
    for row in range(1 << m):
        for back in np.flatnonzero(counts):
            if (row | back) != (1 << m) - 1:
                continue  # a condition that neither meets: the leaf is never reached
            mine, theirs = row & ~back, back & ~row
            a, b = bin(mine).count("1"), bin(theirs).count("1")
            share = counts[back] / total * path.value
            for i in range(m):
                if mine >> i & 1:
                    table[row, i] += share * factorial(a - 1) * factorial(b) / factorial(a + b)
                elif theirs >> i & 1:
                    table[row, i] -= share * factorial(a) * factorial(b - 1) / factorial(a + b)
    return table


class TreeAttributor:
    """Interventional attribution of a boosted model's log-odds."""

    def fit(self, model: BoostedModel, background: DataFrame) -> TreeAttributor:
        self.model = model
        self.paths = [p for t in model.trees[: model.kept] for p in leaf_paths(t)]
        paths = self.paths

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = [np.zeros(1 << len(p.features), np.int64) for p in paths]
            for f in frames:
                for s, found in zip(sums, all_patterns(paths, np.stack(f["features"].to_numpy())), strict=True):
                    s += np.bincount(found, minlength=len(s))
            rows = [(i, int(j), int(s[j])) for i, s in enumerate(sums) for j in np.flatnonzero(s)]
            yield pd.DataFrame(rows, columns=["leaf", "pattern", "n"])

        found = background.select(model.features()).mapInPandas(run, "leaf bigint, pattern bigint, n bigint").groupBy("leaf", "pattern").agg(F.sum("n").alias("n"))
        counts = [np.zeros(1 << len(p.features)) for p in paths]
        for leaf, pattern, n in found.collect():
            counts[leaf][pattern] = n
        self.background_rows = int(counts[0].sum())
        self.tables = [2.0 * pattern_table(p, c) for p, c in zip(paths, counts, strict=True)]
        full = [(1 << len(p.features)) - 1 for p in paths]
        self.base = float(sum(2.0 * p.value * c[f] / c.sum() for p, c, f in zip(paths, counts, full, strict=True)))
        return self

    def explain(self, rows: DataFrame, *, short: bool = False) -> DataFrame:
        """Adds ``base``, ``phi`` (array in the encoder's order, or if ``short`` in that of the model's ``used_names``), ``margin`` and ``score``."""
        paths, tables, used = self.paths, self.tables, np.array(self.model.used)
        width = len(used) if short else len(self.model.encoder.names)

        @F.pandas_udf("array<double>")
        def phi(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_numpy())
            out = np.zeros((len(used), len(x)))
            for p, t, found in zip(paths, tables, all_patterns(paths, x), strict=True):
                for i, f in enumerate(p.features):
                    out[f] += t[:, i][found]
            if short:
                return pd.Series(list(np.ascontiguousarray(out.T)))
            full = np.zeros((len(x), width))
            full[:, used] = out.T
            return pd.Series(list(full))

        return self.model.score(rows).withColumn("phi", phi(self.model.features())).withColumn("base", F.lit(self.base))


class LinearAttributor:
    """Attribution of a logistic model's log-odds; expressions only."""

    def fit(self, model: LogisticModel, background: DataFrame) -> LinearAttributor:
        self.model = model
        self.background_rows = background.count()
        sums = background.select(F.inline(model.encoder.entries())).groupBy("i").agg(F.sum("value").alias("s")).collect()
        self.means = np.zeros(len(model.encoder.names))
        for i, total in sums:
            self.means[i] = total / self.background_rows
        self.base = model.intercept + float(np.dot(model.coefficients, self.means))
        return self

    def explain(self, rows: DataFrame) -> DataFrame:
        away = F.zip_with(self.model.encoder.dense(), F.lit([float(m) for m in self.means]), lambda x, m: x - m)
        phi = F.zip_with(away, F.lit([float(w) for w in self.model.coefficients]), lambda x, w: x * w)
        return self.model.score(rows).withColumn("margin", self.model.margin()).withColumn("phi", phi).withColumn("base", F.lit(self.base))


def fidelity_audit(explained: DataFrame) -> DataFrame:
    """One row: largest gap between base + attributions and the log-odds, and whether all is finite."""
    total = F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
    gap = F.max(F.abs(total - F.col("margin")))
    finite = F.bool_and(F.forall("phi", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return explained.agg(F.count(F.lit(1)).alias("explained_rows"), gap.alias("maximum_error"), finite.alias("all_finite")).withColumn(
        "status", F.when((F.col("maximum_error") <= FIDELITY) & F.col("all_finite"), "PASS").otherwise("FAIL")
    )


def global_importance(explained: DataFrame, names: list[str], limit: int = 15) -> DataFrame:
    """``(feature, importance)``: mean absolute attribution as a share of the total, the largest ``limit``."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    per = explained.select(F.posexplode("phi").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("a"))
    whole = F.sum("a").over(Window.partitionBy(F.lit(1)))  # one row per feature
    named = per.select(F.element_at(F.lit(names), F.col("i") + 1).alias("feature"), F.coalesce(F.try_divide(F.col("a"), whole), F.lit(0.0)).alias("importance"))
    return named.orderBy(F.col("importance").desc(), "feature").limit(limit)
