"""Scoring models: class-balanced logistic regression (Newton's steps, beyond 2,000 features pyspark.ml) and boosted trees (``boosting``)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.boosting import Grown, binned, fit_bins, grow
from tidegraph.operators.encode import CombinedEncoder, Numbers, TabularEncoder
from tidegraph.session import Scratch

#: Prefixes of boosted trees whose validation margins are written at once, and ranges they are ranked in.
PREFIXES, RANGES = 40, 16
#: Features up to which the logistic fit sums their whole curvature matrix (8 bytes a pair, 32 MB, from at most 8 tasks), and rows summed at once.
NEWTON_FEATURES, NEWTON_ROWS = 2_000, 50_000


def balanced(rows: DataFrame) -> DataFrame:
    """Adds ``label`` and class-balancing ``weight``; raises unless both classes occur."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_fraud") == 1).alias("p"), F.count_if(F.col("is_fraud") == 0).alias("q")).first()
    if not r["p"] or not r["q"] or r["p"] + r["q"] != r["n"]:
        raise ValueError("training labels must contain both 0 and 1 and nothing else")
    weight = F.when(F.col("is_fraud") == 1, r["n"] / (2.0 * r["p"])).otherwise(r["n"] / (2.0 * r["q"]))
    return rows.withColumn("label", F.col("is_fraud").cast("double")).withColumn("weight", weight)


@dataclass
class LogisticModel:
    """L2 logistic regression on the tabular features, or with ``graph=True`` on tabular and graph features."""

    graph: bool = False
    l2_strength: float = 0.10
    max_iterations: int = 5_000
    tolerance: float = 1e-8

    def fit(self, train: DataFrame) -> LogisticModel:
        if self.l2_strength <= 0 or self.max_iterations <= 0 or self.tolerance <= 0:
            raise ValueError("settings must be positive")
        self.encoder = (CombinedEncoder() if self.graph else TabularEncoder()).fit(train)
        rows = balanced(train)
        if len(self.encoder.names) <= NEWTON_FEATURES:
            self.coefficients, self.intercept, self.iterations = self._newton(rows)
        else:
            self.coefficients, self.intercept, self.iterations = self._quasi_newton(rows)
        self.converged = self.iterations < self.max_iterations
        self.training_loss = self.weighted_loss(train)
        return self

    def _quasi_newton(self, rows: DataFrame) -> tuple[np.ndarray, float, int]:
        """(coefficients, intercept, iterations) by gradients alone, for many features."""
        rows = self.encoder.vectors(rows, ["label", "weight"]).persist()
        n = rows.count()
        # Balanced weights sum to n, so the summed-loss strength turns into strength / n for the mean loss.
        learner = LogisticRegression(
            featuresCol="x", labelCol="label", weightCol="weight", regParam=self.l2_strength / n, elasticNetParam=0.0, standardization=False,
            maxIter=self.max_iterations, tol=self.tolerance,
        )
        model = learner.fit(rows)
        rows.unpersist()
        return np.array(model.coefficients.toArray()), float(model.intercept), int(model.summary.totalIterations)

    def _newton(self, rows: DataFrame) -> tuple[np.ndarray, float, int]:
        """The same by Newton's steps: a pass sums loss, slope and curvature, and correlated features do not slow it down.

        A step that raises the loss is halved. It ends when a step promises less than a thousandth of the tolerance.
        """
        scratch, placed = Scratch(rows.sparkSession, "logistic"), list(self.encoder._placed())
        numbers = [(at + k, c) for at, b in placed if isinstance(b, Numbers) for k, c in enumerate(b.columns.values())]
        hot = [(at, b) for at, b in placed if not isinstance(b, Numbers)]
        columns = [c.cast("double").alias(f"n{i}") for i, (_, c) in enumerate(numbers)]
        columns += [F.coalesce(b.lookup([at + k for k in range(len(b.values))]), F.lit(-1)).cast("int").alias(f"c{i}") for i, (at, b) in enumerate(hot)]
        d, dense = len(self.encoder.names), [i for i, _ in numbers]
        table = scratch.table(rows.select(*columns, "label", "weight"), "encoded").coalesce(max(1, min(8, rows.sparkSession.sparkContext.defaultParallelism)))

        def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            wide = np.array([*dense, d])

            def add(held: list[pa.RecordBatch], total: np.ndarray) -> None:
                columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)]
                y, w, codes = columns[-2], columns[-1], columns[len(dense) : -2]
                x = np.stack([*columns[: len(dense)], np.ones(len(y))], 1)
                known = [np.flatnonzero(c >= 0) for c in codes]
                m = x @ at[wide]
                for c, k in zip(codes, known, strict=True):
                    m[k] += at[c[k]]
                chance = 0.5 * (1.0 + np.tanh(0.5 * m))
                gap, bent = w * (chance - y), w * chance * (1.0 - chance)
                slope, bend = total[1 : d + 2], total[d + 2 :].reshape(d + 1, d + 1)
                total[0] += float(w @ (np.logaddexp(0.0, m) - y * m))
                slope[wide] += x.T @ gap
                bend[np.ix_(wide, wide)] += x.T @ (x * bent[:, None])
                for i, (c, k) in enumerate(zip(codes, known, strict=True)):
                    slope += np.bincount(c[k], gap[k], d + 1)
                    bend[np.arange(d + 1), np.arange(d + 1)] += np.bincount(c[k], bent[k], d + 1)
                    for j, f in enumerate(wide):
                        both = np.bincount(c[k], x[k, j] * bent[k], d + 1)
                        bend[f] += both
                        bend[:, f] += both
                    for other in codes[:i]:
                        k2 = k[other[k] >= 0]
                        both = np.bincount(c[k2].astype(np.int64) * (d + 1) + other[k2], bent[k2], (d + 1) ** 2).reshape(d + 1, d + 1)
                        bend += both
                        bend += both.T

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, held = np.zeros(1 + (d + 1) * (d + 2)), []
                for b in batches:
                    held.append(b)
                    if sum(x.num_rows for x in held) >= NEWTON_ROWS:
                        add(held, total)
                        held = []
                if held:
                    add(held, total)
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

            found = sum(np.frombuffer(r[0]) for r in table.mapInArrow(run, "sums binary").collect())
            return float(found[0]), found[1 : d + 2], found[d + 2 :].reshape(d + 1, d + 1)

        # Balanced weights sum to n: the penalty of the summed loss is l2_strength.
        kept = np.r_[np.full(d, self.l2_strength), 0.0]
        at, n = np.zeros(d + 1), table.count()
        best, step, share = np.inf, np.zeros(d + 1), 1.0
        for iteration in range(self.max_iterations):
            loss, slope, bend = sums(at)
            loss += 0.5 * float(kept @ at**2)
            if loss > best + 1e-12 * abs(best) and share > 1e-6:
                share *= 0.5
                at = at - share * step
                continue
            best, share = loss, 1.0
            slope = slope + kept * at
            step = -np.linalg.solve(bend + np.diag(kept), slope)
            if -0.5 * float(slope @ step) <= 1e-3 * self.tolerance * n:
                return at[:-1], float(at[-1]), iteration
            at = at + step
        return at[:-1], float(at[-1]), self.max_iterations

    def margin(self):
        return self.encoder.linear(self.coefficients) + self.intercept

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of label 1; expressions only."""
        if not hasattr(self, "coefficients"):
            raise RuntimeError("fit first")
        return rows.withColumn("score", 1.0 / (1.0 + F.exp(-self.margin())))

    def slope(self, rows: DataFrame) -> float:
        """Largest entry of the gradient of the penalised mean loss: 0 at the optimum."""
        scored = self.score(balanced(rows))
        gap = (F.col("score") - F.col("label")) * F.col("weight")
        size = scored.agg(F.sum("weight").alias("w"), F.sum(gap).alias("g"), F.count(F.lit(1)).alias("n")).first()
        sums = np.zeros(len(self.coefficients))
        for i, g in scored.select(gap.alias("gap"), F.inline(self.encoder.entries())).groupBy("i").agg(F.sum(F.col("gap") * F.col("value"))).collect():
            sums[i] = g
        return float(max(np.abs(sums / size["w"] + self.l2_strength / size["n"] * self.coefficients).max(), abs(size["g"] / size["w"])))

    def weighted_loss(self, rows: DataFrame) -> float:
        p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-15)), F.lit(1e-15))
        loss = F.when(F.col("label") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
        r = self.score(balanced(rows)).agg(F.sum(loss * F.col("weight")).alias("l"), F.sum("weight").alias("w")).first()
        return r["l"] / r["w"]

    def strongest(self, limit: int = 8) -> list[tuple[str, float]]:
        order = np.argsort(-np.abs(self.coefficients), kind="stable")[:limit]
        return [(self.encoder.names[i], float(self.coefficients[i])) for i in order]


@dataclass
class Tree:
    """Arrays over nodes: feature (-1 at leaves), threshold (left if value <= threshold), children, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            open_ = f >= 0
            if not open_.any():
                return self.value[at] * self.weight
            go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(open_, np.where(go_left, self.left[at], self.right[at]), at)


@dataclass
class BoostedModel:
    """Boosted trees on all features; the number of trees kept maximises validation average precision.

    Up to ``max_trees`` are grown; the search ends when ``patience`` further trees bring no gain. A
    tree depends only on those before it, so trees are grown in doubling stages, and no more of them
    than the search looks at or a stage holds; a stage goes on from the trees there are. Leaves are bounded by ``depth``: growth is level-wise.
    """

    max_trees: int = 400
    step: float = 0.03
    depth: int = 4
    min_leaf: int = 15
    column_share: float = 0.9
    patience: int = 40
    seed: int = 42
    trees: list[Tree] = field(default_factory=list, repr=False)
    grown: list[Grown] = field(default_factory=list, repr=False)

    def fit(self, train: DataFrame, validation: DataFrame) -> BoostedModel:
        if self.max_trees <= 0 or self.step <= 0 or self.depth <= 0 or self.min_leaf <= 0 or self.patience <= 0 or not 0 < self.column_share <= 1:
            raise ValueError("boosting settings are out of range")
        balanced(validation)
        self.encoder = CombinedEncoder().fit(train)
        rows = balanced(train)
        self.label_weights = tuple(rows.groupBy("is_fraud").agg(F.first("weight")).sort("is_fraud").toPandas().iloc[:, 1])
        self.bins = fit_bins(rows, self.encoder)
        rows = Scratch(train.sparkSession, "boosted").table(binned(rows, self.encoder, self.bins), "binned")
        grown, self.trees, self.grown, self.precision = min(2 * self.patience, self.max_trees), [], [], {}
        while True:
            self._grow(rows, grown)
            self.kept, ended = self._best_prefix(validation)
            if ended or grown == self.max_trees:
                break
            grown = min(2 * grown, self.max_trees)
        return self

    def _grow(self, rows: DataFrame, count: int) -> None:
        """Grows trees after those there are, up to ``count``."""
        self.grown = grow(
            rows, self.bins, self.grown, count, self.label_weights, step=self.step, depth=self.depth, min_leaf=self.min_leaf, column_share=self.column_share, seed=self.seed
        )
        gains = np.zeros(len(self.encoder.names))
        for t in self.grown:
            for f, gain in t.gains.items():
                gains[f] += gain
        self.importances = gains / gains.sum() if gains.sum() else gains
        # Trees read few of the features: only those are sent to Python, renumbered.
        self.used = sorted({f for t in self.grown for f in t.feature if f >= 0}) or [0]
        place = {f: i for i, f in enumerate(self.used)}
        self.trees = [
            Tree(np.array([place.get(f, -1) for f in t.feature], np.int64), np.array(t.threshold), np.array(t.left), np.array(t.right), np.array(t.value), t.weight) for t in self.grown
        ]

    def _best_prefix(self, validation: DataFrame) -> tuple[int, bool]:
        """(trees kept, whether patience ended the search): exact average precision of every prefix, some new ones at a time."""
        best, at, ended = -1.0, 1, False
        for k in range(1, len(self.trees) + 1):
            if k not in self.precision:
                self.precision |= self._prefix_precision(validation, k, min(k + PREFIXES, len(self.trees) + 1))
            if self.precision[k] > best + 1e-12:
                best, at = self.precision[k], k
            elif k - at >= self.patience:
                ended = True
                break
        self.validation_precision = best
        return at, ended

    def _prefix_precision(self, validation: DataFrame, first: int, end: int) -> dict[int, float]:
        """Average precision of the prefixes from ``first`` to before ``end``, equal margins as one.

        Margins are packed by prefix and range; a range is ranked in one task, after the counts of the ranges above it.
        """
        trees = self.trees[: end - 1]

        def pack(frames):
            for f in frames:
                x, label = np.stack(f["features"].to_numpy()), f["label"].to_numpy(np.int8)
                margin, out = np.zeros(len(x)), []
                for k, t in enumerate(trees, 1):
                    margin = margin + t.predict(x)
                    if k < first:
                        continue
                    order = np.argsort(-margin, kind="stable")
                    m, y = margin[order], label[order]
                    # Ranges of the probability, the highest first: a function of the margin alone.
                    place = np.minimum(RANGES - 1, (RANGES / (1.0 + np.exp(2.0 * m))).astype(np.int64))
                    edges = np.searchsorted(place, np.arange(RANGES + 1))
                    out += [(k, r, b - a, int(y[a:b].sum()), m[a:b].tobytes(), y[a:b].tobytes()) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                yield pd.DataFrame(out, columns=["kept", "place", "n", "tp", "margins", "labels"])

        rows = validation.select(self.features(), F.col("is_fraud").cast("bigint").alias("label"))
        scratch = Scratch(validation.sparkSession, "prefixes")
        packed = scratch.table(rows.mapInPandas(pack, "kept bigint, place bigint, n bigint, tp bigint, margins binary, labels binary"), "packed")
        sizes = {(r.kept, r.place): (r.n, r.tp) for r in packed.groupBy("kept", "place").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp")).collect()}
        above, totals = {}, {}
        for k in range(first, end):
            n = tp = 0
            for r in range(RANGES):
                above[k, r] = (n, tp)
                n, tp = n + sizes.get((k, r), (0, 0))[0], tp + sizes.get((k, r), (0, 0))[1]
            totals[k] = tp

        def rank(f: pd.DataFrame) -> pd.DataFrame:
            k, r = int(f["kept"].iloc[0]), int(f["place"].iloc[0])
            margin, label = np.frombuffer(b"".join(f["margins"])), np.frombuffer(b"".join(f["labels"]), np.int8)
            order = np.argsort(-margin, kind="stable")
            margin, ones = margin[order], np.cumsum(label[order], dtype=np.int64)
            last = np.flatnonzero(np.r_[margin[1:] != margin[:-1], True])
            n, tp = above[k, r]
            found = np.diff(np.r_[0, ones[last]])
            return pd.DataFrame({"kept": [k], "part": [float((found * (tp + ones[last]) / (n + last + 1.0)).sum())]})

        parts = scratch.table(packed.groupBy("kept", "place").applyInPandas(rank, "kept bigint, part double"), "parts").collect()
        sums: dict[int, list[float]] = {}
        for r in sorted(parts):
            sums.setdefault(r["kept"], []).append(r["part"])
        scratch.drop("packed")
        return {k: sum(v) / totals[k] for k, v in sums.items()}

    def used_names(self) -> list[str]:
        """The features that trees read: their number is bounded by the trees, not by the categories."""
        return [self.encoder.names[i] for i in self.used]

    def features(self):
        """The used features as an array column."""
        return F.array(*self.encoder.pick(self.used)).alias("features")

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``margin`` (log-odds) and ``score``."""
        trees = self.trees[: self.kept]
        if not trees:
            raise RuntimeError("fit first")

        @F.pandas_udf("double")
        def margin(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            x = np.stack(features.to_numpy())
            return pd.Series(2.0 * sum(t.predict(x) for t in trees))

        return rows.withColumn("margin", margin(self.features())).withColumn("score", 1.0 / (1.0 + F.exp(-F.col("margin"))))

    def strongest(self, limit: int = 12) -> list[tuple[str, float]]:
        if limit <= 0:
            raise ValueError("limit must be positive")
        order = np.argsort(-self.importances, kind="stable")[:limit]
        return [(self.encoder.names[i], float(self.importances[i])) for i in order]


def select_model(validation_precision: dict[str, float], configured: str | None = None) -> str:
    """The model with the best validation average precision (ties: by name); a configured choice must agree."""
    best = min(validation_precision, key=lambda m: (-validation_precision[m], m))
    if configured is not None and configured != best:
        raise ValueError(f"configured model {configured}, best on validation {best}")
    return best

