"""Train-fitted encoders made of expressions.

An encoder is a list of blocks: numbers (one expression each) and one-hot categories (one lookup
each, whatever the number of categories). Linear scores, long forms and picked features are built
from the blocks, so no wide array of zeros is made unless it is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.slices import quantiles
from tidegraph.schema import ENTITY_TYPES, IDENTIFIER_COLUMNS, MODEL_GRAPH_FEATURES, TABULAR_CATEGORIES, TARGET_NAMES, require_columns

MISSING = "<missing>"
#: More categories of one column than this are refused: they would not be one-hot columns any more.
MAX_CATEGORIES = 10_000


def audit_feature_names(names: Sequence[str]) -> None:
    bad = sorted(n for n in names if n in TARGET_NAMES or n in IDENTIFIER_COLUMNS)
    if bad:
        raise ValueError(f"forbidden model features: {', '.join(bad)}")


@dataclass
class Numbers:
    """Features that are one expression each."""

    columns: dict[str, Column]

    @property
    def names(self) -> list[str]:
        return list(self.columns)


@dataclass
class OneHot:
    """Equality flags of a column's training categories; an unseen category is all zeros."""

    column: str
    values: list[str]

    @property
    def names(self) -> list[str]:
        return [f"{self.column}={v}" for v in self.values]

    def value(self) -> Column:
        return F.coalesce(self.column, F.lit(MISSING))

    def lookup(self, results: Sequence) -> Column:
        """The result at the row's category, NULL if unseen."""
        return F.try_element_at(F.create_map(*(x for v, r in zip(self.values, results, strict=True) for x in (F.lit(v), F.lit(r)))), self.value())


@dataclass
class Encoder:
    blocks: list[Numbers | OneHot] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [n for b in self.blocks for n in b.names]

    def _placed(self):
        at = 0
        for b in self.blocks:
            yield at, b
            at += len(b.names)

    def pick(self, indices: Sequence[int]) -> list[Column]:
        """One double expression per chosen feature."""
        out = {}
        for at, b in self._placed():
            for i in indices:
                if at <= i < at + len(b.names):
                    out[i] = b.columns[b.names[i - at]] if isinstance(b, Numbers) else (b.value() == b.values[i - at]).cast("double")
        return [out[i] for i in indices]

    def linear(self, weights: np.ndarray) -> Column:
        """The weighted sum of all features."""
        total = F.lit(0.0)
        for at, b in self._placed():
            w = [float(x) for x in weights[at : at + len(b.names)]]
            if isinstance(b, Numbers):
                terms = [F.lit(x) * c for x, c in zip(w, b.columns.values(), strict=True)]
                total = total + F.aggregate(F.array(*terms), F.lit(0.0), lambda a, x: a + x)
            else:
                total = total + F.coalesce(b.lookup(w), F.lit(0.0))
        return total

    def entries(self) -> Column:
        """Array of ``struct(i, value)`` of the features that may differ from zero, i from 0."""
        each = []
        for at, b in self._placed():
            if isinstance(b, Numbers):
                each += [F.struct(F.lit(at + k).alias("i"), c.cast("double").alias("value")) for k, c in enumerate(b.columns.values())]
            else:
                each.append(F.struct(b.lookup([at + k for k in range(len(b.values))]).alias("i"), F.lit(1.0).alias("value")))
        return F.filter(F.array(*each), lambda e: e["i"].isNotNull())

    def dense(self) -> Column:
        """All features as an array<double> in the order of ``names``."""
        parts = []
        for _, b in self._placed():
            if isinstance(b, Numbers):
                parts.append(F.array(*(c.cast("double") for c in b.columns.values())))
            else:
                k = len(b.values)
                hit = b.lookup(list(range(k)))
                one = F.concat(F.array_repeat(F.lit(0.0), hit), F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.lit(k - 1) - hit))
                parts.append(F.coalesce(one, F.array_repeat(F.lit(0.0), k)))
        return F.concat(*parts)

    def vectors(self, rows: DataFrame, keep: Sequence[str], name: str = "x") -> DataFrame:
        """``keep`` and the features as an ml vector, sparse where that is smaller."""
        inputs, chosen, hot = [], [F.col(c) for c in keep], []
        for j, (_, b) in enumerate(self._placed()):
            if isinstance(b, Numbers):
                for k, c in enumerate(b.columns.values()):
                    chosen.append(c.cast("double").alias(f"__{j}_{k}"))
                    inputs.append(f"__{j}_{k}")
            else:
                # One index more than there are categories stands for unseen ones and is dropped.
                n = len(b.values)
                index = F.coalesce(b.lookup([float(i) for i in range(n)]), F.lit(float(n)))
                chosen.append(index.alias(f"__{j}", metadata={"ml_attr": {"type": "nominal", "num_vals": n + 1}}))
                hot.append(f"__{j}")
                inputs.append(f"__{j}_v")
        df = rows.select(*chosen)
        if hot:
            df = OneHotEncoder(inputCols=hot, outputCols=[f"{h}_v" for h in hot], dropLast=True).fit(df).transform(df)
        return VectorAssembler(inputCols=inputs, outputCol=name).transform(df).select(*keep, name)


class TabularEncoder(Encoder):
    """Standardised log amount, a flag per entity present, and one-hot categories of the training rows."""

    def fit(self, train: DataFrame) -> TabularEncoder:
        require_columns(train, ["amount", *TABULAR_CATEGORIES, *ENTITY_TYPES], "tabular input")
        (self.median,) = quantiles(train, "amount", 0.5)
        logs = F.log1p(F.coalesce("amount", F.lit(self.median)))
        m = train.agg(F.avg(logs).alias("m"), F.stddev_pop(logs).alias("s")).first()
        self.mean, self.scale = m["m"], m["s"] or 1.0
        numbers = {"log_amount_standardized": (logs - self.mean) / self.scale}
        numbers |= {f"has_{c.removesuffix('_id')}": F.col(c).isNotNull().cast("double") for c in ENTITY_TYPES}
        self.blocks = [Numbers(numbers)]
        for c in TABULAR_CATEGORIES:
            found = train.select(F.coalesce(c, F.lit(MISSING)).alias("v")).distinct().limit(MAX_CATEGORIES + 1).collect()
            if len(found) > MAX_CATEGORIES:
                raise ValueError(f"more than {MAX_CATEGORIES} categories in {c}")
            self.blocks.append(OneHot(c, sorted(r[0] for r in found)))
        audit_feature_names(self.names)
        return self


@dataclass
class GraphEncoder(Encoder):
    """log1p and standardisation by population deviation (1 where it is 0) of the graph features."""

    features: Sequence[str] = MODEL_GRAPH_FEATURES

    def fit(self, train: DataFrame) -> GraphEncoder:
        require_columns(train, self.features, "graph input")
        self.check(train)
        logs = {c: F.log1p(F.col(c).cast("double")) for c in self.features}
        m = train.agg(*(F.avg(x).alias(f"m_{c}") for c, x in logs.items()), *(F.stddev_pop(x).alias(f"s_{c}") for c, x in logs.items())).first()
        self.moments = {c: (m[f"m_{c}"], m[f"s_{c}"] or 1.0) for c in self.features}
        self.blocks = [Numbers({f"log1p_standardized_{c}": (logs[c] - mean) / scale for c, (mean, scale) in self.moments.items()})]
        audit_feature_names(self.names)
        return self

    def check(self, rows: DataFrame) -> None:
        ok = [F.coalesce((F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double")) & (F.col(c).cast("double") < float("inf")), F.lit(False)) for c in self.features]
        if not rows.filter(F.exists(F.array(*ok), lambda x: ~x)).isEmpty():
            raise ValueError("graph features must be finite and not negative")


class CombinedEncoder(Encoder):
    """Tabular features followed by graph features."""

    def fit(self, train: DataFrame) -> CombinedEncoder:
        self.blocks = [*TabularEncoder().fit(train).blocks, *GraphEncoder().fit(train).blocks]
        audit_feature_names(self.names)
        return self


def long_form(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """``(transaction_id, feature, value)`` of the features that are not zero."""
    each = rows.select("transaction_id", F.inline(encoder.entries())).filter("value <> 0.0D")
    return each.select("transaction_id", F.element_at(F.lit(encoder.names), F.col("i") + 1).alias("feature"), "value")
