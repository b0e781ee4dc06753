"""A readable additive baseline: amount outliers and entities unseen in training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.slices import quantiles


@dataclass
class RulesBaseline:
    """Fitted without reading labels; known entities stay tables, so their number is not limited."""

    high: float = 0.95
    very_high: float = 0.99

    def fit(self, train: DataFrame) -> RulesBaseline:
        if not 0 < self.high < self.very_high < 1:
            raise ValueError("quantiles must satisfy 0 < high < very_high < 1")
        self.high_amount, self.very_high_amount = quantiles(train, "amount", self.high, self.very_high)
        self.known = {c: train.select(c).filter(F.col(c).isNotNull()).distinct() for c in ("device_id", "recipient_id")}
        return self

    def rate(self, rows: DataFrame) -> DataFrame:
        """Adds ``score`` (0..4) and ``reasons``; a NULL entity adds nothing."""
        if not hasattr(self, "known"):
            raise RuntimeError("fit first")
        out = rows
        for c, seen in self.known.items():
            out = out.join(seen.withColumn(f"__seen_{c}", F.lit(True)), c, "left")
        unseen = {c: F.col(c).isNotNull() & F.col(f"__seen_{c}").isNull() for c in self.known}
        high, very = F.col("amount") >= self.high_amount, F.col("amount") >= self.very_high_amount
        flags = [high, very, *unseen.values()]
        score = sum((F.coalesce(f, F.lit(False)).cast("double") for f in flags[1:]), F.coalesce(flags[0], F.lit(False)).cast("double"))
        reasons = F.concat_ws(
            ";", F.when(very, "very_high_amount").when(high, "high_amount"), F.when(unseen["device_id"], "device_unseen_in_training"),
            F.when(unseen["recipient_id"], "recipient_unseen_in_training"),
        )
        shown = F.when(reasons == "", "no_rule_triggered").otherwise(reasons)
        return out.select(*rows.columns, score.alias("score"), shown.alias("reasons"))
