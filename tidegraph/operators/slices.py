"""Exhaustive error slices of an evaluated ranking, empty slices kept."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.ordering import global_running
from tidegraph.session import Scratch

BANDS = ("at_or_below_train_median", "train_median_to_p90", "above_train_p90")


def band(c: str, median: float, ninetieth: float) -> Column:
    return F.when(F.col(c) <= median, BANDS[0]).when(F.col(c) <= ninetieth, BANDS[1]).otherwise(BANDS[2])


def column_quantiles(rows: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, with linear interpolation between neighbouring values; NULLs are left out.

    Values are counted per column with map-side combining, the counted values of all columns are put
    in one distributed total order, and only the values at the wanted positions come back.
    """
    each = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in wanted))
    counts = rows.select(F.inline(each)).filter("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(rows.sparkSession, "quantiles")
    run = scratch.table(global_running(scratch.table(counts, "counts"), [F.col("c"), F.col("v")], sums={"upto": "n"}), "run")
    ends = {r["c"]: (r["a"], r["b"]) for r in run.groupBy("c").agg(F.min(F.col("upto") - F.col("n")).alias("a"), F.max("upto").alias("b")).collect()}
    places = {c: [ends[c][0] + (ends[c][1] - ends[c][0] - 1) * q for q in shares] for c, shares in wanted.items() if c in ends}
    positions = sorted({f(p) for found in places.values() for p in found for f in (math.floor, math.ceil)})
    hit = F.exists(F.lit(positions), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n")))
    found = sorted((r["upto"], r["v"]) for r in run.filter(hit).select("upto", "v").collect()) if positions else []
    at = lambda w: next(v for upto, v in found if w < upto)
    between = lambda p: at(math.floor(p)) + (at(math.ceil(p)) - at(math.floor(p))) * (p - math.floor(p))
    return {c: [between(p) for p in places[c]] if c in places else [None] * len(shares) for c, shares in wanted.items()}


def quantiles(rows: DataFrame, column: str, *shares: float) -> list[float | None]:
    """The exact quantiles of one column."""
    return column_quantiles(rows, {column: shares})[column]


def slice_families(train: DataFrame, *, graph: bool = True) -> dict[str, tuple[Column, tuple[str, ...] | None]]:
    """Family -> (slice expression, its full list of slices or None where the data decide)."""
    found = column_quantiles(train, {c: (0.5, 0.9) for c in ("amount", *(("specific_shared_transaction_count",) if graph else ()))})
    median, ninetieth = found["amount"]
    families: dict[str, tuple[Column, tuple[str, ...] | None]] = {"amount_band": (band("amount", median, ninetieth), BANDS)}
    if graph:
        s50, s90 = found["specific_shared_transaction_count"]
        families["specific_connectivity"] = (band("specific_shared_transaction_count", s50, s90), BANDS)
        known = ("all_specific_entities_new", "at_least_one_known_specific_entity")
        families["specific_entity_history"] = (F.when(F.col("specific_known_entity_count") == 0, known[0]).otherwise(known[1]), known)
        matured = ("no_matured_neighbour", "matured_neighbours_no_fraud", "matured_fraud_neighbour")
        families["matured_label_history"] = (
            F.when(F.col("matured_neighbor_label_count") == 0, matured[0]).when(F.col("matured_neighbor_fraud_count") == 0, matured[1]).otherwise(matured[2]),
            matured,
        )
    families["product_code"] = (F.coalesce("product_code", F.lit("<missing>")), None)
    return families


def slice_summary(rank: DataFrame, families: Mapping[str, tuple[Column, tuple[str, ...] | None]], review: int) -> DataFrame:
    """Rows, labels, prevalence, mean score, alerts and errors per family and slice of a ranked table.

    One pass: every row is expanded to its slice in each family, combined map-side. Slices without
    rows have zeros; recall is NULL where a slice has no positive.
    """
    each = F.array(*(F.struct(F.lit(f).alias("family"), c.alias("slice")) for f, (c, _) in families.items()))
    rows = rank.select("is_fraud", "score", (F.col("rank") <= review).alias("alert"), F.inline(each))
    fraud = F.col("is_fraud") == 1
    agg = rows.groupBy("family", "slice").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(fraud).alias("fraud_labels"), F.avg("score").alias("mean_score"), F.count_if("alert").alias("alert_count"),
        F.count_if(F.col("alert") & fraud).alias("true_positives"), F.count_if(F.col("alert") & ~fraud).alias("false_positives"),
    )
    full = [(f, s) for f, (_, names) in families.items() for s in names or ()]
    if full:
        frame = rank.sparkSession.createDataFrame(full, "family string, slice string")
        agg = F.broadcast(frame).join(agg, ["family", "slice"], "full_outer").na.fill(0)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("true_positives")
    return agg.select(
        "family", "slice", "rows", "fraud_labels", zero(F.col("fraud_labels"), F.col("rows")).alias("fraud_prevalence"), "mean_score", "alert_count", "true_positives", "false_positives",
        (F.col("fraud_labels") - tp).alias("false_negatives"), zero(tp, F.col("alert_count")).alias("precision"), F.try_divide(tp, F.col("fraud_labels")).alias("recall_within_slice"),
    )


def exhaustive_gates(summary: DataFrame, rows: int, review: int, positives: int) -> DataFrame:
    """One row: every family covers all rows, alerts and positives."""
    per = summary.groupBy("family").agg(F.sum("rows").alias("r"), F.sum("alert_count").alias("a"), F.sum("fraud_labels").alias("p"))
    return per.agg(
        F.bool_and(F.col("a") == review).alias("selected_alert_count_matches_capacity"), F.bool_and(F.col("r") == rows).alias("slice_rows_are_exhaustive"),
        F.bool_and(F.col("a") == review).alias("slice_alerts_are_exhaustive"), F.bool_and(F.col("p") == positives).alias("slice_fraud_labels_are_exhaustive"),
    )
