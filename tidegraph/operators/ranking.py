"""Ranking evaluation under a review capacity; every input is ``(transaction_id, transaction_time, is_fraud, score)``.

Ranks are a total order: score descending, then time, then id. Functions return small driver-side
results computed by distributed aggregation; the rank itself is numbered by range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.ordering import global_running

CAPACITY = 0.05


def score_guard(scored: DataFrame) -> DataFrame:
    """One row: rows, positives, labels other than 0 and 1, scores that are not finite."""
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") < F.lit(float("inf"))), F.lit(False))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("is_fraud").cast("bigint")), F.lit(0)).alias("positives"),
        F.count_if(~F.coalesce(F.col("is_fraud").isin(0, 1), F.lit(False))).alias("bad_labels"), F.count_if(~finite).alias("bad_scores"),
    )


def check_scores(scored: DataFrame) -> tuple[int, int]:
    """(rows, positives); raises on an empty table, labels other than 0 and 1, or scores that are not finite."""
    r = score_guard(scored).first()
    if not r["rows"]:
        raise ValueError("no scored rows")
    if r["bad_labels"]:
        raise ValueError("labels must be 0 or 1")
    if r["bad_scores"]:
        raise ValueError("scores must be finite")
    return r["rows"], r["positives"]


def review_count(rows: int, fraction: float) -> int:
    """Rows that fit the capacity: at least one, rounded up."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return max(1, math.ceil(rows * fraction))


def ranked(scored: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 1) and ``positives_so_far``."""
    shaped = scored.withColumn("__label", F.col("is_fraud").cast("bigint"))
    order = [F.col("score").desc(), F.col("transaction_time").asc(), F.col("transaction_id").asc()]
    return global_running(shaped, order, position="rank", sums={"positives_so_far": "__label"}).drop("__label")


def _score_groups(scored: DataFrame) -> DataFrame:
    groups = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_fraud").cast("bigint")).alias("tp"))
    return global_running(groups, [F.col("score").desc()], sums={"cn": "n", "ctp": "tp"})


def cumulative_positives(scored: DataFrame) -> DataFrame:
    """True and false positives at or above each distinct score."""
    return _score_groups(scored).select("score", F.col("ctp").alias("true_positives"), (F.col("cn") - F.col("ctp")).alias("false_positives"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: non-interpolated average precision with equal scores grouped; 0 without positives."""
    precision = F.sum(F.col("tp") * F.col("ctp") / F.col("cn"))
    return _score_groups(scored).agg(F.coalesce(F.try_divide(precision, F.sum("tp")), F.lit(0.0)).alias("average_precision"))


def threshold_at_capacity(rank: DataFrame, rows: int, fraction: float = CAPACITY) -> float:
    """The score at the last place of the capacity."""
    return float(rank.filter(F.col("rank") == review_count(rows, fraction)).select("score").first()[0])


def top_fraction(rank: DataFrame, rows: int, positives: int, blocks: Sequence[tuple[str, float]]) -> DataFrame:
    """Per named fraction: alerts, true and false positives, precision, recall, false-positive rate."""
    parts = F.array(*(F.struct(F.lit(name).alias("block"), F.lit(float(f)).alias("fraction"), F.lit(review_count(rows, f)).alias("k")) for name, f in blocks))
    cut = rank.filter(F.col("rank") <= max(review_count(rows, f) for _, f in blocks)).select("rank", "is_fraud", F.inline(parts)).filter("rank <= k")
    agg = cut.groupBy("block", "fraction").agg(F.count(F.lit(1)).alias("alert_count"), F.sum(F.col("is_fraud").cast("bigint")).alias("true_positives"))
    fp = F.col("alert_count") - F.col("true_positives")
    return agg.select(
        "block", "fraction", "alert_count", "true_positives", fp.alias("false_positives"), (F.col("true_positives") / F.col("alert_count")).alias("precision"),
        (F.col("true_positives") / F.lit(positives) if positives else F.lit(0.0)).alias("recall"),
        (fp / F.lit(rows - positives) if rows > positives else F.lit(0.0)).alias("false_positive_rate"),
    )


def threshold_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row for all scores at or above the threshold, ties included; ratios with empty base are 0."""
    hit = F.col("score") >= threshold
    a, tp = F.count_if(hit), F.count_if(hit & (F.col("is_fraud") == 1))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return scored.agg(
        F.lit(float(threshold)).alias("threshold"), a.alias("alert_count"), ratio(a, F.count(F.lit(1))).alias("alert_fraction"), ratio(tp, a).alias("precision"),
        ratio(tp, F.count_if(F.col("is_fraud") == 1)).alias("recall"), ratio(a - tp, F.count_if(F.col("is_fraud") == 0)).alias("false_positive_rate"),
    )


def minimum_alerts(rank: DataFrame, rows: int, positives: int, recalls: Sequence[float]) -> DataFrame:
    """Per recall: the smallest top-k that reaches it (0 if no positive is needed)."""
    need = []
    for r in recalls:
        if not 0 <= r <= 1:
            raise ValueError("recall must be in [0, 1]")
        need.append((float(r), math.ceil(positives * r)))
    wanted = rank.sparkSession.createDataFrame(need, "target_recall double, need bigint")
    hits = rank.filter("is_fraud = 1").select(F.col("positives_so_far").alias("need"), "rank")
    return wanted.join(hits, "need", "left").select(
        "target_recall", F.coalesce("rank", F.lit(0)).cast("bigint").alias("alert_count"), (F.coalesce("rank", F.lit(0)) / F.lit(rows)).alias("alert_fraction")
    )


def tie_audit(rank: DataFrame, rows: int, fraction: float = CAPACITY) -> DataFrame:
    """One row on the scores at the capacity's edge."""
    k = review_count(rows, fraction)
    cutoff = threshold_at_capacity(rank, rows, fraction)
    above, at = F.count_if(F.col("score") > cutoff), F.count_if(F.col("score") == cutoff)
    return rank.agg(
        F.lit(cutoff).alias("cutoff_score"), above.alias("rows_above_cutoff"), at.alias("rows_at_cutoff"), (F.lit(k) - above).cast("bigint").alias("selected_from_cutoff_tie"),
        (at > F.lit(k) - above).alias("tie_break_required"),
    )


def evaluate(scored: DataFrame, *, capacity: float = CAPACITY) -> dict:
    """The evaluation bundle of one score column as plain values."""
    n, p = check_scores(scored)
    rank = ranked(scored)
    blocks = [("at_investigation_capacity", capacity), ("top_1_percent", 0.01), ("top_5_percent", 0.05)]
    rows = {r["block"]: r.asDict() for r in top_fraction(rank, n, p, blocks).collect()}
    return {"pr_auc": average_precision(scored).first()[0], **rows}


def concatenated_scores(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Scored validation and test rows as one table; refused if the columns differ or an id is in both."""
    if set(validation.columns) != set(test.columns):
        raise ValueError("scores of validation and test have different columns")
    if not validation.join(test.select("transaction_id"), "transaction_id", "left_semi").isEmpty():
        raise ValueError("a transaction is in validation and in test")
    return validation.unionByName(test)


def alert_reduction(baseline_alerts: int, alerts: int) -> float:
    """Share of the baseline's alerts saved at the same recall (0 without baseline alerts)."""
    return (baseline_alerts - alerts) / baseline_alerts if baseline_alerts else 0.0


def worst_cases(rank: DataFrame, rows: int, fraction: float = CAPACITY, limit: int = 5) -> DataFrame:
    """The highest-ranked false positives and missed positives, ``limit`` of each."""
    k = review_count(rows, fraction)
    kind = F.when((F.col("rank") <= k) & (F.col("is_fraud") == 0), "false_positive").when((F.col("rank") > k) & (F.col("is_fraud") == 1), "missed_fraud")
    w = Window.partitionBy("kind").orderBy("rank")
    return rank.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("case_no", F.row_number().over(w)).filter(F.col("case_no") <= limit)
