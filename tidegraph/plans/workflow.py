"""The stages of a run, handing over through written tables: prepare, features, evaluate, explain."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import ranking
from tidegraph.operators.asof import matured_labels
from tidegraph.operators.attach import attach_features
from tidegraph.operators.attribution import LinearAttributor, TreeAttributor, fidelity_audit, global_importance
from tidegraph.operators.link_graph import build_edges, graph_statistics, integrity_audit, replay_audit
from tidegraph.operators.models import BoostedModel, LogisticModel, select_model
from tidegraph.operators.quality import feature_audit, validate_transactions
from tidegraph.operators.reasons import ReasonBuilder
from tidegraph.operators.rules import RulesBaseline
from tidegraph.operators.slices import exhaustive_gates, slice_families, slice_summary
from tidegraph.operators.temporal_split import assign_splits
from tidegraph.operators.views import connection_summary, connection_view, require_target_free, review_bundle
from tidegraph.plans.pipeline import Settings, structural_features
from tidegraph.schema import STRUCTURAL_FEATURES
from tidegraph.sources import sinks


def prepare(source: DataFrame, folder: str, settings: Settings = Settings()) -> dict[str, Any]:
    """Validates, splits and writes the canonical table; returns (and writes) its manifest."""
    rows = assign_splits(
        validate_transactions(source), train_fraction=settings.train_fraction, validation_fraction=settings.validation_fraction, purge_seconds=settings.purge_seconds
    )
    manifest = sinks.write_prepared(rows, folder)
    sinks.write_json(manifest, f"{folder}/manifest.json")
    return manifest


def features(spark: SparkSession, folder: str, settings: Settings = Settings()) -> dict[str, Any]:
    """Writes structural features and matured labels of the prepared table, with graph and feature audits."""
    rows = spark.read.parquet(f"{folder}/transactions")
    edges = build_edges(rows)
    sinks.write_table(structural_features(rows, settings), f"{folder}/graph_features")
    sinks.write_table(matured_labels(rows, delay=settings.maturity_seconds), f"{folder}/label_history_features")
    written = spark.read.parquet(f"{folder}/graph_features")
    audit = {
        "graph": graph_statistics(rows, edges).first().asDict(), "integrity": integrity_audit(rows, edges).first().asDict(),
        "replay": replay_audit(rows).first().asDict(), "features": feature_audit(written, rows, STRUCTURAL_FEATURES).first().asDict(),
    }
    gates = [v for part in ("integrity",) for v in audit[part].values() if isinstance(v, bool)]
    clean = audit["features"]["rows_not_finite"] == audit["features"]["rows_negative"] == 0 and audit["features"]["equal_sets"]
    audit["status"] = "PASS" if all(gates) and clean else "FAIL"
    sinks.write_json(audit, f"{folder}/feature_audit.json")
    return audit


def _attached(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    rows = spark.read.parquet(f"{folder}/transactions")
    table = attach_features(rows, spark.read.parquet(f"{folder}/graph_features"), spark.read.parquet(f"{folder}/label_history_features"))
    return {s: table.filter(F.col("split") == s) for s in ("train", "validation", "test")}


def _models(parts: dict[str, DataFrame], settings: Settings, trees: int) -> dict[str, Any]:
    train = parts["train"]
    return {
        "tabular_logistic": LogisticModel(l2_strength=settings.l2_strength).fit(train),
        "graph_logistic": LogisticModel(graph=True, l2_strength=settings.l2_strength).fit(train),
        "graph_boosted": BoostedModel(max_trees=trees, seed=settings.seed).fit(train, parts["validation"]),
    }


def evaluate(spark: SparkSession, folder: str, settings: Settings = Settings(), *, trees: int = BoostedModel.max_trees) -> dict[str, Any]:
    """Fits on train, chooses on validation, reports on test; writes ``metrics.json`` and the test scores.

    Thresholds come from validation at capacity. Each model is also compared with the rules at the
    recall the rules reach at capacity.
    """
    parts = _attached(spark, folder)
    rules = RulesBaseline().fit(parts["train"])
    models = _models(parts, settings, trees)
    scorers = {"rules": rules.rate, **{n: m.score for n, m in models.items()}}
    out: dict[str, Any] = {"models": {}}
    scored, listed = {}, None
    for name, score in scorers.items():
        validation, test = score(parts["validation"]), score(parts["test"])
        n_validation, _ = ranking.check_scores(validation)
        threshold = ranking.threshold_at_capacity(ranking.ranked(validation), n_validation, settings.capacity)
        scored[name] = test
        both = ranking.concatenated_scores(validation, test).select("transaction_id", "transaction_time", "split", "is_fraud", F.col("score").alias(f"{name}_score"))
        listed = both if listed is None else listed.join(both.select("transaction_id", f"{name}_score"), "transaction_id")
        out["models"][name] = {
            "validation_pr_auc": ranking.average_precision(validation).first()[0], "test": ranking.evaluate(test, capacity=settings.capacity),
            "at_validation_threshold": ranking.threshold_metrics(test, threshold).first().asDict(),
        }
    matched = out["models"]["rules"]["test"]["at_investigation_capacity"]["recall"]
    for name, test in scored.items():
        n, p = ranking.check_scores(test)
        found = ranking.minimum_alerts(ranking.ranked(test), n, p, [matched]).first().asDict()
        out["models"][name]["matched_recall"] = found
    base = out["models"]["rules"]["matched_recall"]["alert_count"]
    for m in out["models"].values():
        m["alert_reduction"] = ranking.alert_reduction(base, m["matched_recall"]["alert_count"])
    out["selected"] = select_model({n: out["models"][n]["validation_pr_auc"] for n in ("graph_logistic", "graph_boosted")})
    test = scored[out["selected"]]
    rank = ranking.ranked(test)
    n, p = ranking.check_scores(test)
    k = ranking.review_count(n, settings.capacity)
    slices = slice_summary(rank, slice_families(parts["train"]), k)
    out["slices"] = [r.asDict() for r in slices.collect()]
    out["slice_gates"] = exhaustive_gates(slices, n, k, p).first().asDict()
    shown = ["kind", "transaction_id", "amount", "product_code", "specific_shared_transaction_count", "matured_neighbor_fraud_ratio", "score"]
    out["worst_cases"] = [r.asDict() for r in ranking.worst_cases(rank, n, settings.capacity).select(*shown).collect()]
    sinks.write_table(rank.select("transaction_id", "transaction_time", "score", "rank"), f"{folder}/test_scores")
    sinks.write_table(listed, f"{folder}/scores")
    sinks.write_json(out, f"{folder}/metrics.json")
    sinks.write_text(sinks.evaluation_report(out), f"{folder}/evaluation.md")
    return out


def explain(spark: SparkSession, folder: str, settings: Settings = Settings(), *, model: str = "graph_boosted", trees: int = BoostedModel.max_trees) -> dict[str, Any]:
    """Alerts with reasons, importance and target-free local views of the test rows; writes ``alerts.json``."""
    parts = _attached(spark, folder)
    train, test = parts["train"], parts["test"]
    if model == "graph_boosted":
        fitted = BoostedModel(max_trees=trees, seed=settings.seed).fit(train, parts["validation"])
        explained = TreeAttributor().fit(fitted, train).explain(test)
    elif model == "graph_logistic":
        fitted = LogisticModel(graph=True, l2_strength=settings.l2_strength).fit(train)
        explained = LinearAttributor().fit(fitted, train).explain(test)
    else:
        raise ValueError("model is graph_boosted or graph_logistic")
    sinks.write_table(explained.drop("is_fraud"), f"{folder}/explained")
    explained = spark.read.parquet(f"{folder}/explained")
    audit = fidelity_audit(explained).first().asDict()
    if audit["status"] != "PASS":
        raise RuntimeError(f"attributions do not add up: {audit}")
    names = fitted.encoder.names
    summary, alerts = ReasonBuilder().fit(train).artifact(explained, names, model=model, capacity=settings.capacity, max_reasons=settings.max_reasons)
    sinks.write_table(alerts, f"{folder}/alerts")
    alerts = spark.read.parquet(f"{folder}/alerts")
    art = summary.first().asDict(recursive=True) | {"fidelity": audit, "importance": [r.asDict() for r in global_importance(explained, names).collect()]}
    sinks.write_json(art, f"{folder}/alerts.json")
    sinks.write_text(sinks.alert_report(art, alerts), f"{folder}/alerts.md")
    safe = spark.read.parquet(f"{folder}/transactions").drop("is_fraud")
    require_target_free(safe)
    chosen = alerts.select("transaction_id")
    sinks.write_table(connection_view(safe, chosen), f"{folder}/connection_views")
    sinks.write_table(connection_summary(safe, chosen), f"{folder}/connection_summaries")
    structural, labels = (spark.read.parquet(f"{folder}/{t}") for t in ("graph_features", "label_history_features"))
    columns = ("specific_shared_transaction_count", "specific_max_component_transactions", "specific_max_entity_degree")
    sinks.write_table(review_bundle(alerts, safe, {"graph": (structural, columns), "labels": (labels, ("matured_neighbor_fraud_ratio",))}, art["review_count"]), f"{folder}/review")
    return art
