"""The four stages end to end on the 500-row seeded table."""

from __future__ import annotations

import pytest

from tidegraph.__main__ import parser
from tidegraph.plans import workflow
from tidegraph.schema import TARGET_NAMES
from tidegraph.sources.sinks import evidence_snapshot, read_json, read_text
from tidegraph.sources.synthetic import generate_synthetic


def test_stages(spark, tmp_path):
    folder = str(tmp_path / "run")
    made = workflow.prepare(generate_synthetic(spark, 500), folder)
    assert (made["row_count"], made["fraud_count"]) == (500, 49) and read_json(f"{folder}/manifest.json")["content_checksum"] == made["content_checksum"]
    audit = workflow.features(spark, folder)
    assert (audit["replay"]["batch_count"], audit["graph"]["edge_count"]) == (500, 3_500)
    assert audit["features"]["rows_not_finite"] == 0 and all(v for k, v in audit["integrity"].items() if isinstance(v, bool))
    metrics = workflow.evaluate(spark, folder, trees=5)
    models = metrics["models"]
    assert round(models["rules"]["test"]["pr_auc"], 4) == 0.2976 and round(models["graph_logistic"]["test"]["pr_auc"], 4) == 0.8935
    # The published counts of alerts at the rules' recall (37.5 %) and at the validation threshold.
    assert [models[m]["matched_recall"]["alert_count"] for m in ("rules", "tabular_logistic", "graph_logistic")] == [4, 5, 3]
    assert [models[m]["at_validation_threshold"]["alert_count"] for m in ("rules", "tabular_logistic", "graph_logistic")] == [8, 3, 3]
    assert all(metrics["slice_gates"].values()) and metrics["selected"] in models
    both = spark.read.parquet(f"{folder}/scores")
    assert both.count() == 84 + 84 and {"rules_score", "tabular_logistic_score", "graph_logistic_score", "graph_boosted_score"} <= set(both.columns)
    art = workflow.explain(spark, folder, trees=5)
    alerts = spark.read.parquet(f"{folder}/alerts")
    assert art["status"] == "PASS" and alerts.count() == art["review_count"] == 5 and read_json(f"{folder}/alerts.json")["disclaimer"] == art["disclaimer"]
    review = spark.read.parquet(f"{folder}/review")
    assert review.count() == 5 and not TARGET_NAMES & set(review.columns) and review.filter("matured_neighbor_fraud_ratio is null").isEmpty()
    assert "graph_logistic" in read_text(f"{folder}/evaluation.md") and art["disclaimer"] in read_text(f"{folder}/alerts.md")
    snapshot = evidence_snapshot(folder)
    assert snapshot["status"] == "PASS" and len(snapshot["documents"]) == 4
    assert evidence_snapshot(folder, ("absent.json",))["missing"] == ["absent.json"]
    views = spark.read.parquet(f"{folder}/connection_views")
    assert not TARGET_NAMES & set(views.columns) and views.groupBy("selected_transaction_id").count().agg({"count": "max"}).first()[0] <= 20
    assert spark.read.parquet(f"{folder}/connection_summaries").count() == 5
    with pytest.raises(ValueError):
        workflow.explain(spark, folder, model="rules")


def test_command_line():
    a = parser().parse_args(["prepare", "--output", "x", "--mode", "synthetic", "--max-rows", "5"])
    assert (a.stage, a.mode, a.max_rows, a.purge_seconds) == ("prepare", "synthetic", 5, 86_400)
