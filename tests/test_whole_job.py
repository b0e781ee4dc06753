"""The registered queries do the operators' whole job: the contract's settings, all rows, all families."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from helpers import canonical, random_rows

import __spark_entry__ as entry
from tidegraph.operators.asof import entity_edges
from tidegraph.operators.models import BoostedModel, LogisticModel
from tidegraph.operators.ordering import time_batches
from tidegraph.operators.projection import node_name, pagerank_snapshots
from tidegraph.plans import payment_queries, reference_queries
from tidegraph.schema import SPECIFIC_TYPES
from tidegraph.sources.canonical import canonical_payments

DATA = Path("/root/testdata/sf0.001")

needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@needs_data
def test_pagerank_query_refreshes_every_25_batches(spark):
    rows = canonical_payments(spark, str(DATA)).cache()
    batch = {r.transaction_id: r.batch_no for r in rows.join(time_batches(rows), "transaction_time").select("transaction_id", "batch_no").collect()}
    scores = {(r.snapshot_no, r.node): r.score for r in pagerank_snapshots(rows, refresh_batches=25).collect()}
    nodes: dict[str, list[str]] = {}
    for r in entity_edges(rows, SPECIFIC_TYPES, ["transaction_id"]).select("transaction_id", node_name("entity_type", "entity_value").alias("node")).collect():
        nodes.setdefault(r.transaction_id, []).append(r.node)
    got = entry.queries()["g10_pagerank_asof"](spark, str(DATA)).collect()
    assert {r.transaction_id for r in got} == set(batch) and len(got) == len(batch)
    for r in got:
        b = batch[r.transaction_id]
        s = [scores.get((b // 25, n), 0.0) for n in nodes.get(r.transaction_id, [])]
        assert r.pagerank_snapshot_age_batches == b % 25
        # The query rounds to nine decimals, so that its SQL gives the same values.
        assert r.specific_max_pagerank == pytest.approx(max(s, default=0.0), abs=6e-10)
        assert r.specific_mean_pagerank == pytest.approx(sum(s) / len(s) if s else 0.0, abs=6e-10)
    assert any(r.specific_max_pagerank > 0 for r in got if 25 <= batch[r.transaction_id] < 500)


@pytest.mark.parametrize("task_edges", [1, 1_000])
def test_asked_snapshots_are_those_of_all_nodes(spark, task_edges):
    df = canonical(spark, random_rows(np.random.default_rng(4), 40)).cache()
    scores = {(r.snapshot_no, r.node): r.score for r in pagerank_snapshots(df, refresh_batches=5).collect()}
    wanted = [*sorted(scores)[::3], (1, "card::unknown"), (0, "card::card0")]
    asked = spark.createDataFrame(wanted, "snapshot_no bigint, node string")
    got = {(r.snapshot_no, r.node): r.score for r in pagerank_snapshots(df, refresh_batches=5, task_edges=task_edges, asked=asked).collect()}
    assert got == pytest.approx({k: scores[k] for k in wanted if k in scores}, abs=1e-9)


class Fitted(Exception):
    pass


def settings_at_fit(spark, monkeypatch, model, query: str, *names: str) -> list:
    """The settings of ``model`` that a query fits with; nothing is fitted."""
    seen = []

    def fit(self, *_):
        seen.extend(getattr(self, n) for n in names)
        raise Fitted

    monkeypatch.setattr(model, "fit", fit)
    rows = spark.createDataFrame([], "split string")
    monkeypatch.setattr(reference_queries, "_modelled", lambda *_: rows)
    with pytest.raises(Fitted):
        entry.queries()[query](spark, "")
    return seen


@pytest.mark.parametrize("query", ["m9_boosted_scores", "m16_alert_reasons"])
def test_boosted_queries_search_all_prefixes_of_the_operator(spark, monkeypatch, query):
    assert settings_at_fit(spark, monkeypatch, BoostedModel, query, "max_trees") == [BoostedModel.max_trees]


@pytest.mark.parametrize(("query", "graph"), [("m7_logistic_scores", True), ("m13_linear_attribution", False), ("a12_global_importance", True)])
def test_logistic_queries_use_the_operators_bound_and_refuse_unconverged(spark, monkeypatch, query, graph):
    assert settings_at_fit(spark, monkeypatch, LogisticModel, query, "graph", "max_iterations", "tolerance") == [graph, 5_000, 1e-8]

    def stopped(self, _):
        self.converged, self.iterations = False, self.max_iterations
        return self

    monkeypatch.setattr(LogisticModel, "fit", stopped)
    with pytest.raises(RuntimeError, match="did not converge"):
        entry.queries()[query](spark, "")


@pytest.mark.parametrize("late", [2**24 - 1, 2**24 + 5, 2**31 + 5])
def test_label_history_beyond_194_days(spark, monkeypatch, late):
    facts = spark.createDataFrame([("c", 1, 50, 50, None)], "card string, report_id bigint, known_time bigint, valid_from bigint, valid_to bigint")
    events = lambda t: spark.createDataFrame([("a", 60, "c"), ("b", t, "c")], "transaction_id string, transaction_time bigint, card string")
    monkeypatch.setattr(payment_queries, "_p7_facts", lambda *_: (events(late), facts))
    got = {r.transaction_id: (r.known_frauds, r.last_known_time) for r in entry.queries()["p7_label_history"](spark, "").collect()}
    assert got == {"a": (1, 50), "b": (1, 50)}
