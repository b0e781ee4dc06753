"""Encoders, models, attributions and reasons on the 500-row seeded table, with the published figures."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from helpers import canonical
from pyspark.sql import functions as F

from tidegraph.operators.attribution import LinearAttributor, TreeAttributor, all_patterns, fidelity_audit, global_importance, leaf_paths
from tidegraph.operators.encode import CombinedEncoder, GraphEncoder, TabularEncoder, audit_feature_names, long_form
from tidegraph.operators.boosting import binned, grow
from tidegraph.operators.models import BoostedModel, LogisticModel, Tree, balanced, select_model
from tidegraph.operators.ranking import average_precision, evaluate, review_count
from tidegraph.operators.reasons import THRESHOLDS, ReasonBuilder, reason_counts
from tidegraph.operators.rules import RulesBaseline
from tidegraph.operators.temporal_split import assign_splits
from tidegraph.operators.views import review_bundle
from tidegraph.plans.pipeline import builder_audit, model_table
from tidegraph.session import Scratch
from tidegraph.sources.synthetic import generate_synthetic


@pytest.fixture(scope="module")
def table(spark):
    return model_table(assign_splits(generate_synthetic(spark, 500))).cache()


@pytest.fixture(scope="module")
def parts(table):
    return {s: table.filter(F.col("split") == s).cache() for s in ("train", "validation", "test")}


@pytest.fixture(scope="module")
def boosted(parts):
    return BoostedModel(max_trees=6, depth=3).fit(parts["train"], parts["validation"])


def ap(df):
    return round(average_precision(df).first()[0], 4)


def test_published_figures(table, parts):
    late = table.filter("split in ('validation', 'test')").groupBy("is_fraud").agg(
        *(F.round(F.avg(c), 3).alias(c) for c in ("specific_shared_transaction_count", "specific_max_entity_degree", "specific_max_component_transactions"))
    )
    rows = {r.is_fraud: tuple(r)[1:] for r in late.collect()}
    assert rows == {0: (18.434, 8.559, 380.072), 1: (25.938, 24.75, 70.438)}
    rules = RulesBaseline().fit(parts["train"])
    assert ap(rules.rate(parts["test"])) == 0.2976
    tabular = LogisticModel().fit(parts["train"])
    assert ap(tabular.score(parts["test"])) == 0.4989
    graph = LogisticModel(graph=True).fit(parts["train"])
    assert len(graph.encoder.names) == 48 and len(tabular.encoder.names) == 20 and graph.converged
    assert (ap(graph.score(parts["validation"])), ap(graph.score(parts["test"]))) == (0.925, 0.8935)
    bundle = evaluate(graph.score(parts["test"]))
    assert (bundle["at_investigation_capacity"]["alert_count"], bundle["at_investigation_capacity"]["true_positives"]) == (5, 5)
    assert builder_audit(table).first().pagerank_refresh_count == 20


def test_encoders(parts):
    e = CombinedEncoder().fit(parts["train"])
    dense = np.array([r[0] for r in parts["train"].select(e.dense()).collect()])
    assert dense.shape == (300, 48)
    assert dense[:, 0].mean() == pytest.approx(0, abs=1e-9) and dense[:, 0].std() == pytest.approx(1)
    vectors = np.array([r.x.toArray() for r in e.vectors(parts["train"], ["transaction_id"]).collect()])
    picked = np.array([list(r) for r in parts["train"].select(*(c.alias(str(i)) for i, c in enumerate(e.pick([5, 9, 40])))).collect()])
    assert np.allclose(vectors, dense) and np.allclose(picked, dense[:, [5, 9, 40]])
    w = np.arange(48.0)
    linear = np.array([r[0] for r in parts["train"].select(e.linear(w)).collect()])
    assert np.allclose(linear, dense @ w)
    assert long_form(parts["train"], e).count() == np.count_nonzero(dense)
    unseen = parts["train"].limit(1).withColumn("product_code", F.lit("?")).withColumn("payer_email_domain", F.lit(None).cast("string"))
    t = TabularEncoder().fit(parts["train"])
    values = dict(zip(t.names, unseen.select(t.dense()).first()[0], strict=True))
    assert values["has_payer_email_domain"] == 0.0 and sum(v for k, v in values.items() if k.startswith("product_code=")) == 0
    for bad in (["label"], ["card_id"]):
        with pytest.raises(ValueError):
            audit_feature_names(bad)
    with pytest.raises(ValueError):
        GraphEncoder().fit(parts["train"].withColumn("specific_max_pagerank", F.lit(-1.0)))


def test_logistic_refuses(parts, spark):
    with pytest.raises(ValueError):
        LogisticModel(l2_strength=0).fit(parts["train"])
    with pytest.raises(ValueError):
        LogisticModel().fit(parts["train"].filter("is_fraud = 0"))
    with pytest.raises(RuntimeError):
        LogisticModel().score(parts["train"])
    model = LogisticModel().fit(parts["train"])
    assert 0 < model.training_loss < 1 and len(model.strongest(3)) == 3


def test_boosted(parts, boosted):
    again = BoostedModel(max_trees=6, depth=3).fit(parts["train"], parts["validation"])
    a, b = (sorted((r.transaction_id, r.score) for r in m.score(parts["test"]).collect()) for m in (boosted, again))
    assert a == b and all(0 <= s <= 1 for _, s in a) and 1 <= boosted.kept <= 6
    assert ap(boosted.score(parts["validation"])) == pytest.approx(boosted.validation_precision, abs=1e-4)
    assert ap(boosted.score(parts["test"])) > 0.5
    assert sum(v for _, v in boosted.strongest(48)) == pytest.approx(1)
    assert select_model({"b": 0.9, "a": 0.9}) == "a"
    with pytest.raises(ValueError):
        select_model({"a": 0.9, "b": 0.1}, "b")


def test_boosting_does_not_grow_a_stage_again(parts):
    """Later stages keep the trees there are, a tree is no Spark job, and its first split is the best of all bins."""
    model, jobs = BoostedModel(max_trees=12, depth=2, patience=2, step=0.2, column_share=1.0), parts["train"].sparkSession.sparkContext.statusTracker()
    model.fit(parts["train"], parts["validation"])
    few, rows = list(model.grown[:4]), parts["train"].count()
    assert len(model.grown) in (4, 8, 12)
    trees = parts["train"].sparkSession
    trees.sparkContext.setJobGroup("grow", "grow")
    table = Scratch(trees, "grow").table(binned(balanced(parts["train"]), model.encoder, model.bins), "binned")
    more = grow(table, model.bins, few, 30, model.label_weights, step=0.2, depth=2, min_leaf=15, column_share=1.0, seed=42)
    trees.sparkContext._jsc.sc().clearJobGroup()
    assert more[:4] == few and len(more) == 30 and len(jobs.getJobIdsForGroup("grow")) < 10
    picked = balanced(parts["train"]).select(F.array(*model.encoder.pick(range(len(model.encoder.names)))).alias("x"), "label", "weight").toPandas()
    x, y, w = np.stack(picked["x"]), 2 * picked["label"].to_numpy() - 1, picked["weight"].to_numpy()
    fall = lambda left: sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left)) - (w * y).sum() ** 2 / w.sum()
    masks = [x[:, f] <= t for f, t in ((int(f), t) for f, ts in zip(model.bins.number_features, model.bins.thresholds, strict=True) for t in ts)]
    best = max(fall(m) for m in masks if 15 <= m.sum() <= rows - 15)
    tree = few[0]
    assert fall(x[:, tree.feature[0]] <= tree.threshold[0]) >= best * (1 - 1e-6)


def test_boosting_stages_are_one_search(parts):
    """Trees grown in doubling stages keep the prefix that all trees at once give."""
    settings = dict(max_trees=24, depth=2, patience=3, step=0.2)
    staged = BoostedModel(**settings).fit(parts["train"], parts["validation"])
    whole = BoostedModel(**settings)
    grow = BoostedModel._grow
    whole._grow = lambda rows, _: grow(whole, rows, 24)
    whole.fit(parts["train"], parts["validation"])
    assert len(staged.trees) < 24 == len(whole.trees) or staged.kept + 3 > 12
    assert (staged.kept, staged.validation_precision) == (whole.kept, pytest.approx(whole.validation_precision))
    assert BoostedModel().max_trees == 400 and BoostedModel().step == 0.03 and BoostedModel().patience == 40


def test_logistic_optimum(parts):
    model = LogisticModel().fit(parts["train"])
    assert model.slope(parts["train"]) < 1e-5
    model.coefficients = model.coefficients + 0.1
    assert model.slope(parts["train"]) > 1e-3


def brute_shapley(f, x, background):
    m = len(x)
    value = lambda s: np.mean([f(np.where([i in s for i in range(m)], x, z)[None])[0] for z in background])
    out = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for s in combinations(others, k):
                out[i] += factorial(k) * factorial(m - k - 1) / factorial(m) * (value({*s, i}) - value(set(s)))
    return out


def test_tree_attribution_is_shapley():
    from tidegraph.operators.attribution import pattern_table

    tree = Tree(np.array([0, 1, 0, -1, -1, -1, -1]), np.array([0.5, 0.3, 0.8, 0, 0, 0, 0]), np.array([1, 3, 5, 0, 0, 0, 0]), np.array([2, 4, 6, 0, 0, 0, 0]), np.array([0, 0, 0, 1.0, -2.0, 3.0, 0.5]), 0.7)
    rng = np.random.default_rng(0)
    background, rows = rng.random((40, 3)), rng.random((10, 3))
    phi = np.zeros((10, 3))
    for p in leaf_paths(tree):
        t = pattern_table(p, np.bincount(p.patterns(background), minlength=1 << len(p.features)).astype(float))
        phi[:, p.features] += t[p.patterns(rows)]
    for x, got in zip(rows, phi, strict=True):
        assert got == pytest.approx(brute_shapley(tree.predict, x, background))


def test_attribution_and_reasons(spark, parts, boosted):
    explained = TreeAttributor().fit(boosted, parts["train"]).explain(parts["test"]).cache()
    audit = fidelity_audit(explained).first()
    assert audit.status == "PASS" and audit.explained_rows == 84
    linear = LogisticModel(graph=True).fit(parts["train"])
    assert fidelity_audit(LinearAttributor().fit(linear, parts["train"]).explain(parts["test"])).first().status == "PASS"
    top = global_importance(explained, boosted.encoder.names, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance >= 0
    builder = ReasonBuilder().fit(parts["train"])
    summary, alerts = builder.artifact(explained, boosted.encoder.names)
    art = summary.first()
    assert art.status == "PASS" and art.review_count == review_count(84, 0.05) == 5 and len(art.gates) == 7 and all(art.gates.values())
    assert alerts.count() == 5 and art.capacity_tie_audit.tie_break_rule and art.disclaimer and set(art.thresholds) == set(THRESHOLDS)
    for a in alerts.collect():
        gained = [r["contribution"] for r in a["reasons"]]
        assert 1 <= len(gained) <= 3 and gained == sorted(gained, reverse=True) and all(r["detail"] and r["title"] for r in a["reasons"])
    assert dict(reason_counts(alerts).collect()) == art.reason_code_counts
    twice = builder.artifact(explained.unionByName(explained), boosted.encoder.names)[0].first()
    assert twice.status == "FAIL" and not twice.gates["transaction_ids_unique"]
    features = {"graph": (parts["test"], ["specific_max_entity_degree"])}
    bundle = review_bundle(alerts, parts["test"].select("transaction_id", "amount", "is_fraud"), features, 5)
    assert "is_fraud" not in bundle.columns and bundle.count() == 5
    with pytest.raises(ValueError):
        review_bundle(alerts.withColumn("recommended_action", F.lit("BLOCK")), parts["test"].select("transaction_id", "amount"), features, 5)
    with pytest.raises(ValueError):
        review_bundle(alerts, parts["test"].select("transaction_id", "amount"), features, 6)


def test_short_attributions_are_those_of_the_features_read(parts, boosted):
    """One number per feature that trees read, however many categories there are; the same sums, alerts and reasons as in full."""
    attributor = TreeAttributor().fit(boosted, parts["train"])
    full, short = attributor.explain(parts["test"]).cache(), attributor.explain(parts["test"], short=True).cache()
    names = boosted.used_names()
    assert 0 < len(names) < len(boosted.encoder.names)
    a, b = ({r.transaction_id: np.array(r.phi) for r in x.select("transaction_id", "phi").collect()} for x in (full, short))
    at = [boosted.encoder.names.index(n) for n in names]
    assert all(len(b[i]) == len(names) and np.array_equal(a[i][at], b[i]) and np.count_nonzero(a[i]) == np.count_nonzero(b[i]) for i in a)
    assert fidelity_audit(short).first().status == "PASS"
    builder = ReasonBuilder().fit(parts["train"])
    assert sorted(builder.alerts(short, names).collect()) == sorted(builder.alerts(full, boosted.encoder.names).collect())


def test_patterns_at_once():
    rng = np.random.default_rng(1)
    x = np.round(rng.random((300, 4)), 1)
    x[0, 0] = np.nan
    tree = Tree(np.array([0, 1, 0, -1, -1, -1, -1]), np.array([0.5, 0.3, 0.8, 0, 0, 0, 0]), np.array([1, 3, 5, 0, 0, 0, 0]), np.array([2, 4, 6, 0, 0, 0, 0]), np.arange(7.0), 1.0)
    paths = leaf_paths(tree)
    for p, found in zip(paths, all_patterns(paths, x), strict=True):
        assert np.array_equal(found, p.patterns(x))


def test_reason_gate_and_fallback(spark, parts):
    builder = ReasonBuilder().fit(parts["train"])
    names = ["log1p_standardized_matured_neighbor_fraud_count", "log1p_standardized_specific_max_clustering", "has_card"]
    base = parts["test"].limit(1).withColumn("score", F.lit(0.5))
    phi = lambda *v: F.array(*map(F.lit, map(float, v)))
    no_fraud = base.withColumn("matured_neighbor_fraud_count", F.lit(0)).withColumn("specific_max_clustering", F.lit(-1.0))
    codes = lambda df: [r["code"] for r in df.select(builder.reasons(names).alias("r")).first()["r"]]
    assert codes(no_fraud.withColumn("phi", phi(5, 5, 1))) == ["TRANSACTION_ATTRIBUTE_PATTERN"]
    assert codes(no_fraud.withColumn("phi", phi(5, 5, -1))) == ["COMBINED_MODEL_SIGNAL"]
    assert codes(no_fraud.withColumn("matured_neighbor_fraud_count", F.lit(2)).withColumn("phi", phi(5, 5, 1))) == ["MATURED_FRAUD_NEIGHBOUR", "TRANSACTION_ATTRIBUTE_PATTERN"]


def test_empty_rows_can_be_scored(spark, parts, boosted):
    none = parts["test"].limit(0)
    assert boosted.score(none).count() == 0
    assert canonical(spark, []).count() == 0


def test_logistic_fit_takes_few_passes_to_the_optimum_of_the_other_fit(parts):
    model = LogisticModel(graph=True).fit(parts["train"])
    assert model.converged and model.iterations <= 30
    assert model.slope(parts["train"]) < 1e-8
    other = LogisticModel(graph=True)
    other.encoder = model.encoder
    weights, intercept, _ = other._quasi_newton(balanced(parts["train"]))
    np.testing.assert_allclose(np.r_[model.coefficients, model.intercept], np.r_[weights, intercept], atol=2e-2)
