"""Queries of the causal-feature, audit, ranking and explanation operators over the canonical payments."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.normal import normal_form
from tidegraph.operators import ranking
from tidegraph.operators.asof import degree_features, matured_labels, shared_transactions
from tidegraph.operators.attach import align_scores, one_to_one_left
from tidegraph.operators.attribution import FIDELITY, LinearAttributor, TreeAttributor, fidelity_audit, global_importance
from tidegraph.operators.components import component_features
from tidegraph.operators.encode import GraphEncoder, TabularEncoder, long_form
from tidegraph.operators.link_graph import build_edges, graph_statistics, integrity_audit, node_components, replay_audit, serialised_edges, serialised_nodes, type_counts
from tidegraph.operators.models import BoostedModel, LogisticModel, select_model
from tidegraph.operators.ordering import global_running, time_batches
from tidegraph.operators.projection import clustering_features, pagerank_features, projection_edges
from tidegraph.operators.quality import entity_profile, feature_audit, id_set_difference, quality_profile, split_profile, times_non_decreasing, value_counts, violations
from tidegraph.operators.reasons import ACTION, ReasonBuilder
from tidegraph.operators.rules import RulesBaseline
from tidegraph.operators.slices import column_quantiles, exhaustive_gates, slice_families, slice_summary
from tidegraph.operators.temporal_split import assign_splits
from tidegraph.operators.views import alerts_with_reason, connection_summary, connection_view, masked_entities, review_bundle
from tidegraph.plans import reference_sql as sql
from tidegraph.plans.pipeline import Settings, builder_audit, model_table
from tidegraph.schema import CANONICAL_COLUMNS, ENTITY_TYPES, LABEL_FEATURES, MODEL_GRAPH_FEATURES, SPECIFIC_TYPES, SPLITS, STRUCTURAL_FEATURES
from tidegraph.session import Scratch, fingerprint, path_exists, shared_table
from tidegraph.sources.canonical import canonical_payments
from tidegraph.sources.sinks import manifest
from tidegraph.sources.tables import current_transactions, table
from tidegraph.sources.two_file import entity_key
from tidegraph.streaming.degrees import stream_activity


def _shared(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame], *more: str) -> DataFrame:
    """A table made from a folder's input tables, written once a session for all queries."""
    return shared_table(spark, name, [f"{d}/{t}.parquet" for t in ("transactions", *more)], build)


def _pay(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d, "pay", lambda: canonical_payments(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d, "split", lambda: assign_splits(_pay(spark, d)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- validation, split, profile -------------------------------------------------------------------


def v1_validation(spark: SparkSession, d: str) -> DataFrame:
    cur = current_transactions(spark, d, CANONICAL_COLUMNS)
    return violations(cur.withColumns({c: normal_form(c) for c in ENTITY_TYPES}))


def v2_quality_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality_profile(_split(spark, d))


def w2_temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("transaction_id", "transaction_time", "split")


def w3_batch_number(spark: SparkSession, d: str) -> DataFrame:
    pay = _pay(spark, d)
    return pay.join(time_batches(pay), "transaction_time").select("transaction_id", "batch_no")


def t1_causal_order(spark: SparkSession, d: str) -> DataFrame:
    return global_running(_pay(spark, d).select("transaction_id", "transaction_time"), [F.col("transaction_time"), F.col("transaction_id")]).select("transaction_id", "position")


def a1_split_profile(spark: SparkSession, d: str) -> DataFrame:
    return split_profile(_split(spark, d))


def a2_entity_profile(spark: SparkSession, d: str) -> DataFrame:
    return entity_profile(_pay(spark, d))


def a3_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return value_counts(_pay(spark, d), "product_code")


def a4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the amount per split; a split without rows has none."""
    rows, shares = _split(spark, d), {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = column_quantiles(rows.select(*(F.when(F.col("split") == s, F.col("amount")).alias(s) for s in SPLITS)), {s: tuple(shares.values()) for s in SPLITS})
    listed = [(s, *(round(x, 6) for x in v)) for s, v in found.items() if v[0] is not None]
    return spark.createDataFrame(listed, "split string, " + ", ".join(f"{n} double" for n in shares))


def a5_moments(spark: SparkSession, d: str) -> DataFrame:
    logs = F.log1p("amount")
    s = F.stddev_pop(logs)
    return _split(spark, d).groupBy("split").agg(F.round(F.avg(logs), 6).alias("mean_log"), F.round(F.when(s > 0, s).otherwise(1.0), 6).alias("scale_log"))


def s6_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest(_split(spark, d))


def v8_replay_audit(spark: SparkSession, d: str) -> DataFrame:
    return replay_audit(_pay(spark, d))


def u2_id_sets(spark: SparkSession, d: str) -> DataFrame:
    return id_set_difference(table(spark, d, "graph_features").select("transaction_id").distinct(), _pay(spark, d))


# --- graph ----------------------------------------------------------------------------------------


def g1_edges(spark: SparkSession, d: str) -> DataFrame:
    return build_edges(_pay(spark, d))


def a8_type_counts(spark: SparkSession, d: str) -> DataFrame:
    pay = _pay(spark, d)
    return type_counts(pay, build_edges(pay))


def a9_graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    pay = _pay(spark, d)
    return graph_statistics(pay, build_edges(pay, SPECIFIC_TYPES, allow_entityless=True))


def v7_integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    pay = _pay(spark, d)
    return integrity_audit(pay, build_edges(pay))


def s9_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return serialised_edges(build_edges(_pay(spark, d)))


def s9_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    pay = _pay(spark, d)
    return serialised_nodes(pay, build_edges(pay))


def g2_degree_asof(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(degree_features(_pay(spark, d)), "graph_mean_entity_degree", "specific_mean_entity_degree")


def g4_projection(spark: SparkSession, d: str) -> DataFrame:
    return projection_edges(_pay(spark, d))


def g6_components_asof(spark: SparkSession, d: str) -> DataFrame:
    return component_features(_pay(spark, d))


def g7_shared_specific(spark: SparkSession, d: str) -> DataFrame:
    return shared_transactions(_pay(spark, d))


def g7_shared_all(spark: SparkSession, d: str) -> DataFrame:
    return shared_transactions(_pay(spark, d), ENTITY_TYPES, "graph_shared_transaction_count")


def g8_matured_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(matured_labels(_split(spark, d)), "matured_neighbor_fraud_ratio")


def g9_clustering_asof(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(clustering_features(_pay(spark, d)), "specific_max_clustering", "specific_mean_clustering")


def g10_pagerank_asof(spark: SparkSession, d: str) -> DataFrame:
    ranks = pagerank_features(_pay(spark, d), refresh_batches=Settings().refresh_batches)
    return ranks.withColumns({c: F.round(c, 9) for c in ("specific_max_pagerank", "specific_mean_pagerank")})


def g11_builder_audit(spark: SparkSession, d: str) -> DataFrame:
    return builder_audit(_pay(spark, d))


def _attached(spark: SparkSession, d: str) -> DataFrame:
    """Split rows with all 26 structural and 3 label features computed and attached."""
    return _shared(spark, d, "attached", lambda: model_table(_split(spark, d)))


def j2_attached(spark: SparkSession, d: str) -> DataFrame:
    """The full causal feature table."""
    ratios = [c for c, t in _attached(spark, d).select(*STRUCTURAL_FEATURES, *LABEL_FEATURES).dtypes if t == "double"]
    return _rounded(_attached(spark, d).select("transaction_id", "transaction_time", *STRUCTURAL_FEATURES, *LABEL_FEATURES), *ratios)


def a6_split_feature_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the published features per split, over the features as delivered."""
    published = (
        "graph_shared_transaction_count", "specific_shared_transaction_count", "specific_max_entity_degree", "specific_max_component_transactions",
        "specific_max_pagerank", "specific_max_clustering",
    )
    return _modelled(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *(F.round(F.avg(c), 6).alias(c) for c in published))


def a7_label_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Means of three features per label on validation and test rows."""
    late = _modelled(spark, d).filter(F.col("split").isin("validation", "test"))
    published = ("specific_shared_transaction_count", "specific_max_entity_degree", "specific_max_component_transactions")
    return late.groupBy(F.col("is_fraud").cast("int").alias("is_fraud")).agg(F.count(F.lit(1)).alias("rows"), *(F.round(F.avg(c), 6).alias(c) for c in published))


# --- rules score and ranking ----------------------------------------------------------------------


def _rated(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d)
    return _shared(spark, d, "rated", lambda: RulesBaseline().fit(rows.filter("split = 'train'")).rate(rows))


def _test(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int, int]:
    scored = _rated(spark, d).filter("split = 'test'")
    n, p = ranking.check_scores(scored)
    return scored, _shared(spark, d, "ranked", lambda: ranking.ranked(scored)), n, p


def m2_rule_score(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).select("transaction_id", "score", "reasons")


def m4_tabular_long(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d)
    return _rounded(long_form(rows, TabularEncoder().fit(rows.filter("split = 'train'"))), "value")


def w6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _test(spark, d)[1].select("transaction_id", "score", "rank")


def t4_threshold(spark: SparkSession, d: str) -> DataFrame:
    _, rank, n, _ = _test(spark, d)
    return rank.filter(F.col("rank") == ranking.review_count(n, 0.05)).select(F.col("score").alias("threshold"))


def t5_tie_audit(spark: SparkSession, d: str) -> DataFrame:
    _, rank, n, _ = _test(spark, d)
    return ranking.tie_audit(rank, n)


def t6_worst_cases(spark: SparkSession, d: str) -> DataFrame:
    _, rank, n, _ = _test(spark, d)
    return ranking.worst_cases(rank, n).select("kind", "transaction_id", "amount", "score", F.col("case_no").cast("bigint").alias("case_no"))


def e2_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.average_precision(_test(spark, d)[0]), "average_precision")


def e3_top_fractions(spark: SparkSession, d: str) -> DataFrame:
    _, rank, n, p = _test(spark, d)
    blocks = [("at_investigation_capacity", 0.05), ("top_1_percent", 0.01), ("top_5_percent", 0.05)]
    return _rounded(ranking.top_fraction(rank, n, p, blocks), "precision", "recall", "false_positive_rate")


def e4_threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    scored, rank, n, _ = _test(spark, d)
    return _rounded(ranking.threshold_metrics(scored, ranking.threshold_at_capacity(rank, n)), "alert_fraction", "precision", "recall", "false_positive_rate")


def e5_min_alerts(spark: SparkSession, d: str) -> DataFrame:
    _, rank, n, p = _test(spark, d)
    return _rounded(ranking.minimum_alerts(rank, n, p, [0.25, 0.375, 0.5]), "alert_fraction")


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, int, int, int]:
    _, rank, n, p = _test(spark, d)
    rows = _modelled(spark, d)
    extra = rows.select("transaction_id", "specific_shared_transaction_count", "specific_known_entity_count", "matured_neighbor_label_count", "matured_neighbor_fraud_count")
    k = ranking.review_count(n, 0.05)
    return slice_summary(rank.join(extra, "transaction_id"), slice_families(rows.filter("split = 'train'")), k), n, k, p


def a11_error_slices(spark: SparkSession, d: str) -> DataFrame:
    """All five families, empty slices kept."""
    return _rounded(_slices(spark, d)[0], "fraud_prevalence", "mean_score", "precision", "recall_within_slice")


def a11_slice_gates(spark: SparkSession, d: str) -> DataFrame:
    return exhaustive_gates(*_slices(spark, d))


def u1_scored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Validation and test rows with their rule scores, one below the other."""
    rated = _rated(spark, d).select("transaction_id", "transaction_time", "split", "is_fraud", "score", "reasons")
    return ranking.concatenated_scores(rated.filter("split = 'validation'"), rated.filter("split = 'test'"))


# --- views ----------------------------------------------------------------------------------------


def _alerts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, rank, n, _ = _test(spark, d)
    top = rank.filter(F.col("rank") <= ranking.review_count(n, 0.05)).select("transaction_id")
    return _pay(spark, d).drop("is_fraud"), Scratch(spark, "alerts").table(top, "alerts")


def g12_connection_view(spark: SparkSession, d: str) -> DataFrame:
    view = connection_view(*_alerts(spark, d))
    return view.withColumn("neighbour_rank", F.col("neighbour_rank").cast("bigint"))


def g12_connection_summary(spark: SparkSession, d: str) -> DataFrame:
    return connection_summary(*_alerts(spark, d))


def g13_masked_entities(spark: SparkSession, d: str) -> DataFrame:
    return masked_entities(*_alerts(spark, d))


def j4_review_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the rules with transaction and feature columns: checked joins, no target at any depth."""
    _, rank, n, _ = _test(spark, d)
    k = ranking.review_count(n, 0.05)
    top = rank.filter(F.col("rank") <= k)
    alerts = top.select("transaction_id", "rank", (F.col("score") / 4).alias("risk_score"), F.lit(ACTION).alias("recommended_action"), F.split("reasons", ";").alias("reasons"))
    rows = _modelled(spark, d)
    columns = ("specific_shared_transaction_count", "specific_max_component_transactions", "specific_max_entity_degree")
    features = {"graph": (rows, columns), "labels": (rows, ("matured_neighbor_fraud_ratio",))}
    bundle = review_bundle(Scratch(spark, "j4").table(alerts, "alerts"), rows.select("transaction_id", "transaction_time", "amount", "product_code", "is_fraud"), features, k)
    ratio = F.round("matured_neighbor_fraud_ratio", 6).alias("matured_neighbor_fraud_ratio")
    return bundle.select("transaction_id", "rank", "risk_score", "recommended_action", F.array_join("reasons", ",").alias("reason_codes"), "transaction_time", "amount", "product_code", *columns, ratio)


def rc_alerts_with_code(spark: SparkSession, d: str) -> DataFrame:
    """Alerts that carry one reason code, by exact membership."""
    alerts = j4_review_bundle(spark, d).select("transaction_id", "rank", F.split("reason_codes", ",").alias("reason_codes"))
    return alerts_with_reason(alerts, "device_unseen_in_training").select("transaction_id", "rank")


# --- models and explanations ----------------------------------------------------------------------


def _modelled(spark: SparkSession, d: str) -> DataFrame:
    """Split rows with the delivered graph features and matured labels (each transaction once, clean numbers)."""

    def build() -> DataFrame:
        rows = _split(spark, d)
        given = [c for c in MODEL_GRAPH_FEATURES if c not in LABEL_FEATURES]
        number = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double")), F.col(c))
        features = table(spark, d, "graph_features").select("transaction_id", *(F.coalesce(number(c), F.lit(0)).alias(c) for c in given)).dropDuplicates(["transaction_id"])
        return rows.join(features, "transaction_id", "left").na.fill(0, given).join(matured_labels(rows).drop("transaction_time"), "transaction_id")

    return _shared(spark, d, "modelled", build, "graph_features")


_fits: dict[tuple[str, ...], LogisticModel | BoostedModel] = {}


def _fitted(spark: SparkSession, d: str, name: str, fit: Callable[[], LogisticModel | BoostedModel]):
    """A model fitted once a session for the same input files; models are a few numbers on the driver."""
    if not path_exists(spark, f"{d}/transactions.parquet"):
        return fit()
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, f"{d}/transactions.parquet", f"{d}/graph_features.parquet"))
    if key not in _fits:
        _fits[key] = fit()
    return _fits[key]


def _logistic(spark: SparkSession, d: str, rows: DataFrame, *, graph: bool = False) -> LogisticModel:
    """The operator's own fit; a model that stopped at the bound of its iterations is refused."""
    model = _fitted(spark, d, f"logistic-{graph}", lambda: LogisticModel(graph=graph).fit(rows.filter("split = 'train'")))
    if not model.converged:
        raise RuntimeError(f"the logistic fit did not converge in {model.iterations} iterations")
    return model


def _boosted(spark: SparkSession, d: str, rows: DataFrame) -> BoostedModel:
    return _fitted(spark, d, "boosted", lambda: BoostedModel().fit(rows.filter("split = 'train'"), rows.filter("split = 'validation'")))


def m7_logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _modelled(spark, d)
    return _logistic(spark, d, rows, graph=True).score(rows.filter("split = 'test'")).select("transaction_id", "score")


def m8_logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """The fit of both logistic models: features, whether it converged to a point without slope, and below the loss of no model."""
    rows = _modelled(spark, d)
    out = []
    for name, graph in (("tabular_logistic", False), ("graph_logistic", True)):
        model = _logistic(spark, d, rows, graph=graph)
        flat = model.slope(rows.filter("split = 'train'")) < 1e-4
        out.append((name, len(model.encoder.names), bool(model.converged), bool(flat), bool(0 < model.training_loss < math.log(2.0))))
    return spark.createDataFrame(out, "model string, features bigint, converged boolean, slope_is_zero boolean, loss_below_no_model boolean")


def m9_boosted_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _modelled(spark, d)
    return _boosted(spark, d, rows).score(rows.filter("split = 'test'")).select("transaction_id", "margin", "score")


def m10_importances(spark: SparkSession, d: str) -> DataFrame:
    """One row about the boosted model's gains: how many features, all not negative, adding up to one, strongest first."""
    model = _boosted(spark, d, _modelled(spark, d))
    every, top = model.strongest(len(model.encoder.names)), model.strongest()
    values = [v for _, v in every]
    row = (len(every), len(top), bool(min(values) >= 0), abs(sum(values) - 1) < 1e-9, values == sorted(values, reverse=True), {n for n, _ in top} <= set(model.encoder.names))
    return spark.createDataFrame([row], "features bigint, shown bigint, none_negative boolean, add_up_to_one boolean, strongest_first boolean, names_known boolean")


def m11_selection(spark: SparkSession, d: str) -> DataFrame:
    """One row: the model chosen on validation is the one that ranks best there."""
    rows = _modelled(spark, d)
    models = {"graph_logistic": _logistic(spark, d, rows, graph=True), "graph_boosted": _boosted(spark, d, rows)}
    precision = {n: ranking.average_precision(m.score(rows.filter("split = 'validation'"))).first()[0] for n, m in models.items()}
    best = select_model(precision)
    return spark.createDataFrame([(len(models), bool(precision[best] == max(precision.values())))], "candidates bigint, chosen_is_best boolean")


def m12_score_reproduction(spark: SparkSession, d: str) -> DataFrame:
    """One row: written scores of the test rows against scores computed again, within 1e-12."""
    rows = _modelled(spark, d).filter("split = 'test'")
    model = _logistic(spark, d, _modelled(spark, d), graph=True)
    written = Scratch(spark, "m12").table(model.score(rows).select("transaction_id", F.col("score").alias("written")), "scores")
    both = align_scores(written, model.score(rows).select("transaction_id", "score"), 1e-12, "written")
    return both.agg(F.count(F.lit(1)).alias("rows"), (F.max(F.abs(F.col("score") - F.col("written"))) <= 1e-12).alias("reproduced"))


def m13_linear_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Both logistic models' attributions rebuild the log-odds of every test row."""
    rows, parts = _modelled(spark, d), []
    for name, graph in (("tabular_logistic", False), ("graph_logistic", True)):
        explained = LinearAttributor().fit(_logistic(spark, d, rows, graph=graph), rows.filter("split = 'train'")).explain(rows.filter("split = 'test'"))
        parts.append(fidelity_audit(explained).select(F.lit(name).alias("model"), "explained_rows", (F.col("maximum_error") <= FIDELITY).alias("adds_up"), "all_finite", "status"))
    return parts[0].unionByName(parts[1])


def _explained(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Explained test rows, and the names of the features that their attributions are for: those that trees read."""
    rows = _modelled(spark, d)
    model = _boosted(spark, d, rows)
    explain = lambda: TreeAttributor().fit(model, rows.filter("split = 'train'")).explain(rows.filter("split = 'test'"), short=True)
    return _shared(spark, d, "explained", explain, "graph_features"), model.used_names()


def m14_tree_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The boosted model's attributions rebuild the log-odds of every test row."""
    audit = fidelity_audit(_explained(spark, d)[0])
    return audit.select("explained_rows", (F.col("maximum_error") <= FIDELITY).alias("adds_up"), "all_finite", "status")


def m16_alert_reasons(spark: SparkSession, d: str) -> DataFrame:
    explained, names = _explained(spark, d)
    return ReasonBuilder().fit(_modelled(spark, d).filter("split = 'train'")).alerts(explained, names)


def m17_alert_artifact(spark: SparkSession, d: str) -> DataFrame:
    """The artifact's status, gates and counts; the alerts themselves are a table."""
    explained, names = _explained(spark, d)
    summary, alerts = ReasonBuilder().fit(_modelled(spark, d).filter("split = 'train'")).artifact(explained, names)
    gates = [F.col("gates")[g].alias(g) for g in (
        "alert_count_matches_capacity", "transaction_ids_unique", "every_alert_has_reason", "reason_codes_known", "positive_contributions_only", "target_fields_absent", "review_only_action",
    )]
    ranks = alerts.agg(F.count(F.lit(1)).alias("alerts"), (F.max("rank") == F.count(F.lit(1))).alias("ranks_complete"), F.bool_and(F.size("reasons").between(1, 3)).alias("one_to_three_reasons"))
    one = summary.select("status", "review_count", *gates, F.col("capacity_tie_audit.tie_break_rule").alias("tie_break_rule"), F.lit(1).alias("__one"))
    return one.join(F.broadcast(ranks.withColumn("__one", F.lit(1))), "__one").drop("__one")


def a12_global_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = _modelled(spark, d)
    model = _logistic(spark, d, rows, graph=True)
    return global_importance(LinearAttributor().fit(model, rows.filter("split = 'train'")).explain(rows.filter("split = 'test'")), model.encoder.names)


def f9_event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON written and read back, with guarded access to a property, over the events table."""
    nested = F.to_json(F.struct("event_id", F.struct("event_type", "value").alias("what"), F.from_json("props", "map<string,string>").alias("props")))
    documents = Scratch(spark, "f9").table(table(spark, d, "events").select(nested.alias("j")), "documents")
    back = documents.select(F.from_json("j", "event_id bigint, what struct<event_type:string,value:double>, props map<string,string>").alias("e"))
    events = back.select("e.what.event_type", "e.what.value", F.try_element_at("e.props", F.lit("k")).cast("bigint").alias("k"))
    return events.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- single operators over the whole tables -------------------------------------------------------


def g5_components(spark: SparkSession, d: str) -> DataFrame:
    """How many components of the specific graph have how many nodes and transactions."""
    edges = build_edges(_pay(spark, d), SPECIFIC_TYPES, allow_entityless=True)
    sizes = node_components(edges, Scratch(spark, "g5"))
    return sizes.groupBy("nodes", "transactions").agg(F.count(F.lit(1)).alias("components"))


def s3_entity_keys(spark: SparkSession, d: str) -> DataFrame:
    """Hashed keys out of several parts, absent parts marked."""
    parts = [F.col(c) for c in ("product_code", "payer_email_domain", "recipient_email_domain")]
    return table(spark, d, "transactions").select("raw_delivery_id", entity_key("proxy", *parts).alias("entity_key"))


def j1_identity_join(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one left join, the right side reduced to present ids first and checked."""
    columns = ["graph_entity_count", "graph_sum_entity_degree"]
    features = Scratch(spark, "j1").table(table(spark, d, "graph_features").select("transaction_id", *columns).distinct(), "features")
    return one_to_one_left(_pay(spark, d).select("transaction_id"), features, "transaction_id", reduce_first=True)


def e1_score_guard(spark: SparkSession, d: str) -> DataFrame:
    scored = _rated(spark, d).filter("split = 'test'")
    return ranking.score_guard(scored)


def e7_alert_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Alerts that the rules and a ranking by matured fraud neighbours need for some recalls, and what the latter saves."""
    _, rank, n, p = _test(spark, d)
    other = _modelled(spark, d).filter("split = 'test'").withColumn("score", F.col("matured_neighbor_fraud_ratio"))
    recalls = [0.25, 0.375, 0.5]
    base = {r["target_recall"]: r["alert_count"] for r in ranking.minimum_alerts(rank, n, p, recalls).collect()}
    found = {r["target_recall"]: r["alert_count"] for r in ranking.minimum_alerts(ranking.ranked(other), n, p, recalls).collect()}
    rows = [(r, base[r], found[r], round(ranking.alert_reduction(base[r], found[r]), 6)) for r in recalls]
    return spark.createDataFrame(rows, "target_recall double, rules_alerts bigint, neighbour_alerts bigint, alert_reduction double")


def v4_feature_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit of all 26 delivered features, PageRank and clustering bounds included, against the transactions."""
    features = table(spark, d, "graph_features").select("transaction_id", "transaction_time", *STRUCTURAL_FEATURES)
    return feature_audit(features, _pay(spark, d), STRUCTURAL_FEATURES)


def w10_time_order(spark: SparkSession, d: str) -> DataFrame:
    return times_non_decreasing(table(spark, d, "transactions").filter("transaction_time IS NOT NULL"), "raw_delivery_id")


def w7_cumulative_positives(spark: SparkSession, d: str) -> DataFrame:
    return ranking.cumulative_positives(_test(spark, d)[0])


def m5_graph_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Standardised logs of all 28 graph features, fitted on the training rows."""
    rows = _modelled(spark, d)
    encoder = GraphEncoder().fit(rows.filter("split = 'train'"))
    values = encoder.pick(range(len(encoder.features)))
    return rows.select("transaction_id", *(F.round(v, 6).alias(c) for c, v in zip(encoder.features, values, strict=True)))


def m15_reason_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """All eight thresholds of the reasons over the training rows."""
    limits = ReasonBuilder().fit(_modelled(spark, d).filter("split = 'train'")).thresholds
    return spark.createDataFrame([(name, round(v, 9)) for name, v in limits.items()], "threshold_name string, threshold double")


def st_hourly_activity(spark: SparkSession, d: str) -> DataFrame:
    """The events table replayed as a stream into tumbling hours."""
    scratch = Scratch(spark, "stream")
    columns = table(spark, d, "events").schema
    folder = scratch.root + "/events"
    scratch.table(table(spark, d, "events"), "events")
    stream = spark.readStream.schema(columns).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch.root + "/hours"
    query = (
        stream_activity(stream, late="3650 days").writeStream.outputMode("complete").option("checkpointLocation", scratch.root + "/progress")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


_NAMES = """v1_validation v2_quality_profile w2_temporal_split w3_batch_number t1_causal_order a1_split_profile a2_entity_profile a3_value_counts a4_quantiles
a5_moments s6_manifest v8_replay_audit u2_id_sets g1_edges a8_type_counts a9_graph_statistics v7_integrity_audit s9_graph_edges s9_graph_nodes g2_degree_asof
g4_projection g6_components_asof g7_shared_specific g7_shared_all g8_matured_labels g9_clustering_asof g10_pagerank_asof g11_builder_audit j2_attached
a6_split_feature_means a7_label_diagnostics m2_rule_score m4_tabular_long w6_ranked t4_threshold t5_tie_audit t6_worst_cases e2_average_precision
e3_top_fractions e4_threshold_metrics e5_min_alerts a11_error_slices g12_connection_view g12_connection_summary g13_masked_entities m7_logistic_scores
m9_boosted_scores m13_linear_attribution m16_alert_reasons m8_logistic_fit m10_importances m11_selection m12_score_reproduction m14_tree_attribution m17_alert_artifact a11_slice_gates u1_scored_rows
j4_review_bundle rc_alerts_with_code a12_global_importance f9_event_properties g5_components s3_entity_keys j1_identity_join
e1_score_guard e7_alert_reduction v4_feature_audit w10_time_order w7_cumulative_positives m5_graph_encoding m15_reason_thresholds st_hourly_activity""".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES}

ORACLE: dict[str, str] = {
    "v1_validation": sql.q_validate(),
    "v2_quality_profile": sql.V2,
    "w2_temporal_split": sql.W2,
    "w3_batch_number": sql.W3,
    "t1_causal_order": sql.T1,
    "a1_split_profile": sql.A1,
    "a2_entity_profile": sql.A2,
    "a3_value_counts": sql.A3,
    "a4_quantiles": sql.A4,
    "a5_moments": sql.A5,
    "s6_manifest": sql.S6,
    "v8_replay_audit": sql.V8,
    "u2_id_sets": sql.U2,
    "g1_edges": sql.G1,
    "a8_type_counts": sql.A8,
    "a9_graph_statistics": sql.A9,
    "v7_integrity_audit": sql.V7,
    "s9_graph_edges": sql.S9,
    "s9_graph_nodes": sql.S9_NODES,
    "g2_degree_asof": sql.G2,
    "g4_projection": sql.G4,
    "g7_shared_specific": sql.G7,
    "g7_shared_all": sql.G7_ALL,
    "g8_matured_labels": sql.G8,
    "g9_clustering_asof": sql.G9,
    "g6_components_asof": sql.G6,
    "g10_pagerank_asof": sql.G10,
    "g11_builder_audit": sql.G11,
    "j2_attached": sql.J2,
    "a6_split_feature_means": sql.A6,
    "a7_label_diagnostics": sql.A7,
    "m2_rule_score": sql.M2,
    "m4_tabular_long": sql.M4,
    "w6_ranked": sql.W6,
    "t4_threshold": sql.T4,
    "t5_tie_audit": sql.T5,
    "t6_worst_cases": sql.T6,
    "e2_average_precision": sql.E2,
    "e3_top_fractions": sql.E3,
    "e4_threshold_metrics": sql.E4,
    "e5_min_alerts": sql.E5,
    "a11_error_slices": sql.A11,
    "g12_connection_view": sql.G12,
    "g12_connection_summary": sql.G12_SUMMARY,
    "g13_masked_entities": sql.G13,
    "f9_event_properties": sql.F9,
    "a11_slice_gates": sql.A11_GATES,
    "u1_scored_rows": sql.U1,
    "j4_review_bundle": sql.J4,
    "rc_alerts_with_code": sql.RC,
    "m8_logistic_fit": sql.M8,
    "m10_importances": sql.M10,
    "m11_selection": sql.M11,
    "m12_score_reproduction": sql.M12,
    "m13_linear_attribution": sql.M13,
    "m14_tree_attribution": sql.M14,
    "m17_alert_artifact": sql.M17,
    "g5_components": sql.G5,
    "s3_entity_keys": sql.S3,
    "j1_identity_join": sql.J1,
    "e1_score_guard": sql.E1,
    "e7_alert_reduction": sql.E7,
    "v4_feature_audit": sql.V4,
    "w10_time_order": sql.W10,
    "w7_cumulative_positives": sql.W7,
    "m5_graph_encoding": sql.M5,
    "m15_reason_thresholds": sql.M15,
    "st_hourly_activity": sql.ST,
}
