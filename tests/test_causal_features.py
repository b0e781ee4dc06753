"""Causal features against brute force, plus invariants: prefix, label flip, equal times, hubs."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import canonical, clustering, components, nodes, random_rows, shares
from pyspark.sql import functions as F

from tidegraph.operators.asof import degree_features, matured_labels, shared_transactions
from tidegraph.operators.components import component_features
from tidegraph.operators.link_graph import append_batch, build_edges, graph_statistics, integrity_audit, replay_audit, serialised_edges
from tidegraph.operators.ordering import global_running, time_batches, values_at_positions
from tidegraph.operators.projection import clustering_features, pagerank_features, pagerank_snapshots, power_iteration, projection_edges
from tidegraph.operators.snapshots import Growth, Snapshots
from tidegraph.plans.pipeline import Settings, structural_features
from tidegraph.schema import ENTITY_TYPES, SPECIFIC_TYPES, STRUCTURAL_FEATURES, GraphBuildError
from tidegraph.session import list_names, scratch_folder
from tidegraph.sources.synthetic import generate_synthetic


@pytest.fixture(scope="module")
def data(spark):
    rows = random_rows(np.random.default_rng(21), 90)
    return rows, canonical(spark, rows).cache()


def by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}


def test_degrees(data):
    rows, df = data
    got = by_id(degree_features(df))
    for r in rows:
        earlier = [x for x in rows if x["transaction_time"] < r["transaction_time"]]
        d = {t: sum(x[c] == r[c] for x in earlier) if r[c] is not None else None for c, t in ENTITY_TYPES.items()}
        present = [v for v in d.values() if v is not None]
        specific = [d[t] for t in SPECIFIC_TYPES.values() if d[t] is not None]
        g = got[r["transaction_id"]]
        assert [g[f"historical_{t}_degree"] for t in d] == [v or 0 for v in d.values()]
        assert (g.graph_entity_count, g.graph_known_entity_count, g.graph_sum_entity_degree, g.graph_max_entity_degree) == (len(present), sum(v > 0 for v in present), sum(present), max(present))
        assert g.graph_mean_entity_degree == pytest.approx(np.mean(present))
        assert (g.specific_entity_count, g.specific_max_entity_degree) == (len(specific), max(specific, default=0))
        assert g.specific_mean_entity_degree == pytest.approx(np.mean(specific) if specific else 0.0)


def test_same_time_rows_do_not_see_each_other(spark):
    df = canonical(spark, [{"device_id": "d", "transaction_time": t} for t in (5, 5, 6)])
    assert [r.historical_device_degree for r in degree_features(df).orderBy("transaction_id").collect()] == [0, 0, 2]


@pytest.mark.parametrize("types", [SPECIFIC_TYPES, ENTITY_TYPES])
def test_shared_transactions(data, types):
    rows, df = data
    got = by_id(shared_transactions(df, types, "n"))
    for r in rows:
        assert got[r["transaction_id"]].n == sum(shares(r, x, types) for x in rows if x["transaction_time"] < r["transaction_time"])


@pytest.mark.parametrize("group_rows", [1, 20, 1_000])
def test_shared_transactions_wherever_values_are_counted(data, group_rows):
    rows, df = data
    got = by_id(shared_transactions(df, ENTITY_TYPES, "n", group_rows=group_rows))
    assert {r["transaction_id"]: got[r["transaction_id"]].n for r in rows} == {
        r["transaction_id"]: sum(shares(r, x, ENTITY_TYPES) for x in rows if x["transaction_time"] < r["transaction_time"]) for r in rows
    }


def test_shared_transactions_send_a_row_once_per_value(spark):
    df = canonical(spark, [{**{c: f"{c}{i % 5}" for c in ENTITY_TYPES}, "transaction_time": i} for i in range(300)]).repartition(2).cache()
    df.count()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in stage_list(spark)}
    before = stages()
    got = shared_transactions(df, ENTITY_TYPES, "n").agg(F.sum("n"), F.max("n")).first()
    sent = sum(n for k, n in stages().items() if k not in before)
    assert tuple(got) == (sum(i // 5 for i in range(300)), 59)
    # 127 subsets a row would be 38,100 records each time they are sent.
    assert 300 * 7 <= sent < 300 * 25


def stage_list(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("delay", [0, 1, 30_000, 86_400])
def test_matured_labels(data, delay):
    rows, df = data
    pool = lambda r: r["transaction_time"] < 200_000
    split = df.withColumn("split", F.when(F.col("transaction_time") < 200_000, "train").otherwise("test"))
    got = by_id(matured_labels(split, delay=delay))
    for r in rows:
        near = [x for x in rows if pool(x) and x["transaction_time"] < r["transaction_time"] and x["transaction_time"] + delay <= r["transaction_time"] and shares(r, x)]
        g = got[r["transaction_id"]]
        fraud = sum(x["is_fraud"] for x in near)
        assert (g.matured_neighbor_label_count, g.matured_neighbor_fraud_count) == (len(near), fraud)
        assert g.matured_neighbor_fraud_ratio == pytest.approx(fraud / len(near) if near else 0.0)


@pytest.mark.parametrize("group_rows", [5, 1_000])
def test_matured_labels_wherever_values_are_counted(data, group_rows):
    rows, df = data
    split = df.withColumn("split", F.when(F.col("transaction_time") < 200_000, "train").otherwise("test"))
    got = by_id(matured_labels(split, delay=30_000, group_rows=group_rows))
    for r in rows:
        near = [x for x in rows if x["transaction_time"] < 200_000 and x["transaction_time"] + 30_000 <= r["transaction_time"] and shares(r, x)]
        g = got[r["transaction_id"]]
        assert (g.matured_neighbor_label_count, g.matured_neighbor_fraud_count) == (len(near), sum(x["is_fraud"] for x in near))


def test_clustering_reads_written_events(data):
    """Wedges and sums are separate jobs, so their shuffle files never exist together."""
    assert any("/events/" in f for f in clustering_features(data[1]).inputFiles())


def test_label_delay_case(spark):
    rows = [{"device_id": "d", "transaction_time": t, "is_fraud": y} for t, y in ((100, 1), (100, 0), (149, 0), (150, 0))]
    got = matured_labels(canonical(spark, rows).withColumn("split", F.lit("train")), delay=50).orderBy("transaction_id").collect()
    assert [r.matured_neighbor_label_count for r in got] == [0, 0, 0, 2]
    assert (got[3].matured_neighbor_fraud_count, got[3].matured_neighbor_fraud_ratio) == (1, 0.5)


def test_matured_labels_refuse(spark):
    df = canonical(spark, [{"device_id": "d"}]).withColumn("split", F.lit("test"))
    with pytest.raises(ValueError):
        matured_labels(df)
    with pytest.raises(ValueError):
        matured_labels(df, delay=-1)


def test_labels_outside_the_pool_do_not_matter(data):
    _, df = data
    split = df.withColumn("split", F.when(F.col("transaction_time") < 200_000, "train").otherwise("test"))
    flipped = split.withColumn("is_fraud", F.when(F.col("split") == "test", 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")).cast("tinyint"))
    assert sorted(matured_labels(split).collect()) == sorted(matured_labels(flipped).collect())


@pytest.mark.parametrize("segment_rows", [1_000_000, 17, 4])
def test_components(data, segment_rows):
    rows, df = data
    got = by_id(component_features(df, segment_rows=segment_rows))
    for r in rows:
        earlier = [x for x in rows if x["transaction_time"] < r["transaction_time"] and nodes(x)]
        root = components([(("t", x["transaction_id"]), ("e", n)) for x in earlier for n in nodes(x)])
        mine = [root["e", n] for n in nodes(r) if ("e", n) in root]
        size = lambda k: sum(v == k for v in root.values())
        txns = lambda k: sum(v == k and x[0] == "t" for x, v in root.items())
        g = got[r["transaction_id"]]
        assert g.specific_max_component_nodes == max(map(size, mine), default=0)
        assert g.specific_max_component_transactions == max(map(txns, mine), default=0)


@pytest.mark.parametrize("task_edges", [0, 5, 1_000])
def test_components_do_not_depend_on_where_contraction_ends(data, task_edges):
    _, df = data
    assert sorted(component_features(df, segment_rows=17, task_edges=task_edges).collect()) == sorted(component_features(df).collect())


def test_feature_tables_leave_nothing_else_behind(data):
    """Every part is written before the next begins, and what it needed on the way is gone."""
    _, df = data
    folder = scratch_folder(df.sparkSession)
    before = set(list_names(df.sparkSession, folder, ""))
    built = structural_features(df, Settings(refresh_batches=4))
    made = set(list_names(df.sparkSession, folder, "")) - before
    assert {n.rpartition("-")[0] for n in made} == {"structural", "numbered"}
    assert built.count() == df.count()


def test_projection_and_clustering(spark):
    rows = random_rows(np.random.default_rng(2), 60, values=6, null_share=0.35)
    df = canonical(spark, rows)
    edges = {(e.u, e.v): (e.weight, e.first_observed_time, e.last_observed_time) for e in projection_edges(df).collect()}
    for (u, v), (w, a, b) in edges.items():
        times = [r["transaction_time"] for r in rows if {u, v} <= nodes(r)]
        assert (w, a, b) == (len(times), min(times), max(times))
    got = by_id(clustering_features(df))
    for r in rows:
        history = [x for x in rows if x["transaction_time"] < r["transaction_time"]]
        c = [clustering(history, n) for n in nodes(r)]
        g = got[r["transaction_id"]]
        assert g.specific_max_clustering == pytest.approx(max(c, default=0.0))
        assert g.specific_mean_clustering == pytest.approx(np.mean(c) if c else 0.0)


def test_power_iteration_without_edges():
    assert power_iteration(np.array([], int), np.array([], int), np.array([]), 4, 0.85) == pytest.approx([0.25] * 4)
    star = power_iteration(np.array([0, 0, 0]), np.array([1, 2, 3]), np.ones(3), 4, 0.85)
    assert star.sum() == pytest.approx(1.0, abs=1e-4) and star[0] > 2 * star[1] and star[1] == pytest.approx(star[3])


def test_pagerank_ways_agree(data):
    rows, df = data
    a = {(r.snapshot_no, r.node): r.score for r in pagerank_snapshots(df, refresh_batches=4).collect()}
    b = {(r.snapshot_no, r.node): r.score for r in pagerank_snapshots(df.filter("transaction_time < 300000"), refresh_batches=4, task_edges=1).collect()}
    assert a and b and all(a[k] == pytest.approx(v, abs=1e-9) for k, v in b.items())
    ages = {r.transaction_id: r for r in pagerank_features(df, refresh_batches=4).collect()}
    times = sorted({r["transaction_time"] for r in rows})
    for r in rows:
        batch = times.index(r["transaction_time"])
        g = ages[r["transaction_id"]]
        assert g.pagerank_snapshot_age_batches == batch % 4
        s = [a.get((batch // 4, n), 0.0) for n in nodes(r)]
        assert g.specific_max_pagerank == pytest.approx(max(s, default=0.0))
    with pytest.raises(ValueError):
        pagerank_snapshots(df, refresh_batches=0)
    with pytest.raises(ValueError):
        pagerank_snapshots(df, alpha=1.0)


def test_prefix_and_label_invariance(spark):
    df = generate_synthetic(spark, 100).cache()
    settings = Settings(refresh_batches=25)
    whole = by_id(structural_features(df, settings))
    cut = df.orderBy("transaction_time").limit(50).cache()
    part = by_id(structural_features(cut, settings))
    assert part == {k: whole[k] for k in part} and len(part) == 50
    flipped = by_id(degree_features(df.withColumn("is_fraud", (1 - F.col("is_fraud")).cast("tinyint"))))
    assert all(flipped[k].graph_sum_entity_degree == whole[k].graph_sum_entity_degree for k in whole)
    for r in whole.values():
        assert all(r[c] is not None and 0 <= r[c] < float("inf") for c in STRUCTURAL_FEATURES)
        assert r.pagerank_snapshot_age_batches < 25


def test_hubs_are_not_specific(spark):
    rows = [{"card_id": f"c{i}", "device_id": f"d{i}", "payer_email_domain": "p", "recipient_email_domain": "q", "transaction_time": i} for i in range(3)]
    df = canonical(spark, rows)
    assert shared_transactions(df, ENTITY_TYPES, "n").agg(F.max("n")).first()[0] == 2
    assert shared_transactions(df).agg(F.max("specific_shared_transaction_count")).first()[0] == 0


def test_edges_and_audits(spark):
    rows = [{"card_id": "same", "device_id": "same", "address_id": "  ", "transaction_time": 1}, {"card_id": " same ", "recipient_id": "none", "transaction_time": 1}, {"device_id": "x", "transaction_time": 2}]
    df = canonical(spark, rows)
    edges = build_edges(df).cache()
    assert {(e.transaction_id, e.entity_type, e.entity_value) for e in edges.collect()} == {("t000", "card", "same"), ("t000", "device", "same"), ("t001", "card", "same"), ("t002", "device", "x")}
    audit = integrity_audit(df, edges).first().asDict()
    assert all(v for k, v in audit.items() if isinstance(v, bool)) and audit["edge_count"] == 4
    assert not integrity_audit(df, edges.withColumn("label", F.lit(1))).first().target_attributes_absent
    wrong = edges.withColumn("observed_time", F.col("observed_time") + 1)
    assert not integrity_audit(df, wrong).first().edge_times_match_transactions
    stats = graph_statistics(df, edges).first().asDict()
    assert stats == {"node_count": 6, "edge_count": 4, "transaction_node_count": 3, "entity_node_count": 3, "connected_component_count": 2, "largest_component_size": 4, "isolated_transaction_count": 0}
    assert replay_audit(df).first().asDict() == {"batch_count": 2, "multi_row_batches": 1, "largest_batch": 2, "row_count": 3, "pre_existing_id_violations": 0}
    assert build_edges(df, cutoff_time=1).count() == 3
    assert {(r.source, r.target) for r in serialised_edges(edges).collect()} >= {("card::same", "transaction::t000")}


def test_edge_build_refuses(spark):
    df = canonical(spark, [{"card_id": "a", "transaction_time": 5}])
    with pytest.raises(GraphBuildError):
        build_edges(df.unionByName(df))
    with pytest.raises(GraphBuildError):
        build_edges(canonical(spark, [{"card_id": " "}]))
    edges = build_edges(df)
    later = canonical(spark, [{"card_id": "a", "transaction_id": "u", "transaction_time": 6}])
    assert append_batch(edges, later).count() == 2
    for t in (4, 5):
        with pytest.raises(GraphBuildError):
            append_batch(edges, later.withColumn("transaction_time", F.lit(t).cast("bigint")))
    with pytest.raises(GraphBuildError):
        append_batch(edges, later.withColumn("transaction_id", F.lit("t000")))


def test_total_order(spark):
    df = spark.range(1_000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 5).alias("v")).repartition(7)
    got = global_running(df, [F.col("id")], sums={"s": "v"}).orderBy("id").collect()
    assert [r.position for r in got] == list(range(1, 1001))
    assert [r.s for r in got] == list(np.cumsum([r.v for r in got]))
    assert values_at_positions(df.select((F.col("id") * 1000).alias("t")), "t", [0, 500, 999]) == [0, 500_000, 999_000]
    batches = time_batches(spark.createDataFrame([(5,), (5,), (9,), (1,)], "transaction_time bigint")).orderBy("batch_no").collect()
    assert [tuple(b) for b in batches] == [(1, 1, 0), (5, 2, 1), (9, 1, 2)]


@pytest.mark.parametrize(("tolerance", "needed"), [(3e-3, {1}), (1e-3, {1, 2}), (4.4e-4, {2, 3})])
def test_snapshots_one_after_another_are_those_of_whole_iterations(tolerance, needed):
    draw = np.random.default_rng(7)
    nodes_at, edges_at, u, v = [0], [0], [], []
    for _ in range(120):
        nodes_at.append(nodes_at[-1] + int(draw.integers(3, 9)))
        for _ in range(int(draw.integers(4, 16))):
            # Low numbers are hubs; some of the nodes have no edge for a while.
            a = int(draw.integers(0, 6)) if draw.random() < 0.3 else int(draw.integers(0, nodes_at[-1]))
            b = int(draw.integers(0, nodes_at[-1]))
            if a % nodes_at[-1] != b:
                u.append(min(a % nodes_at[-1], b)), v.append(max(a % nodes_at[-1], b))
        edges_at.append(len(u))
    # And an edge after the last snapshot, with a node of its own.
    u, v, w = np.array([*u, 0]), np.array([*v, nodes_at[-1]]), draw.integers(1, 4, len(u) + 1)
    walk = Snapshots(Growth.of(u, v, w, nodes_at, edges_at, hubs=5), 0.85, tolerance=tolerance, whole_edges=0)
    taken = set()
    for s in range(40, 121):
        moves: list[float] = []
        whole = power_iteration(u[: edges_at[s]], v[: edges_at[s]], w[: edges_at[s]], nodes_at[s], 0.85, tolerance=tolerance, moves=moves)
        wanted = np.unique(np.r_[np.arange(6), draw.integers(0, nodes_at[s], 20)])
        np.testing.assert_allclose(walk.scores(s, wanted), whole[wanted], rtol=1e-10)
        taken.add(len(moves))
    assert taken == needed
    assert needed != {1} or walk.iterated == 0
