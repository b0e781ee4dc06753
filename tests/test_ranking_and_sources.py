"""Ranking metrics, split, validation, joins, views, sources, sinks and streaming."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from helpers import canonical
from pyspark.sql import functions as F

from tidegraph.operators import ranking
from tidegraph.operators.asof import degree_features, entity_edges
from tidegraph.operators.attach import align_scores, attach_features, one_to_one_left
from tidegraph.operators.quality import feature_audit, id_set_difference, quality_profile, times_non_decreasing, validate_transactions, violations
from tidegraph.operators.rules import RulesBaseline
from tidegraph.operators.slices import BANDS, column_quantiles, exhaustive_gates, quantiles, slice_families, slice_summary
from tidegraph.operators.temporal_split import assign_splits
from tidegraph.operators.views import alerts_with_reason, connection_summary, connection_view, contains_target_key, masked, require_target_free, target_fields
from tidegraph.schema import CANONICAL_SCHEMA, LABEL_FEATURES, DataValidationError
from tidegraph.sources import sinks
from tidegraph.sources.synthetic import generate_synthetic, load_source, synthetic_frame
from tidegraph.sources.two_file import load_two_file, pruned_csv
from tidegraph.streaming.degrees import degree_batches, stream_activity, stream_degrees, stream_edges


def scored(spark, labels, scores):
    return spark.createDataFrame([(f"t{i}", i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores, strict=True))], "transaction_id string, transaction_time bigint, is_fraud int, score double")


def test_ranking_cases(spark):
    df = scored(spark, (1, 0, 1, 0), (0.9, 0.8, 0.7, 0.1))
    assert ranking.average_precision(df).first()[0] == pytest.approx(5 / 6)
    rank = ranking.ranked(df)
    top = ranking.top_fraction(rank, 4, 2, [("half", 0.5)]).first()
    assert (top.alert_count, top.precision, top.recall, top.false_positive_rate) == (2, 0.5, 0.5, 0.5)
    assert [(r.alert_count, r.alert_fraction) for r in ranking.minimum_alerts(rank, 4, 2, [1.0, 0.0]).orderBy(F.desc("target_recall")).collect()] == [(3, 0.75), (0, 0.0)]
    tie = scored(spark, (1, 0, 1, 0), (0.9, 0.8, 0.8, 0.1))
    threshold = ranking.threshold_at_capacity(ranking.ranked(tie), 4, 0.5)
    assert threshold == 0.8 and ranking.threshold_metrics(tie, threshold).first().alert_count == 3
    audit = ranking.tie_audit(ranking.ranked(tie), 4, 0.5).first()
    assert tuple(audit) == (0.8, 1, 2, 1, True)
    assert ranking.average_precision(scored(spark, (0, 0), (0.2, 0.1))).first()[0] == 0.0
    assert ranking.evaluate(df, capacity=0.5)["pr_auc"] == pytest.approx(5 / 6)
    assert ranking.alert_reduction(4, 3) == 0.25 and ranking.alert_reduction(0, 3) == 0.0


def test_average_precision_matches_definition(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 4
    want = 0.0
    for v in sorted(set(s), reverse=True):
        want += ((s == v) & (y == 1)).sum() / y.sum() * (y[s >= v].sum() / (s >= v).sum())
    assert ranking.average_precision(scored(spark, y.tolist(), s)).first()[0] == pytest.approx(want)


def test_ranking_refuses(spark):
    for labels, scores in (((), ()), ((2,), (0.1,)), ((1,), (float("nan"),)), ((1,), (float("inf"),))):
        with pytest.raises(ValueError):
            ranking.check_scores(scored(spark, labels, scores))
    with pytest.raises(ValueError):
        ranking.review_count(5, 0)


def test_split(spark):
    df = generate_synthetic(spark, 500)
    got = {r["split"]: r["count"] for r in assign_splits(df).groupBy("split").count().collect()}
    assert got == {"train": 300, "purge_train_validation": 16, "validation": 84, "purge_validation_test": 16, "test": 84}
    small = generate_synthetic(spark, 100).toPandas().sort_values("transaction_time")
    small.loc[60, "transaction_time"] = small.loc[59, "transaction_time"]
    moved = assign_splits(spark.createDataFrame(small, CANONICAL_SCHEMA), purge_seconds=0)
    assert {r.split for r in moved.filter(F.col("transaction_id").isin("syn_000059", "syn_000060")).collect()} == {"train"}
    for kwargs in ({"train_fraction": 1.0}, {"train_fraction": 0.6, "validation_fraction": 0.4}, {"purge_seconds": -1}, {"purge_seconds": 10**9}):
        with pytest.raises(ValueError):
            assign_splits(df, **kwargs)
    with pytest.raises(ValueError):
        assign_splits(df.limit(0))


def test_validation(spark):
    good = canonical(spark, [{"card_id": "a", "transaction_time": 9}, {"card_id": "b", "transaction_time": 3}])
    assert [r.transaction_time for r in validate_transactions(good.withColumn("raw_x", F.lit(1))).collect()] == [3, 9]
    text = good.select(*(F.col(c).cast("string").alias(c) for c in good.columns))
    assert validate_transactions(text).schema["is_fraud"].dataType.simpleString() == "tinyint"
    bad = {
        "unique": good.unionByName(good), "empty": good.withColumn("transaction_id", F.lit("")), "time": good.withColumn("transaction_time", F.lit("soon")),
        "amount": good.withColumn("amount", F.lit(float("nan"))), "0 or 1": good.withColumn("is_fraud", F.lit(2)), "entity": canonical(spark, [{}]),
        "missing": good.drop("amount"),
    }
    for word, df in bad.items():
        with pytest.raises(DataValidationError, match=word):
            validate_transactions(df)
    assert violations(bad["unique"]).first().duplicate_ids == 2
    assert violations(good.limit(0)).first().row_count == 0


def test_quality(spark):
    df = assign_splits(generate_synthetic(spark, 200))
    assert quality_profile(df).first().status == "PASS"
    assert quality_profile(df.filter("split <> 'validation'")).first().status == "FAIL"
    indexed = spark.createDataFrame([(0, 5), (1, 5), (2, 7), (3, 6)], "i int, transaction_time bigint")
    assert not times_non_decreasing(indexed, "i", chunk=2).first()[0]
    assert not times_non_decreasing(indexed, "i").first()[0]
    assert times_non_decreasing(indexed.filter("i < 3"), "i", chunk=2).first()[0]
    sets = id_set_difference(df.limit(3), df).first()
    assert (sets.only_left, sets.only_right, sets.equal_sets) == (0, 197, False)
    features = degree_features(df)
    audit = feature_audit(features, df, features.columns[2:]).first()
    assert audit.equal_sets and audit.rows_not_finite == 0 and audit.rows_negative == 0 and audit.most_rows_per_id == 1 and audit.target_free


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(2, "r"), (9, "s"), (9, "t")], "k int, y string")
    assert {tuple(r) for r in one_to_one_left(left, right, "k", reduce_first=True).collect()} == {(1, "a", None), (2, "b", "r")}
    with pytest.raises(ValueError):
        one_to_one_left(left, right, "k")
    with pytest.raises(ValueError):
        one_to_one_left(left, right, "k", reduce_first=True, complete=["y"])


def test_attach_refuses(spark):
    rows = canonical(spark, [{"card_id": "a"}, {"card_id": "b"}])
    base = rows.select("transaction_id", "transaction_time", F.lit(1).alias("f"))
    labels = rows.select("transaction_id", "transaction_time", *(F.lit(0).alias(c) for c in LABEL_FEATURES))
    assert attach_features(rows, base, labels, ["f"]).count() == 2
    wrong = {
        "times": base.withColumn("transaction_time", F.col("transaction_time") + 1), "target": base.withColumn("label", F.lit(1)), "repeated": base.unionByName(base),
        "match": base.limit(1), "numbers": base.withColumn("f", F.lit(-1)), "lacks": base.drop("f"),
    }
    for word, part in wrong.items():
        with pytest.raises(ValueError, match=word):
            attach_features(rows, part, labels, ["f"])
    s = rows.select("transaction_id", F.lit(0.5).alias("score"))
    with pytest.raises(ValueError):
        align_scores(rows.withColumn("old", F.lit(0.4)), s, 1e-12, "old")


def test_rules(spark):
    rows = [{"card_id": "c", "device_id": f"d{i}", "recipient_id": "r", "amount": float(i)} for i in range(21)]
    train = canonical(spark, rows)
    model = RulesBaseline().fit(train)
    assert (model.high_amount, model.very_high_amount) == (19.0, pytest.approx(19.8))
    probe = canonical(spark, [{"amount": 20.0, "device_id": "new", "recipient_id": "r"}, {"amount": 19.0, "device_id": None, "recipient_id": "new"}, {"amount": 1.0, "device_id": "d1", "recipient_id": "r"}])
    got = [(r.score, r.reasons) for r in model.rate(probe).orderBy("transaction_id").collect()]
    assert got == [(3.0, "very_high_amount;device_unseen_in_training"), (2.0, "high_amount;recipient_unseen_in_training"), (0.0, "no_rule_triggered")]
    with pytest.raises(ValueError):
        RulesBaseline(0.9, 0.9).fit(train)
    with pytest.raises(RuntimeError):
        RulesBaseline().rate(train)


def test_slices(spark):
    df = generate_synthetic(spark, 200)
    families = slice_families(df, graph=False)
    rank = ranking.ranked(df.withColumn("score", F.round("amount")).filter("amount < 30"))
    n = rank.count()
    summary = slice_summary(rank, families, 5)
    rows = {(r.family, r.slice): r for r in summary.collect()}
    assert rows["amount_band", BANDS[2]].rows == 0 and rows["amount_band", BANDS[2]].recall_within_slice is None
    positives = rank.filter("is_fraud = 1").count()
    assert all(exhaustive_gates(summary, n, 5, positives).first())


def test_views(spark):
    rows = [{"card_id": "a", "device_id": "d", "transaction_time": 1}, {"card_id": "a", "transaction_time": 2}, {"card_id": "a", "device_id": "d", "transaction_time": 2}, {"card_id": "a", "device_id": "d", "transaction_time": 3}, {"device_id": "z", "transaction_time": 3}]
    df = canonical(spark, rows)
    alert = df.filter("transaction_id in ('t003', 't004')").select("transaction_id")
    with pytest.raises(ValueError):
        connection_view(df, alert)
    safe = df.drop("is_fraud")
    got = [(r.transaction_id, r.shared_entities, r.neighbour_rank) for r in connection_view(safe, alert, neighbours=2).orderBy("neighbour_rank").collect()]
    assert got == [("t002", 2, 1), ("t000", 2, 2)]
    s = {r.selected_transaction_id: r for r in connection_summary(safe, alert, neighbours=2).collect()}
    assert (s["t003"].historical_neighbour_count, s["t003"].truncated, s["t003"].node_count, s["t003"].edge_count) == (3, True, 5, 6)
    assert (s["t004"].historical_neighbour_count, s["t004"].node_count, s["t004"].strictly_historical) == (0, 2, True)
    want = "ref-" + hashlib.sha256(b"a").hexdigest()[:8]
    assert safe.select(masked("card_id").alias("m")).first().m == want


def test_target_scan(spark):
    nested = spark.createDataFrame([(1, [{"label": "x"}])], "a int, reasons array<struct<label:string>>")
    assert target_fields(nested.schema) == ["reasons[].label"]
    maps = spark.createDataFrame([(1, [({"target": "x"},)])], "a int, reasons array<struct<evidence:map<string,string>>>")
    for df in (nested, maps):
        with pytest.raises(ValueError):
            require_target_free(df)
    require_target_free(spark.createDataFrame([(1, [({"ok": "x"},)])], maps.schema))
    assert contains_target_key({"a": [{"b": {"isFraud": 1}}]}) and not contains_target_key({"a": ["label"]})
    codes = spark.createDataFrame([(1, ["HIGH_ENTITY"]), (2, ["HIGH_ENTITY_REUSE"])], "a int, reason_codes array<string>")
    assert [r.a for r in alerts_with_reason(codes, "HIGH_ENTITY").collect()] == [1]


def test_synthetic(spark):
    frame = synthetic_frame(200)
    ring = frame[frame.device_id == "device:ring_shared"]
    assert len(ring) >= 18 and ring.card_id.nunique() == 3 and (ring.is_fraud == 1).all()
    assert frame.equals(synthetic_frame(200)) and not frame.equals(synthetic_frame(200, 7))
    big = synthetic_frame(500)
    assert big.transaction_time.iloc[[0, 299, 315, 316, 499]].tolist() == [2989, 1708216, 1790836, 1798055, 2847050] and big.is_fraud.sum() == 49
    with pytest.raises(ValueError):
        synthetic_frame(99)
    assert load_source(spark, "auto", "/nonexistent", n_rows=100).count() == 100
    with pytest.raises(FileNotFoundError):
        load_source(spark, "external", "/nonexistent")


def test_two_files(spark, tmp_path):
    (tmp_path / "train_transaction.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,card2,addr1,addr2,P_emaildomain,R_emaildomain,V1\n1001,0,86400,10.5,W,111.0,,300,87, GMAIL.com ,,9\n1002,1,86500,20,,112,5,,,,Shop.example,9\n")
    (tmp_path / "train_identity.csv").write_text("TransactionID,DeviceType,DeviceInfo,id_31\n1002,mobile,Phone,chrome\n9999,x,y,z\n9999,x,y,z\n")
    rows = {r.transaction_id: r for r in load_two_file(spark, tmp_path).collect()}
    a, b = rows["ieee:1001"], rows["ieee:1002"]
    key = lambda prefix, payload: f"{prefix}:{hashlib.sha256(payload.encode()).hexdigest()[:16]}"
    missing = "<missing>"
    assert a.device_id is None and a.payer_email_domain == "gmail.com"
    assert a.card_id == key("card", f"111|{missing}|{missing}|{missing}|{missing}|{missing}")
    assert b.device_id == key("device", f"mobile|phone|{missing}|chrome")
    assert a.customer_id == key("customer_proxy", f"{a.card_id}|300|gmail.com")
    assert a.recipient_id == key("recipient_proxy", f"w|{missing}") and b.product_code == "unknown" and b.address_id is None
    assert not any("isFraud" in c for c in a.asDict())
    assert load_two_file(spark, tmp_path, strict_recipient=True).filter("recipient_id is null").count() == 1
    assert load_two_file(spark, tmp_path, max_rows=1).count() == 1
    assert pruned_csv(spark, tmp_path / "train_transaction.csv", ["ProductCD", "absent"]).columns == ["ProductCD"]


def test_sinks(spark, tmp_path):
    df = assign_splits(generate_synthetic(spark, 100))
    one = sinks.write_prepared(df, str(tmp_path / "a"))
    two = sinks.write_prepared(df.repartition(3), str(tmp_path / "b"), csv=True)
    assert one["content_checksum"] == two["content_checksum"] and one["row_count"] == 100
    assert sinks.content_checksum(df.limit(99)) != one["content_checksum"]
    sinks.write_json({"status": "PASS"}, tmp_path / "x" / "a.json")
    assert sinks.read_json(tmp_path / "x" / "a.json") == json.loads('{"status": "PASS"}')
    assert "| PASS" in sinks.quality_report(df) or "PASS |" in sinks.quality_report(df)
    with pytest.raises(ValueError):
        sinks.markdown_table(df, limit=5)


def test_stream_matches_batch(spark, tmp_path):
    df = generate_synthetic(spark, 120)
    ordered = df.orderBy("transaction_time").collect()
    for i in range(3):
        spark.createDataFrame(ordered[i * 40 : (i + 1) * 40], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = stream_degrees(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.transaction_id, r.entity_type): r.degree for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.transaction_id, t): r[f"historical_{t}_degree"] for r in degree_features(df).collect() for t in ("card", "device", "recipient", "payer_email_domain")}
    assert len(got) == 840 and all(got[k] == v for k, v in want.items())
    q = stream_edges(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "edges"), str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "edges")).count() == entity_edges(df).count()


def test_degree_batches(spark, tmp_path):
    df = canonical(spark, [{"transaction_time": i // 3, "device_id": "hot", "card_id": f"c{i % 4}"} for i in range(90)])
    ordered = df.orderBy("transaction_time", "transaction_id").collect()
    late = canonical(spark, [{"transaction_id": "late", "transaction_time": 2, "device_id": "hot"}]).collect()
    folder, want = str(tmp_path / "run"), {(r.transaction_id, t): r[f"historical_{t}_degree"] for r in degree_features(df).collect() for t in ("card", "device")}
    # A batch ends in the middle of a time, and one holds a row of an earlier time.
    for part in (ordered[:31], ordered[31:59], ordered[59:] + late):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = degree_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), folder, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    got = {(r.transaction_id, r.entity_type): r.degree for r in spark.read.parquet(f"{folder}/degrees").collect()}
    assert got.pop(("late", "device")) is None and got == want
    assert len(list((tmp_path / "run" / "state").iterdir())) == 2


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts0, 'a' event_type, 2.0D value").selectExpr("cast(ts0 as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    q = stream_activity(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.table("activity").collect()] == [("a", 1, 2.0)]


def test_views_against_brute_force(spark):
    from helpers import nodes, random_rows

    rows = random_rows(np.random.default_rng(33), 80, values=3, times=15)
    df = canonical(spark, rows).drop("is_fraud")
    chosen = [r["transaction_id"] for r in rows[::7]]
    ids = spark.createDataFrame([(i,) for i in chosen + ["absent"]], "transaction_id string")
    got = {}
    for r in connection_view(df, ids, neighbours=4).collect():
        got.setdefault(r.selected_transaction_id, {})[r.neighbour_rank] = (r.transaction_id, r.shared_entities)
    summary = {r.selected_transaction_id: r for r in connection_summary(df, ids, neighbours=4).collect()}
    assert set(summary) == set(chosen)
    for r in rows[::7]:
        near = [(len(nodes(r) & nodes(x)), x["transaction_time"], x["transaction_id"]) for x in rows if x["transaction_time"] < r["transaction_time"] and nodes(r) & nodes(x)]
        best = sorted(near, key=lambda x: (-x[0], -x[1], x[2]))[:4]
        assert [got.get(r["transaction_id"], {})[k + 1] for k in range(len(best))] == [(i, n) for n, _, i in best]
        assert summary[r["transaction_id"]].historical_neighbour_count == len(near)


def test_quantiles(spark):
    values = (5, 1, 1, 9, 2, 2, 7)
    df = spark.createDataFrame([(float(v), v * 10) for v in values] + [(None, 4)], "v double, w int")
    shares = (0.0, 0.1, 0.5, 0.9, 0.95, 1.0)
    assert quantiles(df, "v", *shares) == pytest.approx(list(np.quantile(values, shares)))
    both = column_quantiles(df.withColumn("none", F.lit(None).cast("double")), {"w": (0.5,), "v": shares, "none": (0.5,)})
    assert both == {"w": [pytest.approx(np.quantile([4, *(10 * v for v in values)], 0.5))], "v": pytest.approx(list(np.quantile(values, shares))), "none": [None]}
    assert quantiles(df.limit(0), "v", 0.5) == [None]
