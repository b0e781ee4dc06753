"""p1..p7 operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import components
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegraph.functions.normal import WHITESPACE, cents, day_number, normal_form, paid, timed
from tidegraph.operators import distinct_bitmap as db
from tidegraph.operators import quantile_sketch as qs
from tidegraph.operators.asof_attributes import asof_matches, asof_totals, dyadic_nodes, enclosing_nodes, validity_of_versions
from tidegraph.operators.contraction import connected_labels, link_groups, permute, unpermute
from tidegraph.operators.current import current_rows
from tidegraph.operators.entity_features import TypeDictionary, entity_entries, feature_table, merge_entries, sparse_vectors, with_type_names
from tidegraph.operators.keyed_totals import heavy_keys, keyed_totals
from tidegraph.operators.rolling import advance_day, correct_state, daily_corrections, daily_totals, expand_days, latest_version, maintain_state, rolling_state
from tidegraph.session import Scratch, list_names


def test_normal_form(spark):
    values = ["  A\tb ", None, "", "   ", "<NA>", "NaN ", "none", " Null\n", "x none", WHITESPACE + "Q" + WHITESPACE]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", normal_form("v").alias("n")).collect()
    assert [r.n for r in sorted(rows)] == ["a\tb", None, None, None, None, None, None, None, "x none", "q"]


def test_conditions_and_cents(spark):
    df = spark.createDataFrame([(None, None), (-1, -2.0), (0, float("nan")), (86_399, 0.0), (86_400, 19.99), (5, 0.29)], "t bigint, a double")
    got = df.select(timed("t").alias("t"), paid("a").alias("p"), day_number("t").alias("d"), F.when(paid("a"), cents("a")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, False, None, None), (False, False, -1, None), (True, False, 0, None), (True, True, 0, 0), (True, True, 1, 1999), (True, True, 0, 29)]


def test_current_rows(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, "x"), ("a", 2, 2, "y"), ("a", 2, 3, "z"), ("b", None, 9, "n"), ("b", 1, 0, "m"), (None, 5, 5, "q")], "transaction_id string, raw_ingested_at int, raw_delivery_id int, row_number string"
    )
    assert {(r[0], r[3]) for r in current_rows(df).collect()} == {("a", "z"), ("b", "m")}
    assert current_rows(df.limit(0)).count() == 0


# --- distinct counts ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 100, 3_000, 100_000, 1_000_000])
def test_bitmap_error(spark, n):
    shape = db.BitmapShape()
    df = spark.range(n).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("v"), F.lit("g").alias("g"))
    got = db.estimate_distinct(db.distinct_sketch(df, ["g"], {"v": "v"}, shape), ["g"], ["v"], shape).first()["n_v"]
    assert abs(got - n) <= max(0.6, 4 * shape.relative_error() * n)
    assert shape.relative_error() < 0.05


def test_bitmap_merges_and_cube(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), f"r{rng.integers(4)}" if rng.random() > 0.1 else None, None if rng.random() < 0.1 else f"c{rng.integers(60)}") for _ in range(2_000)]
    df = spark.createDataFrame(rows, "day int, r string, slot string").withColumnRenamed("slot", "card")
    per_day = db.distinct_sketch(df, ["day", "r"], {"c": "card"})
    whole = db.estimate_distinct(db.merge_sketches(per_day, ["r"]), ["r"], ["c"]).collect()
    direct = db.estimate_distinct(db.distinct_sketch(df, ["r"], {"c": "card"}), ["r"], ["c"]).collect()
    assert sorted(map(str, whole)) == sorted(map(str, direct))
    cube = {(x.grouping_level, x.day, x.r): x.n_c for x in db.estimate_distinct(db.cube_sketches(per_day, ["day", "r"]), ["grouping_level", "day", "r"], ["c"]).collect()}
    exact = defaultdict(set)
    for d, r, c in rows:
        if c is not None:
            for level, key in ((0, (d, r)), (1, (d, None)), (2, (None, r)), (3, (None, None))):
                exact[(level, *key)].add(c)
    assert set(cube) == set(exact)
    assert all(abs(cube[k] - len(exact[k])) <= 2.5 for k in exact)


def test_bitmap_edges(spark):
    empty = spark.createDataFrame([], "g string, v string")
    assert db.estimate_distinct(db.distinct_sketch(empty, ["g"], {"v": "v"}), ["g"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        db.distinct_sketch(empty.withColumnRenamed("g", "slot"), ["slot"], {"v": "v"})
    with pytest.raises(ValueError):
        db.BitmapShape(bits=100)


# --- groups of links ---------------------------------------------------------------------------------


def test_permute_is_a_bijection(spark):
    df = spark.range(5_000).select((F.xxhash64("id")).alias("v"))
    back = df.select("v", permute(F.col("v"), 7).alias("p")).select("v", "p", unpermute(F.col("p"), 7).alias("b"))
    assert back.filter("v <> b").count() == 0
    assert back.select("p").distinct().count() == 5_000


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_contraction(spark, kind):
    rng = np.random.default_rng(5)
    edges = {
        "chain": [(i, i + 1) for i in range(400) if i % 97],
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))],
        "star": [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 50)] + [(7, 7), (5, 9)],
        "none": [(3, 3)],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 4), (4, None)], "u bigint, v bigint")
    got = {r.vertex: r.label for r in connected_labels(df, Scratch(spark, "t")).collect()}
    want = components([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    assert len({(got[v], want[v]) for v in want}) == len(set(want.values())) == len(set(got.values()))


@pytest.mark.parametrize("task_edges", [1, 60, 100_000])
def test_last_edges_are_joined_in_one_task(spark, task_edges):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(400) if i % 97] + [(int(a), int(b)) for a, b in rng.integers(500, 900, (250, 2))] + [(1_000, i) for i in range(1_001, 1_090)]
    scratch = Scratch(spark, "t")
    got = {r.vertex: r.label for r in connected_labels(spark.createDataFrame(edges, "u bigint, v bigint"), scratch, task_edges=task_edges).collect()}
    want = components([e for e in edges if e[0] != e[1]])
    assert set(got) == set(want)
    assert len({(got[v], want[v]) for v in want}) == len(set(want.values())) == len(set(got.values()))
    # With all edges in a task there is no round at all.
    assert bool(list_names(spark, scratch.root, "map-")) == (task_edges < 100_000)


def test_link_groups(spark):
    rows = [("t3", "a", None, None), ("t1", "a", "x", None), ("t2", None, "x", None), ("t9", None, None, None), ("t5", "x", None, "q"), ("t4", None, None, "q"), ("t8", "b", "b", "b")]
    df = spark.createDataFrame(rows, "id string, label string, vertex string, u string")
    got = {r.id: r.group_id for r in link_groups(df, "id", ["label", "vertex", "u"]).collect()}
    # Equal values in different fields (x, b) do not link.
    assert got == {"t3": "t1", "t1": "t1", "t2": "t1", "t9": "t9", "t5": "t4", "t4": "t4", "t8": "t8"}
    assert link_groups(df.limit(0), "id", ["label", "vertex", "u"]).count() == 0
    odd = spark.createDataFrame([(None, "a"), ("t2", "a"), ("t2", "a"), (None, "z"), (None, None)], "id string, label string")
    assert sorted(map(str, link_groups(odd, "id", ["label"]).collect())) == sorted(
        ["Row(id=None, group_id='t2')", "Row(id='t2', group_id='t2')", "Row(id='t2', group_id='t2')", "Row(id=None, group_id=None)", "Row(id=None, group_id=None)"]
    )
    with pytest.raises(ValueError):
        link_groups(df, "id", ["id"])


def test_link_groups_random(spark):
    rng = np.random.default_rng(8)
    rows = [(f"t{i:04d}", *(None if rng.random() < 0.4 else f"v{int(rng.pareto(0.6) * 20) % 500}" for _ in range(3))) for i in range(900)]
    got = dict(link_groups(spark.createDataFrame(rows, "id string, a string, b string, c string"), "id", ["a", "b", "c"]).collect())
    by = defaultdict(list)
    for t, *vs in rows:
        for f, v in enumerate(vs):
            if v:
                by[f, v].append(t)
    want = components([(m[0], x) for m in by.values() for x in m[1:]], [r[0] for r in rows])
    assert got == want


# --- percentiles -------------------------------------------------------------------------------------


def exact_quantile(values, q):
    return sorted(values)[max(1, math.ceil(round(q * len(values), 9))) - 1]


def test_small_groups_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 3 else f"g{g}", float(x)) for g in range(6) for x in rng.integers(0, 40, 10 * g + 1)] + [("g0", None), ("g0", float("nan"))]
    df = spark.createDataFrame(rows, "level string, v double").repartition(5).withColumnRenamed("level", "k")
    got = {r.k: r for r in qs.sketch_quantiles(qs.quantile_sketch(df, ["k"], "v"), ["k"], [0.0, 0.5, 0.9, 1.0]).collect()}
    by = defaultdict(list)
    for k, v in rows:
        if v is not None and v == v:
            by[k].append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        assert got[k].n == len(vs)
        assert [got[k][f"q_{i}"] for i in range(4)] == [exact_quantile(vs, q) for q in (0.0, 0.5, 0.9, 1.0)]


@pytest.mark.parametrize("shape", ["shuffled", "sorted", "reversed", "repeated"])
def test_rank_error_bound(spark, shape):
    n = 300_000
    base = np.random.default_rng(1).lognormal(3, 2, n)
    values = {"shuffled": base, "sorted": np.sort(base), "reversed": np.sort(base)[::-1], "repeated": np.round(base)}[shape]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"d": np.arange(n) % 7, "v": values}))
    quantiles = [0.1, 0.5, 0.9, 0.99, 0.999, 0.9999]
    daily = qs.merge_quantile_sketches(qs.quantile_sketch(df, ["d"], "v"), ["d"])
    assert daily.selectExpr("max(size(items))").first()[0] < 1_000
    got = qs.sketch_quantiles(daily.withColumn("all", F.lit(1)), ["all"], quantiles).first()
    ordered = np.sort(values)
    assert got.n == n
    for i, q in enumerate(quantiles):
        low, high = np.searchsorted(ordered, got[f"q_{i}"], "left") / n, np.searchsorted(ordered, got[f"q_{i}"], "right") / n
        gap = max(0.0, low - q, q - high)
        assert gap <= qs.rank_error(q) + 1 / n, (q, gap)


def test_many_groups_in_runs(spark):
    """Groups leave a task as their runs end; the result does not depend on where."""
    rng = np.random.default_rng(4)
    rows = [(f"k{int(rng.integers(300))}" if rng.random() < 0.7 else None, float(x)) for x in rng.lognormal(2, 1, 6_000)]
    df = spark.createDataFrame(rows, "k string, v double")
    whole = sorted(qs.sketch_quantiles(qs.quantile_sketch(df, ["k"], "v"), ["k"], [0.5, 0.9]).collect(), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        cut = qs.sketch_quantiles(qs.quantile_sketch(df, ["k"], "v"), ["k"], [0.5, 0.9], merge_rows=40)
        assert sorted(cut.collect(), key=str) == whole and len(whole) == 301
        merged = qs.merge_quantile_sketches(qs.quantile_sketch(df, ["k"], "v"), ["k"], merge_rows=40)
        assert sorted(qs.sketch_quantiles(merged, ["k"], [0.5, 0.9]).collect(), key=str) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sketch_edges(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert qs.sketch_quantiles(qs.quantile_sketch(empty, ["k"], "v"), ["k"], [0.5]).count() == 0
    one = qs.sketch_quantiles(qs.quantile_sketch(spark.range(10).selectExpr("cast(id as double) v"), [], "v"), [], [0.5]).first()
    assert (one.n, one.q_0) == (10, 4.0)
    with pytest.raises(ValueError):
        qs.quantile_sketch(empty, ["k"], "v", k=5)
    with pytest.raises(ValueError):
        qs.quantile_sketch(empty.toDF("level", "v"), ["level"], "v")


# --- rolling totals ----------------------------------------------------------------------------------


def brute_rolling(daily, windows, horizon=None):
    out = {}
    for e in {k[0] for k in daily}:
        days = [d for (x, d) in daily if x == e]
        for d in range(min(days), (horizon if horizon is not None else max(days)) + 1):
            out[e, d] = [sum(daily.get((e, x), (0, 0))[m] for x in range(d - w + 1, d + 1)) for w in windows for m in (0, 1)]
    return out


def as_days(runs, windows=(7, 30)):
    return {(r.entity, r.day_no): [r[f"{m}_{w}"] for w in windows for m in ("cents", "n")] for r in expand_days(runs, windows).collect()}


def test_rolling_state(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{rng.integers(5)}", int(rng.integers(80)), int(rng.integers(1, 900))) for _ in range(120)] + [(None, 3, 5), ("c1", None, 5), ("c1", 4, None)]
    df = spark.createDataFrame(rows, "card string, at bigint, next_at bigint")
    daily = daily_totals(df, "card", "at", "next_at")
    exact = defaultdict(lambda: (0, 0))
    for c, d, a in rows:
        if None not in (c, d, a):
            exact[c, d] = (exact[c, d][0] + a, exact[c, d][1] + 1)
    assert as_days(rolling_state(daily)) == brute_rolling(exact, (7, 30))
    assert as_days(rolling_state(daily, horizon=95)) == brute_rolling(exact, (7, 30), 95)
    assert as_days(rolling_state(daily, (3,)), (3,)) == brute_rolling(exact, (3,))
    assert rolling_state(daily.limit(0)).count() == 0


def test_advance_and_correct(spark):
    rows = [("a", 0, 100, 1), ("a", 6, 50, 1), ("b", 3, 10, 2), ("a", 12, 5, 1), ("b", 12, 1, 1)]
    daily = spark.createDataFrame(rows, "entity string, day_no bigint, cents bigint, n bigint")
    exact = {(e, d): (c, n) for e, d, c, n in rows}
    state = spark.createDataFrame([], "entity string, cents_7 bigint, n_7 bigint, cents_30 bigint, n_30 bigint")
    for day in range(13):
        state = advance_day(state, daily, day)
        got = {r.entity: list(r)[1:] for r in state.collect()}
        want = {e: v for (e, d), v in brute_rolling(exact, (7, 30), 12).items() if d == day}
        assert got == want
        state = spark.createDataFrame(state.collect(), state.schema)
    change = spark.createDataFrame([("a", 6, -20, 0), ("b", 5, 7, 1)], daily.schema)
    fixed = {("a", 0): (100, 1), ("a", 6): (30, 1), ("a", 12): (5, 1), ("b", 3): (10, 2), ("b", 5): (7, 1), ("b", 12): (1, 1)}
    corrected = correct_state(daily, change, 2)
    got = {(r.entity, r.day_no): [r.cents_7, r.n_7, r.cents_30, r.n_30] for r in corrected.filter("day_no <= 12").collect()}
    assert got == {k: v for k, v in brute_rolling(fixed, (7, 30)).items() if k[1] >= {"a": 6, "b": 5}[k[0]]}
    both = expand_days(rolling_state(daily)).withColumn("version", F.lit(1)).unionByName(corrected, allowMissingColumns=True)
    final = {(r.entity, r.day_no): [r.cents_7, r.n_7, r.cents_30, r.n_30] for r in latest_version(both).collect() if r.n_30 and r.day_no <= 12}
    assert final == {k: v for k, v in brute_rolling(fixed, (7, 30)).items() if v[3]}


def test_moved_payments_leave_nothing_behind(spark):
    old = spark.createDataFrame([("a", 2, 100, 1), ("a", 40, 5, 1), ("b", 9, 3, 1)], "entity string, day_no bigint, cents bigint, n bigint")
    new = spark.createDataFrame([("a", 4, 100, 1), ("a", 40, 5, 1), ("c", 1, 8, 1)], old.schema)
    change = daily_corrections(old, new)
    assert change.count() == 4
    both = expand_days(rolling_state(old, horizon=60)).withColumn("version", F.lit(1)).unionByName(correct_state(old, change, 2, horizon=60), allowMissingColumns=True)
    final = {(r.entity, r.day_no): [r.cents_7, r.n_7, r.cents_30, r.n_30] for r in latest_version(both).collect() if r.n_30}
    exact = {(e, d): (c, n) for e, d, c, n in (tuple(r) for r in new.collect())}
    assert final == {k: v for k, v in brute_rolling(exact, (7, 30), 60).items() if v[3]}


def test_maintained_state_is_the_window_form(spark):
    rng = np.random.default_rng(16)
    made = lambda n: {(f"c{rng.integers(6)}", int(rng.integers(70))): (int(rng.integers(1, 900)), int(rng.integers(1, 4))) for _ in range(n)}
    old = made(50)
    new = {k: v for k, v in old.items() if rng.random() < 0.8} | made(25) | {("late", 3): (5, 1), ("late", 60): (7, 1)}
    frame = lambda x: spark.createDataFrame([(*k, *v) for k, v in x.items()], "entity string, day_no bigint, cents bigint, n bigint")
    state = maintain_state(frame(old), frame(new), Scratch(spark, "t"), horizon=72, days_advanced=5)
    first = {e: min(d for x, d in new if x == e) for e, _ in new}
    values = lambda r: [r.cents_7, r.n_7, r.cents_30, r.n_30]
    got = {(r.entity, r.day_no): values(r) for r in state.rows().collect() if r.day_no >= first.get(r.entity, 99)}
    want = brute_rolling(new, (7, 30), 72)
    assert got == want
    hot = state.where("cents_30 >= 900")
    assert {(r.entity, r.day_no): values(r) for r in hot.collect()} == {k: v for k, v in want.items() if v[2] >= 900}
    nothing = maintain_state(frame(old).limit(0), frame(old).limit(0), Scratch(spark, "t"), horizon=0)
    assert nothing.rows().count() == 0


# --- entity features ---------------------------------------------------------------------------------


def test_entity_features(spark, tmp_path):
    rows = [("c1", "x", 5, 100), ("c1", "x", 9, 50), ("c1", None, 7, 1), ("c2", "y", None, None), (None, "x", 1, 1), ("c2", "y", 3, 2), ("c3", "z", 1, 1)]
    df = spark.createDataFrame(rows, "entity string, type_no string, last_time bigint, cents bigint")
    book = TypeDictionary(spark, str(tmp_path / "types"))
    assert book.read().count() == 0
    types = book.extend(df.select(F.col("type_no").alias("event_type")))
    assert {(r.type_no, r.event_type, r.version) for r in types.collect()} == {(0, "x", 1), (1, "y", 1), (2, "z", 1)}
    entries = entity_entries(df, "entity", "type_no", "last_time", "cents", types)
    merged = merge_entries(entries.unionByName(entries))
    assert {(r.entity, r.type_no, r.n, r.cents, r.last_time) for r in merged.collect()} == {("c1", 0, 4, 300, 9), ("c1", -1, 2, 2, 7), ("c2", 1, 4, 4, 3), ("c3", 2, 2, 2, 1)}
    table = {r.entity: r for r in feature_table(sparse_vectors(entries), types).collect()}
    assert (table["c1"].n_0, table["c1"].total_0, table["c1"].last_0, table["c1"].n_1, table["c1"].last_1, table["c1"].n_all) == (2, 1.5, 9, 0, None, 3)
    assert (table["c2"].n_1, table["c2"].total_1, table["c2"].last_1, table["c2"].n_2, table["c2"].total_all) == (2, 0.02, 3, 0, 0.02)
    assert feature_table(sparse_vectors(entries.limit(0)), types).count() == 0
    empty = TypeDictionary(spark, str(tmp_path / "none")).extend(df.limit(0).select(F.col("type_no").alias("event_type")))
    assert entity_entries(df, "entity", "type_no", "last_time", "cents", empty).count() == 1
    assert feature_table(sparse_vectors(entries.limit(0)), empty).columns == ["entity", "n_all", "total_all", "last_time_all"]


def test_days_with_different_types_merge(spark, tmp_path):
    events = lambda rows: spark.createDataFrame(rows, "e string, t string, at bigint, c bigint")
    days = [events([("c1", "pay", 1, 10)]), events([("c1", "auth", 2, 3), ("c1", "pay", 3, 5), ("c2", "auth", 4, 1)]), events([("c2", "pay", 9, 2)])]
    book, parts = TypeDictionary(spark, str(tmp_path / "types")), []
    for day in days:
        types = book.extend(day.select(F.col("t").alias("event_type")))
        parts.append(entity_entries(day, "e", "t", "at", "c", types))
    assert {r.event_type: (r.type_no, r.version) for r in types.collect()} == {"pay": (0, 1), "auth": (1, 2)}
    merged = merge_entries(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = {(r.entity, r.event_type): (r.n, r.cents, r.last_time) for r in with_type_names(merged, types).collect()}
    assert got == {("c1", "pay"): (2, 15, 3), ("c1", "auth"): (1, 3, 2), ("c2", "auth"): (1, 1, 4), ("c2", "pay"): (1, 2, 9)}
    with pytest.raises(Exception, match="lacks"):
        feature_table(sparse_vectors(merged), types.filter("version = 1")).collect()


# --- heavy keys --------------------------------------------------------------------------------------


def test_keyed_totals(spark):
    rows = [("a", "q", 5)] * 60 + [(f"k{i}", "q", None) for i in range(38)] + [(None, "r", 7)] * 2
    df = spark.createDataFrame(rows, "n string, field_name string, cents int")
    got = keyed_totals(df, ["n", "field_name"], "cents")
    by = {(r.field_name, r.key_value): (r.n, r.n_amounts, r.cents) for r in got.collect()}
    assert by["n", "a"] == (60, 60, 300) and by["n", None] == (2, 2, 14) and by["n", "k3"] == (1, 0, 0) and by["field_name", "q"] == (98, 60, 300)
    assert {(r.field_name, r.key_value) for r in heavy_keys(got, 0.02).collect()} == {("n", "a"), ("field_name", "q"), ("field_name", "r")}
    assert heavy_keys(keyed_totals(df.limit(0), ["n"], "cents"), 0.01).count() == 0


def test_map_side_combining_is_planned(spark):
    plan = keyed_totals(spark.range(10).selectExpr("id % 2 as k", "id as c"), ["k"], "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


# --- as known at the time ----------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300))
def test_dyadic_cover(spark, a, b):
    nodes = spark.range(1).select(dyadic_nodes(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), 0, 9).alias("n")).first()["n"]
    covered = Counter(x for n in nodes for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
    assert covered == Counter(range(a, b))


def test_enclosing_nodes(spark):
    got = spark.range(1).select(enclosing_nodes(F.lit(13).cast("bigint"), F.lit(0b11010).cast("bigint"), 1, 3).alias("n")).first()["n"]
    assert [(n["level"], n["node"]) for n in got] == [(1, 6), (3, 1)]


def test_asof_matches(spark):
    rng = np.random.default_rng(9)
    facts = [(f"c{rng.integers(4)}", i, int(rng.integers(400_000)), None if rng.random() < 0.3 else int(rng.integers(400_000))) for i in range(60)] + [(None, 98, 1, 2), ("c1", 99, None, 5)]
    events = [(i, f"c{rng.integers(6)}", int(rng.integers(400_000))) for i in range(80)] + [(90, None, 5), (91, "c1", None), (92, "c1", facts[0][2])]
    f = spark.createDataFrame(facts, "card string, fid int, valid_from bigint, valid_to bigint")
    e = spark.createDataFrame(events, "eid int, card string, level bigint")
    got = {(r.eid, r.fid) for r in asof_matches(e, f, "card", "level", "valid_from", "valid_to", low=12).collect()}
    want = {(i, k) for i, c, t in events for d, k, a, b in facts if c is not None and c == d and t is not None and a is not None and a <= t and (b is None or t < b)}
    assert got == want
    assert asof_matches(e.limit(0), f, "card", "level", "valid_from", "valid_to").count() == 0
    both = asof_matches(e.withColumn("valid_from", F.lit("x")).withColumn("note", F.lit(1)), f.withColumn("note", F.lit(2)), "card", "level", "valid_from", "valid_to", low=12)
    assert {(r.eid, r.fid) for r in both.collect()} == want and {"fact_valid_from", "note", "fact_note"} <= set(both.columns)


def test_asof_totals(spark):
    rng = np.random.default_rng(10)
    facts = [(f"c{rng.integers(3)}", i, int(rng.integers(900)), None if rng.random() < 0.3 else int(rng.integers(900))) for i in range(60)] + [(None, 9, 1, 2), ("c1", 9, None, 3)]
    events = [(i, f"c{rng.integers(5)}", int(rng.integers(1_000))) for i in range(90)] + [(90, "c1", 5), (91, "c1", 5), (92, None, 4), (93, "c1", None)]
    f = spark.createDataFrame(facts, "card string, l int, a bigint, b bigint")
    e = spark.createDataFrame(events, "eid int, card string, n bigint")
    got = {(r.card, r.n): (r.n_valid, r.l) for r in asof_totals(e, f, "card", "n", "a", "b", "l").collect()}
    want = {}
    for _, c, t in events:
        valid = [k for d, k, a, b in facts if c is not None and t is not None and d == c and a is not None and a <= t and (b is None or t < b)]
        if valid:
            want[c, t] = (len(valid), max(valid))
    assert got == want


@pytest.mark.parametrize("shift", [0, -5_000, 2**24, 2**31 + 5, 2**40])
def test_asof_any_times_and_one_entity_with_most_events(spark, shift):
    facts = [("hot", k, shift + 40 * k, None if k % 3 else shift + 40 * k + 700) for k in range(20)] + [("c", 50, shift - 9_000, shift + 3), ("c", 51, shift + 10**7, None)]
    events = [(i, "hot", shift + i) for i in range(900)] + [(1_000 + i, f"c{i}", shift) for i in range(60)] + [(2_000, "c", shift), (2_001, "c", shift + 3)]
    f = spark.createDataFrame(facts, "card string, fid bigint, a bigint, b bigint")
    e = spark.createDataFrame(events, "eid int, card string, t bigint")
    want = {(i, k) for i, c, t in events for d, k, a, b in facts if c == d and a <= t and (b is None or t < b)}
    assert {(r.eid, r.fid) for r in asof_matches(e, f, "card", "t", "a", "b", low=4).collect()} == want
    totals = {(r.card, r.t): (r.n_valid, r.fid) for r in asof_totals(e, f, "card", "t", "a", "b", "fid").collect()}
    assert totals == {(c, t): (len(v), max(v)) for i, c, t in events if (v := [k for j, k in want if j == i])}


def test_validity_of_versions(spark):
    rows = [("s", 1, 10), ("s", 2, 10), ("s", 3, 20), ("s", 3, 20), ("s", 4, None), (None, 5, 1), ("u", 6, 0)]
    df = spark.createDataFrame(rows, "k string, rid int, known bigint")
    got = {(r.rid, r.valid_from, r.valid_to) for r in validity_of_versions(df, "k", "known", "rid").collect()}
    assert got == {(1, 10, 10), (2, 10, 20), (3, 20, None), (6, 0, None)}
