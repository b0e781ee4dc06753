"""The payment queries p1..p7: each applies its operator to the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.normal import cents, day_number, normal_form, paid, timed
from tidegraph.operators.asof_attributes import asof_matches, asof_totals, validity_of_versions
from tidegraph.operators.contraction import link_groups
from tidegraph.operators.distinct_bitmap import BitmapShape, cube_sketches, distinct_sketch, estimate_distinct
from tidegraph.operators.entity_features import TypeDictionary, entity_entries, feature_table, sparse_vectors, with_type_names
from tidegraph.operators.keyed_totals import heavy_keys, keyed_totals
from tidegraph.operators.quantile_sketch import quantile_sketch, rank_error, sketch_quantiles
from tidegraph.operators.current import DELIVERY_ORDER
from tidegraph.operators.rolling import VersionedState, maintain_state
from tidegraph.operators.skew import fair_join, frequent_keys
from tidegraph.plans import payment_sql as sql
from tidegraph.session import Scratch, broadcast_if_small
from tidegraph.sources.tables import current_transactions, table

LINK_FIELDS = ("card_id", "customer_id", "device_id", "address_id")
MEASURES = ("amount", "specific_max_entity_degree", "specific_max_pagerank")


# --- p1 distinct counts ---------------------------------------------------------------------------


def _p1_rows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    cur = current_transactions(spark, d, ["transaction_time", "recipient_id", "card_id", "device_id", *more]).filter(timed())
    return cur.select(
        day_number().alias("day_no"), normal_form("recipient_id").alias("recipient_id"), *(normal_form(c).alias(c) for c in more),
        normal_form("card_id").alias("card_id"), normal_form("device_id").alias("device_id"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _p1_rows(spark, d).filter(F.col("recipient_id").isNotNull())
    keys = ["day_no", "recipient_id"]
    estimates = estimate_distinct(distinct_sketch(rows, keys, {"card": "card_id", "device": "device_id"}), keys, ["card", "device"])
    # The cases keep away from both limits by more than the sketch's error.
    return estimates.filter((F.round("n_card") >= 20) & (F.col("n_card") >= 3 * F.col("n_device"))).select(*keys)


def p1_distinct_cube(spark: SparkSession, d: str) -> DataFrame:
    """Estimated card and device counts for every combination of day, recipient and product."""
    keys = ["day_no", "recipient_id", "product_code"]
    daily = distinct_sketch(_p1_rows(spark, d, "product_code"), keys, {"card": "card_id", "device": "device_id"})
    return estimate_distinct(cube_sketches(daily, keys), ["grouping_level", *keys], ["card", "device"])


def p1_cube_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row per group of the cube: exact counts, and whether the estimates are within five standard errors (or one) of them."""
    keys, fields = ["day_no", "recipient_id", "product_code"], {"card": "card_id", "device": "device_id"}
    rows = Scratch(spark, "p1").table(_p1_rows(spark, d, "product_code"), "rows")
    estimates = estimate_distinct(cube_sketches(distinct_sketch(rows, keys, fields), keys), ["grouping_level", *keys], list(fields))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("v")) for f, c in fields.items()))
    marks = rows.select(*keys, F.inline(each)).filter("v IS NOT NULL").distinct()
    # Every identifier once per group of the cube, then counted: both steps combine map-side.
    level = lambda mask: F.struct(F.lit(mask).alias("grouping_level"), *(F.when(F.lit(not mask >> (len(keys) - 1 - i) & 1), F.col(k)).alias(k) for i, k in enumerate(keys)))
    wide = marks.select(F.explode(F.array(*map(level, range(1 << len(keys))))).alias("g"), "field", "v").select("g.*", "field", "v").distinct()
    exact = wide.groupBy("grouping_level", *keys).agg(*(F.count_if(F.col("field") == f).alias(f"exact_{f}") for f in fields))
    same = F.col("e.grouping_level") == F.col("x.grouping_level")
    for k in keys:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"x.{k}"))
    both = exact.alias("x").join(estimates.alias("e"), same, "left")
    near = lambda f: F.abs(F.col(f"n_{f}") - F.col(f"exact_{f}")) <= F.greatest(F.lit(1.0), 5 * BitmapShape().relative_error() * F.col(f"exact_{f}"))
    return both.select("x.grouping_level", *(f"x.{k}" for k in keys), *(f"exact_{f}" for f in fields), *(F.coalesce(near(f), F.lit(False)).alias(f"{f}_within") for f in fields))


# --- p2 groups of linked transactions -------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cur = current_transactions(spark, d, LINK_FIELDS).select("transaction_id", *(normal_form(c).alias(c) for c in LINK_FIELDS))
    hubs = table(spark, d, "hub_devices").select(F.col("device_id").alias("hub")).filter("hub IS NOT NULL").distinct()
    linked = cur.join(broadcast_if_small(hubs), F.col("device_id") == F.col("hub"), "left").withColumn(
        "device_id", F.when(F.col("hub").isNull(), F.col("device_id"))
    )
    return link_groups(linked.drop("hub"), "transaction_id", LINK_FIELDS)


# --- p3 percentiles -------------------------------------------------------------------------------


def _p3_values(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``(measure, *columns, value)`` of current transactions."""
    cur = current_transactions(spark, d, [*columns, "amount"])
    features = table(spark, d, "graph_features").select("transaction_id", *MEASURES[1:]).dropDuplicates(["transaction_id"])
    joined = cur.join(features, "transaction_id", "left")
    each = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES))
    return joined.select(*columns, F.inline(each)).filter((F.col("value") >= 0) & ~F.isnan("value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["measure", "recipient_id"]
    values = _p3_values(spark, d, "recipient_id").withColumn("recipient_id", normal_form("recipient_id")).filter("recipient_id IS NOT NULL")
    q = sketch_quantiles(quantile_sketch(values, keys, "value"), keys, [0.5, 0.9])
    return q.filter("n >= 25 AND q_1 > 0 AND q_1 >= 8 * q_0").select(*keys)


def _p3_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """``(measure, value, day_no, dimension, key_value)``: every value once per recipient, product and day."""
    values = _p3_values(spark, d, "recipient_id", "product_code", "transaction_time").select(
        "measure", "value", F.when(timed(), day_number()).alias("day_no"),
        F.inline(F.array(
            F.struct(F.lit("recipient_id").alias("dimension"), normal_form("recipient_id").alias("key_value")),
            F.struct(F.lit("product_code").alias("dimension"), normal_form("product_code").alias("key_value")),
            F.struct(F.lit("day_no").alias("dimension"), F.when(timed(), day_number().cast("string")).alias("key_value")),
        )),
    )
    return values.filter("key_value IS NOT NULL")


P3_SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def _p3_estimates(values: DataFrame) -> DataFrame:
    daily = quantile_sketch(values, ["measure", "dimension", "key_value", "day_no"], "value")
    q = sketch_quantiles(daily, ["measure", "dimension", "key_value"], list(P3_SHARES.values()))
    return q.select("measure", "dimension", "key_value", "n", *(F.col(f"q_{i}").alias(name) for i, name in enumerate(P3_SHARES)))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and high percentiles per measure and recipient, product or day, out of daily sketches."""
    return _p3_estimates(_p3_dimensions(spark, d))


def p3_rank_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row per group: its exact size, and whether the rank of every percentile is within twice the stated bound."""
    scratch = Scratch(spark, "p3")
    values = scratch.table(_p3_dimensions(spark, d), "values")
    groups = F.concat_ws("\u0001", "measure", "dimension", "key_value")
    found = scratch.table(_p3_estimates(values).withColumn("g", groups), "found")
    met = fair_join(values.select(groups.alias("g"), "value"), found.select("g", *P3_SHARES), "g", F.col("value"), frequent_keys(found, "g"))
    ranks = met.groupBy("g").agg(
        F.count(F.lit(1)).alias("size"), *(F.count_if(F.col("value") <= F.col(p)).alias(f"upto_{p}") for p in P3_SHARES), *(F.count_if(F.col("value") < F.col(p)).alias(f"below_{p}") for p in P3_SHARES)
    )
    n, ok = F.col("size"), F.col("size") == F.col("n")
    for p, q in P3_SHARES.items():
        slack = 2 * rank_error(q) * n + 1
        ok = ok & (F.col(f"upto_{p}") >= q * n - slack) & (F.col(f"below_{p}") <= q * n + slack)
    return ranks.join(found, "g").select("measure", "dimension", "key_value", "n", ok.alias("ranks_within"))


# --- p4 rolling totals ----------------------------------------------------------------------------


def _p4_state(spark: SparkSession, d: str) -> tuple[VersionedState, DataFrame, int]:
    """(state, ``(entity, first_day, last_day)``, last day of the data).

    Version 1 is what the deliveries up to a week before the last one gave; version 2 recomputes the
    card days that the later deliveries (new, late, changed or moved payments) reach. Both versions'
    daily totals come out of one pass: per transaction the current delivery then and now.
    """
    scratch = Scratch(spark, "p4")
    sent = table(spark, d, "transactions").select("transaction_id", "transaction_time", "amount", "card_id", *DELIVERY_ORDER).filter("transaction_id IS NOT NULL")
    cut = sent.agg(F.max("raw_ingested_at") - F.expr("INTERVAL 7 DAYS")).first()[0]
    row = F.struct(*DELIVERY_ORDER, "transaction_time", "amount", "card_id")
    then = F.max(F.when(F.col("raw_ingested_at") <= F.lit(None if cut is None else str(cut)).cast("timestamp_ntz"), row))
    both = sent.groupBy("transaction_id").agg(F.max(row).alias("now"), then.alias("then"))
    same = F.col("then.raw_delivery_id").eqNullSafe(F.col("now.raw_delivery_id"))
    each = F.array_compact(F.array(
        F.struct(F.col("now").alias("r"), same.alias("is_old"), F.lit(True).alias("is_new")),
        F.when(~same & F.col("then").isNotNull(), F.struct(F.col("then").alias("r"), F.lit(True).alias("is_old"), F.lit(False).alias("is_new"))),
    ))
    flat = both.select(F.inline(each)).select("r.transaction_time", "r.amount", "r.card_id", "is_old", "is_new").filter(timed() & paid())
    keyed = flat.select(normal_form("card_id").alias("entity"), day_number().alias("day_no"), cents().alias("c"), "is_old", "is_new").filter("entity IS NOT NULL")
    sums = [
        x.alias(f"{name}_{flag}")
        for flag in ("is_old", "is_new")
        for name, x in (("cents", F.coalesce(F.sum(F.when(F.col(flag), F.col("c"))), F.lit(0))), ("n", F.count_if(flag)))
    ]
    daily = scratch.table(keyed.groupBy("entity", "day_no").agg(*sums), "daily")
    of = lambda flag: daily.select("entity", "day_no", F.col(f"cents_{flag}").alias("cents"), F.col(f"n_{flag}").alias("n")).filter("n > 0")
    old, new = of("is_old"), of("is_new")
    horizon = new.agg(F.coalesce(F.max("day_no"), F.lit(0))).first()[0]
    spans = new.groupBy("entity").agg(F.min("day_no").alias("first_day"), F.max("day_no").alias("last_day"))
    return maintain_state(old, new, scratch, horizon=horizon), spans, horizon


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    state, spans, _ = _p4_state(spark, d)
    hot = state.where("cents_30 >= 150000 AND cents_7 * 5 >= cents_30 * 4").join(spans, "entity")
    return hot.filter("day_no BETWEEN first_day + 29 AND last_day").select(F.col("entity").alias("card_id"), "day_no")


def p4_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of the last 7 and 30 days per card and day, from its first to its last day."""
    state, spans, _ = _p4_state(spark, d)
    days = state.rows().join(spans, "entity").filter("day_no BETWEEN first_day AND last_day")
    mean = lambda w: F.round(F.try_divide(F.col(f"cents_{w}") / 100.0, F.col(f"n_{w}")), 6).alias(f"mean_{w}")
    return days.select(
        F.col("entity").alias("card_id"), "day_no", (F.col("cents_7") / 100.0).alias("total_7"), "n_7",
        (F.col("cents_30") / 100.0).alias("total_30"), "n_30", mean(7), mean(30),
    )


def p4_corrected_totals(spark: SparkSession, d: str) -> DataFrame:
    """The rolling totals of every card and day, with or without a payment, up to the last day of the data."""
    state, spans, _ = _p4_state(spark, d)
    days = state.rows().join(spans.select("entity", "first_day"), "entity").filter("day_no >= first_day")
    return days.select(F.col("entity").alias("card_id"), "day_no", "cents_7", "n_7", "cents_30", "n_30")


# --- p5 entity features ---------------------------------------------------------------------------


def _p5_entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(entries, dictionary); a daily job would keep the dictionary's folder and extend it."""
    kinds = table(spark, d, "transactions").select(normal_form("raw_event_type").alias("event_type"))
    types = TypeDictionary(spark, Scratch(spark, "p5").root + "/types").extend(kinds)
    cur = current_transactions(spark, d, ["transaction_time", "amount", "card_id", "raw_event_type"]).filter(timed() & paid())
    rows = cur.select(normal_form("card_id").alias("card"), normal_form("raw_event_type").alias("e"), "transaction_time", cents().alias("c"))
    return entity_entries(rows, "card", "e", "transaction_time", "c", types), types


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    entries, types = _p5_entries(spark, d)
    each = sparse_vectors(entries).select("entity", "cents_all", "last_time_all", F.inline("entries"))
    hit = each.filter("type_no >= 0 AND n >= 5 AND cents * 2 >= cents_all AND last_time <= last_time_all - 2592000")
    return with_type_names(hit, types).select(F.col("entity").alias("card_id"), "event_type")


def p5_entity_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per card with count, total and latest time of every event type as columns."""
    entries, types = _p5_entries(spark, d)
    return feature_table(sparse_vectors(entries), types).withColumnRenamed("entity", "card_id")


def p5_sparse_entries(spark: SparkSession, d: str) -> DataFrame:
    """The same features as one row per card and event type that occurs."""
    entries, types = _p5_entries(spark, d)
    each = sparse_vectors(entries).select("entity", F.inline("entries"))
    return with_type_names(each, types).select(F.col("entity").alias("card_id"), "event_type", "n", "cents", "last_time")


# --- p6 heavy keys --------------------------------------------------------------------------------


def p6_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums per device and per payer domain, the row without value included."""
    cur = current_transactions(spark, d, ["device_id", "payer_email_domain", "amount"])
    rows = cur.select(normal_form("device_id").alias("device_id"), normal_form("payer_email_domain").alias("payer_email_domain"), F.when(paid(), cents()).alias("c"))
    return keyed_totals(rows, ["device_id", "payer_email_domain"], "c")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    totals = Scratch(spark, "p6").table(p6_key_totals(spark, d), "totals")
    return heavy_keys(totals, 0.01).select("field_name", "key_value")


# --- p7 labels as known ---------------------------------------------------------------------------


def _p7_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(timed current transactions with card, validity intervals of fraud reports per card)."""
    scratch = Scratch(spark, "p7")
    cur = current_transactions(spark, d, ["transaction_time", "card_id"]).filter(timed())
    cur = cur.select("transaction_id", "transaction_time", normal_form("card_id").alias("card")).filter("card IS NOT NULL")
    cur = scratch.table(cur, "timed")
    reports = table(spark, d, "label_reports").filter("is_fraud IS NOT NULL AND known_time IS NOT NULL")
    valid = validity_of_versions(reports.select("report_id", "transaction_id", "is_fraud", "known_time"), "transaction_id", "known_time", "report_id")
    valid = valid.filter("is_fraud = 1 AND (valid_to IS NULL OR valid_to > valid_from)")
    said = valid.select(F.col("transaction_id").alias("sid"), "report_id", "known_time", "valid_from", "valid_to")
    on = cur.select(F.col("transaction_id").alias("sid"), F.col("transaction_time").alias("s_time"), "card").join(said, "sid")
    # The report speaks to later transactions only, so the interval also starts after S itself.
    facts = on.select("card", "report_id", "known_time", F.greatest("valid_from", F.col("s_time") + 1).alias("valid_from"), "valid_to")
    return cur, scratch.table(facts, "facts")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cur, facts = _p7_facts(spark, d)
    return asof_matches(cur, facts, "card", "transaction_time", "valid_from", "valid_to").select("transaction_id", "report_id")


def p7_label_history(spark: SparkSession, d: str) -> DataFrame:
    """Per timed transaction: how many earlier frauds of its card were known, and when the last became known."""
    cur, facts = _p7_facts(spark, d)
    known = asof_totals(cur, facts, "card", "transaction_time", "valid_from", "valid_to", "known_time")
    return cur.join(known, ["card", "transaction_time"], "left").select(
        "transaction_id", F.coalesce("n_valid", F.lit(0)).cast("bigint").alias("known_frauds"), F.col("known_time").alias("last_known_time")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_distinct_cube, p1_cube_audit, p2_found, p3_found, p3_percentiles, p3_rank_audit, p4_found, p4_rolling_totals, p4_corrected_totals, p5_found, p5_entity_features,
        p5_sparse_entries, p6_found, p6_key_totals, p7_found, p7_label_history,
    )
}

ORACLE: dict[str, str] = {
    "p1_found": sql.P1_FOUND,
    "p1_cube_audit": sql.P1_CUBE,
    "p2_found": sql.P2_FOUND,
    "p3_rank_audit": sql.P3_RANKS,
    "p5_entity_features": sql.P5_FEATURES,
    "p3_found": sql.P3_FOUND,
    "p4_found": sql.P4_FOUND,
    "p4_rolling_totals": sql.P4_ROLLING,
    "p4_corrected_totals": sql.P4_CORRECTED,
    "p5_found": sql.P5_FOUND,
    "p5_sparse_entries": sql.P5_ENTRIES,
    "p6_found": sql.P6_FOUND,
    "p6_key_totals": sql.P6_TOTALS,
    "p7_found": sql.P7_FOUND,
    "p7_label_history": sql.P7_HISTORY,
}
