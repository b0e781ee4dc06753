"""Local connection views of alerts, masked labels, and checks that no target reaches the view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.operators.asof import BUCKET_SECONDS, bucket_offsets, entity_edges, strictly_earlier, subset_keys
from tidegraph.operators.attach import one_to_one_left
from tidegraph.schema import SPECIFIC_TYPES, TARGET_NAMES
from tidegraph.session import Scratch

NEIGHBOURS = 20


def masked(value: Column | str, visible: int = 8) -> Column:
    """A stable reference that does not show the value."""
    c = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit("ref-"), F.left(F.sha2(c, 256), F.lit(visible)))


def target_fields(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of fields named like a target at any depth of a type."""
    if isinstance(kind, T.StructType):
        found = []
        for f in kind.fields:
            path = f"{at}.{f.name}" if at else f.name
            found += ([path] if f.name in TARGET_NAMES else []) + target_fields(f.dataType, path)
        return found
    if isinstance(kind, T.ArrayType):
        return target_fields(kind.elementType, at + "[]")
    if isinstance(kind, T.MapType):
        return target_fields(kind.valueType, at + "{}")
    return []


def contains_target_key(value: Any) -> bool:
    """The same for plain values: any mapping key named like a target."""
    if isinstance(value, Mapping):
        return bool(TARGET_NAMES & set(map(str, value))) or any(map(contains_target_key, value.values()))
    return isinstance(value, Sequence) and not isinstance(value, (str, bytes)) and any(map(contains_target_key, value))


def require_target_free(df: DataFrame) -> None:
    """Raises if a column, a nested field or a string-keyed map's key is named like a target."""
    found = target_fields(df.schema)
    if found:
        raise ValueError("targets in view data: " + ", ".join(found))

    def maps(kind: T.DataType, c: Column) -> list[Column]:
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            return [F.coalesce(F.arrays_overlap(F.map_keys(c), F.array(*map(F.lit, sorted(TARGET_NAMES)))), F.lit(False))]
        if isinstance(kind, T.StructType):
            return [m for f in kind.fields for m in maps(f.dataType, c[f.name])]
        if isinstance(kind, T.ArrayType):
            inner = lambda x: maps(kind.elementType, x)
            if inner(F.lit(None)):
                return [F.coalesce(F.exists(c, lambda x: F.greatest(*[i.cast("int") for i in inner(x)], F.lit(0)) > 0), F.lit(False))]
        return []

    tests = [m for f in df.schema.fields for m in maps(f.dataType, F.col(f.name))]
    if tests and not df.filter(F.greatest(*(t.cast("int") for t in tests), F.lit(0)) > 0).isEmpty():
        raise ValueError("targets in map keys of view data")


def _sharers(rows: DataFrame, selected: DataFrame, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """(counts, best sharers) of every selected transaction.

    Counts are ``(transaction_id, found)``, the distinct strictly earlier transactions sharing a
    specific entity, by inclusion and exclusion over entity subsets. A transaction among the best
    ``neighbours`` shares some subset S and nothing more, and fewer than ``neighbours`` later ones
    share all of S; so the latest ``neighbours`` of each subset are candidates enough. They are
    picked by position: a subset's rows are numbered in time order, and a selected row with p
    strictly earlier ones takes the positions up to p by an equi-join. No pair beyond these
    candidates is made, even for an entity that a third of all rows share.
    """
    scratch = Scratch(rows.sparkSession, "views")
    ids = selected.select("transaction_id").distinct()
    columns = list(SPECIFIC_TYPES)
    asked = rows.join(ids, "transaction_id", "left_semi")
    spread = subset_keys(rows, columns, ["transaction_id", "transaction_time"])
    wanted = subset_keys(asked, columns, []).select("k1", "k2").distinct()
    spread = scratch.table(spread.join(wanted, ["k1", "k2"], "left_semi").withColumn("__n", F.lit(1).cast("bigint")), "spread")
    earlier = strictly_earlier(spread, ["k1", "k2"], "transaction_time", ["__n"])
    mine = scratch.table(earlier.join(ids, "transaction_id", "left_semi"), "mine")
    counts = mine.groupBy("transaction_id").agg(F.sum(F.col("sign") * F.col("__n")).alias("found"))
    placed = spread.withColumn("__bucket", F.floor(F.col("transaction_time") / F.lit(BUCKET_SECONDS)).cast("bigint"))
    w = Window.partitionBy("k1", "k2", "__bucket").orderBy("transaction_time", F.col("transaction_id").desc())
    inside = placed.select("k1", "k2", "__bucket", F.col("transaction_id").alias("other"), F.row_number().over(w).alias("__p"))
    offsets = bucket_offsets(placed, ["k1", "k2"], ["__n"])
    numbered = inside.join(offsets, ["k1", "k2", "__bucket"], "left").select("k1", "k2", "other", (F.col("__p") + F.coalesce("__before___n", F.lit(0))).alias("pos"))
    places = mine.filter(F.col("__n") > 0).select("k1", "k2", "transaction_id", F.explode(F.sequence(F.greatest(F.col("__n") - (neighbours - 1), F.lit(1)), F.col("__n"))).alias("pos"))
    pairs = places.join(numbered, ["k1", "k2", "pos"]).select("transaction_id", "other").distinct()
    left = asked.select("transaction_id", *(F.col(c).alias(f"__{c}") for c in columns))
    right = rows.select(F.col("transaction_id").alias("other"), "transaction_time", *columns)
    same = sum((F.coalesce((F.col(c) == F.col(f"__{c}")).cast("bigint"), F.lit(0)) for c in columns[1:]), F.coalesce((F.col(columns[0]) == F.col(f"__{columns[0]}")).cast("bigint"), F.lit(0)))
    shared = pairs.join(left, "transaction_id").join(right, "other").select(
        F.col("transaction_id").alias("selected_transaction_id"), F.col("other").alias("transaction_id"), "transaction_time", same.cast("bigint").alias("shared_entities")
    )
    order = Window.partitionBy("selected_transaction_id").orderBy(F.col("shared_entities").desc(), F.col("transaction_time").desc(), "transaction_id")
    return counts, shared.withColumn("neighbour_rank", F.row_number().over(order)).filter(F.col("neighbour_rank") <= neighbours)


def connection_view(rows: DataFrame, selected: DataFrame, *, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The ``neighbours`` best sharers per selected transaction: most shared, then latest, then id.

    ``(selected_transaction_id, transaction_id, transaction_time, shared_entities, neighbour_rank)``
    of strictly earlier transactions; ``selected`` is a set of ids, such as the alerts of a capacity.
    """
    if neighbours <= 0:
        raise ValueError("neighbours must be positive")
    require_target_free(rows)
    return _sharers(rows, selected, neighbours)[1]


def connection_summary(rows: DataFrame, selected: DataFrame, *, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per selected transaction about its view: counts found, shown, nodes, edges."""
    if neighbours <= 0:
        raise ValueError("neighbours must be positive")
    require_target_free(rows)
    ids = selected.select("transaction_id").distinct()
    counts, best = _sharers(rows, ids, neighbours)
    shown = best.groupBy(F.col("selected_transaction_id").alias("transaction_id")).agg(
        F.count(F.lit(1)).alias("shown"), F.sum("shared_entities").alias("links"), F.max("transaction_time").alias("latest")
    )
    base = rows.join(ids, "transaction_id", "left_semi").select(
        "transaction_id", "transaction_time", F.size(F.array_compact(F.array(*SPECIFIC_TYPES))).cast("bigint").alias("available")
    )
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return base.join(counts, "transaction_id", "left").join(shown, "transaction_id", "left").select(
        F.col("transaction_id").alias("selected_transaction_id"), F.col("transaction_time").alias("selected_transaction_time"), F.col("available").alias("available_specific_entities"),
        z("found").alias("historical_neighbour_count"), z("shown").alias("displayed_historical_neighbours"), (z("found") > z("shown")).alias("truncated"),
        (F.lit(1) + F.col("available") + z("shown")).alias("node_count"), (F.col("available") + z("links")).alias("edge_count"),
        F.coalesce(F.col("latest") < F.col("transaction_time"), F.lit(True)).alias("strictly_historical"),
    )


def masked_entities(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected transactions' own entities under masked labels."""
    mine = entity_edges(rows.join(selected.select("transaction_id").distinct(), "transaction_id", "left_semi"), SPECIFIC_TYPES, ["transaction_id"])
    return mine.select(
        F.col("transaction_id").alias("selected_transaction_id"), "entity_type", masked("entity_value").alias("masked_value"), masked("transaction_id", 12).alias("masked_transaction")
    )


def alerts_with_reason(alerts: DataFrame, code: str, codes: str = "reason_codes") -> DataFrame:
    """Alerts that carry exactly this reason code in their array of codes."""
    return alerts.filter(F.array_contains(codes, code))


def review_bundle(alerts: DataFrame, rows: DataFrame, features: Mapping[str, tuple[DataFrame, Sequence[str]]], review_count: int) -> DataFrame:
    """Alerts with transaction and feature columns for review, refused unless target-free and complete."""
    enriched = rows.drop(*(c for c in rows.columns if c in TARGET_NAMES))
    for _, (table, columns) in features.items():
        enriched = one_to_one_left(enriched, table.select("transaction_id", *columns), "transaction_id", complete=columns)
    require_target_free(alerts)
    bad = alerts.filter((F.col("recommended_action") != "INVESTIGATOR_REVIEW") | ~F.col("risk_score").between(0, 1) | (F.size("reasons") == 0))
    if not bad.isEmpty():
        raise ValueError("alerts must recommend review only, with a score in [0, 1] and a reason")
    out = one_to_one_left(alerts, enriched, "transaction_id", complete=["amount"])
    if out.count() != review_count:
        raise ValueError("number of alerts differs from the review count")
    return out
