"""Counts and sums over strictly earlier rows of a key.

All causal features rest on one question: the sum of a key's values up to a cutoff time. It is
answered in two levels so that a key with a large share of all rows never sits in one window
partition: rows are windowed inside ``(key, time bucket)``, and the totals of a key's buckets -
combined map-side, one small row per bucket - are summed up before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.overlap import GROUP_ROWS, frequent_values, home_terms
from tidegraph.schema import ENTITY_TYPES, HUB_TYPES, SPECIFIC_TYPES
from tidegraph.session import Scratch

BUCKET_SECONDS = 86_400


def _bucket(time: str, seconds: int) -> Column:
    return F.floor(F.col(time) / F.lit(seconds)).cast("bigint")


def bucket_offsets(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``(*keys, __bucket, __before_<sum>)``: a key's sums over its earlier ``__bucket``s, where not all are 0."""
    totals = rows.groupBy(*keys, "__bucket").agg(*(F.sum(s).alias(s) for s in sums))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__bucket", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__before_{s}") for s in sums))
    # Most keys live in one bucket: their zeros need not be joined back.
    return before.filter(" OR ".join(f"__before_{s} <> 0" for s in sums))


def _with_offset(s: str) -> Column:
    return (F.col(s) + F.coalesce(F.col(f"__before_{s}"), F.lit(0))).alias(s)


def strictly_earlier(rows: DataFrame, keys: Sequence[str], time: str, sums: Sequence[str], *, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Replaces each of ``sums`` by its sum over the key's rows with a smaller ``time`` (equal times excluded)."""
    placed = rows.withColumn("__bucket", _bucket(time, bucket_seconds))
    frame = Window.partitionBy(*keys, "__bucket").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    others = [c for c in rows.columns if c not in sums and c not in keys]
    inside = placed.select(*keys, "__bucket", *others, *(F.coalesce(F.sum(s).over(frame), F.lit(0)).alias(s) for s in sums))
    joined = inside.join(bucket_offsets(placed, keys, sums), [*keys, "__bucket"], "left")
    return joined.select(*keys, *others, *map(_with_offset, sums))


def sums_until(
    events: DataFrame, lookups: DataFrame, keys: Sequence[str], time: str, sums: Sequence[str], *, bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """For every lookup ``(*keys, time, ...)``: sums over the key's events with event time <= lookup time.

    Both sides have ``keys`` and ``time``; the result has the lookups' columns and ``sums``.
    """
    extra = [c for c in lookups.columns if c not in keys and c != time]
    a = events.select(*keys, time, F.lit(0).alias("__kind"), *sums, *(F.lit(None).cast(lookups.schema[c].dataType).alias(c) for c in extra))
    b = lookups.select(*keys, time, F.lit(1).alias("__kind"), *(F.lit(0).cast(events.schema[s].dataType).alias(s) for s in sums), *extra)
    rows = a.unionByName(b).withColumn("__bucket", _bucket(time, bucket_seconds))
    frame = Window.partitionBy(*keys, "__bucket").orderBy(time, "__kind").rangeBetween(Window.unboundedPreceding, 0)
    inside = rows.select(*keys, "__bucket", time, "__kind", *extra, *(F.sum(s).over(frame).alias(s) for s in sums)).filter("__kind = 1")
    joined = inside.join(bucket_offsets(rows, keys, sums), [*keys, "__bucket"], "left")
    return joined.select(*keys, time, *extra, *map(_with_offset, sums))


def entity_edges(rows: DataFrame, types: Mapping[str, str] = ENTITY_TYPES, keep: Sequence[str] = ("transaction_id", "transaction_time")) -> DataFrame:
    """One row ``(*keep, entity_type, entity_value)`` per entity a transaction has."""
    each = F.array(*(F.struct(F.lit(t).alias("entity_type"), F.col(c).alias("entity_value")) for c, t in types.items()))
    return rows.select(*keep, F.inline(each)).filter("entity_value IS NOT NULL")


def degree_features(rows: DataFrame) -> DataFrame:
    """Per transaction: strictly-earlier degree per entity type and its roll-ups.

    ``historical_<type>_degree`` (0 without entity), counts of entities present, known (degree > 0)
    and new, sum, maximum and mean over the entities present; the ``specific_`` ones leave out the
    domain types. One exchange for all seven types.
    """
    edges = entity_edges(rows).withColumn("degree", F.lit(1).cast("bigint"))
    seen = strictly_earlier(edges, ["entity_type", "entity_value"], "transaction_time", ["degree"])
    d = F.col("degree")
    specific = F.col("entity_type").isin(*SPECIFIC_TYPES.values())
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = seen.groupBy("transaction_id", "transaction_time").agg(
        *(zero(F.max(F.when(F.col("entity_type") == t, d))).alias(f"historical_{t}_degree") for t in ENTITY_TYPES.values()),
        F.count(d).alias("graph_entity_count"),
        F.count(F.when(d > 0, 1)).alias("graph_known_entity_count"),
        F.count(F.when(d == 0, 1)).alias("graph_new_entity_count"),
        F.sum(d).alias("graph_sum_entity_degree"),
        F.max(d).alias("graph_max_entity_degree"),
        F.count(F.when(specific, 1)).alias("specific_entity_count"),
        F.count(F.when(specific & (d > 0), 1)).alias("specific_known_entity_count"),
        zero(F.max(F.when(specific, d))).alias("specific_max_entity_degree"),
        zero(F.sum(F.when(specific, d))).alias("__specific_sum"),
    )
    return per.select(
        *(c for c in per.columns if c != "__specific_sum"),
        zero(F.try_divide(F.col("graph_sum_entity_degree"), F.col("graph_entity_count"))).alias("graph_mean_entity_degree"),
        zero(F.try_divide(F.col("__specific_sum"), F.col("specific_entity_count"))).alias("specific_mean_entity_degree"),
    )


def subset_keys(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per non-empty subset of a row's present entity columns: ``(*keep, k1, k2, sign)``.

    The number of distinct rows that share at least one value with a row is, by inclusion and
    exclusion, the sum over subsets of sign * (rows equal on the whole subset). A subset's values
    are identified by two independent 64-bit hashes.
    """
    hashed = rows.select(
        *keep,
        *(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"__a{i}") for i, c in enumerate(columns)),
        *(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c), F.lit(i + 1))).alias(f"__b{i}") for i, c in enumerate(columns)),
    )
    each = []
    for size in range(1, len(columns) + 1):
        for subset in combinations(range(len(columns)), size):
            present = F.col(f"__a{subset[0]}").isNotNull()
            for i in subset[1:]:
                present = present & F.col(f"__a{i}").isNotNull()
            mask = sum(1 << i for i in subset)
            key = F.struct(
                F.xxhash64(F.lit(mask), *(F.col(f"__a{i}") for i in subset)).alias("k1"), F.xxhash64(*(F.col(f"__b{i}") for i in subset), F.lit(mask)).alias("k2"),
                F.lit(1 if size % 2 else -1).cast("bigint").alias("sign"),
            )
            each.append(F.when(present, key))
    return hashed.select(*keep, F.explode(F.array_compact(F.array(*each))).alias("__k")).select(*keep, "__k.*")


def sharing_sums(rows: DataFrame, columns: Sequence[str], values: Sequence[str], *, delay: int = 1, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(transaction_id, *values)``: sums of ``values`` over the distinct rows at least ``delay`` older that share a value; rows without any are left out.

    No pairs are built. Subsets of frequent entities alone are prefix sums, all others are counted
    at one of their other entities (``overlap``), some types at a time, whose shuffle files are
    deleted before the next.
    """
    scratch = Scratch(rows.sparkSession, "sharing-sums")
    columns = sorted(columns, key=lambda c: c in HUB_TYPES)
    frequent = frequent_values(rows, columns, scratch, group_rows)
    terms = [
        scratch.table(home_terms(rows, columns, homes, frequent, values, delay), f"homes-{homes[0]}")
        for homes in (range(a, min(b, len(columns))) for a, b in ((0, 1), (1, 3), (3, len(columns)))) if homes
    ]
    often = [c for c, v in frequent.items() if v]
    if often:
        only = rows.select("transaction_id", "transaction_time", *values, *(F.when(F.col(c).isin(frequent[c]), F.col(c)).alias(c) for c in often))
        if delay == 1:
            found = strictly_earlier(subset_keys(only, often, ["transaction_id", "transaction_time", *values]), ["k1", "k2"], "transaction_time", values)
        else:
            events = subset_keys(only, often, ["transaction_time", *values]).groupBy("k1", "k2", "transaction_time").agg(*(F.sum(v).alias(v) for v in values))
            lookups = subset_keys(only, often, ["transaction_id", "transaction_time"]).withColumn("transaction_time", F.col("transaction_time") - delay)
            found = sums_until(events, lookups, ["k1", "k2"], "transaction_time", values)
        some = found.filter(" OR ".join(f"{v} <> 0" for v in values))
        terms.append(scratch.table(some.select("transaction_id", *((F.col("sign") * F.col(v)).alias(v) for v in values)), "frequent-only"))
    union = terms[0]
    for t in terms[1:]:
        union = union.unionByName(t)
    return union.groupBy("transaction_id").agg(*(F.sum(v).alias(v) for v in values))


def shared_transactions(
    rows: DataFrame, types: Mapping[str, str] = SPECIFIC_TYPES, name: str = "specific_shared_transaction_count", *, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``(transaction_id, name)``: distinct strictly earlier transactions sharing at least one entity."""
    shared = sharing_sums(rows.withColumn("__n", F.lit(1).cast("bigint")), list(types), ["__n"], group_rows=group_rows).withColumnRenamed("__n", name)
    return rows.select("transaction_id").join(shared, "transaction_id", "left").select("transaction_id", F.coalesce(name, F.lit(0)).alias(name))


def matured_labels(rows: DataFrame, *, delay: int = 86_400, eligible_split: str = "train", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Matured neighbour labels per transaction: ``(transaction_id, transaction_time, count, fraud count, ratio)``.

    A neighbour shares a specific entity, belongs to ``eligible_split``, is strictly earlier and at
    least ``delay`` seconds old; each neighbour counts once. ``ratio`` is 0 without neighbours.
    """
    if delay < 0:
        raise ValueError("delay must not be negative")
    pool = rows.filter(F.col("split") == eligible_split)
    bad = pool.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("is_fraud").isin(0, 1), F.lit(False))).alias("bad")).first()
    if not bad["n"]:
        raise ValueError(f"no rows of the eligible split {eligible_split}")
    if bad["bad"]:
        raise ValueError("labels of the eligible split must be binary")
    counted = F.coalesce(F.col("split") == eligible_split, F.lit(False))
    valued = rows.withColumns({"n": counted.cast("bigint"), "f": F.when(counted, F.col("is_fraud").cast("bigint")).otherwise(0)})
    per = sharing_sums(valued, list(SPECIFIC_TYPES), ["n", "f"], delay=max(delay, 1), group_rows=group_rows)
    joined = rows.select("transaction_id", "transaction_time").join(per, "transaction_id", "left")
    n, f = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(0))
    return joined.select(
        "transaction_id", "transaction_time", n.alias("matured_neighbor_label_count"), f.alias("matured_neighbor_fraud_count"),
        F.coalesce(F.try_divide(f, n), F.lit(0.0)).alias("matured_neighbor_fraud_ratio"),
    )
