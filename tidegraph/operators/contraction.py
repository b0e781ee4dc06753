"""Connected groups over billions of links by randomised graph contraction.

Every round draws a fresh bijective hash of the vertex labels. Each vertex hooks to the neighbour
(or itself) with the smallest hash and takes that hash as its new label; edges are relabelled,
loops dropped and repeats removed. The expected number of vertices falls by a constant factor a
round, whatever the shape of the graph (long chains included), so the rounds are logarithmic. The
per-round mappings are written out and expanded backwards at the end.

Labels are 64-bit. A round's hash is a keyed Feistel permutation, so it never merges two vertices;
only the first encoding of arbitrary values as 64-bit labels could, and ``encode_vertices`` proves
for the data at hand that it does not (with a second, independent hash) or takes another seed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.skew import fair_join, frequent_keys
from tidegraph.session import Scratch

LOW = 0xFFFFFFFF


def permute(label: Column, key: int) -> Column:
    """A keyed bijection of 64-bit integers: three Feistel steps over the two 32-bit halves."""
    left, right = F.shiftrightunsigned(label, 32), label.bitwiseAND(F.lit(LOW))
    for step in range(3):
        mixed = F.hash(right, F.lit(key * 3 + step)).cast("bigint").bitwiseAND(F.lit(LOW))
        left, right = right, left.bitwiseXOR(mixed)
    return F.call_function("shiftleft", left, F.lit(32)).bitwiseOR(right)


def unpermute(label: Column, key: int) -> Column:
    """The inverse of ``permute`` with the same key."""
    left, right = F.shiftrightunsigned(label, 32), label.bitwiseAND(F.lit(LOW))
    for step in reversed(range(3)):
        mixed = F.hash(left, F.lit(key * 3 + step)).cast("bigint").bitwiseAND(F.lit(LOW))
        left, right = right.bitwiseXOR(mixed), left
    return F.call_function("shiftleft", left, F.lit(32)).bitwiseOR(right)


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the label of each) of edges in memory; a label is a vertex of the group."""
    vertices, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    top, a, b = np.arange(len(vertices)), code[: len(u)], code[len(u) :]
    while True:
        x, y = top[a], top[b]
        open_ = x != y
        if not open_.any():
            return vertices, vertices[top]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        # Tops point to the least top next to them, then everything to its own top: labels only fall, so there are no rings.
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = top[top]
            if np.array_equal(up, top):
                break
            top = up


def _joined_in_task(edges: DataFrame) -> DataFrame:
    """``(vertex, label)`` of all of some edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            vertex, label = joined(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2)))
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(label)], names=["vertex", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "vertex bigint, label bigint")


def connected_labels(edges: DataFrame, scratch: Scratch, *, seed: int = 11, max_rounds: int = 200, task_edges: int = 0) -> DataFrame:
    """Rows ``(vertex bigint, label bigint)``: two vertices have the same label iff a path joins them.

    ``edges`` has bigint columns ``u`` and ``v``; direction, repeats, loops and NULL ends do not
    matter (an edge with a NULL end is ignored; a vertex with loops only is not in the result).
    No edge: empty result. Labels are opaque: callers name groups by an aggregate over members.
    Once at most ``task_edges`` edges are left (counted), one task joins them, in place of further rounds.
    """
    live = edges.select("u", "v").filter("u <> v")
    mappings: list[str] = []
    number = 0
    live = scratch.table(_oriented(live), "edges-0")
    while number < max_rounds and not live.isEmpty():
        if task_edges and live.count() <= task_edges:
            mappings.append("rest")
            scratch.table(_joined_in_task(live), "rest")
            live = live.limit(0)
            break
        key = seed * 1_000 + number
        # Both directions once; the map-side half of the minimum sees a hub's edges first, so a
        # vertex that holds a third of the edges still sends one row per partition.
        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        hooked = both.groupBy("u").agg(F.min(permute(F.col("v"), key)).alias("best"), F.count(F.lit(1)).alias("n"))
        name = f"map-{number}"
        hooks = scratch.table(hooked.select(F.col("u").alias("vertex"), F.least("best", permute(F.col("u"), key)).alias("label"), "n"), name)
        mappings.append(name)
        # The counts came with the hooks: a hub's edges are spread over several tasks in both joins.
        hubs, labels = frequent_keys(hooks, "vertex"), hooks.select("vertex", "label")
        left = fair_join(live.withColumnRenamed("u", "vertex"), labels, "vertex", F.col("v"), hubs).select(F.col("label").alias("u"), "v")
        moved = fair_join(left.withColumnRenamed("v", "vertex"), labels, "vertex", F.col("u"), hubs).select("u", F.col("label").alias("v"))
        number += 1
        live = scratch.table(_oriented(moved.filter("u <> v")), f"edges-{number}")
        scratch.drop(f"edges-{number - 1}")
    if not live.isEmpty():
        raise RuntimeError(f"not contracted after {max_rounds} rounds")
    if not mappings:
        return edges.sparkSession.createDataFrame([], "vertex bigint, label bigint")
    spark, labels = edges.sparkSession, None
    for name in reversed(mappings):
        step = spark.read.schema("vertex bigint, label bigint").parquet(f"{scratch.root}/{name}")
        if labels is None:
            labels = step
        else:
            up = labels.select(F.col("vertex").alias("label"), F.col("label").alias("top"))
            # Labels that many vertices hook to are counted, too; every label has one row of its own.
            many = frequent_keys(step.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
            met = fair_join(step, up, "label", F.col("vertex"), many, "left")
            labels = met.select("vertex", F.coalesce("top", "label").alias("label"))
    return labels


def _oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def encode_vertices(records: DataFrame, values: Mapping[str, Column], keep: Sequence[Column], scratch: Scratch, *, seed: int = 11, attempts: int = 5) -> tuple[DataFrame, int]:
    """(table, seed): ``keep`` and for each kind i of ``values`` its 64-bit label ``__v{i}``, NULL for NULL.

    Values of different kinds are different vertices. The labels are proved for the data at hand:
    with a second, independent hash no label has two values, or another seed is taken.
    """
    kinds = list(values.items())
    for salt in range(seed, seed + attempts):
        labels = [F.when(v.isNotNull(), F.xxhash64(F.lit(f"{salt}:{k}"), v)).alias(f"__v{i}") for i, (k, v) in enumerate(kinds)]
        checks = [F.when(v.isNotNull(), F.xxhash64(v, F.lit(k), F.lit(~salt))).alias(f"__c{i}") for i, (k, v) in enumerate(kinds)]
        base = scratch.table(records.select(*keep, *labels, *checks), f"records-{salt}")
        each = F.array(*(F.struct(F.col(f"__v{i}").alias("v"), F.col(f"__c{i}").alias("c")) for i in range(len(kinds))))
        pairs = base.select(F.inline(each)).filter("v IS NOT NULL")
        if pairs.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").isEmpty():
            return base.drop(*(f"__c{i}" for i in range(len(kinds)))), salt
    raise RuntimeError("no seed without label collisions was found")


def link_groups(records: DataFrame, record_id: str, link_fields: Sequence[str], *, seed: int = 11, group_column: str = "group_id") -> DataFrame:
    """Rows ``(record_id, group_id)``: one identifier for all records linked directly or indirectly.

    Two records are linked by an equal non-NULL value in the same one of ``link_fields``. The
    group's identifier is the smallest ``record_id`` in it; a record without any value is its own
    group. Every row comes back once: repeated ids are separate rows, and a row with a NULL id
    links like any other and gets its group's smallest id (NULL if there is none). Extra columns
    are ignored, so their names do not matter.

    The graph that is contracted has the field values as vertices; a record is not a vertex but
    ties its first value to its others, so a value shared by a third of all records costs one
    vertex, its repeated edges vanish in the map-side distinct, and the records that share it are
    spread over salts when they get their group.
    """
    if record_id in link_fields or group_column == record_id:
        raise ValueError("record_id, link_fields and group_column must differ")
    scratch = Scratch(records.sparkSession, "link-groups")
    n = len(link_fields)
    base, salt = encode_vertices(records, {f: F.col(f) for f in link_fields}, [F.col(record_id).alias("__id")], scratch, seed=seed)
    first = F.coalesce(*(F.col(f"__v{i}") for i in range(n)))
    ties = base.select(first.alias("u"), F.explode(F.array(*(F.col(f"__v{i}") for i in range(n)))).alias("v")).filter("u <> v")
    labels = connected_labels(ties, scratch, seed=salt)
    owners = base.select("__id", first.alias("vertex"))
    least = owners.filter("vertex IS NOT NULL").groupBy("vertex").agg(F.min("__id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    placed = least.join(labels, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label"), "least_id", "n")
    placed = scratch.table(placed, "placed")
    named = scratch.table(placed.groupBy("label").agg(F.min("least_id").alias("__group"), F.count(F.lit(1)).alias("n")), "named")
    by_vertex = fair_join(placed.select("vertex", "label"), named.drop("n"), "label", F.col("vertex"), frequent_keys(named, "label")).select("vertex", "__group")
    found = fair_join(owners, by_vertex, "vertex", F.col("__id"), frequent_keys(placed, "vertex"), "left")
    return found.select(F.col("__id").alias(record_id), F.coalesce("__group", "__id").alias(group_column))
