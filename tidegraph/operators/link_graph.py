"""The typed transaction-entity graph as tables: edges, statistics, audits and serialised form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.normal import clean_entity
from tidegraph.operators.asof import entity_edges
from tidegraph.operators.contraction import connected_labels, encode_vertices
from tidegraph.schema import ENTITY_TYPES, TARGET_NAMES, GraphBuildError
from tidegraph.session import Scratch


def cleaned(rows: DataFrame, types: Mapping[str, str] = ENTITY_TYPES) -> DataFrame:
    """Entity columns in the graph's notion of a value: trimmed, NULL for words that mean missing."""
    return rows.withColumns({c: clean_entity(c) for c in types})


def build_edges(
    rows: DataFrame, types: Mapping[str, str] = ENTITY_TYPES, *, cutoff_time: int | None = None, allow_entityless: bool = False
) -> DataFrame:
    """Edges ``(transaction_id, entity_type, entity_value, relation, observed_time)`` up to an inclusive cutoff.

    Raises on repeated or empty ids, NULL times, and rows without any entity unless allowed.
    """
    chosen = rows if cutoff_time is None else rows.filter(F.col("transaction_time") <= cutoff_time)
    chosen = cleaned(chosen, types)
    bad = chosen.agg(
        F.count_if(clean_entity("transaction_id").isNull()).alias("empty"), F.count_if(F.col("transaction_time").isNull()).alias("no_time"),
        F.count_if(F.coalesce(*types).isNull()).alias("bare"),
    ).first()
    if bad["empty"]:
        raise GraphBuildError("transaction_id must not be empty")
    if bad["no_time"]:
        raise GraphBuildError("every transaction needs a time")
    if bad["bare"] and not allow_entityless:
        raise GraphBuildError(f"{bad['bare']} transactions have no usable entity")
    if not chosen.groupBy("transaction_id").count().filter("count > 1").isEmpty():
        raise GraphBuildError("repeated transaction_id")
    return entity_edges(chosen, types).select(
        "transaction_id", "entity_type", "entity_value", F.concat(F.lit("uses_"), F.col("entity_type")).alias("relation"),
        F.col("transaction_time").alias("observed_time"),
    )


def append_batch(edges: DataFrame, batch: DataFrame, types: Mapping[str, str] = ENTITY_TYPES) -> DataFrame:
    """Edges with one more batch of a single, strictly later time; the incremental form of ``build_edges``."""
    span = batch.agg(F.min("transaction_time").alias("a"), F.max("transaction_time").alias("b"), F.count_if(F.col("transaction_time").isNull()).alias("n")).first()
    if span["n"] or span["a"] is None or span["a"] != span["b"]:
        raise GraphBuildError("a batch has exactly one time")
    last = edges.agg(F.max("observed_time")).first()[0]
    if last is not None and span["a"] <= last:
        raise GraphBuildError("batches must come in strictly increasing time order")
    if not edges.join(batch.select("transaction_id"), "transaction_id", "left_semi").isEmpty():
        raise GraphBuildError("repeated transaction_id")
    return edges.unionByName(build_edges(batch, types))


def type_counts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, name, n)``: nodes by type and edges by relation, one pass over the distinct nodes."""
    nodes = edges.select("entity_type", "entity_value").distinct().groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    txns = rows.agg(F.count_distinct("transaction_id").alias("n")).select(F.lit("transaction").alias("name"), "n")
    relations = edges.groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return (
        nodes.select(F.lit("node_type").alias("kind"), "name", "n")
        .unionByName(txns.select(F.lit("node_type").alias("kind"), "name", "n"))
        .unionByName(relations.select(F.lit("relation").alias("kind"), "name", "n"))
    )


def node_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(label, nodes, transactions)`` per connected component of transactions and entities.

    The graph is contracted on its nodes' 64-bit labels, which are proved to be distinct.
    """
    kinds = {"transaction": F.col("transaction_id"), "entity": F.concat_ws("::", "entity_type", "entity_value")}
    ends = encode_vertices(edges, kinds, [], scratch)[0].toDF("u", "v")
    labels = connected_labels(ends, scratch)
    txns = ends.select(F.col("u").alias("vertex")).distinct().withColumn("is_txn", F.lit(1))
    per = labels.join(txns, "vertex", "left")
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.count("is_txn").alias("transactions"))


def graph_statistics(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, largest component, isolated transactions."""
    scratch = Scratch(rows.sparkSession, "graph-statistics")
    sizes = node_components(edges, scratch)
    linked = edges.select("transaction_id").distinct()
    lone = rows.select("transaction_id").distinct().join(linked, "transaction_id", "left_anti").agg(F.count(F.lit(1)).alias("isolated_transaction_count"))
    entities = edges.select("entity_type", "entity_value").distinct().agg(F.count(F.lit(1)).alias("entity_node_count"))
    txns = rows.agg(F.count_distinct("transaction_id").alias("transaction_node_count"))
    counts = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    comps = sizes.agg(F.count(F.lit(1)).alias("__linked_components"), F.coalesce(F.max("nodes"), F.lit(0)).alias("__largest"))
    out = txns.withColumn("__one", F.lit(1))
    for part in (entities, counts, comps, lone):  # one row each
        out = out.join(F.broadcast(part.withColumn("__one", F.lit(1))), "__one")
    return out.select(
        (F.col("transaction_node_count") + F.col("entity_node_count")).alias("node_count"), "edge_count", "transaction_node_count", "entity_node_count",
        (F.col("__linked_components") + F.col("isolated_transaction_count")).alias("connected_component_count"),
        F.greatest("__largest", F.when(F.col("isolated_transaction_count") > 0, 1).otherwise(0)).alias("largest_component_size"), "isolated_transaction_count",
    )


def integrity_audit(rows: DataFrame, edges: DataFrame, types: Mapping[str, str] = ENTITY_TYPES) -> DataFrame:
    """One row of gates: the edge table against the transactions it should come from."""
    source = cleaned(rows, types)
    expected = source.agg(
        F.sum(F.size(F.array_compact(F.array(*types)))).cast("bigint").alias("expected_edge_count"), F.count(F.lit(1)).alias("expected_transaction_count")
    )
    times = edges.join(rows.select("transaction_id", F.col("transaction_time").alias("__t")), "transaction_id", "left")
    gates = times.agg(
        (F.count_if(~F.col("entity_type").isin(*types.values())) == 0).alias("node_types_valid"),
        (F.count_if(clean_entity("entity_value").isNull()) == 0).alias("entity_values_non_missing"),
        (F.count_if(F.col("entity_type") == "transaction") == 0).alias("edges_are_transaction_entity_only"),
        (F.count_if(F.col("relation") != F.concat(F.lit("uses_"), F.col("entity_type"))) == 0).alias("edge_relations_match_entity_types"),
        (F.count_if(~F.coalesce(F.col("__t") == F.col("observed_time"), F.lit(False))) == 0).alias("edge_times_match_transactions"),
        F.count(F.lit(1)).alias("edge_count"),
    )
    simple = edges.groupBy("transaction_id", "entity_type", "entity_value").count().agg((F.coalesce(F.max("count"), F.lit(1)) == 1).alias("undirected_simple_graph"))
    both = (
        rows.select("transaction_id", F.lit(1).alias("s"), F.lit(0).alias("e")).unionByName(edges.select("transaction_id", F.lit(0).alias("s"), F.lit(1).alias("e")))
        .groupBy("transaction_id").agg(F.max("s").alias("s"), F.max("e").alias("e"))
        .agg((F.count_if(F.col("s") < F.col("e")) == 0).alias("transaction_nodes_match_source"), (F.count_if(F.col("e") == 0) == 0).alias("transactions_have_entity_edges"))
    )
    out = gates.withColumn("__one", F.lit(1))
    for part in (expected, simple, both):  # one row each
        out = out.join(F.broadcast(part.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one").withColumn("target_attributes_absent", F.lit(not TARGET_NAMES & set(edges.columns))).withColumn(
        "edge_count_matches_available_entities", F.col("edge_count") == F.col("expected_edge_count")
    )


def replay_audit(rows: DataFrame) -> DataFrame:
    """One row: time batches, batches of several rows, rows and repeated ids of the replay order."""
    per = rows.groupBy("transaction_time").agg(F.count(F.lit(1)).alias("n"))
    batches = per.agg(
        F.count(F.lit(1)).alias("batch_count"), F.count_if(F.col("n") > 1).alias("multi_row_batches"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_batch"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
    )
    ids = rows.groupBy("transaction_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("pre_existing_id_violations"))
    return batches.withColumn("__one", F.lit(1)).join(F.broadcast(ids.withColumn("__one", F.lit(1))), "__one").drop("__one")


def serialised_edges(edges: DataFrame) -> DataFrame:
    """Portable edges: ids as ``type::value``, ends in order of (type, value)."""
    txn, entity = F.concat(F.lit("transaction::"), F.col("transaction_id")), F.concat_ws("::", "entity_type", "entity_value")
    entity_first = F.col("entity_type") < F.lit("transaction")
    return edges.select(
        F.when(entity_first, entity).otherwise(txn).alias("source"), F.when(entity_first, txn).otherwise(entity).alias("target"), "relation", "observed_time"
    )


def serialised_nodes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Portable nodes with the attributes of transactions and entities."""
    t = rows.select(
        F.concat(F.lit("transaction::"), F.col("transaction_id")).alias("id"), F.lit("transaction").alias("node_type"), F.col("transaction_id").alias("entity_value"),
        "transaction_time", "amount", "product_code",
    )
    e = edges.select("entity_type", "entity_value").distinct().select(
        F.concat_ws("::", "entity_type", "entity_value").alias("id"), F.col("entity_type").alias("node_type"), "entity_value",
        F.lit(None).cast("bigint").alias("transaction_time"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("product_code"),
    )
    return t.unionByName(e)
