"""Streaming counterparts: entity degrees by score-then-update, and appended edges.

``stream_degrees`` keeps its state in Spark's state store; a task sees one entity's rows of a
micro-batch at a time. ``degree_batches`` keeps it in a versioned table and scores a micro-batch
with the two-level counts of the batch operators, so that an entity with most of a micro-batch's
rows is spread over tasks.

Every entity keeps one bounded state: its count of transactions strictly before its last time, the
count at that time, and the time. A row is scored against the state before its own time; rows of
an earlier time than the state's are rejected as reversals (they come out with a NULL degree).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegraph.operators.asof import entity_edges, strictly_earlier
from tidegraph.operators.skew import fair_join, frequent_keys
from tidegraph.session import Scratch, delete_path, list_names

OUTPUT = "transaction_id string, transaction_time bigint, entity_type string, entity_value string, degree bigint"
STATE = "before bigint, at_last bigint, last_time bigint"


def _score_then_update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before, at_last, last = state.get if state.exists else (0, 0, -1)
    rows = pd.concat(list(frames)).sort_values(["transaction_time", "transaction_id"], kind="stable")
    degrees: list[int | None] = []
    for t in rows["transaction_time"].tolist():
        if t < last:
            degrees.append(None)
            continue
        if t > last:
            before, at_last, last = before + at_last, 0, t
        degrees.append(before)
        at_last += 1
    state.update((before, at_last, last))
    out = rows[["transaction_id", "transaction_time"]].copy()
    out["entity_type"], out["entity_value"] = key
    out["degree"] = pd.array(degrees, dtype="Int64")
    yield out


def stream_degrees(rows: DataFrame) -> DataFrame:
    """Strictly-earlier degree per row and entity of a stream of canonical transactions."""
    edges = entity_edges(rows)
    return edges.groupBy("entity_type", "entity_value").applyInPandasWithState(_score_then_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


KEYS = ["entity_type", "entity_value"]


def degree_batches(rows: DataFrame, folder: str, checkpoint: str):
    """The same degrees, written to ``folder/degrees`` per micro-batch, with the state in ``folder/state``.

    A micro-batch reads the newest state before it and writes its own version, so a replayed one
    gives the same; versions before the last but one are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        edges = Scratch(spark, "stream").table(entity_edges(batch), "edges")
        versions = [int(v) for v in list_names(spark, f"{folder}/state", "epoch=") if int(v) < epoch]
        state = spark.read.schema(f"entity_type string, entity_value string, {STATE}").parquet(f"{folder}/state/epoch={max(versions)}") if versions else None
        known = state if state is not None else spark.createDataFrame([], f"entity_type string, entity_value string, {STATE}")
        name = F.concat_ws("\u0001", *KEYS)
        counts = edges.groupBy(name.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        met = fair_join(edges.withColumn("k", name), known.select(name.alias("k"), "before", "at_last", "last_time"), "k", F.col("transaction_id"), frequent_keys(counts, "k"), "left").drop("k")
        met = Scratch(spark, "stream").table(met.na.fill(0, ["before", "at_last"]).na.fill(-1, ["last_time"]).withColumn("n", F.lit(1).cast("bigint")), "met")
        late, valid = F.col("transaction_time") < F.col("last_time"), F.col("transaction_time") >= F.col("last_time")
        earlier = strictly_earlier(met.filter(valid), KEYS, "transaction_time", ["n"])
        degree = F.col("n") + F.col("before") + F.when(F.col("transaction_time") > F.col("last_time"), F.col("at_last")).otherwise(0)
        shown = ["transaction_id", "transaction_time", *KEYS]
        out = earlier.select(*shown, degree.alias("degree")).unionByName(met.filter(late).select(*shown, F.lit(None).cast("bigint").alias("degree")))
        out.write.mode("overwrite").parquet(f"{folder}/degrees/epoch={epoch}")
        per_time = met.filter(valid).groupBy(*KEYS, "before", "at_last", "last_time", "transaction_time").agg(F.count(F.lit(1)).alias("n"))
        now = per_time.groupBy(*KEYS, "before", "at_last", "last_time").agg(F.sum("n").alias("n"), F.max("transaction_time").alias("t"), F.max_by("n", "transaction_time").alias("n_t"))
        same = F.col("t") == F.col("last_time")
        moved = now.select(
            *KEYS, (F.col("before") + F.when(same, 0).otherwise(F.col("at_last") + F.col("n") - F.col("n_t"))).alias("before"),
            F.when(same, F.col("at_last") + F.col("n")).otherwise(F.col("n_t")).alias("at_last"), F.col("t").alias("last_time"),
        )
        kept = known.join(moved.select(*KEYS), KEYS, "left_anti")
        kept.unionByName(moved).write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")
        for v in sorted(versions)[:-1]:
            delete_path(spark, f"{folder}/state/epoch={v}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_edges(rows: DataFrame, path: str, checkpoint: str):
    """Appends the edges of every micro-batch to a table; replayed batches overwrite their own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        entity_edges(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_activity(events: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value sums per event type and tumbling window, late events dropped by watermark."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
