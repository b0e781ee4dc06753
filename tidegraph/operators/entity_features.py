"""One feature row per entity out of events of hundreds of types.

Types get indices from a dictionary that is kept with the vectors: a table of versions that are
only ever appended to, so an index means the same type for ever and vectors of any days merge. The
state of an entity is a sparse vector: an array of ``struct(type_no, n, cents, last_time)`` with at
most one entry per type, so its size is bounded by the dictionary and not by the events. Vectors
merge entry by entry (sum, sum, max) and are turned into columns only at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.operators.ordering import global_running
from tidegraph.session import Scratch, broadcast_if_small, path_exists

#: Only as columns are types limited: a table of more than this many types is refused, the vectors are not.
MAX_COLUMN_TYPES = 4_096
NO_TYPE = -1


class TypeDictionary:
    """``(type_no, event_type, version)`` in a folder of its own; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        """All types known so far; empty before the first ``extend``."""
        schema = "type_no int, event_type string"
        if not path_exists(self.spark, self.folder):
            return self.spark.createDataFrame([], schema + ", version int")
        return self.spark.read.option("basePath", self.folder).schema(schema + ", version int").parquet(f"{self.folder}/version=*")

    def extend(self, kinds: DataFrame) -> DataFrame:
        """Appends the types of ``kinds (event_type)`` that have no index yet, as a new version; returns all types.

        Indices follow the largest one in use, in order of the name. NULL is not a type. A version
        is one folder written at once; a repeated call with the same types appends nothing.
        """
        known = self.read()
        last = known.agg(F.coalesce(F.max("type_no"), F.lit(-1)).alias("n"), F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()
        found = kinds.select("event_type").filter("event_type IS NOT NULL").distinct()
        fresh = Scratch(self.spark, "types").table(found.join(known.select("event_type"), "event_type", "left_anti"), "fresh")
        if not fresh.isEmpty() or not path_exists(self.spark, self.folder):
            numbered = global_running(fresh, [F.col("event_type")], position="type_no")
            numbered.select((F.col("type_no") + last["n"]).cast("int").alias("type_no"), "event_type").write.parquet(f"{self.folder}/version={last['v'] + 1}")
        return self.read()


def entity_entries(df: DataFrame, entity: str, type_column: str, time: str, amount_cents: str, types: DataFrame) -> DataFrame:
    """Mergeable entries ``(entity, type_no, n, cents, last_time)``; events without type get number -1.

    ``types`` is a dictionary; it is broadcast if counted small. Events with a NULL entity or of a
    type outside the dictionary are left out; NULL amounts add 0 and NULL times do not count as latest.
    """
    rows = df.filter(F.col(entity).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(type_column).alias("event_type"), F.col(amount_cents).alias("cents"), F.col(time).alias("last_time")
    )
    # Combined by name first: a frequent type sends the join one row per entity and partition.
    named = _combined(rows.withColumn("n", F.lit(1).cast("bigint")), "event_type")
    numbered = named.join(broadcast_if_small(types.select("event_type", "type_no")), "event_type", "left")
    number = F.when(F.col("event_type").isNull(), F.lit(NO_TYPE)).otherwise(F.col("type_no"))
    return numbered.select("entity", number.alias("type_no"), "n", "cents", "last_time").filter("type_no IS NOT NULL")


def _combined(entries: DataFrame, kind: str) -> DataFrame:
    return entries.groupBy("entity", kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).cast("bigint").alias("cents"), F.max("last_time").alias("last_time")
    )


def merge_entries(entries: DataFrame) -> DataFrame:
    """Entries of days or partitions combined; all must be numbered by versions of one dictionary."""
    return _combined(entries, "type_no")


def sparse_vectors(entries: DataFrame) -> DataFrame:
    """One row per entity: its sparse vector with the totals over all types."""
    entry = F.struct("type_no", "n", "cents", "last_time")
    return entries.groupBy("entity").agg(
        F.sum("n").alias("n_all"), F.sum("cents").alias("cents_all"), F.max("last_time").alias("last_time_all"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )


def with_type_names(entries: DataFrame, types: DataFrame) -> DataFrame:
    """Entries with their ``event_type``; NULL for events without type."""
    return entries.join(broadcast_if_small(types.select("type_no", "event_type")), "type_no", "left")


def feature_table(vectors: DataFrame, types: DataFrame) -> DataFrame:
    """Vectors expanded into ``n_<i>, total_<i>, last_<i>`` columns, one triple per index of the dictionary.

    A type an entity never had gives 0, 0.0 and NULL. An index beyond ``types`` raises: the vectors
    were made with a later version. Each batch scatters its entries into dense columns once.
    """
    width = 1 + types.agg(F.coalesce(F.max("type_no"), F.lit(-1))).first()[0]
    if width > MAX_COLUMN_TYPES:
        raise ValueError(f"more than {MAX_COLUMN_TYPES} event types cannot be columns; use the sparse vectors")
    triples = [(f"n_{i}", f"total_{i}", f"last_{i}") for i in range(width)]
    fields = [T.StructField(c, k) for t in triples for c, k in zip(t, (T.LongType(), T.DoubleType(), T.LongType()), strict=True)]
    head = vectors.select("entity", "n_all", (F.col("cents_all") / 100.0).alias("total_all"), "last_time_all", "entries")
    schema = T.StructType([*head.schema.fields[:4], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(4)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            entry = lists.flatten()
            number = entry.field("type_no").to_numpy(zero_copy_only=False)
            if len(number) and number.max() >= width:
                raise ValueError("vectors hold a type that the dictionary lacks")
            typed = number >= 0
            row, number = row[typed], number[typed]
            pick = lambda f, empty=0: entry.field(f).fill_null(empty).to_numpy(zero_copy_only=False)[typed]  # noqa: E731, B023
            n, cents, last = (np.zeros((width, b.num_rows), np.int64) for _ in range(3))
            n[number, row], cents[number, row], last[number, row] = pick("n"), pick("cents"), pick("last_time")
            seen = np.zeros((width, b.num_rows), bool)
            seen[number, row] = entry.field("last_time").is_valid().to_numpy(zero_copy_only=False)[typed]
            columns = [x for i in range(width) for x in (pa.array(n[i]), pa.array(cents[i] / 100.0), pa.array(last[i], mask=~seen[i]))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *columns], names=schema.names)

    return head.mapInArrow(run, schema)
