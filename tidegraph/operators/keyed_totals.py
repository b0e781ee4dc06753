"""Per-key results when a few keys hold most of the rows.

Only algebraic state (counts, sums, minima, maxima) is kept per key, so Spark's hash aggregation
combines rows inside every input partition - spilling by sort when its table is full - and the
shuffle carries at most one compact state per key and partition. The hottest key then costs its
reducer one row per map task, whatever its share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_totals(df: DataFrame, fields: Sequence[str], amount_cents: str) -> DataFrame:
    """``(field_name, key_value, n, n_amounts, cents)`` for each value of each of ``fields``.

    One pass over the rows serves all fields. The NULL key has a row of its own per field, so the
    counts of a field add up to all rows. NULL amounts count in ``n`` only; the sum of none is 0.
    """
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")) for f in fields))
    rows = df.select(F.inline(each), F.col(amount_cents).alias("__cents"))
    return rows.groupBy("field_name", "key_value").agg(
        F.count(F.lit(1)).alias("n"), F.count("__cents").alias("n_amounts"), F.coalesce(F.sum("__cents"), F.lit(0)).cast("bigint").alias("cents")
    )


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """The non-NULL keys that hold at least ``share`` of their field's rows, with that share.

    The per-field totals are themselves a sum with map-side combining; they are few rows (one per
    field) and join back on the field.
    """
    whole = totals.groupBy("field_name").agg(F.sum("n").alias("n_field"))
    joined = totals.join(F.broadcast(whole), "field_name")
    return joined.filter(F.col("key_value").isNotNull() & (F.col("n") >= F.ceil(F.col("n_field") * F.lit(share) - F.lit(1e-6)))).withColumn(
        "share", F.col("n") / F.col("n_field")
    )
