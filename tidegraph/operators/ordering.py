"""Total orders without a single-task sort: global row numbers, running sums and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import Scratch

BUCKET_SECONDS = 86_400


def global_running(df: DataFrame, order: Sequence[Column], *, position: str = "position", sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``position`` (from 1) and running sums in a total order over the whole table.

    Rows are range-partitioned by ``order`` and numbered inside partitions; the partitions' totals
    (one small row each) give the offsets. ``order`` must be a total order for stable results.
    ``sums`` maps result columns to summed columns.
    """
    sums = sums or {}
    scratch = Scratch(df.sparkSession, "running")
    parted = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parted = scratch.table(parted, "parted")
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = parted.select(
        "*", F.count(F.lit(1)).over(inside).alias("__n"), *(F.sum(c).over(inside).alias(f"__r_{name}") for name, c in sums.items())
    )
    totals = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__r_{name}") for name, c in sums.items()))
    # One row per partition of the table, so an ordinary single-partition window and a broadcast are bounded.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ["__n", *(f"__r_{n}" for n in sums)]))
    out = numbered.join(F.broadcast(offsets), "__part")
    return out.select(
        *df.columns, (F.col("__n") + F.col("__n_before")).alias(position), *((F.col(f"__r_{n}") + F.col(f"__r_{n}_before")).alias(n) for n in sums)
    )


def bucket_counts(df: DataFrame, column: str) -> list[tuple[int, int, int]]:
    """``(bucket, rows, largest value)`` per coarse bucket of a bigint column, in order.

    Bounded by the range of the column over the bucket width, not by the rows.
    """
    found = df.groupBy(_bucket(column).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(column).alias("m")).collect()
    return sorted((r["b"], r["n"], r["m"]) for r in found)


def _bucket(column: str) -> Column:
    return F.floor(F.col(column) / F.lit(BUCKET_SECONDS)).cast("bigint")


def values_at_positions(df: DataFrame, column: str, positions: Sequence[int], coarse: Sequence[tuple[int, int, int]] | None = None) -> list[int]:
    """The values of a bigint column at 0-based positions of its ascending order, exactly.

    Two passes of counting: per coarse bucket (which a caller may pass in), then per value of the
    buckets hit. Neither sorts the rows.
    """
    coarse = bucket_counts(df, column) if coarse is None else coarse
    found: dict[int, tuple[int, int]] = {}
    for p in positions:
        before = 0
        for b, n, _ in coarse:
            if p < before + n:
                found[p] = (b, before)
                break
            before += n
        else:
            raise ValueError("position beyond the table")
    hit = sorted({b for b, _ in found.values()})
    fine = sorted((r[0], r[1]) for r in df.filter(_bucket(column).isin(hit)).groupBy(column).count().collect())
    out = []
    for p in positions:
        b, before = found[p]
        for v, n in fine:
            if v // BUCKET_SECONDS == b:
                before += n
                if p < before:
                    out.append(v)
                    break
    return out


def time_batches(df: DataFrame, time: str = "transaction_time") -> DataFrame:
    """``(time, rows, batch_no)``: equal times form one batch, numbered from 0 in order."""
    per_time = df.groupBy(time).agg(F.count(F.lit(1)).alias("rows"))
    numbered = global_running(per_time, [F.col(time)], position="batch_no")
    return numbered.withColumn("batch_no", F.col("batch_no") - 1)
