"""The latest version of every keyed record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELIVERY_ORDER = ("raw_ingested_at", "raw_delivery_id")


def current_rows(df: DataFrame, key: str = "transaction_id", order: Sequence[str] = DELIVERY_ORDER) -> DataFrame:
    """One row per ``key``: the one with the largest ``order`` values.

    Rows without a key are left out. NULL order values lose against any value. The rank-one filter
    lets Spark keep one candidate per key in every partition before the shuffle, so a key that
    holds a large share of the rows sends only one row per partition. ``order`` should end in a
    unique column; if rows tie in all of it, one of them is kept.
    """
    rank = "__rank_of_version"
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.filter(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)
