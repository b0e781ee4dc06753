"""Readers of the test tables; each selects its columns at the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidegraph.operators.current import DELIVERY_ORDER, current_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_transactions(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """The current version of every transaction with only ``columns`` carried through the shuffle."""
    wanted = list(dict.fromkeys(["transaction_id", *columns]))
    df = table(spark, folder, "transactions").select(*dict.fromkeys([*wanted, *DELIVERY_ORDER]))
    return current_rows(df).select(*wanted)
