"""The canonical view over the delivered transactions table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.normal import normal_form, paid, timed
from tidegraph.schema import CANONICAL_COLUMNS, ENTITY_TYPES
from tidegraph.sources.tables import current_transactions


def canonical_payments(spark: SparkSession, folder: str) -> DataFrame:
    """Current transactions that meet the canonical contract, entity values and codes in normal form."""
    cur = current_transactions(spark, folder, CANONICAL_COLUMNS)
    shaped = cur.select(*(normal_form(c).alias(c) if c in ENTITY_TYPES or c in ("product_code", "source") else F.col(c) for c in CANONICAL_COLUMNS))
    return shaped.filter(timed() & paid() & F.col("is_fraud").isin(0, 1) & F.coalesce(*ENTITY_TYPES).isNotNull())
