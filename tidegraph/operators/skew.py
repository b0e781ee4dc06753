"""Joins of many rows with one row per key, when a key may hold a large share of the rows.

The keys that hold more than a task's fair share are counted first. Their rows are spread over
salts, and the one matching row is repeated once per salt, so that no task gets more than about a
fair share of them - whatever adaptive execution makes of the plan. Fewer than ``parts`` keys can
hold more than the ``parts``-th part of the rows, which bounds the list of frequent keys by proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT, SALTS = "__salt", "__salts"


def fair_parts(df: DataFrame) -> int:
    """How many parts the rows should fall into: a few per task of a shuffle."""
    return 4 * max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def frequent_keys(counts: DataFrame, key: str, n: str = "n", *, parts: int | None = None) -> DataFrame | None:
    """``(key, __salts)`` of the keys with more than the ``parts``-th part of all rows, or None if there are none.

    ``counts`` has one row per key with its number of rows ``n``; it is read once or twice. The
    result is a local table of fewer than ``parts`` rows; a NULL key is never frequent.
    """
    parts = parts or fair_parts(counts)
    size = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.max(F.when(F.col(key).isNotNull(), F.col(n))), F.lit(0)).alias("most")).first()
    if size["most"] * parts <= size["total"]:
        return None
    salts = F.ceil(F.col(n) * F.lit(parts) / F.lit(int(size["total"]))).cast("int").alias(SALTS)
    found = counts.filter(F.col(key).isNotNull() & (F.col(n) * parts > size["total"])).select(key, salts)
    return counts.sparkSession.createDataFrame(found.collect(), found.schema)


def fair_join(rows: DataFrame, single: DataFrame, key: str, by: Column, frequent: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``single`` (one row per key) on ``key``; ``how`` is inner or left.

    Rows of frequent keys are spread by a hash of ``by``; in a left join rows with a NULL key match
    nothing and are spread, too. ``by`` must be a deterministic expression of the row.
    """
    if frequent is None and how == "inner":
        return rows.join(single, key)
    salts = F.lit(1)
    if frequent is not None:
        rows, single = rows.join(F.broadcast(frequent), key, "left"), single.join(F.broadcast(frequent), key, "left")  # fewer than ``parts`` rows
        salts = F.coalesce(SALTS, F.lit(1))
        single = single.withColumn(SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop(SALTS)
    else:
        single = single.withColumn(SALT, F.lit(0))
    salts = F.when(F.col(key).isNull(), fair_parts(rows)).otherwise(salts)
    rows = rows.withColumn(SALT, F.pmod(F.xxhash64(by), salts).cast("int")).drop(SALTS)
    return rows.join(single, [key, SALT], how).drop(SALT)
