"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree of free space.

Items go to groups of bounded expected size, drawn by a seeded hash of id and part; every group is packed on its own, so the work
is spread evenly whatever the ids, sources or sizes look like, and each group leaves at most a few
containers part-filled. An item is cut only if it alone exceeds the capacity: its full-capacity
parts fill containers, and its rest is packed like any item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.session import Scratch, broadcast_if_small

CAPACITY = 2_048
#: Expected items per group: large against the items of a container, small against a task's memory.
GROUP_ITEMS = 8_192


class FreeSpaceTree:
    """Complete binary tree whose leaves are containers' free space and whose nodes hold the maximum below."""

    def __init__(self, leaves: int, capacity: int):
        self.first = 1
        while self.first < max(1, leaves):
            self.first *= 2
        self.node = [capacity] * (2 * self.first)

    def place(self, size: int) -> int:
        """Puts ``size`` into the leftmost container with room; returns its number."""
        node, first = self.node, self.first
        at = 1
        while at < first:
            at *= 2
            if node[at] < size:
                at += 1
        node[at] -= size
        found = at - first
        at //= 2
        while at:
            left, right = node[2 * at], node[2 * at + 1]
            most = left if left >= right else right
            if node[at] == most:
                break
            node[at] = most
            at //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size, for sizes already in decreasing order and none above ``capacity``."""
    tree = FreeSpaceTree(len(sizes), capacity)
    return np.array([tree.place(s) for s in sizes.tolist()], np.int64)


def pack(
    items: DataFrame, item_id: str, size: str, *, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 17
) -> DataFrame:
    """Rows ``(container_id, item_id, part_no, part_start, part_size)``; every unit of every item once.

    Items not above ``capacity`` have one part, number 0. A larger item has parts of exactly
    ``capacity`` and one rest; ``part_start`` counts size units. An item of size 0 or NULL takes
    part with size 0. Repeated ids are separate items. Within a group, ties go by id and part.
    Container ids are unique and have gaps. Empty input: empty result. The same items give the
    same containers however they are stored, unless an id is repeated so often that it alone would
    fill an eighth of a group: its rows, and those without id, are told apart by their place.
    """
    if capacity < 1 or group_items < 1:
        raise ValueError("capacity and group_items must be positive")
    whole = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    last_part = F.greatest(F.ceil(F.col("__size") / F.lit(capacity)).cast("bigint") - 1, F.lit(0).cast("bigint"))
    sized = Scratch(items.sparkSession, "pack").table(items.select(F.col(item_id).alias("item_id"), whole.alias("__size")), "sized")
    groups = max(1, -(-(sized.agg(F.coalesce(F.sum(last_part + 1), F.lit(0))).first()[0]) // group_items))
    # At most eight such ids per group of items.
    often = sized.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") * 8 > group_items) | F.col("item_id").isNull()).select(F.col("item_id").alias("__often"))
    placed = sized.withColumn("__row", F.monotonically_increasing_id()).join(broadcast_if_small(often), F.col("item_id").eqNullSafe(F.col("__often")), "left_semi")
    rest = sized.withColumn("__row", F.lit(0).cast("bigint")).join(broadcast_if_small(often), F.col("item_id").eqNullSafe(F.col("__often")), "left_anti")
    parts = rest.unionByName(placed).select("item_id", "__size", "__row", F.explode(F.sequence(F.lit(0).cast("bigint"), last_part)).alias("part_no"))
    parts = parts.select(
        "item_id", "part_no", (F.col("part_no") * capacity).alias("part_start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("__size") - F.col("part_no") * capacity).alias("part_size"),
        F.pmod(F.xxhash64("item_id", "part_no", "__row", F.lit(seed)), F.lit(groups)).cast("bigint").alias("group_no"),
    )
    schema = T.StructType(
        [T.StructField("container_id", T.LongType()), parts.schema["item_id"], *(T.StructField(c, T.LongType()) for c in ("part_no", "part_start", "part_size"))]
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part_size", "item_id", "part_no"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(group["part_size"].to_numpy(), capacity)
        out = group[["item_id", "part_no", "part_start", "part_size"]]
        out.insert(0, "container_id", (group["group_no"].to_numpy() << 32) + bins)
        return out

    return parts.groupBy("group_no").applyInPandas(run, schema).withColumnRenamed("item_id", item_id)
