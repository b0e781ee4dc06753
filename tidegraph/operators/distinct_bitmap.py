"""Distinct counts over very large identifier sets by multiresolution bitmaps.

An identifier's hash picks a slice with geometric probability (1/2, 1/4, ...) and a bit in that
slice. A sketch is kept sparsely as rows ``(group, field, slot, bits)`` where a slot is one
64-bit word of one slice; merging two sketches is a bitwise OR per slot, so days, partitions and
groups combine with the built-in ``bit_or`` aggregate inside Spark's hash aggregation.

Estimate: slices from the first unsaturated one on are linear-counted, summed and scaled by the
probability of reaching them. With ``bits`` = 1,024 the relative standard error is at most
``relative_error()`` = 3.0 % at any cardinality up to about ``bits * 2**27`` (simulated: 1.4 % up to
1,000 identifiers, at most 2.8 % beyond).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.session import Scratch

SKETCH_COLUMNS = ("field", "slot", "bits")


@dataclass(frozen=True)
class BitmapShape:
    """``bits`` per slice (a power of two, at least 64) and the number of geometric ``slices`` (at most 32)."""

    bits: int = 1024
    slices: int = 30
    full_at: float = 0.9

    def __post_init__(self):
        if self.bits < 64 or self.bits & (self.bits - 1) or not 2 <= self.slices <= 32 or not 0 < self.full_at < 1:
            raise ValueError("bits must be a power of two from 64, slices 2..32, full_at in (0,1)")

    @property
    def words(self) -> int:
        return self.bits // 64

    def relative_error(self) -> float:
        """Bound of the relative standard error: sampling into, and collisions inside, the base slice."""
        load = -math.log(1 - self.full_at)
        reached = self.bits * load  # ids seen from the base slice on when the slice before it is just full
        collisions = math.sqrt(math.exp(load) - load - 1) / (load * math.sqrt(self.bits))
        return math.sqrt(1 / reached + (collisions / 2) ** 2 + (collisions / 2) ** 2 / 2)


def _place(value: Column, shape: BitmapShape) -> tuple[Column, Column]:
    """(slot, single-bit word) of a value."""
    h = F.xxhash64(value)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    deep = F.when(low == 0, F.lit(32)).otherwise(F.lit(31) - F.floor(F.log2(low.cast("double"))).cast("int"))
    slice_no = F.least(deep, F.lit(shape.slices - 1))
    at = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(shape.bits - 1)).cast("int")
    slot = slice_no * F.lit(shape.words) + F.shiftright(at, 6)
    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)))
    return slot.cast("int"), word


def distinct_sketch(
    df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column | str], shape: BitmapShape = BitmapShape()
) -> DataFrame:
    """Sketches of every field per group: rows ``(*keys, field, slot, bits)``.

    NULL values are not counted; NULL keys form a group of their own; a group without any value
    has no rows. The input's other columns are ignored, so their names may clash with ours.
    """
    if set(keys) & set(SKETCH_COLUMNS):
        raise ValueError(f"rename keys called {SKETCH_COLUMNS}")
    each = []
    for name, value in fields.items():
        value = F.col(value) if isinstance(value, str) else value
        slot, word = _place(value, shape)
        each.append(F.struct(F.lit(name).alias("field"), F.when(value.isNotNull(), slot).alias("slot"), word.alias("bits")))
    marks = df.select(*keys, F.inline(F.array(*each))).filter(F.col("slot").isNotNull())
    return merge_sketches(marks, keys)


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine sketches (of days, partitions or finer groups) into those of ``keys``."""
    return sketches.groupBy(*keys, "field", "slot").agg(F.bit_or("bits").alias("bits"))


def cube_sketches(sketches: DataFrame, keys: Sequence[str], level: str = "grouping_level") -> DataFrame:
    """Sketches of every combination of ``keys`` from those of all of them.

    ``level`` has bit i (from the left) set where key i is rolled up, as SQL's grouping_id. The
    lattice is rolled up key by key: every combination is merged from the smallest (counted) of the
    written combinations that have one key more, so the finest sketches are read once per key only.
    """
    plain = list(keys)
    scratch = Scratch(sketches.sparkSession, "cube")
    done: dict[int, tuple[DataFrame, int]] = {}
    for mask in sorted(range(1 << len(plain)), key=lambda m: (m.bit_count(), m)):
        kept = [k for i, k in enumerate(plain) if not mask >> (len(plain) - 1 - i) & 1]
        parents = [done[mask & ~(1 << i)] for i in range(len(plain)) if mask >> i & 1]
        merged = merge_sketches(min(parents, key=lambda p: p[1])[0], kept) if parents else sketches.select(*plain, *SKETCH_COLUMNS)
        written = scratch.table(merged, f"level-{mask}")
        done[mask] = (written, written.count())
    out = [
        t.select(F.lit(mask).alias(level), *((F.col(k) if k in t.columns else F.lit(None)).cast(sketches.schema[k].dataType).alias(k) for k in plain), *SKETCH_COLUMNS)
        for mask, (t, _) in done.items()
    ]
    return reduce(DataFrame.unionByName, out)


def estimate_distinct(
    sketches: DataFrame, keys: Sequence[str], fields: Sequence[str], shape: BitmapShape = BitmapShape()
) -> DataFrame:
    """One row per group with a double column ``n_<field>`` per field (0.0 for a field without values).

    Merged sketches have at most ``slices * words`` rows per group and field, so groups are brought
    together once, and both steps of the estimate run where they are.
    """
    gathered = sketches.repartition(*keys) if keys else sketches
    per_slice = gathered.groupBy(*keys, "field", F.floor(F.col("slot") / F.lit(shape.words)).cast("int").alias("slice_no")).agg(
        F.sum(F.bit_count("bits")).alias("filled")
    )
    limit = int(shape.bits * shape.full_at)
    free = F.greatest(F.lit(shape.bits) - F.col("filled"), F.lit(0.5)) / F.lit(float(shape.bits))
    counted = per_slice.withColumn("in_slice", -F.ln(free) * F.lit(float(shape.bits)))
    # The base is the slice after the last full one; ids of a slice s reach the sum only if s >= base.
    last_full = [F.max(F.when((F.col("field") == f) & (F.col("filled") > limit), F.col("slice_no"))) for f in fields]
    by_slice = [
        F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("slice_no", "in_slice")))) for f in fields
    ]
    grouped = counted.groupBy(*keys).agg(
        *(c.alias(f"__full_{i}") for i, c in enumerate(last_full)), *(c.alias(f"__s_{i}") for i, c in enumerate(by_slice))
    )

    def scaled(i: int) -> Column:
        base = F.least(F.coalesce(F.col(f"__full_{i}") + 1, F.lit(0)), F.lit(shape.slices - 1))
        counted_from_base = F.transform(F.col(f"__s_{i}"), lambda x: F.when(x["slice_no"] >= base, x["in_slice"]).otherwise(0.0))
        total = F.aggregate(counted_from_base, F.lit(0.0), lambda acc, x: acc + x)
        return total * F.pow(F.lit(2.0), base.cast("double"))

    return grouped.select(*keys, *(scaled(i).alias(f"n_{f}") for i, f in enumerate(fields)))
