"""Numbers of distinct earlier rows that share at least one value with a row, without building pairs.

Such a number is, by inclusion and exclusion over subsets of a row's values, the sum of sign * (earlier
rows equal on the whole subset). A subset is counted where its *home* value is: a row is sent once
to each of its values, with hashes of the values that may come with it, and all subsets at home
there are counted inside the task, growing a subset only by rows that still have company. So a row
is shuffled once per value, not once per subset. Values of more than ``group_rows`` rows (and a
fair share of all) are no home: subsets of such values alone are counted as prefix sums by day.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.skew import fair_parts
from tidegraph.session import Scratch

#: A value of up to so many rows is counted in one task.
GROUP_ROWS = 4_096
#: Rows that a task counts at once, besides those of one value.
BLOCK_ROWS = 65_536
#: Most parts of a fair share: bounds the list of frequent values.
MOST_PARTS = 1_000


def _code(c: str, seed: int):
    """A hash that is 0 only for NULL."""
    h = F.xxhash64(F.col(c), F.lit(seed))
    return F.when(F.col(c).isNull(), 0).when(h == 0, 1).otherwise(h)


def frequent_values(rows: DataFrame, columns: Sequence[str], scratch: Scratch, group_rows: int = GROUP_ROWS) -> dict[str, list]:
    """Per column the values of more than ``group_rows`` rows and more than a fair share of all: fewer than ``MOST_PARTS`` each."""
    least = max(rows.count() // min(fair_parts(rows), MOST_PARTS), group_rows)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("value")) for i, c in enumerate(columns)))
    counts = rows.select(F.inline(each)).filter("value IS NOT NULL").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    found = scratch.table(counts.filter(F.col("n") > least), "frequent").collect()
    return {c: sorted(r["value"] for r in found if r["i"] == i) for i, c in enumerate(columns)}


def home_terms(rows: DataFrame, columns: Sequence[str], homes: Sequence[int], frequent: dict[str, list], values: Sequence[str], delay: int = 1) -> DataFrame:
    """``(transaction_id, *values)``: signed sums of the bigint ``values`` of rows at least ``delay`` older, over the subsets at home in the columns ``homes``.

    A subset's home is its first value that is not frequent. Home values are told apart by two
    hashes of 64 bits, the others, only ever compared within one home, by one.
    """
    often = {c: F.col(c).isin(v) if v else F.lit(False) for c, v in frequent.items()}
    code = {c: F.col(f"__c{j}") for j, c in enumerate(columns)}
    coded = rows.filter("transaction_time IS NOT NULL").select(
        "transaction_id", "transaction_time", *values, *(_code(c, j).alias(f"__c{j}") for j, c in enumerate(columns)), *(F.coalesce(often[c], F.lit(False)).alias(f"__f{j}") for j, c in enumerate(columns)),
        *(_code(columns[i], i + 1_000).alias(f"__s{i}") for i in homes),
    )
    each = []
    for i in homes:
        rest = (F.lit(0).cast("bigint") if j == i else code[c] if j > i else F.when(F.col(f"__f{j}"), code[c]).otherwise(0) for j, c in enumerate(columns))
        at_home = F.struct(code[columns[i]].alias("h1"), F.col(f"__s{i}").alias("h2"), *(x.alias(f"c{j}") for j, x in enumerate(rest)))
        each.append(F.when((code[columns[i]] != 0) & ~F.col(f"__f{i}"), at_home))
    sent = coded.select("transaction_id", *values, F.col("transaction_time").cast("bigint").alias("at"), F.explode(F.array_compact(F.array(*each))).alias("x"))
    sent = sent.select("transaction_id", "at", *values, "x.*").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "at")
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BLOCK_ROWS:
                continue
            block = pa.Table.from_batches(held).combine_chunks()
            h1, h2 = block["h1"].to_numpy(), block["h2"].to_numpy()
            other = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield from _counted(block.slice(0, whole), width, values, delay)
            held, size = block.slice(whole).to_batches(), block.num_rows - whole
        if size:
            yield from _counted(pa.Table.from_batches(held), width, values, delay)

    return sent.mapInArrow(run, "transaction_id string, " + ", ".join(f"{v} bigint" for v in values))


def _counted(block: pa.Table, width: int, values: Sequence[str], delay: int) -> Iterator[pa.RecordBatch]:
    column = lambda c: block[c].to_numpy()
    total = signed_sums(column("h1"), column("h2"), column("at"), [column(f"c{j}") for j in range(width)], [column(v) for v in values], delay)
    at = np.flatnonzero(total.any(0))
    found = pa.table({"transaction_id": block["transaction_id"].take(pa.array(at)), **{v: t[at] for v, t in zip(values, total, strict=True)}})
    yield from found.combine_chunks().to_batches()


def signed_sums(h1: np.ndarray, h2: np.ndarray, at: np.ndarray, codes: Sequence[np.ndarray], values: Sequence[np.ndarray], delay: int) -> np.ndarray:
    """Per value and row: the sum over subsets of its ``codes`` (0: none) of sign * (the value's sum over rows of its home with the same subset, at least ``delay`` older).

    Rows are sorted by ``h1, h2, at``; ``delay`` is positive; the empty subset, which is the home alone, counts plus.
    """
    total = np.zeros((len(values), len(at)), np.int64)
    dense = [np.unique(c, return_inverse=True) for c in codes]
    times, place = np.unique(at, return_inverse=True)
    known = np.searchsorted(times, at - delay, side="right")

    def grow(rows: np.ndarray, key: np.ndarray, nexts: int, sign: int) -> None:
        """``rows`` in order of ``key``, then time."""
        if len(rows) < 2:
            return
        fresh = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(fresh)
        label = np.cumsum(fresh) - 1
        company = np.diff(np.r_[start, len(rows)])[label] > 1
        if not company.any():
            return
        base = label * (len(times) + 1)
        until = np.searchsorted(base + place[rows], base + known[rows])
        for t, v in zip(total, values, strict=True):
            sums = np.r_[0, np.cumsum(v[rows])]
            t[rows] += sign * (sums[until] - sums[start[label]])
        rows, label = rows[company], label[company]
        for j in range(nexts, len(codes)):
            has = codes[j][rows] != 0
            some, names = rows[has], dense[j]
            key = label[has] * len(names[0]) + names[1][some]
            order = np.argsort(key, kind="stable")
            grow(some[order], key[order], j + 1, -sign)

    home = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(at) else np.empty(0, bool)
    grow(np.arange(len(at)), np.cumsum(home), 0, 1)
    return total
