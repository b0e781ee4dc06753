"""Percentiles of very large numeric columns by relative-rank compactors.

A sketch has levels; an item on level h stands for 2**h values. When the buffer of a level is full
it is sorted and its *lower* part is compacted: every second item moves up a level, the others go.
The upper part is protected, so ranks close to the maximum stay almost exact and the rank error at
percentile q is proportional to 1 - q. How far a compaction reaches into the compactable half
follows the trailing ones of the number of compactions so far; sections get more and smaller as
that number grows. Sketches of partitions, days or groups merge by joining levels (the counters by
OR) and compacting again.

Stated error: the rank of a returned value differs from q*n by at most ``rank_error(q) * n`` with
probability 0.99; groups smaller than one buffer (``6 * k`` values) are exact.

All groups of a task are processed together with numpy; a task holds at most ``FLUSH_ITEMS`` raw
values besides the sketches of its groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_K = 32
FLUSH_ITEMS = 1_000_000
#: Rows of sketches, of whole keys, that are merged at once.
MERGE_ROWS = 100_000
SKETCH_FIELDS = [
    T.StructField("level", T.IntegerType()),
    T.StructField("state", T.LongType()),
    T.StructField("items", T.ArrayType(T.DoubleType(), False)),
]
FIRST_SECTIONS = 3


def rank_error(q: float, k: int = DEFAULT_K) -> float:
    """Bound of |rank - q| that holds with probability 0.99."""
    return 3 * 0.16 / k * (1 - q)


def _shape(state: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sections, section size) after ``state`` compactions."""
    sections = np.full(len(state), FIRST_SECTIONS, dtype=np.int64)
    size = np.full(len(state), float(k))
    for _ in range(5):
        more = (state >= np.left_shift(1, np.minimum(sections - 1, 62))) & (size > 5.6)
        sections = np.where(more, sections * 2, sections)
        size = np.where(more, size / np.sqrt(2.0), size)
    return sections, np.maximum(4, 2 * np.round(size / 2)).astype(np.int64)


def _coin(first: np.ndarray, last: np.ndarray, level: int, state: np.ndarray) -> np.ndarray:
    """A bit per segment, drawn from its content, so that a repeated task gives the same sketch."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last.view(np.uint64)
    x = x ^ (state.astype(np.uint64) << np.uint64(7)) ^ np.uint64(level + 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(1)).astype(np.int64)


def _trailing_ones(state: np.ndarray) -> np.ndarray:
    lowest_zero = ~state & (state + 1)
    return np.round(np.log2(lowest_zero.astype(np.float64))).astype(np.int64)


def compact(group: np.ndarray, level: np.ndarray, value: np.ndarray, states: dict[int, tuple[np.ndarray, np.ndarray]], n_groups: int, k: int):
    """Compacts every full (group, level) once, from the lowest level up.

    ``states`` maps a level to (group codes, counters). Returns a list over levels of
    ``(sorted group codes, sorted values, counters by group code)``.
    """
    out = []
    up_group, up_value = np.empty(0, np.int64), np.empty(0)
    highest = max([int(level.max()) if len(level) else 0, *states.keys()]) if len(level) or states else 0
    h = 0
    while h <= highest or len(up_group):
        here = level == h
        g, v = np.concatenate([group[here], up_group]), np.concatenate([value[here], up_value])
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        counters = np.zeros(n_groups, np.int64)
        if h in states:
            np.bitwise_or.at(counters, states[h][0], states[h][1])
        up_group, up_value = np.empty(0, np.int64), np.empty(0)
        if len(g):
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            lengths = np.diff(np.r_[starts, len(g)])
            seg_group = g[starts]
            sections, size = _shape(counters[seg_group], k)
            capacity = 2 * sections * size
            full = lengths >= capacity
            if full.any():
                reach = np.minimum(_trailing_ones(counters[seg_group]) + 1, sections)
                stay = capacity // 2 + (sections - reach) * size
                take = np.where(full, (lengths - stay) & ~1, 0)
                coin = np.zeros(len(starts), np.int64)
                f = np.flatnonzero(full)
                coin[f] = _coin(v[starts[f]], v[starts[f] + take[f] - 1], h, counters[seg_group[f]])
                rank = np.arange(len(g)) - np.repeat(starts, lengths)
                lower = rank < np.repeat(take, lengths)
                moves = lower & ((rank & 1) == np.repeat(coin, lengths))
                up_group, up_value = g[moves], v[moves]
                g, v = g[~lower], v[~lower]
                counters[seg_group[f]] += 1
        out.append((g, v, counters))
        h += 1
    return out


def _codes(columns: list[pa.ChunkedArray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(code per row, first row of each code): exact group codes of several key columns."""
    code = np.zeros(n, np.int64)
    for c in columns:
        enc = c.combine_chunks().dictionary_encode(null_encoding="encode")
        enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
        idx = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (len(enc.dictionary) + 1) + idx, return_inverse=True)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse, first


class _Task:
    """Sketches of one task: raw values and arriving sketches are folded in when enough have gathered."""

    def __init__(self, keys: Sequence[str], k: int, schema: pa.Schema):
        self.keys, self.k, self.schema = list(keys), k, schema
        self.held: list[pa.Table] = []
        self.waiting = 0
        self.rows = 0

    def add(self, table: pa.Table, items: int) -> None:
        self.held.append(table)
        self.rows += table.num_rows
        self.waiting += items
        if self.waiting >= FLUSH_ITEMS:
            self.fold()

    def fold(self) -> tuple[pa.Table, list] | None:
        self.waiting = 0
        if not self.held:
            return None
        whole = pa.concat_tables(self.held)
        n = whole.num_rows
        code, first = _codes([whole[c] for c in self.keys], n) if self.keys else (np.zeros(n, np.int64), np.zeros(min(n, 1), np.int64))
        lists = whole["items"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        levels = whole["level"].to_numpy().astype(np.int64)
        counters = whole["state"].to_numpy().astype(np.int64)
        states = {}
        for h in np.unique(levels):
            at = (levels == h) & (counters > 0)
            states[int(h)] = (code[at], counters[at])
        folded = compact(np.repeat(code, lengths), np.repeat(levels, lengths), values, states, len(first), self.k)
        key_rows = whole.select(self.keys).take(pa.array(first)) if self.keys else None
        parts = []
        for h, (g, v, counters) in enumerate(folded):
            present = np.unique(np.r_[g, np.flatnonzero(counters)])
            if not len(present):
                continue
            ends = np.searchsorted(g, present, side="right")
            offsets = np.r_[np.searchsorted(g, present[:1], side="left"), ends]
            columns = [key_rows[c].take(pa.array(present)).combine_chunks() for c in self.keys]
            columns += [pa.array(np.full(len(present), h, np.int32)), pa.array(counters[present]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v))]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in columns]
            parts.append(pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, self.schema, strict=True)], schema=self.schema))
        self.held = parts
        return key_rows, folded

    def result(self) -> pa.Table | None:
        self.fold()
        return pa.concat_tables(self.held) if self.held else None


def _batches(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
    if table is not None:
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)


def quantile_sketch(df: DataFrame, keys: Sequence[str], value: str, k: int = DEFAULT_K) -> DataFrame:
    """Sketches ``(*keys, level, state, items)`` per input partition, mergeable and not yet merged.

    NULL and NaN values are left out; a NULL key is a group of its own. ``k`` is even and at least
    4; the error falls as 1/k. The rows of one group may be spread over any number of partitions:
    each partition contributes one sketch, so a hot group is never gathered.
    """
    if k < 4 or k % 2:
        raise ValueError("k must be even and at least 4")
    names = list(keys)
    if {f.name for f in SKETCH_FIELDS} & set(names):
        raise ValueError("rename keys called level, state or items")
    chosen = df.select(*names, F.col(value).cast("double").alias("__value")).filter(F.col("__value").isNotNull() & ~F.isnan("__value"))
    schema = T.StructType([*(chosen.schema[c] for c in names), *SKETCH_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        for b in batches:
            if not b.num_rows:
                continue
            if task is None:
                task = _Task(names, k, _arrow_schema(b.schema, names))
            n = b.num_rows
            singles = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), b.column(b.schema.get_field_index("__value")))
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            columns += [pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), singles]
            task.add(pa.Table.from_arrays([a.cast(f.type) for a, f in zip(columns, task.schema, strict=True)], schema=task.schema), n)
        if task is not None:
            yield from _batches(task.result())

    return chosen.mapInArrow(run, schema)


def _arrow_schema(incoming: pa.Schema, names: list[str]) -> pa.Schema:
    fields = [pa.field(c, incoming.field(c).type) for c in names]
    return pa.schema([*fields, pa.field("level", pa.int32()), pa.field("state", pa.int64()), pa.field("items", pa.list_(pa.float64()))])


def merge_quantile_sketches(sketches: DataFrame, keys: Sequence[str], k: int = DEFAULT_K, *, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """One sketch per group of ``keys`` (which may be coarser than those the sketches were made for)."""
    return _merged(sketches, keys, k, None, merge_rows)


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float], k: int = DEFAULT_K, *, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """Merges and evaluates: ``(*keys, n, q_0, q_1, ...)`` in the order of ``quantiles``.

    ``q_i`` is the smallest kept value that at least that share of the values does not exceed.
    """
    return _merged(sketches, keys, k, list(quantiles), merge_rows)


def _merged(sketches: DataFrame, keys: Sequence[str], k: int, quantiles: list[float] | None, merge_rows: int) -> DataFrame:
    names = list(keys)
    chosen = sketches.select(*names, "level", "state", "items", (F.xxhash64(*names) if names else F.lit(0).cast("bigint")).alias("__h"))
    # Sorted runs of a key: a task holds the sketches of the keys at hand, not those of all its keys.
    chosen = (chosen.repartition("__h") if names else chosen.coalesce(1)).sortWithinPartitions("__h")
    key_fields = [chosen.schema[c] for c in names]
    if quantiles is None:
        schema = T.StructType([*key_fields, *SKETCH_FIELDS])
    else:
        schema = T.StructType(
            [*key_fields, T.StructField("n", T.LongType()), *(T.StructField(f"q_{i}", T.DoubleType()) for i in range(len(quantiles)))]
        )

    def finished(task: _Task) -> Iterator[pa.RecordBatch]:
        if quantiles is None:
            yield from _batches(task.result())
        elif task.held:
            yield from _batches(_evaluated(task, names, quantiles, schema.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if task is None:
                task = _Task(names, k, _arrow_schema(b.schema, names))
            hashes = b.column(b.schema.get_field_index("__h")).to_numpy(zero_copy_only=False)
            columns = [b.column(b.schema.get_field_index(c)) for c in task.schema.names]
            table = pa.Table.from_arrays([a.cast(f.type) for a, f in zip(columns, task.schema, strict=True)], schema=task.schema)
            # The keys before the batch's last one are complete.
            cut = int(np.searchsorted(hashes, hashes[-1], side="left"))
            if cut and task.rows + cut >= merge_rows:
                task.add(table.slice(0, cut), _items(table.slice(0, cut)))
                yield from finished(task)
                task = _Task(names, k, task.schema)
                table = table.slice(cut)
            elif not cut and last is not None and hashes[-1] != last and task.rows >= merge_rows:
                yield from finished(task)
                task = _Task(names, k, task.schema)
            task.add(table, _items(table))
            last = hashes[-1]
        if task is not None:
            yield from finished(task)

    return chosen.mapInArrow(run, schema)


def _items(table: pa.Table) -> int:
    return int(pc.sum(pc.list_value_length(table["items"])).as_py() or 0)


def _evaluated(task: _Task, names: list[str], quantiles: list[float], columns_out: list[str]) -> pa.Table:
    """One row per group of a task: its size and quantiles."""
    key_rows, levels = task.fold()
    g = np.concatenate([x[0] for x in levels])
    v = np.concatenate([x[1] for x in levels])
    w = np.concatenate([np.full(len(x[0]), 1 << h, np.int64) for h, x in enumerate(levels)])
    order = np.lexsort((v, g))
    g, v, w = g[order], v[order], w[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    total = np.add.reduceat(w, starts)
    running = np.cumsum(w)
    before = running[starts] - w[starts]
    columns = [key_rows[c].take(pa.array(g[starts])).combine_chunks() for c in names] + [pa.array(total)]
    for q in quantiles:
        target = before + np.maximum(1, np.ceil(np.round(q * total, 9))).astype(np.int64)
        columns.append(pa.array(v[np.searchsorted(running, target, side="left")]))
    return pa.Table.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in columns], names=columns_out)
