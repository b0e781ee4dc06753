"""Gradient-boosted trees grown level by level over binned rows, all trees in one barrier stage.

Every task holds its rows' bins (a byte per number, two per category column) and margins. Histograms of all
tasks are added up for every level, so every task chooses the same splits. A category column
is one histogram, whatever the number of its categories; of two siblings only the smaller is
counted. Gradients are rounded to multiples of 2**-20, so sums are exact and the trees do not
depend on how rows are spread over tasks.

The loss is log(1 + exp(-2 y F)) with labels -1 and 1; the first tree fits the labels at weight 1,
every further one the negative gradient at weight ``step``; leaves are weighted means.
"""

from __future__ import annotations

import pickle
import secrets
import socket
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.encode import Encoder, Numbers

#: Bins of a number.
BINS = 32
SCALE = float(1 << 20)
WAIT_SECONDS = 3_600


@dataclass
class Bins:
    """Thresholds per number (bin k: the k-th is the first not below the value), categories per category column, and their feature numbers."""

    thresholds: list[np.ndarray]
    number_features: np.ndarray
    categories: list[int]
    category_features: list[int]

    @property
    def width(self) -> int:
        return len(self.thresholds) + 2 * len(self.categories) + 1


def fit_bins(rows: DataFrame, encoder: Encoder) -> Bins:
    """At most 31 thresholds a number: its quantiles, and where single values hold many of them, quantiles of the other rows, too."""
    numbers, features, categories, first = [], [], [], []
    for at, b in encoder._placed():
        if isinstance(b, Numbers):
            numbers += [c.cast("double") for c in b.columns.values()]
            features += range(at, at + len(b.names))
        else:
            categories.append(len(b.values))
            first.append(at)
    every = [k / BINS for k in range(1, BINS)]
    found = [sorted(v or []) for v in rows.agg(*(F.percentile_approx(c, F.array(*map(F.lit, every)), F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(numbers))).first()]
    often = [sorted({x for x in v if v.count(x) > 1}) for v in found]
    more, wanted = [], [i for i, v in enumerate(found) if often[i] and len(set(v)) < BINS - 1]
    for i in wanted:
        m = BINS - 1 - len(set(found[i]))
        more.append(F.percentile_approx(F.when(~numbers[i].isin(often[i]), numbers[i]), F.array(*(F.lit(k / (m + 1)) for k in range(1, m + 1))), F.lit(10_000)).alias(f"q{i}"))
    if more:
        for i, v in zip(wanted, rows.agg(*more).first(), strict=True):
            found[i] = found[i] + list(v or [])
    return Bins([np.unique(np.array(v, float)) for v in found], np.array(features, np.int64), categories, first)


def binned(rows: DataFrame, encoder: Encoder, bins: Bins) -> DataFrame:
    """``codes``: per row a byte per number, two per category column and one for the ``label`` (1 or 0)."""
    columns = [c.cast("double").alias(f"n{i}") for i, c in enumerate(c for _, b in encoder._placed() if isinstance(b, Numbers) for c in b.columns.values())]
    hot = [b for _, b in encoder._placed() if not isinstance(b, Numbers)]
    columns += [F.coalesce(b.lookup(list(range(len(b.values)))), F.lit(len(b.values))).cast("int").alias(f"c{i}") for i, b in enumerate(hot)]
    n, k, width, thresholds = len(bins.thresholds), len(hot), bins.width, bins.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty((b.num_rows, width), np.uint8)
            for i, t in enumerate(thresholds):
                out[:, i] = np.searchsorted(t, b.column(i).to_numpy(zero_copy_only=False))
            for i in range(k):
                out[:, n + 2 * i : n + 2 * i + 2] = b.column(n + i).to_numpy(zero_copy_only=False).astype("<u2").view(np.uint8).reshape(-1, 2)
            out[:, -1] = b.column(n + k).to_numpy(zero_copy_only=False)
            offsets = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(out)])], names=["codes"])

    return rows.select(*columns, F.col("label").cast("int")).mapInArrow(run, "codes binary")


class _Sum:
    """Adds arrays up over the tasks of a barrier stage, by way of its first task."""

    def __init__(self) -> None:
        self.context = BarrierTaskContext.get()
        infos = self.context.getTaskInfos()
        self.rank, size = self.context.partitionId(), len(infos)
        hosts = [i.address.rsplit(":", 1)[0] for i in infos]
        server = socket.create_server(("", 0), backlog=size) if not self.rank else None
        mine = f"{server.getsockname()[1]} {secrets.token_hex(32)}" if server else ""
        port, secret = self.context.allGather(mine)[0].split()
        self.peers = []
        if server:
            server.settimeout(WAIT_SECONDS)
            while len(self.peers) < size - 1:
                peer, _ = server.accept()
                peer.settimeout(WAIT_SECONDS)
                if secrets.compare_digest(_receive(peer, 64), secret.encode()):
                    self.peers.append(peer)
            server.close()
        else:
            peer = socket.create_connection(("127.0.0.1" if len(set(hosts)) == 1 else hosts[0], int(port)), WAIT_SECONDS)
            peer.sendall(secret.encode())
            self.peers.append(peer)
        for peer in self.peers:
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.rank:
            self.peers[0].sendall(np.ascontiguousarray(x))
            return np.frombuffer(_receive(self.peers[0], x.nbytes), x.dtype).reshape(x.shape)
        total = x.copy()
        for peer in self.peers:
            total += np.frombuffer(_receive(peer, x.nbytes), x.dtype).reshape(x.shape)
        for peer in self.peers:
            peer.sendall(total)
        return total

    def close(self) -> None:
        for peer in self.peers:
            peer.close()


def _receive(peer: socket.socket, size: int) -> bytearray:
    out = bytearray(size)
    view, at = memoryview(out), 0
    while at < size:
        got = peer.recv_into(view[at:])
        if not got:
            raise ConnectionError("a task of the boosting stage is gone")
        at += got
    return out


@dataclass
class Grown:
    """One tree: arrays over nodes, and what its splits gained per feature."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    weight: float
    gains: dict[int, float]


def grow(
    table: DataFrame, bins: Bins, before: Sequence[Grown], count: int, weights: tuple[float, float], *, step: float, depth: int, min_leaf: int, column_share: float, seed: int
) -> list[Grown]:
    """Trees ``len(before)`` to ``count`` over the rows of ``binned``; ``weights`` are those of the labels 0 and 1."""
    tasks = max(1, table.sparkSession.sparkContext.defaultParallelism)
    settings = (step, depth, min_leaf, column_share, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            if b.num_rows:
                c = b.column(0)
                start, end = struct.unpack_from("<i", c.buffers()[1], 4 * c.offset)[0], struct.unpack_from("<i", c.buffers()[1], 4 * (c.offset + len(c)))[0]
                parts.append(np.frombuffer(c.buffers()[2], np.uint8)[start:end].reshape(len(c), bins.width).copy())
        codes = np.concatenate(parts) if parts else np.empty((0, bins.width), np.uint8)
        total = _Sum()
        trees = _Learner(codes, bins, weights, total, settings).grow(before, count)
        total.close()
        if not total.rank:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], names=["trees"])

    return pickle.loads(table.repartition(tasks).mapInArrow(run, "trees binary", barrier=True).collect()[0]["trees"])


class _Learner:
    def __init__(self, codes: np.ndarray, bins: Bins, weights: tuple[float, float], total, settings: tuple) -> None:
        self.bins, self.total = bins, total
        self.step, self.depth, self.min_leaf, self.column_share, self.seed = settings
        n = len(bins.thresholds)
        self.columns = [np.ascontiguousarray(codes[:, i]) for i in range(n)]
        self.columns += [np.ascontiguousarray(codes[:, n + 2 * i : n + 2 * i + 2]).view("<u2")[:, 0] for i in range(len(bins.categories))]
        self.sizes = [BINS] * n + [k + 1 for k in bins.categories]  # the last of a category column: unseen
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.features = int(len(bins.number_features) + sum(bins.categories))
        self.label = codes[:, -1].astype(np.float64)
        self.weights = weights
        self.weight = np.where(self.label == 1, weights[1], weights[0])
        # A row counts 1, and one of label 1 2**26 more: two exact counts in one sum per task.
        self.counted = 1.0 + self.label * float(1 << 26)
        self.whole: np.ndarray | None = None

    def _histogram(self, values: np.ndarray, rows: np.ndarray | None, slot: np.ndarray | None, slots: int) -> np.ndarray:
        out = np.empty((slots, self.starts[-1]))
        for c, size, at in zip(self.columns, self.sizes, self.starts, strict=False):
            place = c if rows is None else slot * size + c[rows]
            out[:, at : at + size] = np.bincount(place, values, slots * size).reshape(slots, size)
        return out

    def _sums(self, gradient: np.ndarray, rows: np.ndarray | None, slot: np.ndarray | None, slots: int) -> np.ndarray:
        """(rows, rows of label 1, gradient) per slot and bin, over all tasks."""
        g = self._histogram(gradient if rows is None else gradient[rows], rows, slot, slots)
        if rows is None and self.whole is not None:
            return np.stack([*self.whole, self.total(g)])
        both = self._histogram(self.counted if rows is None else self.counted[rows], rows, slot, slots)
        ones = np.floor(both / float(1 << 26))
        out = self.total(np.stack([both - ones * float(1 << 26), ones, g]))
        if rows is None:
            self.whole = out[:2].copy()
        return out

    def grow(self, before: Sequence[Grown], count: int) -> list[Grown]:
        trees, margin = list(before), np.zeros(len(self.label))
        for t in trees:
            margin += t.weight * self._predict(t)
        sign = 2.0 * self.label - 1.0
        while len(trees) < count:
            with np.errstate(over="ignore"):
                target = sign if not trees else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
            tree, at = self._tree(np.rint(target * self.weight * SCALE), len(trees))
            trees.append(tree)
            margin += tree.weight * np.array(tree.value)[at]
        return trees

    def _predict(self, tree: Grown) -> np.ndarray:
        at = np.zeros(len(self.label), np.int64)
        todo = [(0, np.arange(len(at)))]
        while todo:
            node, rows = todo.pop()
            at[rows] = node
            if tree.feature[node] >= 0:
                right = self._right(rows, tree.feature[node], tree.threshold[node])
                todo += [(tree.left[node], rows[~right]), (tree.right[node], rows[right])]
        return np.array(tree.value)[at]

    def _right(self, rows: np.ndarray, feature: int, threshold: float) -> np.ndarray:
        """Which rows have more than the threshold."""
        found = np.flatnonzero(self.bins.number_features == feature)
        if len(found):
            i = int(found[0])
            return self.columns[i][rows] > np.searchsorted(self.bins.thresholds[i], threshold)
        for i, (first, k) in enumerate(zip(self.bins.category_features, self.bins.categories, strict=True)):
            if first <= feature < first + k:
                return self.columns[len(self.bins.thresholds) + i][rows] == feature - first
        raise ValueError(f"no feature {feature}")

    def _mean(self, node: np.ndarray) -> float:
        n, p, g = node[:, : self.sizes[0]].sum(1)
        w = self.weights[1] * p + self.weights[0] * (n - p)
        return float(g / SCALE / w) if w > 0 else 0.0

    def _tree(self, gradient: np.ndarray, number: int) -> tuple[Grown, np.ndarray]:
        tree = Grown([-1], [0.0], [0], [0], [0.0], 1.0 if not number else self.step, {})
        at = np.zeros(len(gradient), np.int64)
        level = {0: self._sums(gradient, None, None, 1)[:, 0]}
        rows_of = {0: np.arange(len(gradient))}
        tree.value[0] = self._mean(level[0])
        for depth in range(self.depth):
            split = {}
            for node, sums in level.items():
                found = self._best(sums, np.random.default_rng((self.seed, number, node)))
                if found is None:
                    continue
                feature, threshold, gain, small_left = found
                tree.gains[feature] = tree.gains.get(feature, 0.0) + gain
                left = len(tree.feature)
                tree.feature[node], tree.threshold[node], tree.left[node], tree.right[node] = feature, threshold, left, left + 1
                for _ in range(2):
                    for x, y in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, 0), (tree.right, 0), (tree.value, 0.0)):
                        x.append(y)
                rows = rows_of[node]
                right = self._right(rows, feature, threshold)
                rows_of[left], rows_of[left + 1] = rows[~right], rows[right]
                at[rows_of[left]], at[rows_of[left + 1]] = left, left + 1
                split[node] = (left, small_left)
            if not split:
                break
            # The smaller child of every split is counted, the other is the rest of its parent.
            counted = [left if small_left else left + 1 for left, small_left in split.values()]
            if depth + 1 == self.depth:
                sums = self._leaves(gradient, rows_of, counted)
            else:
                rows = np.concatenate([rows_of[c] for c in counted])
                slot = np.repeat(np.arange(len(counted)), [len(rows_of[c]) for c in counted])
                sums = self._sums(gradient, rows, slot, len(counted))
            below = {}
            for k, ((node, (left, _)), child) in enumerate(zip(split.items(), counted, strict=True)):
                parent = level[node] if sums.shape[2] > 1 else level[node][:, : self.sizes[0]].sum(1, keepdims=True)
                other = 2 * left + 1 - child
                below[child], below[other] = sums[:, k], parent - sums[:, k]
                for c in (child, other):
                    tree.value[c] = self._mean(below[c])
            level = dict(sorted(below.items()))
        return tree, at

    def _leaves(self, gradient: np.ndarray, rows_of: dict[int, np.ndarray], counted: list[int]) -> np.ndarray:
        """The sums of nodes that are not split any more: no bins."""
        found = [(len(rows_of[c]), self.label[rows_of[c]].sum(), gradient[rows_of[c]].sum()) for c in counted]
        return self.total(np.array(found, float).T[:, :, None].copy())

    def _best(self, sums: np.ndarray, draw: np.random.Generator) -> tuple[int, float, float, bool] | None:
        """(feature, threshold, gain, whether fewer rows go left) of the split with the largest fall of the squared error."""
        n, p, g = sums[:, : self.sizes[0]].sum(1)
        weigh = lambda n, p: self.weights[1] * p + self.weights[0] * (n - p)
        numbers = len(self.bins.thresholds)
        left = np.cumsum(sums[:, : numbers * BINS].reshape(3, numbers, BINS), 2)[:, :, :-1].reshape(3, -1)
        features = [np.repeat(self.bins.number_features, BINS - 1)]
        parts, thresholds = [left], [np.concatenate([np.r_[t, np.full(BINS - 1 - len(t), np.nan)] for t in self.bins.thresholds])]
        for i, (first, k) in enumerate(zip(self.bins.category_features, self.bins.categories, strict=True)):
            at = self.starts[numbers + i]
            parts.append(np.array([n, p, g])[:, None] - sums[:, at : at + k])
            features.append(np.arange(first, first + k))
            thresholds.append(np.full(k, 0.5))
        (ln, lp, lg), feature, threshold = np.concatenate(parts, 1), np.concatenate(features), np.concatenate(thresholds)
        allowed = np.zeros(self.features, bool)
        allowed[draw.permutation(self.features)[: int(np.ceil(self.column_share * self.features))]] = True
        rn = n - ln
        ok = (ln >= self.min_leaf) & (rn >= self.min_leaf) & allowed[feature] & ~np.isnan(threshold)
        if not ok.any():
            return None
        lw, whole = weigh(ln, lp), weigh(n, p)
        rw = whole - lw
        gain = np.full(len(ln), -np.inf)
        gain[ok] = (lg[ok] ** 2 / lw[ok] + (g - lg[ok]) ** 2 / rw[ok] - g**2 / whole) / SCALE**2
        best = int(np.argmax(gain))
        if not gain[best] > 1e-12 * whole:
            return None
        return int(feature[best]), float(threshold[best]), float(gain[best]), bool(ln[best] <= rn[best])
