"""Trees on binned rows: one grower for forests, boosting and classification trees.

Every feature is cut once into at most 256 bins at its quantiles, so a row is one byte per
feature. Statistics are whole numbers (counts, and weights and targets in fixed point):
their sums do not depend on the order of rows, and a tree is the same however its rows are
partitioned.

A node's best split comes from the sums per (node, feature, bin). Nodes of more than
``LOCAL_ROWS`` rows are split together in one Spark job per step: each task adds up the
cells of its rows, Spark adds the tasks' cells and picks the best cut per node with window
sums, and one row per node reaches the driver. A node that fits ``LOCAL_ROWS`` is a bounded
group: it is finished inside one task with the same formula.

* ``Forest``: rows travel to their (tree, node) groups of at most ``FOREST_ROWS`` training rows,
  packed in blocks, test rows with them. A task grows
  the rest of the tree from the training rows and at once scores the test rows, so no
  forest is stored or shipped; votes are summed per row.
* ``boost``: best-first (or depth-limited) trees on gradients. While the whole fit exceeds
  ``BOOST_ROWS``, rows are stored feature by feature in blocks, and each step is one short job:
  a task sums the smaller child of each open node over its blocks, and the driver holds the
  sums of the open nodes (bounded by features and bins, not by rows) and takes the other
  child as the rest. Margins are stored once per round. Else all rounds run in one bounded
  group.
* ``grow_tree``: one tree from distributed steps alone, and ``prune`` for its
  cost-complexity sequence.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.session import checkpoint_dir

BINS = 256
LOCAL_ROWS = 1 << 16
ONE = float(1 << 30)  # fixed-point unit of weights
RESUME = 16  # rounds between checkpoints of the margins in distributed boosting
BLOCK_ROWS = 1 << 16  # rows summed at a time: 2**16 gradients below 2**31 are exact in floating point
FOREST_ROWS = 1 << 19  # rows of a node of a forest that is finished inside one task
CELLS_A_ROW = 8  # cells per row up to which a sum per cell costs less than a sort
BOOST_ROWS = 1 << 20  # rows of a boosting fit that one task does whole: some 200 MB, and no job per step
BUNDLE_CELLS = 1 << 12  # combinations of codes that are counted together: their sums stay in the cache
STEP_CELLS = 1 << 8  # the same in distributed steps, which count them for all open nodes at once
TASK_ROWS = 1 << 22  # rows of a task of distributed boosting, unless there are more cores

_U = np.uint64
ROWS = "uid long, is_test int, label double, bins binary, id string"


class Growth(NamedTuple):
    """When to split, and what a split is worth."""

    leaves: int | None = None
    depth: int = 30
    min_rows: int = 1
    min_split: int = 2
    min_weight: float = 0.0
    l2: float = 0.0
    by_count: bool = False  # weigh sides by rows instead of by weight
    any_gain: bool = False  # split impure nodes even without a gain


class Split(NamedTuple):
    """Totals of a node and its best split; ``feature`` is -1 without one."""

    n: int
    weight: float
    total: float
    feature: int = -1
    cut: int = 0
    gain: float = 0.0


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf; a row goes left if its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    total: list[float] = field(default_factory=list)

    @cached_property
    def arrays(self) -> tuple[np.ndarray, ...]:
        """The finished tree's features, cuts, children and values; made once, as a deep tree is asked many times."""
        return tuple(np.array(x) for x in (self.feature, self.cut, self.left, self.right, self.value))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right, _ = self.arrays
        at = np.zeros(len(bins), dtype=np.int64)
        rows, here, flat = np.arange(len(bins)), at, np.ascontiguousarray(bins).ravel()
        while len(rows):
            asked = feature.take(here)
            inner = asked >= 0
            if not inner.all():
                rows, here, asked = rows[inner], here[inner], asked[inner]
            goes = flat.take(rows * bins.shape[1] + asked) <= cut.take(here)
            here = np.where(goes, left.take(here), right.take(here))
            at[rows] = here
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.arrays[-1][self.leaf_of(bins)]

    def gains(self, features: int) -> np.ndarray:
        out = np.zeros(features)
        np.add.at(out, [f for f in self.feature if f >= 0], [g for f, g in zip(self.feature, self.gain) if f >= 0])
        return out


# --- hashing -----------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def uniform(uid: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per id and salt, whatever the partitioning."""
    with np.errstate(over="ignore"):
        key = _mix(np.asarray(salt, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(1))
        return _mix(uid.astype(np.int64).view(_U) + key).astype(float) / 2.0**64


# Chances of 0, 1, 2, ... draws of a row in a bootstrap sample, summed up.
_DRAWS = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))


def draws(uid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return np.searchsorted(_DRAWS, uniform(uid, seed * 1_000_003 + tree), side="right")


def feature_order(tree: int, paths: np.ndarray, features: int, seed: int) -> np.ndarray:
    """Order in which each node tries features, a row per node."""
    with np.errstate(over="ignore"):
        node = _mix(paths.astype(_U) * _U(0xD1342543DE82EF95) + _U(tree * 7_919 + seed))
        return np.argsort(_mix(node[:, None] + np.arange(features, dtype=_U) * _U(0x9E3779B97F4A7C15)), axis=1, kind="stable")


# --- bins --------------------------------------------------------------------


def cut_points(df: DataFrame, column: str = "features") -> list[np.ndarray]:
    """At most 255 cuts per feature, at quantiles of all rows; one aggregate, a group per feature."""
    shares = [k / BINS for k in range(1, BINS)]
    # A group per feature, so that the tasks' summaries are put together side by side.
    long = df.select(F.posexplode(vector_to_array(column)).alias("f", "v"))
    got = {r["f"]: r["q"] for r in long.groupBy("f").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()}
    return [np.unique(np.array(got[i], dtype=float)) for i in range(len(got))]


def binned(
    df: DataFrame, cuts: Sequence[np.ndarray], key: str, label: str = "label", test: str = "is_test", column: str = "features"
) -> DataFrame:
    """Rows as ``uid, is_test, label, bins, id``: one byte per feature, the number of cuts below the value.

    ``uid`` is a hash of the key and only draws samples; ``id`` is the key.
    """
    rows = df.select(
        F.xxhash64(key).alias("uid"), F.col(test).cast("int").alias("is_test"), F.col(label).cast("double").alias("label"),
        vector_to_array(column).alias("x"), F.col(key).cast("string").alias("id"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            codes = np.empty(x.shape, dtype=np.uint8)
            for i, c in enumerate(cuts):
                codes[:, i] = np.searchsorted(c, x[:, i], side="left")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r.tobytes() for r in codes], pa.binary()), batch.column(4)],
                names=["uid", "is_test", "label", "bins", "id"],
            )

    return rows.mapInArrow(run, ROWS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in tables of at most ``BLOCK_ROWS``."""
    held, count = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            if count + part.num_rows > BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, count = [], 0
            held.append(part)
            count += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


# --- splits of many nodes by Spark -------------------------------------------

CELLS = "tree int, node long, feature int, bin int, n long, weight long, total long"


def _cells(tree: int, nodes: np.ndarray, which: np.ndarray, codes: np.ndarray, weight: np.ndarray, total: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
    """Sums per (node, feature, bin) of some rows; ``which`` is a row's place in ``nodes``, ``chosen`` a node's features."""
    columns, rows, size = np.ascontiguousarray(codes.T), np.arange(len(which)), len(nodes) * BINS
    halves = []
    for x in (weight, total):
        x = x.astype(np.int64)
        # Sums of whole numbers below 2**53 are exact in floating point; else two halves keep them so.
        small = int(max(abs(x.max()), abs(x.min()))) * len(x) < 1 << 53
        halves.append((x,) if small else np.divmod(x, 1 << 20))
    alike, base = (chosen == chosen[0]).all(axis=0), which * BINS
    parts = []
    for slot in range(chosen.shape[1]):
        code = columns[chosen[0, slot]] if alike[slot] else columns[chosen[which, slot], rows]
        key = base + code
        n = np.bincount(key, minlength=size)
        sums = []
        for x in halves:
            found = [np.bincount(key, weights=half, minlength=size).astype(np.int64) for half in x]
            sums.append(found[0] if len(found) == 1 else (found[0] << 20) + found[1])
        at = np.flatnonzero(n)
        parts.append((nodes[at // BINS], chosen[at // BINS, slot], at % BINS, n[at], sums[0][at], sums[1][at]))
    node, feature, b, n, w, t = (np.concatenate(x) for x in zip(*parts, strict=True))
    ints = [pa.array(x.astype(np.int32)) for x in (np.full(len(node), tree), feature, b)]
    return pa.RecordBatch.from_arrays(
        [ints[0], pa.array(node.astype(np.int64)), ints[1], ints[2], *(pa.array(x.astype(np.int64)) for x in (n, w, t))],
        names=["tree", "node", "feature", "bin", "n", "weight", "total"],
    )


def best_splits(cells: DataFrame, growth: Growth, unit: float = ONE) -> dict[tuple[int, int], Split]:
    """Totals and best split per (tree, node); ties go to the first feature, then the lowest cut."""
    summed = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(x).alias(x) for x in ("n", "weight", "total")])
    every = Window.partitionBy("tree", "node", "feature")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = summed.select(
        "tree", "node", "feature", "bin",
        *[F.sum(x).over(upto).alias(f"{x}_l") for x in ("n", "weight", "total")],
        *[F.sum(x).over(every).alias(f"{x}_all") for x in ("n", "weight", "total")],
    )
    double = lambda x: x.cast("double")
    measure, l2 = ("n", growth.l2) if growth.by_count else ("weight", growth.l2 * unit)
    score = lambda t, m: double(t) * double(t) / (double(m) + F.lit(l2))
    right = {x: F.col(f"{x}_all") - F.col(f"{x}_l") for x in ("n", "weight", "total")}
    allowed = (
        (F.col("n_l") >= growth.min_rows)
        & (right["n"] >= growth.min_rows)
        & (F.col("n_all") >= growth.min_split)
        & (F.col("weight_l") >= growth.min_weight * unit)
        & (right["weight"] >= growth.min_weight * unit)
        & (right["n"] > 0)
    )
    value = F.when(allowed, score(F.col("total_l"), F.col(f"{measure}_l")) + score(right["total"], right[measure]))
    scored = sides.withColumn("score", value)
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", -F.col("feature"), -F.col("bin")))).alias("best")
    found = scored.groupBy("tree", "node").agg(
        best, *[F.max(f"{x}_all").alias(x) for x in ("n", "weight", "total")]
    )
    out = {}
    for tree, node, top, n, weight, total in found.collect():
        m = n + growth.l2 if growth.by_count else weight + growth.l2 * unit
        split = Split(n, float(weight), float(total))
        if top is not None:
            gain = top[0] - float(total) * float(total) / m
            if gain > 0 or growth.any_gain:
                split = split._replace(feature=-top[1], cut=-top[2], gain=gain)
        out[tree, node] = split
    return out


def best_split(n: np.ndarray, weight: np.ndarray, total: np.ndarray, growth: Growth, unit: float, allowed: np.ndarray | None = None) -> Split:
    """The same from one node's sums, arrays of (feature, bin)."""
    rows, w_all, t_all = n[0].sum(), weight[0].sum(), total[0].sum()
    n_l, w_l, t_l = np.cumsum(n, axis=1), np.cumsum(weight, axis=1), np.cumsum(total, axis=1)
    n_r, w_r, t_r = rows - n_l, w_all - w_l, t_all - t_l
    m_l, m_r, m, l2 = (n_l, n_r, rows, growth.l2) if growth.by_count else (w_l, w_r, w_all, growth.l2 * unit)
    t_l, t_r = t_l.astype(float), t_r.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = t_l * t_l / (m_l + l2) + t_r * t_r / (m_r + l2)
    least = growth.min_weight * unit
    # A cut counts at a bin that holds rows, as an empty one divides them like the bin before.
    ok = (n > 0) & (n_l >= growth.min_rows) & (n_r >= max(1, growth.min_rows)) & (w_l >= least) & (w_r >= least)
    if allowed is not None:
        ok &= allowed[:, None]
    split = Split(int(rows), float(w_all), float(t_all))
    if rows < growth.min_split or not ok.any():
        return split
    score = np.where(ok, score, -np.inf)
    at = int(score.argmax())
    gain = float(score.flat[at]) - float(t_all) * float(t_all) / float(m + l2)
    if gain > 0 or growth.any_gain:
        return split._replace(feature=at // n.shape[1], cut=at % n.shape[1], gain=gain)
    return split


# --- one tree, best first ----------------------------------------------------

Ask = Callable[[dict[int, Split], list[int]], dict[int, Split]]


def grow(ask: Ask, growth: Growth, eager: bool, value: Callable[[Split], float]) -> Tree:
    """Splits the leaf of greatest gain until no leaf or no allowance is left.

    ``ask(known, nodes)`` gives totals and best splits of nodes, named by their path from
    the root (1; children 2 k and 2 k + 1). An eager grower asks for the children of every
    open leaf at once, as each answer is a Spark job; what is grown stays the same.
    """
    known = ask({}, [1])
    depth = lambda path: path.bit_length() - 1
    worth = lambda path: known[path].feature >= 0 and depth(path) < growth.depth
    heap = [(-known[1].gain, 1)] if worth(1) else []
    inner: set[int] = set()
    leaves = 1
    while heap and (growth.leaves is None or leaves < growth.leaves):
        _, path = heapq.heappop(heap)
        if 2 * path not in known:
            # Only as many open leaves as splits are left can still be split, those of greatest gain.
            others = heap if growth.leaves is None else heapq.nsmallest(growth.leaves - leaves - 1, heap)
            wanted = [path, *(p for _, p in others)] if eager else [path]
            children = [c for p in wanted if 2 * p not in known for c in (2 * p, 2 * p + 1)]
            known.update(ask({p: known[p] for p in known if worth(p)}, children))
        inner.add(path)
        leaves += 1
        for child in (2 * path, 2 * path + 1):
            if worth(child):
                heapq.heappush(heap, (-known[child].gain, child))
    order = [1]
    for path in order:
        if path in inner:
            order += (2 * path, 2 * path + 1)
    place = {path: k for k, path in enumerate(order)}
    tree = Tree()
    for path in order:
        s, split = known[path], path in inner
        tree.feature.append(s.feature if split else -1)
        tree.cut.append(s.cut)
        tree.left.append(place[2 * path] if split else 0)
        tree.right.append(place[2 * path + 1] if split else 0)
        tree.value.append(value(s))
        tree.gain.append(s.gain if split else 0.0)
        tree.n.append(s.n)
        tree.total.append(s.total)
    return tree


def _node_of(known: dict[int, Split], codes: np.ndarray) -> np.ndarray:
    """The deepest node a row reaches by the known splits."""
    at = np.ones(len(codes), dtype=np.int64)
    paths = sorted(known)
    for path in paths:  # parents come before children
        rows = np.flatnonzero(at == path)
        if len(rows):
            at[rows] = 2 * path + (codes[rows, known[path].feature] > known[path].cut)
    return at


Stats = Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _ask_spark(rows: DataFrame, features: int, stats: Stats, growth: Growth, unit: float, allowed: np.ndarray | None = None) -> Ask:
    """Answers by one job over all rows; ``stats`` gives a row's presence, weight and target."""
    use = np.arange(features) if allowed is None else np.flatnonzero(allowed)

    def ask(known: dict[int, Split], nodes: list[int]) -> dict[int, Split]:
        wanted = np.array(sorted(nodes), dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches):
                codes = _codes(batch.column("bins"))
                present, weight, total = stats(batch, codes)
                at = _node_of(known, codes)
                place = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
                k = np.flatnonzero((wanted[place] == at) & present)
                if len(k):
                    chosen = np.tile(use, (len(wanted), 1))
                    yield _cells(0, wanted, place[k], codes[k], weight[k], total[k], chosen)

        found = best_splits(rows.mapInArrow(run, CELLS), growth, unit)
        return {node: found.get((0, node), Split(0, 0.0, 0.0)) for node in nodes}

    return ask


def target_scale(rows: DataFrame) -> float:
    """Fixed-point factor of the labels: 1 for whole numbers below 2**20, else a power of two."""
    top, whole = rows.agg(F.max(F.abs("label")), F.min((F.col("label") == F.floor("label")).cast("int"))).first()
    if top is None or top == 0 or (whole and top < 2**20):
        return 1.0
    return 2.0 ** (29 - int(np.ceil(np.log2(top))))


def grow_tree(rows: DataFrame, features: int, growth: Growth) -> Tree:
    """One tree on the rows of ``binned``; a leaf's value is its mean label. All steps are Spark jobs."""
    scale = target_scale(rows)

    def stats(batch, codes):
        n = batch.num_rows
        return np.ones(n, dtype=bool), np.ones(n), np.rint(batch.column("label").to_numpy() * scale)

    ask = _ask_spark(rows.filter("is_test = 0"), features, stats, growth, 1.0)
    return grow(ask, growth, True, lambda s: s.total / scale / s.weight if s.weight else 0.0)


# --- cost-complexity pruning -------------------------------------------------


def prune_sequence(tree: Tree) -> list[tuple[float, list[int]]]:
    """Weakest links of a 0/1 tree: (penalty per leaf at which nodes collapse, those nodes), rising.

    A node's risk is the number of training rows its majority class misses.
    """
    risk = [min(t, n - t) for n, t in zip(tree.n, tree.total, strict=True)]
    inner = {k for k, f in enumerate(tree.feature) if f >= 0}
    out = []
    while inner:
        below: dict[int, tuple[float, int]] = {}
        for k in range(len(risk) - 1, -1, -1):  # children have greater numbers
            if k in inner:
                (a, b), (c, d) = below[tree.left[k]], below[tree.right[k]]
                below[k] = a + c, b + d
            else:
                below[k] = risk[k], 1
        link = {k: (risk[k] - below[k][0]) / (below[k][1] - 1) for k in inner}
        least = min(link.values())
        gone = [k for k, x in link.items() if x <= least + 1e-12]
        out.append((least, sorted(gone)))
        drop = set()
        todo = list(gone)
        while todo:
            k = todo.pop()
            if k in inner:
                drop.add(k)
                todo += [tree.left[k], tree.right[k]]
        inner -= drop
    return out


def prune(tree: Tree, complexity: float) -> Tree:
    """The tree without splits that save less than ``complexity`` of the root's risk per leaf."""
    limit = complexity * min(tree.total[0], tree.n[0] - tree.total[0])
    cut = {k for penalty, nodes in prune_sequence(tree) if penalty <= limit for k in nodes}
    out, todo = Tree(), [0]
    for k in todo:
        split = tree.feature[k] >= 0 and k not in cut
        at = len(todo)
        if split:
            todo += [tree.left[k], tree.right[k]]
        out.feature.append(tree.feature[k] if split else -1)
        out.left.append(at if split else 0)
        out.right.append(at + 1 if split else 0)
        out.gain.append(tree.gain[k] if split else 0.0)
        for name in ("cut", "value", "n", "total"):
            getattr(out, name).append(getattr(tree, name)[k])
    return out


def predict_trees(rows: DataFrame, parts: Sequence[Tree], base: float = 0.0) -> DataFrame:
    """``id``, ``label`` and ``raw``: the base plus the sum of the trees' values. The trees travel with the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch.column("bins"))
            raw = np.full(batch.num_rows, base)
            for tree in parts:
                raw += tree.predict(codes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(raw)], names=["id", "label", "raw"])

    return rows.mapInArrow(run, "id string, label double, raw double")


# --- forests -----------------------------------------------------------------


class Forest(NamedTuple):
    """Bootstrap trees grown to pure nodes, ``tries`` random features per split (more where none of them splits).

    A bootstrap sample draws each row a Poisson(1) number of times, by a hash of its key.
    """

    trees: int = 300
    tries: int | None = None
    depth: int = 30
    seed: int = 42

    @property
    def growth(self) -> Growth:
        return Growth(depth=self.depth, any_gain=True)


def grow_rows(codes: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: int, tries: int, forest: Forest) -> Tree:
    """The subtree of one node, level by level, all nodes of a level at once; rows lie together by node."""
    n, features = codes.shape
    columns = np.ascontiguousarray(codes.T)
    widths = columns.max(axis=1).astype(np.int64) + 1
    rows, wy = np.arange(n), w * y
    counts = np.array([n])  # rows of each node of this level
    paths, depth = np.array([path % (1 << 63)], dtype=np.uint64), path.bit_length() - 1
    levels, made = [], 1
    while len(counts):
        k, starts = len(counts), np.cumsum(counts) - counts
        weight, total = np.add.reduceat(w, starts), np.add.reduceat(wy, starts)
        mixed = np.minimum.reduceat(y, starts) < np.maximum.reduceat(y, starts)
        best = np.full(k, -np.inf)
        feature, cut = np.full(k, -1), np.zeros(k, dtype=np.int64)
        if depth >= forest.depth:
            mixed[:] = False
        level = _Level(rows, w, wy, counts, weight, total)
        order = np.zeros((k, 0), dtype=np.int64)
        if tries < features and mixed.any():
            order = np.zeros((k, features), dtype=np.int64)
            order[mixed] = feature_order(tree, paths[mixed], features, forest.seed)
        for first in range(0, features, tries):
            open_ = np.flatnonzero(mixed & (feature < 0))
            if not len(open_):
                break
            if tries < features:
                chosen = order[open_, first : first + tries].ravel().astype(np.uint16)
                by = np.argsort(chosen, kind="stable")
                ends = np.searchsorted(chosen[by], np.arange(features), side="right")
                asked = np.split(np.repeat(open_, len(by) // len(open_))[by], ends[:-1])
            else:
                asked, whole = [open_] * features, level.only(open_)
            for f, nodes in enumerate(asked):
                if len(nodes) and widths[f] > 1:
                    some = level.only(nodes) if tries < features else whole
                    score, at = some.best_cuts(columns[f], int(widths[f]))
                    won = score > best[nodes]
                    new = nodes[won]
                    best[new], feature[new], cut[new] = score[won], f, at[won]
        split = np.flatnonzero(feature >= 0)
        left, right = np.zeros((2, k), dtype=np.int64)
        left[split] = made + 2 * np.arange(len(split))
        right[split] = left[split] + 1
        made += 2 * len(split)
        gain = np.zeros(k)
        gain[split] = best[split] - total[split] * total[split] / np.maximum(weight[split], 1e-300)
        levels.append((feature, cut, left, right, total / weight, gain, weight.astype(np.int64), total))
        if not len(split):
            break
        # The rows of split nodes, left ones before right ones in each.
        stay = slice(None) if len(split) == k else level.rows_of(split)
        rows, y, w, wy, size = rows[stay], y[stay], w[stay], wy[stay], counts[split]
        goes = columns.ravel().take(np.repeat(feature[split] * n, size) + rows) > np.repeat(cut[split], size)
        right_of = np.add.reduceat(goes, np.cumsum(size) - size, dtype=np.int64)
        counts = np.stack([size - right_of, right_of], axis=1).ravel()
        first = np.cumsum(counts) - counts
        by = np.empty(len(rows), dtype=np.int64)
        for side, some in enumerate((np.flatnonzero(~goes), np.flatnonzero(goes))):
            held = counts[side::2]
            by[np.arange(len(some)) + np.repeat(first[side::2] - np.cumsum(held) + held, held)] = some
        rows, y, w, wy = rows.take(by), y.take(by), w.take(by), wy.take(by)
        paths, depth = ((np.repeat(paths[split] << _U(1), 2) + np.tile(np.arange(2, dtype=_U), len(split))) & _U((1 << 63) - 1)), depth + 1
    return Tree(*(np.concatenate(x).tolist() for x in zip(*levels, strict=True)))


class _Level(NamedTuple):
    """Rows of the nodes of one level, together by node, with weights and weighted targets, and the nodes' sums."""

    rows: np.ndarray
    w: np.ndarray
    wy: np.ndarray
    counts: np.ndarray
    weight: np.ndarray
    total: np.ndarray

    def rows_of(self, nodes: np.ndarray) -> np.ndarray:
        """Places of the nodes' rows."""
        counts, starts = self.counts[nodes], np.cumsum(self.counts) - self.counts
        return np.arange(counts.sum()) + np.repeat(starts[nodes] - np.cumsum(counts) + counts, counts)

    def only(self, nodes: np.ndarray) -> _Level:
        """The same of some nodes."""
        if len(nodes) == len(self.counts):
            return self
        at = self.rows_of(nodes)
        return _Level(self.rows.take(at), self.w.take(at), self.wy.take(at), self.counts[nodes], self.weight[nodes], self.total[nodes])

    def best_cuts(self, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Score and place of the best cut of one feature per node, the lowest of equal ones; -inf without one."""
        _, w, wy, counts, weight, total = self
        k, code = len(counts), column.take(self.rows)
        key = np.repeat(np.arange(k) * width, counts)
        key += code
        if k * width <= CELLS_A_ROW * len(code):  # a sum per code
            w_l, t_l = (np.bincount(key, x, k * width).reshape(k, width)[:, :-1].cumsum(axis=1) for x in (w, wy))
            score = _scores(w_l, t_l, weight[:, None], total[:, None])
            cut = score.argmax(axis=1)
            return score[np.arange(k), cut], cut
        # Mostly nodes of fewer rows than codes: a sum per code that a node has.
        bits = len(key).bit_length()
        packed = np.sort((key << bits) | np.arange(len(key)))
        key, by = packed >> bits, packed & ((1 << bits) - 1)
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        node = key[ends] // width
        w_l, t_l = (np.cumsum(x.take(by))[ends] - (np.cumsum(every) - every)[node] for x, every in ((w, weight), (wy, total)))
        score = _scores(w_l, t_l, weight[node], total[node])
        top = np.maximum.reduceat(score, np.searchsorted(node, np.arange(k)))
        hit = np.flatnonzero(score == top[node])
        hit = hit[np.append(True, node[hit[1:]] != node[hit[:-1]])]
        return top, key[ends[hit]] % width


def _scores(w_l: np.ndarray, t_l: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What cuts are worth by the sums of their left sides; -inf where a side is empty."""
    w_r, t_r = weight - w_l, total - t_l
    with np.errstate(divide="ignore", invalid="ignore"):
        score = t_l * t_l
        score /= w_l
        t_r *= t_r
        t_r /= w_r
        score += t_r
    score[(w_l <= 0) | (w_r <= 0)] = -np.inf
    return score


def _node_order(node: np.ndarray, code: np.ndarray, nodes: int) -> np.ndarray:
    """Stable order by node, then code: two sorts of short numbers, which go by radix, unless nodes are many."""
    if nodes > 1 << 16:
        return np.argsort(node * BINS + code, kind="stable")
    by = np.argsort(code, kind="stable")
    return by[np.argsort(node.astype(np.uint16)[by], kind="stable")]


def _append(tree: Tree, count: int) -> None:
    for name, blank in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", 0.0), ("gain", 0.0), ("n", 0), ("total", 0.0)):
        getattr(tree, name).extend([blank] * count)


def _top_levels(rows: DataFrame, group: range, features: int, tries: int, forest: Forest, scale: float, bound: int) -> dict[int, dict[int, Split]]:
    """Splits of all nodes above ``bound`` rows, per tree, by one job per level (and try)."""
    tops: dict[int, dict[int, Split]] = {t: {} for t in group}
    open_ = {t: {1: 0} for t in group}  # node -> tries so far
    sizes: dict[tuple[int, int], int] = {}
    while any(open_.values()):
        asked = {t: sorted(nodes) for t, nodes in open_.items() if nodes}
        offsets = {t: [open_[t][p] for p in nodes] for t, nodes in asked.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches):
                codes, uid = _codes(batch.column("bins")), batch.column("uid").to_numpy()
                y = np.rint(batch.column("label").to_numpy() * scale)
                for t, nodes in asked.items():
                    w = draws(uid, t, forest.seed).astype(float)
                    wanted = np.array(nodes, dtype=np.int64)
                    at = _node_of(tops[t], codes)
                    place = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
                    k = np.flatnonzero((wanted[place] == at) & (w > 0))
                    if len(k):
                        order = feature_order(t, wanted.astype(np.uint64), features, forest.seed)
                        pad = np.concatenate([order, order[:, :tries]], axis=1)
                        chosen = np.array([pad[i, o : o + tries] for i, o in enumerate(offsets[t])])
                        yield _cells(t, wanted, place[k], codes[k], w[k], w[k] * y[k], chosen)

        found = best_splits(rows.mapInArrow(run, CELLS), forest.growth, 1.0)
        for t, nodes in asked.items():
            for path in nodes:
                s = found.get((t, path))
                tried = open_[t].pop(path)
                if s is None or s.n <= bound or path.bit_length() > forest.depth:
                    continue
                sizes[t, path] = s.n
                if s.feature >= 0:
                    tops[t][path] = s
                    open_[t].update({2 * path: 0, 2 * path + 1: 0})
                elif tried + tries < features:
                    open_[t][path] = tried + tries
    return tops


def forest_scores(rows: DataFrame, features: int, forest: Forest, bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Mean vote per test row (``id, label, score``), and gain per feature (``feature, gain``).

    ``rows`` are those of ``binned``, stored. Trees are taken in groups, so that
    the rows on their way to (tree, node) groups stay in proportion to the table.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    per_group = min(forest.trees, 16)
    bound = FOREST_ROWS if bound is None else bound
    train = rows.filter("is_test = 0")
    n, scale = train.count(), target_scale(train)
    if n <= LOCAL_ROWS:
        per_group = forest.trees
    tries = min(features, forest.tries or features)
    parts, top_gains = [], np.zeros(features)
    for first in range(0, forest.trees, per_group):
        group = range(first, min(first + per_group, forest.trees))
        tops = {t: {} for t in group} if n <= bound else _top_levels(train, group, features, tries, forest, scale, bound)
        for split in (s for nodes in tops.values() for s in nodes.values()):
            top_gains[split.feature] += split.gain / max(1.0, scale * scale)

        def send(batches: Iterator[pa.RecordBatch], group=group, tops=tops) -> Iterator[pa.RecordBatch]:
            for rows in _gathered(batches):
                uid, test, y = (rows.column(c).to_numpy() for c in ("uid", "is_test", "label"))
                codes, ids = _codes(rows.column("bins").combine_chunks()), rows.column("id").combine_chunks()
                for t in group:
                    w = np.where(test == 1, 0, draws(uid, t, forest.seed)).astype(np.uint8)
                    k = np.flatnonzero((test == 1) | (w > 0))
                    paths = _node_of(tops[t], codes[k])
                    by = np.lexsort((test[k], paths))
                    k, paths = k[by], paths[by]
                    edges = [0, *(np.flatnonzero((np.diff(paths) != 0) | (np.diff(test[k]) != 0)) + 1).tolist(), len(k)]
                    for a, b in zip(edges, edges[1:]):
                        if a < b:
                            r, tested = k[a:b], test[k[a]]
                            packed = [(t, pa.int32()), (paths[a], pa.int64()), (tested, pa.int32()), (codes[r].tobytes(), pa.binary()), (y[r].tobytes(), pa.binary()), (w[r].tobytes(), pa.binary())]
                            named = ids.take(pa.array(r if tested else r[:0]))
                            yield pa.RecordBatch.from_arrays(
                                [*(pa.array([x], kind) for x, kind in packed), pa.ListArray.from_arrays([0, len(named)], named)],
                                names=["tree", "path", "is_test", "bins", "label", "w", "ids"],
                            )

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gains = np.zeros(features)
            current, train_parts, grown = None, [], None

            def done():
                codes, y, w = (np.concatenate(x) for x in zip(*train_parts, strict=True))
                tree = grow_rows(codes, np.rint(y * scale), w.astype(float), current[0], current[1], tries, forest)
                gains[:] += tree.gains(features)
                return tree

            for batch in batches:
                for i in range(batch.num_rows):
                    tree, path, test, bins, label, w = (batch.column(c)[i].as_py() for c in ("tree", "path", "is_test", "bins", "label", "w"))
                    codes, y = np.frombuffer(bins, dtype=np.uint8).reshape(-1, features), np.frombuffer(label)
                    if (tree, path) != current:
                        if train_parts:
                            done()  # a node without test rows still counts for the gains
                        current, train_parts, grown = (tree, path), [], None
                    if test == 0:
                        train_parts.append((codes, y, np.frombuffer(w, dtype=np.uint8)))
                        continue
                    if grown is None and train_parts:
                        grown, train_parts = done(), []
                    if grown is not None:
                        yield _votes(batch.column("ids")[i].values, pa.array(y), grown.predict(codes) / scale)
            if train_parts:
                done()
            yield _gains(gains / max(1.0, scale * scale))

        sent = rows.mapInArrow(send, "tree int, path long, is_test int, bins binary, label binary, w binary, ids array<string>")
        width = max(spark.sparkContext.defaultParallelism, int(n * len(group) / 200_000))
        # Whole trees are dealt out evenly; the many parts of larger ones fall evenly by hash.
        to = [F.col("tree"), F.col("path")] if any(tops.values()) else [_salt(spark, group, width)]
        dealt = sent.repartition(width, *to).sortWithinPartitions("tree", "path", "is_test")
        votes = dealt.mapInArrow(finish, "id string, label double, score double, feature int")
        # Votes and gains of a group are added up and written before the next one starts.
        parts.append(votes.groupBy("id", "label", "feature").agg(F.sum("score").alias("s"), F.count("*").alias("n")).checkpoint())
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    scores = every.filter("feature IS NULL").groupBy("id", "label").agg((F.sum("s") / F.sum("n")).alias("score"))
    above = spark.createDataFrame(list(enumerate(top_gains.tolist())), "feature int, s double")
    gains = every.filter("feature IS NOT NULL").select("feature", "s").unionByName(above).groupBy("feature").agg(F.sum("s").alias("gain"))
    return scores, gains


def _salt(spark: SparkSession, group: range, width: int) -> Column:
    """A number per tree of the group whose hash deals the trees to ``width`` partitions in turn."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(width))
    numbers = dict(spark.range(64 * width).groupBy(place.alias("place")).agg(F.min("id").cast("int")).collect())
    chosen = [numbers.get(i % width, t) for i, t in enumerate(group)]
    return F.element_at(F.array(*[F.lit(x) for x in chosen]), F.col("tree") - group.start + 1)


def _votes(ids: pa.Array, label: pa.Array, score: np.ndarray) -> pa.RecordBatch:
    blank = pa.nulls(len(ids), pa.int32())
    return pa.RecordBatch.from_arrays([ids, label, pa.array(score), blank], names=["id", "label", "score", "feature"])


def _gains(gains: np.ndarray) -> pa.RecordBatch:
    n = len(gains)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array(gains), pa.array(np.arange(n, dtype=np.int32))],
        names=["id", "label", "score", "feature"],
    )


# --- boosting ----------------------------------------------------------------


class Boost(NamedTuple):
    """Gradient boosting: rounds, step, tree limits, shares of rows and of columns per tree."""

    rounds: int = 100
    rate: float = 0.1
    growth: Growth = Growth(leaves=31, min_rows=20, min_weight=1e-3)
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


class Boosted(NamedTuple):
    base: float
    trees: list[Tree]
    features: int

    @property
    def gains(self) -> np.ndarray:
        return sum((t.gains(self.features) for t in self.trees), np.zeros(self.features))


class _Loss(NamedTuple):
    """Gradients in fixed point, and the leaf value they ask for."""

    classify: bool
    scale: float

    def stats(self, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.classify:
            p = np.negative(raw)
            np.exp(p, out=p)
            p += 1.0
            np.divide(1.0, p, out=p)
            weight = 1 - p
            weight *= p
            weight *= ONE
            total = y - p
            total *= self.scale
            return np.rint(weight, out=weight), np.rint(total, out=total)
        return np.full(len(y), ONE), np.rint((y - raw) * self.scale)

    def value(self, s: Split, boost: Boost) -> float:
        weight = s.weight / ONE + boost.growth.l2
        return boost.rate * (s.total / self.scale) / weight if weight > 0 else 0.0


def _allowed(boost: Boost, round_: int, features: int) -> np.ndarray:
    keep = max(1, round(boost.column_share * features))
    out = np.zeros(features, dtype=bool)
    out[np.argsort(uniform(np.arange(features), boost.seed * 31 + 2 * round_ + 1), kind="stable")[:keep]] = True
    return out


def _taken(uid: np.ndarray, boost: Boost, round_: int) -> np.ndarray:
    if boost.row_share >= 1:
        return np.ones(len(uid), dtype=bool)
    return uniform(uid, boost.seed * 31 + 2 * round_) < boost.row_share


class _Bundles(NamedTuple):
    """Features put together, so that one count serves several: a row's cell is the place of its codes among all their combinations."""

    members: list[list[int]]  # features of each bundle
    widths: np.ndarray  # codes per feature

    @staticmethod
    def of(widths: np.ndarray, most: int = BUNDLE_CELLS) -> _Bundles:
        """Narrow features first; the combinations of a bundle are ``most`` at most, or it is one feature."""
        members: list[list[int]] = []
        size = 0
        for f in np.argsort(widths, kind="stable").tolist():
            if members and size * int(widths[f]) <= most:
                members[-1].append(f)
                size *= int(widths[f])
            else:
                members.append([f])
                size = int(widths[f])
        return _Bundles(members, widths)

    @property
    def sizes(self) -> list[int]:
        return [int(np.prod(self.widths[m])) for m in self.members]

    def cells(self, columns: np.ndarray) -> np.ndarray:
        """Bundle x row: the cell of each row, from feature x row codes."""
        out = np.zeros((len(self.members), columns.shape[1]), dtype=np.uint16)
        for cell, members in zip(out, self.members):
            for f in members:
                cell *= np.uint16(self.widths[f])
                cell += columns[f]
        return out

    def codes(self, packed: np.ndarray, feature: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The code of each of ``rows`` in the feature named beside it, from bundle x row cells."""
        bundle, stride = np.zeros(len(self.widths), dtype=np.int64), np.ones(len(self.widths), dtype=np.uint16)
        for i, members in enumerate(self.members):
            bundle[members] = i
            # The last member's code counts single cells.
            stride[members] = np.cumprod([1, *self.widths[members[:0:-1]]])[::-1]
        return packed[bundle[feature], rows] // stride[feature] % self.widths.astype(np.uint16)[feature]

    def members_of(self, bundle: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell x code: 1 where the cell has the code, for all features of the bundle; and the last place of each but one."""
        members = self.members[bundle]
        widths = self.widths[members]
        cell, ends = np.arange(widths.prod()), np.cumsum(widths)
        out = np.zeros((len(cell), ends[-1]))
        for i, end in enumerate(ends):
            out[cell, end - widths[i] + cell // widths[i + 1 :].prod() % widths[i]] = 1
        return out, ends[:-1]

    def spread(self, bundle: int, counts: np.ndarray, codes: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> None:
        """Sums per cell, on the last axis, added up to sums per feature and code in ``out`` (..., feature, code).

        A product with zeros and ones, exact as long as the whole sum is below 2**53.
        """
        members, (cells, ends) = self.members[bundle], codes
        found = np.split(counts @ cells, ends, axis=-1) if len(members) > 1 else [counts]
        for f, part in zip(members, found, strict=True):
            out[..., f, : self.widths[f]] = part


def boost_rows(codes: np.ndarray, y: np.ndarray, uid: np.ndarray, base: float, boost: Boost, loss: _Loss) -> list[Tree]:
    """All rounds over rows that fit one bounded group."""
    n, features = codes.shape
    columns = np.ascontiguousarray(codes.T)
    widths = columns.max(axis=1).astype(np.int64) + 1
    bundles = _Bundles.of(widths)
    packed, sizes = bundles.cells(columns), bundles.sizes
    sides = [bundles.members_of(i) for i in range(len(sizes))]
    raw, out = np.full(n, base), []
    for round_ in range(boost.rounds):
        weight, total = loss.stats(raw, y)
        use = np.flatnonzero(_allowed(boost, round_, features))
        taken = _taken(uid, boost, round_)
        held: dict[int, tuple[np.ndarray, np.ndarray, Split]] = {}  # node -> its rows, its sums, its split

        def sums(rows: np.ndarray) -> np.ndarray:
            # Bundle by bundle, as the sums of one bundle's cells stay in the cache.
            cells, every = np.zeros((3, features, widths.max())), len(rows) == n
            w, t = (weight, total) if every else (weight.take(rows), total.take(rows))
            for i, (column, k) in enumerate(zip(packed, sizes)):
                code = (column if every else column.take(rows)).astype(np.intp)
                count = np.bincount(code, minlength=k)
                found = np.stack([count, np.bincount(code, w, k) if loss.classify else count * ONE, np.bincount(code, t, k)])
                bundles.spread(i, found, sides[i], cells)
            return cells

        def hold(path: int, rows: np.ndarray, cells: np.ndarray) -> Split:
            split = best_split(*cells[:, use], boost.growth, ONE)
            split = split._replace(feature=int(use[split.feature])) if split.feature >= 0 else split
            held[path] = rows, cells, split
            return split

        def ask(known: dict[int, Split], nodes: list[int]) -> dict[int, Split]:
            if nodes == [1]:
                rows = np.flatnonzero(taken)
                return {1: hold(1, rows, sums(rows))}
            left, right = nodes
            rows, cells, s = held.pop(left // 2)
            goes = columns[s.feature].take(rows) <= s.cut
            one, two = rows[goes], rows[~goes]
            if left.bit_length() > boost.growth.depth:  # no sums of their own at the last level
                n_l, n_all = cells[:, s.feature, : s.cut + 1].sum(1), cells[:, s.feature].sum(1)
                found = {}
                for path, part, (k, w, t) in ((left, one, n_l), (right, two, n_all - n_l)):
                    found[path] = Split(int(k), float(w), float(t))
                    held[path] = part, cells, found[path]
                return found
            # The smaller child is summed, the other is what remains.
            less = len(one) <= len(two)
            small = sums(one if less else two)
            rest = cells - small
            return {left: hold(left, one, small if less else rest), right: hold(right, two, rest if less else small)}

        tree = grow(ask, boost.growth, False, lambda s: loss.value(s, boost))
        # What is still held are the leaves.
        for rows, _, split in held.values():
            raw[rows] += loss.value(split, boost)
        if not taken.all():
            raw[~taken] += tree.predict(codes[~taken])
        out.append(tree)
    return out


_TREE = "feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>, gain array<double>, n array<int>, total array<double>"


def boost(rows: DataFrame, features: int, settings: Boost, classify: bool, bound: int | None = None) -> Boosted:
    """Fits on the rows with ``is_test = 0``; rows are stored as ``binned`` makes them."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    train = rows.filter("is_test = 0")
    n, mean, low, high = train.agg(F.count("*"), F.avg("label"), F.min("label"), F.max("label")).first()
    if not n:
        return Boosted(0.0, [], features)
    if classify:
        p = min(max(mean, 1e-12), 1 - 1e-12)
        base, loss = float(np.log(p / (1 - p))), _Loss(True, ONE)
    else:
        # A residual may pass the labels' range, but not by much.
        spread = (high - low) or 1.0
        base, loss = float(mean), _Loss(False, 2.0 ** (28 - int(np.ceil(np.log2(spread)))))
    if n > (BOOST_ROWS if bound is None else bound):
        return Boosted(base, _boost_steps(train, features, settings, loss, base, n), features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("uid")
        codes = _codes(table.column("bins").combine_chunks())
        y, uid = table.column("label").to_numpy(), table.column("uid").to_numpy()
        for tree in boost_rows(codes, y, uid, base, settings, loss):
            yield pa.RecordBatch.from_arrays(
                [pa.array([getattr(tree, c)], pa.list_(k)) for c, k in _FIELDS], names=[c for c, _ in _FIELDS]
            )

    # The bounded group; ``n`` is at most the bound.
    found = train.select("uid", "label", "bins").repartition(1).mapInArrow(run, _TREE).collect()
    return Boosted(base, [Tree(*[list(r[c]) for c, _ in _FIELDS]) for r in found], features)


_FIELDS = [
    ("feature", pa.int32()), ("cut", pa.int32()), ("left", pa.int32()), ("right", pa.int32()),
    ("value", pa.float64()), ("gain", pa.float64()), ("n", pa.int32()), ("total", pa.float64()),
]


class _Block(NamedTuple):
    """Some stored rows: cells bundle by bundle, labels, ids, margins."""

    packed: np.ndarray
    y: np.ndarray
    uid: np.ndarray
    raw: np.ndarray


def _widths(train: DataFrame, features: int) -> np.ndarray:
    """Codes per feature: one more than the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(features, dtype=np.uint8)
        for batch in batches:
            if batch.num_rows:
                np.maximum(top, _codes(batch.column(0)).max(axis=0), out=top)
        yield pa.RecordBatch.from_arrays([pa.array([top.tobytes()], pa.binary())], names=["top"])

    found = [np.frombuffer(r["top"], dtype=np.uint8) for r in train.select("bins").mapInArrow(run, "top binary").collect()]
    return reduce(np.maximum, found).astype(np.int64) + 1


def _blocks(train: DataFrame, bundles: _Bundles, base: float, n: int) -> RDD:
    """The rows in blocks of at most ``BLOCK_ROWS``, spread evenly over the cores."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            codes = _codes(rows.column("bins").combine_chunks())
            packed = bundles.cells(np.ascontiguousarray(codes.T)).tobytes(), *(rows.column(c).to_numpy().tobytes() for c in ("label", "uid"))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["bins", "label", "uid"])

    def unpack(row) -> _Block:
        y = np.frombuffer(row.label)
        packed = np.frombuffer(row.bins, dtype=np.uint16).reshape(-1, len(y))
        return _Block(packed, y, np.frombuffer(row.uid, dtype=np.int64), np.full(len(y), base))

    width = max(train.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    rows = train.select("uid", "label", "bins").repartition(width)
    return rows.mapInArrow(pack, "bins binary, label binary, uid binary").rdd.map(unpack)


def _added(parts: RDD, add: Callable) -> np.ndarray:
    """One array per task, put together; in two steps when there are many tasks."""
    return parts.treeReduce(add) if parts.getNumPartitions() > 64 else reduce(add, parts.collect())


def _reached(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, bundles: _Bundles, packed: np.ndarray) -> np.ndarray:
    """The node each row ends in; ``feature`` is -1 where it stops."""
    n = packed.shape[1]
    if feature[0] < 0:
        return np.zeros(n, dtype=np.int64)
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    while len(rows):
        here = at[rows]
        code = bundles.codes(packed, feature[here], rows)
        here = np.where(code <= cut[here], left[here], right[here])
        at[rows] = here
        rows = rows[feature[here] >= 0]
    return at


def _leaf_places(known: dict[int, Split], wanted: list[int], bundles: _Bundles, packed: np.ndarray) -> np.ndarray:
    """Place in ``wanted`` of the node each row reaches by the known splits, or -1."""
    paths = sorted({1, *known, *(c for p in known for c in (2 * p, 2 * p + 1))})
    place = {path: k for k, path in enumerate(paths)}
    feature = np.array([known[p].feature if p in known else -1 for p in paths])
    cut = np.array([known[p].cut if p in known else 0 for p in paths])
    left = np.array([place[2 * p] if p in known else 0 for p in paths])  # the right child is next
    target = np.full(len(paths), -1)
    target[[place[p] for p in wanted]] = np.arange(len(wanted))
    return target[_reached(feature, cut, left, left + 1, bundles, packed)]


def _ask_blocks(blocks: RDD, bundles: _Bundles, stats: Callable[[_Block], tuple], growth: Growth, unit: float, use: np.ndarray) -> Ask:
    """Answers by one job over the blocks; ``use`` are the features that may split."""
    widths, sizes = bundles.widths, bundles.sizes
    starts = np.cumsum(widths) - widths
    held: dict[int, np.ndarray] = {}  # open node -> its sums: n, weight, target per (feature, bin)

    def summed(known: dict[int, Split], wanted: list[int]) -> dict[int, np.ndarray]:
        def run(parts: Iterator[_Block]) -> Iterator[np.ndarray]:
            # Bundle by bundle for all blocks, then added up per feature: whole numbers below 2**53 in all.
            out = [np.zeros((3, len(wanted) * size)) for size in sizes]
            for block in parts:
                present, weight, total = stats(block)
                node = _leaf_places(known, wanted, bundles, block.packed)
                k = np.flatnonzero((node >= 0) & present)
                if len(k) == len(node):
                    k = slice(None)
                node, weight, total = node[k], weight[k], total[k]
                for cells, column, size in zip(out, block.packed, sizes):
                    key = column[k].astype(np.int64)
                    if len(wanted) > 1:
                        key += node * size
                    for sums, x in zip(cells, (None, weight, total)):
                        sums += np.bincount(key, x, len(sums))
            spread = np.zeros((3, len(wanted), len(widths), widths.max()))
            for i, (cells, size) in enumerate(zip(out, sizes)):
                bundles.spread(i, cells.reshape(3, len(wanted), size), bundles.members_of(i), spread)
            # Codes that no row has are not sent.
            yield np.concatenate([spread[:, :, f, :width] for f, width in enumerate(widths)], axis=2).astype(np.int64)

        found = _added(blocks.mapPartitions(run), np.add)
        cells = np.zeros((len(wanted), 3, len(use), widths[use].max()), dtype=np.int64)
        for i, f in enumerate(use):
            cells[:, :, i, : widths[f]] = found[:, :, starts[f] : starts[f] + widths[f]].swapaxes(0, 1)
        return dict(zip(wanted, cells, strict=True))

    def best(path: int) -> Split:
        split = best_split(*held[path], growth, unit)
        return split._replace(feature=int(use[split.feature])) if split.feature >= 0 else split

    def ask(known: dict[int, Split], nodes: list[int]) -> dict[int, Split]:
        if nodes == [1]:
            held.update(summed({}, nodes))
            return {1: best(1)}
        out, small = {}, []
        for path in sorted({node // 2 for node in nodes}):
            split = known[path]
            sides = held[path][:, np.searchsorted(use, split.feature)]
            left, all_ = sides[:, : split.cut + 1].sum(1), sides.sum(1)
            if (2 * path).bit_length() > growth.depth:  # children at the last level need no sums of their own
                for child, (n, weight, total) in ((2 * path, left), (2 * path + 1, all_ - left)):
                    out[child] = Split(int(n), float(weight), float(total))
            else:
                small.append(2 * path + (2 * left[0] > all_[0]))
        for path, cells in (summed(known, [int(p) for p in small]) if small else {}).items():
            held[path], held[path ^ 1] = cells, held.pop(path // 2) - cells
            out.update({path: best(path), path ^ 1: best(path ^ 1)})
        return out

    return ask


def _boost_steps(train: DataFrame, features: int, settings: Boost, loss: _Loss, base: float, n: int) -> list[Tree]:
    """Round by round over stored blocks; the margins are stored every round, and checkpointed every ``RESUME``."""
    bundles = _Bundles.of(_widths(train, features), STEP_CELLS)
    blocks = _blocks(train, bundles, base, n).persist(StorageLevel.MEMORY_AND_DISK)
    out, older = [], None
    for round_ in range(settings.rounds):

        def stats(block: _Block, round_=round_):
            return (_taken(block.uid, settings, round_), *loss.stats(block.raw, block.y))

        use = np.flatnonzero(_allowed(settings, round_, features))
        ask = _ask_blocks(blocks, bundles, stats, settings.growth, ONE, use)
        tree = grow(ask, settings.growth, True, lambda s: loss.value(s, settings))
        out.append(tree)
        if older is not None:
            older.unpersist()  # this round's first job has stored the margins that follow from it
        older = blocks
        *nodes, value = tree.arrays

        def moved(b: _Block, nodes=nodes, value=value) -> _Block:
            return b._replace(raw=b.raw + value[_reached(*nodes, bundles, b.packed)])

        blocks = older.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        if len(out) % RESUME == 0:
            blocks.checkpoint()
    if older is not None:
        older.unpersist()
    return out
