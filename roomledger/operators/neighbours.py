"""Exact k nearest neighbours.

References whose vectors hold at most ``BROADCAST_CELLS`` numbers travel to the queries.
Beyond that bound pairs are not all compared, with the same result. Reference rows are grouped around centroids. By the triangle inequality a cell
can hold a nearer neighbour only if ``d(query, centroid) - radius`` is below the
k-th distance found so far, so a query visits its home cell first and then only the
cells that bound leaves open, from which only references within that distance come back. Equal vectors are merged first: of equal references only
the k lowest keys can be among the k nearest, and equal queries share one answer. Cells
and their queries are cut into blocks of bounded size; a task compares one block of
queries with one block of references and keeps k candidates per query, so neither a hot
cell nor its pairs meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.session import training_rows

BLOCK = 8192  # queries of a group
CELL_ROWS = 1 << 15  # references of a cell, and of a block of one: queries are sent to cells, so few large ones move less
PAIRS = 1 << 22  # pairs that are compared at a time
SLICE = 1 << 13  # visits, and pairs whose distance is taken whole, at a time
GROUP = 64  # references of which the nearest stands for all in a first bound
MAX_CELLS = 256
BROADCAST_CELLS = 4_000_000  # entries of the reference vectors that travel to the queries


def nearest(
    train: DataFrame, test: DataFrame, k: int, key: str, label: str, features: str = "features", seed: int = 42
) -> DataFrame:
    """(key, neighbour, label, distance, rank) of the k nearest train rows per test row."""
    known = training_rows(_first_k_of_equal(train.select(key, label, features), k, key, features))
    size = known.count()
    entries = known.agg(F.sum(F.size(vector_to_array(features)))).first()[0] or 0
    if entries <= BROADCAST_CELLS:
        return _against_all(known, test, k, key, label, features)
    cells = max(2, min(MAX_CELLS, int(math.sqrt(size / 50)), math.ceil(size / CELL_ROWS)))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol=features, predictionCol="cell").fit(known)
    centres = np.array([c.tolist() for c in model.clusterCenters()])

    placed = _to_arrays(model.transform(known), features).select(
        F.col(key).alias("n_key"), F.col(label).alias("n_label"), "vec", "cell"
    )
    own = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres]), F.col("cell") + 1)
    squares = F.zip_with("vec", own, lambda a, b: (a - b) * (a - b))
    placed = placed.withColumn("_d", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)))
    # One row per centroid: at most MAX_CELLS rows, safe to broadcast.
    sizes = placed.groupBy("cell").agg(F.max("_d").alias("radius"), F.count(F.lit(1)).alias("size"))
    blocks = F.greatest(F.ceil(F.col("size") / min(CELL_ROWS, 4 * BLOCK)), F.lit(1)).cast("int")
    layout = training_rows(sizes.select("cell", "radius", blocks.alias("blocks")))
    reference = placed.drop("_d").join(F.broadcast(layout), "cell").select(
        "n_key", "n_label", "vec", "cell", F.pmod(F.xxhash64("n_key"), F.col("blocks")).cast("int").alias("block")
    ).persist()
    bounds = {r["cell"]: r["radius"] for r in layout.collect()}
    radius = np.array([bounds.get(i, -np.inf) for i in range(len(centres))])

    asked = _to_arrays(test.select(key, features), features)
    queries = asked.groupBy("vec").agg(F.min(key).alias(key))
    home = training_rows(_home(queries, key, centres, bounds))
    first = training_rows(_visit(home.withColumn("cell", F.col("home")), reference, layout, key, k))
    kth = first.groupBy(key).agg(
        F.max("distance").alias("reach"), F.count(F.lit(1)).alias("found")
    )
    open_reach = F.when(F.col("found") >= k, F.col("reach")).otherwise(float("inf"))
    ready = home.join(kth.select(key, open_reach.alias("reach")), key)
    others = _open_cells(ready, key, centres, radius)
    merged = first.unionByName(_visit(others, reference, layout, key, k))
    answers = _top_k(merged, key, k).withColumnRenamed(key, "_asked")
    shared = home.select(F.col("vec"), F.col(key).alias("_asked"))
    return asked.join(shared, "vec").select(key, "_asked").join(answers, "_asked").drop("_asked")


def _against_all(known: DataFrame, test: DataFrame, k: int, key: str, label: str, features: str) -> DataFrame:
    """Every query against all references, which are few enough to travel with the job."""
    rows = known.select(key, F.col(label).cast("double").alias("label"), vector_to_array(features).alias("vec")).orderBy(key).collect()
    known.unpersist()
    names = [r[0] for r in rows]
    y = np.array([r[1] for r in rows], dtype=float)
    x = np.array([r[2] for r in rows], dtype=float)
    types = dict(test.dtypes)
    side = _side(x) if len(x) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.empty(len(names), dtype=object)
        ids[:] = names
        for pdf in batches:
            step = _step(x)
            for start in range(0, len(pdf) if len(x) else 0, step):
                part = pdf.iloc[start : start + step]
                row, at, exact = _ranked(_stack(part["vec"]), x, min(k, len(x)), side=side)
                yield pd.DataFrame(
                    {
                        key: part[key].to_numpy()[row],
                        "neighbour": ids[at],
                        "label": y[at],
                        "distance": exact,
                        "rank": (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32),
                    }
                )

    schema = f"{key} {types[key]}, neighbour {types[key]}, label double, distance double, rank int"
    return _to_arrays(test.select(key, features), features).mapInPandas(run, schema)


def _first_k_of_equal(rows: DataFrame, k: int, key: str, features: str) -> DataFrame:
    """At most k rows per equal vector, lowest keys first; salted so that no group is large."""
    marked = rows.withColumn("_v", vector_to_array(features)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    for group in (["_v", "_salt"], ["_v"]):
        order = Window.partitionBy(*group).orderBy(key)
        marked = marked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
    return marked.drop("_v", "_salt")


def vote(neighbours: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Share of positive neighbours as ``score`` and the majority as ``prediction``."""
    share = F.avg(F.col(label).cast("double"))
    return neighbours.groupBy(key).agg(share.alias("score"), (share > 0.5).cast("double").alias("prediction"))


def _to_arrays(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("vec", vector_to_array(features)).drop(features)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None]
    return np.sqrt(np.maximum(square, 0))


def _step(x: np.ndarray) -> int:
    """Queries that are compared with these references at a time."""
    return max(1, min(512, PAIRS // max(1, len(x))))


def _side(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The references as a factor of the product form, and their largest norm; made once for many queries."""
    xx = (x**2).sum(1)
    return np.column_stack([x, np.ones(len(x)), xx]).T.copy(), float(np.sqrt(xx.max()))


def _candidates(
    q: np.ndarray, x: np.ndarray, take: int, reach: np.ndarray | None = None, side: tuple[np.ndarray, float] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(query, reference) pairs that hold the ``take`` nearest of each query for sure.

    Where ``reach`` is finite, those are the pairs within it: k references are known to be.

    The product form ``|q|^2 - 2 q.x + |x|^2`` is one product of ``p + 2`` terms, whose sizes
    add up to ``(|q| + |x|)^2`` at most. It is off by at most ``p + 2`` times ``eps`` of that, and
    the two squares in it by ``p`` times; a reference beyond the rough k-th place by more
    than two errors of twice ``(p + 4) * eps`` is beaten by k others.
    """
    xt, far_x = side or _side(x)
    qq = (q**2).sum(1)
    rough = np.column_stack([-2 * q, qq, np.ones(len(q))]) @ xt
    error = 4 * (q.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(qq) + far_x) ** 2
    if reach is None:
        kth = _at_most(rough, take)
    else:
        kth, far = reach**2 * (1 + 1e-12), ~np.isfinite(reach)
        if far.any():
            kth[far] = _at_most(rough[far], take)
    return np.divmod(np.flatnonzero(rough <= (kth + 2 * error)[:, None]), rough.shape[1])


def _at_most(rough: np.ndarray, take: int) -> np.ndarray:
    """A bound that ``take`` numbers of each row do not pass: of the least of each ``GROUP`` numbers, the one at that place."""
    groups = rough.shape[1] // GROUP
    if groups >= take:
        rough = rough[:, : groups * GROUP].reshape(len(rough), groups, GROUP).min(axis=2)
    return np.partition(rough, take - 1, axis=1)[:, take - 1]


def _ranked(
    q: np.ndarray, x: np.ndarray, take: int, reach: np.ndarray | None = None, side: tuple[np.ndarray, float] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``take`` nearest of each query in order: (query, reference, distance), ties by reference.

    The product form loses digits; every reference that could be among the nearest within
    that loss is compared again, so ties cost time but drop nobody.
    """
    row, at = _candidates(q, x, take, reach, side)
    exact = np.empty(len(row))
    for k in range(0, len(row), SLICE):
        exact[k : k + SLICE] = np.linalg.norm(q[row[k : k + SLICE]] - x[at[k : k + SLICE]], axis=1)
    if reach is not None:
        near = exact <= reach[row]
        row, at, exact = row[near], at[near], exact[near]
    order = np.lexsort((at, exact, row))
    row, at, exact = row[order], at[order], exact[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < take
    return row[best], at[best], exact[best]


def _home(queries: DataFrame, key: str, centres: np.ndarray, bounds: dict[int, float]) -> DataFrame:
    used = np.array(sorted(bounds))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = _to_centres(_stack(pdf["vec"]), centres[used]).argmin(1)
                yield pdf.assign(home=used[at].astype(np.int32))

    schema = f"{key} {dict(queries.dtypes)[key]}, vec array<double>, home int"
    return queries.select(key, "vec").mapInPandas(place, schema)


def _open_cells(queries: DataFrame, key: str, centres: np.ndarray, radius: np.ndarray) -> DataFrame:
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            gap = _to_centres(_stack(pdf["vec"]), centres) - radius[None]
            # Slack for rounding keeps the bound safe.
            wanted = gap <= pdf["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
            wanted &= np.isfinite(radius)[None]
            wanted[np.arange(len(pdf)), pdf["home"].to_numpy()] = False
            rows, cells = np.nonzero(wanted)
            reach = pdf["reach"].to_numpy()
            # A query may visit every cell, so its vector is repeated for some visits at a time.
            for start in range(0, len(rows), SLICE):
                row = rows[start : start + SLICE]
                yield pdf[[key, "vec"]].iloc[row].assign(cell=cells[start : start + SLICE].astype(np.int32), reach=reach[row])

    schema = f"{key} {dict(queries.dtypes)[key]}, vec array<double>, cell int, reach double"
    return queries.select(key, "vec", "home", "reach").mapInPandas(expand, schema)


def _visit(queries: DataFrame, reference: DataFrame, layout: DataFrame, key: str, k: int) -> DataFrame:
    """Best k candidates per query and block of the cells it visits; none beyond its ``reach``, if it has one.

    So a visit to a cell without a nearer reference gives no row, and its block needs no ranking.
    """
    bounded = "reach" in queries.columns
    visits = queries.select(key, "vec", "cell", *(["reach"] if bounded else []))
    crowd = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("_q"))
    chunks = F.greatest(F.ceil(F.col("_q") / BLOCK), F.lit(1)).cast("int")
    plan = layout.join(crowd, "cell").select("cell", "blocks", chunks.alias("chunks"))
    asked = visits.join(F.broadcast(plan), "cell").select(
        key,
        "vec",
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64(key), F.col("chunks")).cast("int").alias("chunk"),
        *(["reach"] if bounded else []),
    )
    offered = reference.join(F.broadcast(plan.select("cell", "chunks")), "cell").select(
        "n_key", "n_label", "vec", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    types = dict(reference.dtypes)
    schema = f"{key} {dict(queries.dtypes)[key]}, neighbour {types['n_key']}, label double, distance double"
    group = ["cell", "block", "chunk"]

    def compare(ask: pd.DataFrame, offer: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(offer):
            return pd.DataFrame({key: [], "neighbour": [], "label": [], "distance": []})
        x, ids = _stack(offer["vec"]), offer["n_key"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        x, ids, y = x[by_id], ids[by_id], offer["n_label"].to_numpy(float)[by_id]
        take, side, step = min(k, len(x)), _side(x), _step(x)
        parts = []
        for start in range(0, len(ask), step):
            part = ask.iloc[start : start + step]
            q = _stack(part["vec"])
            row, at, exact = _ranked(q, x, take, part["reach"].to_numpy(float) if bounded else None, side)
            parts.append(
                pd.DataFrame({key: part[key].to_numpy()[row], "neighbour": ids[at], "label": y[at], "distance": exact})
            )
        return pd.concat(parts)

    found = asked.groupBy(*group).cogroup(offered.groupBy(*group)).applyInPandas(compare, schema)
    return _top_k(found, key, k).drop("rank")


def _top_k(candidates: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("distance", "neighbour")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
