"""Guest and booking segments: K-Means with restarts, elbow, PCA, bisecting K-Means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomledger.operators import trees
from roomledger.operators.features import standardise
from roomledger.operators.inference import assemble
from roomledger.session import training_rows

# Features, number of segments and restarts.
GUEST_FEATURES = ("bookings", "total_revenue", "avg_revenue", "cancel_rate", "nights")
BOOKING_FEATURES = (
    "total_lodging_amount",
    "total_amount",
    "paid_at_hotel_amount",
    "paid_to_ota_amount",
    "stayed_room_nights",
)
SEGMENTS = 4
RESTARTS = 10
BOOKING_RESTARTS = 25
SEED = 42
ELBOW = range(1, 8)


def scaled_vectors(df: DataFrame, columns: Sequence[str], population: bool = True) -> DataFrame:
    """All columns plus a ``features`` vector of z-scores, stored for repeated passes."""
    copies = {f"_z{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    scaled = standardise(df.withColumns(copies), list(copies), population=population)
    return training_rows(assemble(scaled, list(copies), df.columns))


class Clusters(NamedTuple):
    """Centres and the sum of squares about them."""

    centres: np.ndarray
    cost: float

    def transform(self, vectors: DataFrame, name: str = "segment", features: str = "features") -> DataFrame:
        """Rows with the number of the nearest centre; the first one on a tie."""
        x = vector_to_array(features)
        squares = [
            F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            for c in self.centres
        ]
        marked = vectors.withColumn("_d", F.array(*squares))
        return marked.withColumn(name, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre per row and the squared distance to it."""
    columns = np.ascontiguousarray(x.T)
    at, best = np.zeros(len(x), dtype=np.int64), None
    # A centre at a time over whole columns: no array per row and centre.
    for i, centre in enumerate(centres):
        square = np.zeros(len(x))
        for column, c in zip(columns, centre, strict=True):
            gap = column - c
            gap *= gap
            square += gap
        if best is None:
            best = square
        else:
            nearer = square < best
            at[nearer] = i
            np.minimum(best, square, out=best)
    return at, best


def many_kmeans(
    vectors: DataFrame,
    ks: Sequence[int],
    restarts: int = RESTARTS,
    seed: int = SEED,
    steps: int = 100,
    tol: float = 1e-4,
    features: str = "features",
) -> dict[int, Clusters]:
    """Best of ``restarts`` fits for every k; all fits share each pass over the rows.

    Seeds are drawn one per pass with chances in proportion to the squared distance to the
    seeds before: a row's draw is exponential with that rate, by a hash of the row, and the
    least draw wins. Then each pass adds up rows per (fit, centre); a fit leaves when no
    centre moves more than ``tol``. So the passes are those of the slowest fit.
    """
    rows = vectors.select(
        F.xxhash64(*[c for c in vectors.columns if c != features]).alias("uid"), vector_to_array(features).alias("x")
    )
    first = rows.first()
    if first is None:
        return {}
    width = len(first["x"])
    fits = [(k, r) for k in ks for r in range(restarts if k > 1 else 1)]
    centres: list[np.ndarray] = [np.zeros((0, width)) for _ in fits]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def seeds(open_: list[int], step: int) -> dict[int, np.ndarray]:
        chosen = [centres[f] for f in open_]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for uid, x in batches_of(batches):
                for f, own in zip(open_, chosen, strict=True):
                    far = _nearest(x, own)[1] if len(own) else np.ones(len(x))
                    u = trees.uniform(uid, (seed * 1_009 + fits[f][1]) * 1_000 + step)
                    with np.errstate(divide="ignore"):
                        draw = np.where(far > 0, -np.log(np.maximum(u, 1e-300)) / far, np.inf)
                    at = int(draw.argmin())
                    if f not in best or draw[at] < best[f][0]:
                        best[f] = float(draw[at]), x[at].tolist()
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(best), pa.int32()), pa.array([d for d, _ in best.values()]), pa.array([v for _, v in best.values()])],
                    names=["fit", "draw", "x"],
                )

        drawn = rows.mapInArrow(run, "fit int, draw double, x array<double>")
        return {r["fit"]: np.array(r["x"]) for r in drawn.groupBy("fit").agg(F.min_by("x", "draw").alias("x")).collect()}

    for step in range(max(ks)):
        open_ = [f for f, (k, _) in enumerate(fits) if k > step]
        for f, x in seeds(open_, step).items():
            centres[f] = np.vstack([centres[f], x])

    def sums(open_: list[int]) -> dict[tuple[int, int], tuple[int, float, np.ndarray]]:
        chosen = [centres[f] for f in open_]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {f: np.zeros((len(own), width + 2)) for f, own in zip(open_, chosen, strict=True)}
            for _, x in batches_of(batches):
                for f, own in zip(open_, chosen, strict=True):
                    at, far = _nearest(x, own)
                    for j, column in enumerate([np.ones(len(x)), far, *x.T]):
                        total[f][:, j] += np.bincount(at, column, len(own))
            flat = [(f, c, row.tolist()) for f, t in total.items() for c, row in enumerate(t) if row[0]]
            yield pa.RecordBatch.from_pylist([{"fit": f, "centre": c, "v": v} for f, c, v in flat], layout)

        layout = pa.schema([("fit", pa.int32()), ("centre", pa.int32()), ("v", pa.list_(pa.float64()))])
        parts = rows.mapInArrow(run, "fit int, centre int, v array<double>")
        added = parts.groupBy("fit", "centre").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        return {(r["fit"], r["centre"]): (r["v"][0], r["v"][1], np.array(r["v"][2:])) for r in added.collect()}

    open_ = list(range(len(fits)))
    for _ in range(steps):
        found, still = sums(open_), []
        for f in open_:
            # A centre without rows stays where it is.
            moved = np.array([found[f, c][2] / found[f, c][0] if (f, c) in found else own for c, own in enumerate(centres[f])])
            if np.sqrt(((moved - centres[f]) ** 2).sum(axis=1)).max() > tol:
                still.append(f)
            centres[f] = moved
        open_ = still
        if not open_:
            break
    cost = dict.fromkeys(range(len(fits)), 0.0)
    for (f, _), (_, square, _) in sums(list(cost)).items():
        cost[f] += square
    best = {k: min((f for f, (own, _) in enumerate(fits) if own == k), key=lambda f: (cost[f], f)) for k in ks}
    return {k: Clusters(centres[f], cost[f]) for k, f in best.items()}


def best_kmeans(vectors: DataFrame, k: int = SEGMENTS, restarts: int = RESTARTS, seed: int = SEED) -> Clusters:
    """The restart with the lowest within-cluster sum of squares."""
    return many_kmeans(vectors, [k], restarts, seed)[k]


def profile(assigned: DataFrame, columns: Sequence[str], cluster: str = "segment") -> DataFrame:
    """Means, size and share per segment."""
    share = F.col("n_guests") / F.sum("n_guests").over(Window.partitionBy())
    means = [F.round(F.avg(c), 2).alias(c) for c in columns]
    return (
        assigned.groupBy(cluster)
        .agg(*means, F.count(F.lit(1)).alias("n_guests"))
        .withColumn("share_of_guests", F.round(share, 3))
        .orderBy(cluster)
    )


def elbow(spark: SparkSession, vectors: DataFrame, ks: Sequence[int] = ELBOW, restarts: int = RESTARTS) -> DataFrame:
    """Within-cluster sum of squares per k; for one cluster it is the total about the mean."""
    found = many_kmeans(vectors, list(ks), restarts)
    rows = [(k, float(c.cost)) for k, c in found.items()]
    return spark.createDataFrame(rows, "k int, wss double").withColumn("wss", F.round("wss", 4))


def project(vectors: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Two principal components of the z-scores and their explained variance."""
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(vectors)
    xy = vector_to_array("_pc")
    out = model.transform(vectors).select(*keep, xy[0].alias("pc1"), xy[1].alias("pc2"))
    return out, model.explainedVariance.toArray().tolist()


def booking_profile(assigned: DataFrame, cluster: str = "segment") -> DataFrame:
    """Size and mean revenue, nights and lodging per segment, highest revenue first."""
    return (
        assigned.groupBy(cluster)
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("total_amount"), 2).alias("avg_revenue"),
            F.round(F.avg("stayed_room_nights"), 2).alias("avg_nights"),
            F.round(F.avg("total_lodging_amount"), 2).alias("avg_lodging"),
        )
        .orderBy(F.desc("avg_revenue"))
    )


def divisive(vectors: DataFrame, k: int = SEGMENTS, seed: int = SEED) -> DataFrame:
    """Hierarchical grouping from the top, cut at k groups.

    The fit splits a centre by noise in proportion to its norm, which is zero for
    z-scores, so the points are first moved away from the origin; distances stay.
    """
    away = array_to_vector(F.transform(vector_to_array("features"), lambda x: x + 1.0))
    moved = vectors.withColumn("_moved", away)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_moved", predictionCol="hc_cluster").fit(moved)
    return model.transform(moved).drop("_moved")
