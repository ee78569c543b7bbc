"""Classifier and regressor benchmarks, one split for all: ``pyspark.ml``, and forests and boosting on binned rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegression
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.functions.exact import no_negative_zero
from roomledger.operators import evaluation, features, inference, neighbours, trees
from roomledger.operators.trees import Boost, Forest, Growth
from roomledger.session import training_rows

SEED = 42
KEY = "reservation_id"

# Settings of the compared models.
KNN_K = 15
TREE_DEPTH = 8
SVM_C = 0.5
FOREST_TREES = 300
BOOST = Boost(200, 0.1, Growth(depth=3, by_count=True))
LEAFY = Boost(400, 0.1, Growth(leaves=31, min_rows=20, min_weight=1e-3))
SUBSAMPLED = Boost(400, 0.08, Growth(depth=5, min_weight=1.0, l2=1.0), row_share=0.9, column_share=0.9)
REG_LEAFY = LEAFY._replace(rounds=500)
REG_SUBSAMPLED = Boost(500, 0.05, Growth(depth=6, min_weight=1.0, l2=1.0), row_share=0.9, column_share=0.9)
RIDGE_ALPHA, LASSO_ALPHA = 1.0, 0.1
MAX_TREE_DEPTH = 30
PARALLEL = 4  # models fitted at a time


class SquaredHinge(NamedTuple):
    """Linear classifier with squared hinge loss, the constant penalised like a weight."""

    c: float


class TreeModel(NamedTuple):
    """What is kept of a forest or boosting fit: gains per feature, and the trees if they are few."""

    gains: np.ndarray
    fit: trees.Boosted | None = None

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as the library's tree models name it
        total = float(self.gains.sum())
        return DenseVector(self.gains / total if total else self.gains)


@dataclass
class Split:
    """Train and test rows with plain and scaled feature vectors.

    ``stored`` has the columns only, once; the vectors are put together from them by each
    reader, so that no row is stored three times.
    """

    train: DataFrame
    test: DataFrame
    names: list[str]
    n_train: int
    label_sd: float
    rows: DataFrame
    stored: DataFrame
    extra: list[DataFrame] = field(default_factory=list)

    def binned(self) -> DataFrame:
        """All rows with a byte per feature, cut at the training rows' quantiles; made once."""
        if not self.extra:
            cuts = trees.cut_points(self.train)
            self.extra.append(trees.binned(self.rows, cuts, KEY).persist(StorageLevel.MEMORY_AND_DISK))
        return self.extra[0]

    def release(self) -> None:
        for frame in (self.stored, *self.extra):
            frame.unpersist()


def make_split(matrix: DataFrame, names: Sequence[str], label: str, stratify: bool, share: float = 0.25) -> Split:
    """Exact hold-out, z-scores fitted on the training rows, vectors over one stored copy."""
    marked = training_rows(features.holdout(matrix, share, [label] if stratify else [], KEY, SEED))
    train = marked.filter("is_test = 0")
    columns = [F.col(f"`{n}`") for n in names]
    # One row: the size and label spread, then mean and sd per feature.
    n, sd, *fitted = train.agg(
        F.count(F.lit(1)),
        F.coalesce(F.stddev_samp(label), F.lit(1.0)),
        *[F.avg(c) for c in columns],
        *[F.stddev_pop(c) for c in columns],
    ).first()
    means, sds = fitted[: len(names)], fitted[len(names) :]
    plain = [c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    scaled = [
        ((c - F.lit(m)) / F.lit(s) if s else F.lit(0.0)).alias(f"z{i}")
        for i, (c, m, s) in enumerate(zip(columns, means, sds))
    ]
    rows = marked.select(KEY, "is_test", F.col(label).cast("double").alias("label"), *plain, *scaled)
    for prefix, out in (("x", "features"), ("z", "scaled")):
        inputs = [f"{prefix}{i}" for i in range(len(names))]
        rows = VectorAssembler(inputCols=inputs, outputCol=out).transform(rows).drop(*inputs)
    return Split(
        rows.filter("is_test = 0").drop("is_test"), rows.filter("is_test = 1").drop("is_test"), list(names), n, sd, rows, marked
    )


def _rounds(settings: Boost, rounds: int | None) -> Boost:
    return settings if rounds is None else settings._replace(rounds=rounds)


def classifiers(split: Split, rounds: int | None = None) -> dict[str, tuple[str, Any]]:
    """Name -> (feature column, estimator or settings); C of the library maps to 1 / (C n).

    ``rounds`` replaces the number of boosting rounds and forest trees.
    """
    n = split.n_train
    common = {"labelCol": "label"}
    tries = max(1, int(len(split.names) ** 0.5))
    return {
        "Logistic Regression": (
            "scaled",
            LogisticRegression(
                featuresCol="scaled", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=2000, **common
            ),
        ),
        "Naive Bayes": ("scaled", NaiveBayes(featuresCol="scaled", modelType="gaussian", **common)),
        "KNN (k=15)": ("scaled", None),
        "Decision Tree": ("features", DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=SEED, **common)),
        "Linear SVM": ("scaled", SquaredHinge(SVM_C)),
        "Random Forest": ("features", Forest(rounds or FOREST_TREES, tries, MAX_TREE_DEPTH, SEED)),
        "Gradient Boosting": ("features", _rounds(BOOST, rounds)),
        "Boosting, leafy": ("features", _rounds(LEAFY, rounds)),
        "Boosting, subsampled": ("features", _rounds(SUBSAMPLED, rounds)),
    }


def regressors(split: Split, rounds: int | None = None) -> dict[str, tuple[str, Any]]:
    """Linear models on scaled features; ridge's penalty is rescaled by the label sd."""
    n, sd = split.n_train, split.label_sd
    linear = {"featuresCol": "scaled", "standardization": False, "maxIter": 5000, "labelCol": "label"}
    return {
        "Linear Regression": ("scaled", LinearRegression(**{**linear, "solver": "normal"})),
        "Ridge": (
            "scaled",
            LinearRegression(regParam=RIDGE_ALPHA * sd / n, elasticNetParam=0.0, solver="l-bfgs", tol=1e-9, **linear),
        ),
        "Lasso": ("scaled", LinearRegression(regParam=LASSO_ALPHA, elasticNetParam=1.0, solver="l-bfgs", tol=1e-9, **linear)),
        "Random Forest": ("features", Forest(rounds or FOREST_TREES, None, MAX_TREE_DEPTH, SEED)),
        "Boosting, leafy": ("features", _rounds(REG_LEAFY, rounds)),
        "Boosting, subsampled": ("features", _rounds(REG_SUBSAMPLED, rounds)),
    }


def _tree_scores(split: Split, settings: Forest | Boost, classify: bool) -> tuple[DataFrame, TreeModel]:
    """``KEY, label, raw`` of the test rows: mean vote, or margin."""
    rows, features = split.binned(), len(split.names)
    if isinstance(settings, Forest):
        scores, found = trees.forest_scores(rows, features, settings)
        gains = np.zeros(features)
        for feature, gain in found.collect():
            gains[feature] = gain
        model = TreeModel(gains)
        scores = scores.withColumnRenamed("score", "raw")
    else:
        fit = trees.boost(rows, features, settings, classify)
        model = TreeModel(fit.gains, fit)
        scores = trees.predict_trees(rows.filter("is_test = 1"), fit.trees, fit.base)
    return scores.select(F.col("id").alias(KEY), "label", "raw"), model


def score_classifier(split: Split, name: str, rounds: int | None = None) -> tuple[DataFrame, Any]:
    """Test rows with ``label``, ``score`` and ``prediction``, and the fitted model."""
    column, estimator = classifiers(split, rounds)[name]
    if estimator is None:
        found = neighbours.nearest(split.train, split.test, KNN_K, KEY, "label", column)
        voted = neighbours.vote(found, KEY)
        return split.test.select(KEY, "label").join(voted, KEY), None
    if isinstance(estimator, (Forest, Boost)):
        scores, model = _tree_scores(split, estimator, True)
        cut = 0.5 if isinstance(estimator, Forest) else 0.0
        return scores.select(KEY, "label", F.col("raw").alias("score"), (F.col("raw") > cut).cast("double").alias("prediction")), model
    if isinstance(estimator, SquaredHinge):
        model = inference.squared_hinge(split.train, estimator.c, column)
        score = inference.linear_value(column, model)
        return split.test.select(KEY, "label", score.alias("score"), (score > 0).cast("double").alias("prediction")), model
    model = estimator.fit(split.train)
    out = model.transform(split.test)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    # The order of scores is all AUC needs, so a margin is used as it is.
    score = vector_to_array(F.col(source))[1]
    return out.select(KEY, "label", score.alias("score"), "prediction"), model


def score_regressor(split: Split, name: str, rounds: int | None = None) -> tuple[DataFrame, Any]:
    _, estimator = regressors(split, rounds)[name]
    if isinstance(estimator, (Forest, Boost)):
        scores, model = _tree_scores(split, estimator, False)
        return scores.withColumnRenamed("raw", "prediction"), model
    model = estimator.fit(split.train)
    return model.transform(split.test).select(KEY, "label", "prediction"), model


def _fit_all(split: Split, score: Callable, names: Sequence[str], rounds: int | None) -> list[tuple[str, tuple[DataFrame, Any]]]:
    """Fits of independent models, ``PARALLEL`` at a time: their jobs share the executors."""
    kinds = {n: e for n, (_, e) in {**classifiers(split), **regressors(split)}.items()}
    if any(isinstance(kinds[n], (Forest, Boost)) for n in names):
        split.binned()
    # The longest first: boosting goes on by itself, on few cores, while the others are fitted.
    by_length = sorted(names, key=lambda n: (not isinstance(kinds[n], Boost), not isinstance(kinds[n], Forest)))
    with ThreadPoolExecutor(max_workers=PARALLEL) as pool:
        fits = {n: pool.submit(inheritable_thread_target(split.stored.sparkSession)(score), split, n, rounds) for n in by_length}
        return [(n, fits[n].result()) for n in names]


def classifier_metrics(scored: DataFrame) -> DataFrame:
    """AUC, accuracy, precision, recall and F1 per ``model``, best AUC first."""
    area = evaluation.auc(scored, by=["model"]).select("model", F.bround("auc", 4).alias("auc"))
    rest = evaluation.binary_metrics(scored, by=["model"])
    return area.join(rest, "model").orderBy(F.desc("auc"), "model")


def regressor_metrics(scored: DataFrame) -> DataFrame:
    return evaluation.regression_metrics(scored, by=["model"]).drop("r2_corr").orderBy("rmse", "model")


def classifier_benchmark(
    split: Split, names: Sequence[str] | None = None, rounds: int | None = None
) -> tuple[DataFrame, dict[str, Any]]:
    """The metrics table over the named (default all) models, and the models."""
    parts, fitted = [], {}
    for name, (scored, model) in _fit_all(split, score_classifier, list(names or classifiers(split)), rounds):
        parts.append(scored.select(F.lit(name).alias("model"), "label", "score", "prediction"))
        if model is not None:
            fitted[name] = model
    # Scores are read several times for the metrics; four narrow columns are stored.
    return classifier_metrics(training_rows(reduce(DataFrame.unionByName, parts))), fitted


def regressor_benchmark(
    split: Split, names: Sequence[str] | None = None, rounds: int | None = None
) -> tuple[DataFrame, dict[str, Any]]:
    parts, fitted = [], {}
    for name, (scored, model) in _fit_all(split, score_regressor, list(names or regressors(split)), rounds):
        fitted[name] = model
        parts.append(scored.select(F.lit(name).alias("model"), "label", "prediction"))
    return regressor_metrics(training_rows(reduce(DataFrame.unionByName, parts))), fitted


def importances(spark: SparkSession, model: Any, names: Sequence[str], top: int = 10) -> DataFrame:
    """Highest feature importances of a model of trees; no row for a model without importances."""
    if not hasattr(model, "featureImportances"):
        return spark.createDataFrame([], "feature string, importance double")
    rows = list(zip(names, model.featureImportances.toArray().tolist()))
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def linear_table(spark: SparkSession, model: Any, names: Sequence[str]) -> DataFrame:
    rows = [("const", float(model.intercept)), *zip(names, model.coefficients.toArray().tolist())]
    table = spark.createDataFrame(rows, "variable string, coefficient double")
    return table.withColumn("coefficient", no_negative_zero(F.round("coefficient", 6)))
