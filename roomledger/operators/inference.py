"""Logistic inference, collinearity, and backward selection from cross products."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.functions import labels
from roomledger.functions.exact import no_negative_zero
from roomledger.session import training_rows

Z95 = 1.959963984540054  # Fixed value: 97.5% point of the standard normal.
HIGH_VIF = 5.0
ALPHA = 0.05


def assemble(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``features`` vector of the named columns, next to the kept columns."""
    # Names with dots or brackets are fine in plain columns but not in the assembler's
    # lookup, so it works on positional aliases.
    short = [F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)]
    plain = df.select(*keep, *short)
    vector = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features")
    return vector.transform(plain).select(*keep, "features")


# --- logit -------------------------------------------------------------------


def fit_logit(df: DataFrame, names: Sequence[str], label: str = "is_cancelled") -> GeneralizedLinearRegressionModel:
    """Unregularised logit by iteratively reweighted least squares."""
    rows = training_rows(assemble(df, names, [label]))
    glr = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=label, featuresCol="features", maxIter=50, tol=1e-8
    )
    model = glr.fit(rows)
    rows.unpersist()
    return model


def coefficients(
    spark: SparkSession, model: GeneralizedLinearRegressionModel, names: Sequence[str], scale: int | None = 4
) -> DataFrame:
    """One row per variable (and ``const``): estimate, SE, z, p, odds ratio, 95% CI."""
    s = model.summary
    # The summary's arrays hold the intercept last.
    values = [*model.coefficients.toArray().tolist(), float(model.intercept)]
    rows = [
        (n, b, float(se), float(z), float(p))
        for n, b, se, z, p in zip([*names, "const"], values, s.coefficientStandardErrors, s.tValues, s.pValues)
    ]
    raw = spark.createDataFrame(rows, "variable string, coefficient double, se double, z double, p_value double")
    b, se = F.col("coefficient"), F.col("se")
    full = raw.select(
        "variable",
        "coefficient",
        F.exp(b).alias("odds_ratio"),
        "se",
        "z",
        "p_value",
        F.exp(b - Z95 * se).alias("or_ci_low"),
        F.exp(b + Z95 * se).alias("or_ci_high"),
    )
    if scale is not None:
        full = full.select(
            "variable", *[no_negative_zero(F.bround(c, scale)).alias(c) for c in full.columns[1:]]
        )
    return full.withColumns(
        {"sig": labels.significance_stars("p_value"), "reading": labels.odds_phrase(F.col("odds_ratio"))}
    )


def by_strength(table: DataFrame) -> DataFrame:
    """Without the constant, strongest |z| first."""
    return table.filter("variable != 'const'").orderBy(F.abs("z").desc(), "variable")


def fit_quality(spark: SparkSession, model: GeneralizedLinearRegressionModel) -> DataFrame:
    s = model.summary
    row = (
        int(s.numInstances),
        round(1 - s.deviance / s.nullDeviance, 4),
        round(-s.deviance / 2, 1),
        round(s.aic, 1),
    )
    return spark.createDataFrame([row], "n long, pseudo_r2 double, log_likelihood double, aic double")


def significant(table: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return table.filter((F.col("variable") != "const") & (F.col("p_value") < alpha))


def select_variables(table: DataFrame, vif_table: DataFrame, limit: float = HIGH_VIF) -> DataFrame:
    """Significant variables that are not collinear."""
    return significant(table).join(vif_table, "variable").filter(F.col("vif") <= limit)


def predict(model: GeneralizedLinearRegressionModel, df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Predicted probability as ``score``."""
    return model.transform(assemble(df, names, keep)).select(*keep, F.col("prediction").alias("score"))


# --- cross products ----------------------------------------------------------


def gram(column: str) -> Column:
    """Aggregate: X'X of an array column, flat, row by row; a null product counts as 0.

    One vector is summed whatever the number of columns. There must be a row.
    """
    x = F.col(column)
    products = F.transform(x, lambda a: F.transform(x, lambda b: F.coalesce(a * b, F.lit(0.0))))
    return vector_to_array(Summarizer.sum(array_to_vector(F.flatten(products))))


def _products(rows: DataFrame, column: str) -> np.ndarray:
    """X'X of an array column; a null entry counts as 0. There must be a row.

    A task multiplies its batches and gives one matrix; those are added up by Spark.
    """
    width = rows.select(F.size(column).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    parts = rows.select(column).mapInArrow(run, "g array<double>")
    row = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).first()
    return np.asarray(row["g"]).reshape(width, width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width)


def cross_products(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """X'X of the columns with a leading constant, in one distributed aggregate.

    The result is a (p+1) x (p+1) matrix, whatever the number of rows.
    """
    cols = [F.lit(1.0), *[F.col(f"`{n}`").cast("double") for n in names]]
    return _products(df.select(F.array(*cols).alias("_x")), "_x")


def vif(
    spark: SparkSession, df: DataFrame, names: Sequence[str], centred: bool = False, products: np.ndarray | None = None
) -> DataFrame:
    """Variance inflation per variable; without an intercept unless ``centred``.

    ``products`` is X'X where ``cross_products`` has been taken already.
    """
    products = cross_products(df, names) if products is None else products
    n, sums, gram = products[0, 0], products[0, 1:], products[1:, 1:]
    if centred:
        gram = gram - np.outer(sums, sums) / n
    # Scaled to unit diagonal, which leaves the factors unchanged and the inverse stable.
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    inverse = np.linalg.pinv(gram / np.outer(scale, scale))
    rows = [(name, round(float(v), 2), bool(v > HIGH_VIF)) for name, v in zip(names, np.diag(inverse))]
    return spark.createDataFrame(rows, "variable string, vif double, high boolean").orderBy(F.desc("vif"), "variable")


def backward_selection(
    spark: SparkSession, df: DataFrame, terms: dict[str, Sequence[str]], label: str
) -> tuple[DataFrame, DataFrame]:
    """Backward elimination by AIC; a factor's dummies leave as one term.

    All candidate fits come from a single X'X aggregate. Returns the path of dropped
    terms and the coefficients of the selected model.
    """
    names = [c for group in terms.values() for c in group]
    products = cross_products(df, [*names, label])
    n, y = products[0, 0], len(names) + 1
    at = {c: i + 1 for i, c in enumerate(names)}

    def solve(kept: Sequence[str]):
        idx = [0, *[at[c] for t in kept for c in terms[t]]]
        xx, xy = products[np.ix_(idx, idx)], products[idx, y]
        scale = np.sqrt(np.diag(xx))
        scale[scale == 0] = 1.0
        unit = xx / np.outer(scale, scale)
        beta = np.linalg.pinv(unit, rcond=1e-12) @ (xy / scale) / scale
        rss = max(products[y, y] - beta @ xy, 1e-12)
        rank = np.linalg.matrix_rank(unit, tol=1e-10)
        return n * np.log(rss / n) + 2 * rank, beta, idx

    kept = list(terms)
    aic, beta, idx = solve(kept)
    path = [(0, "", float(aic))]
    while kept:
        trials = [(solve([t for t in kept if t != out])[0], out) for out in kept]
        best, out = min(trials)
        if best >= aic:
            break
        kept.remove(out)
        aic, beta, idx = solve(kept)
        path.append((len(path), out, float(aic)))
    chosen = ["const", *[c for t in kept for c in terms[t]]]
    steps = spark.createDataFrame(path, "step int, dropped string, aic double")
    result = spark.createDataFrame(
        [(c, float(b)) for c, b in zip(chosen, beta)], "variable string, coefficient double"
    )
    return steps, result


def linear_score(df: DataFrame, coefs: DataFrame, name: str = "prediction") -> DataFrame:
    """Score rows with a coefficient table (p rows, read back as constants)."""
    expr = F.lit(0.0)
    for row in coefs.collect():
        weight = F.lit(row["coefficient"])
        expr = expr + (weight if row["variable"] == "const" else weight * F.col(f"`{row['variable']}`"))
    return df.withColumn(name, expr)


# --- ordinary least squares --------------------------------------------------


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for k in (even, odd):
            d = 1 + k * d
            c = 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step *= c * d
        value *= step
        if abs(step - 1) < 1e-15:
            break
    return front * value / a


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return _beta_share(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    return _beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def _independent(gram_: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns that are no combination of the ones before them, by Cholesky steps on the unit diagonal."""
    scale = np.sqrt(np.maximum(np.diag(gram_), 0))
    scale[scale == 0] = 1.0
    left = gram_ / np.outer(scale, scale)
    kept = []
    for j in range(len(left)):
        if left[j, j] <= tol:
            continue
        kept.append(j)
        left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return kept


def ols_summary(spark: SparkSession, df: DataFrame, names: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Least squares with inference, from one X'X aggregate: coefficient rows, and one row on the fit.

    A column that depends on the ones before it is aliased: its row has no numbers, and it
    takes no part in the fit. Without degrees of freedom the tests are null.
    """
    products = cross_products(df, [*names, label])
    n, sums, raw = float(products[0, 0]), products[0, 1:], products[1:, 1:]
    centred = raw - np.outer(sums, sums) / n
    p = len(names)
    plain = lambda x: None if x is None else float(x)
    # A constant column's spread is rounding only.
    flat = np.diag(centred)[:p] <= 1e-12 * np.maximum(np.diag(raw)[:p], 1e-300)
    own = centred[:p, :p].copy()
    own[flat, :], own[:, flat] = 0.0, 0.0
    kept = _independent(own)
    scale = np.sqrt(np.diag(own)[kept])
    inverse = np.linalg.inv(own[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ centred[kept, p]
    means = sums[kept] / n
    const = sums[p] / n - beta @ means
    total = centred[p, p]
    rss = max(total - beta @ centred[kept, p], 0.0)
    rank, free = len(kept), n - len(kept) - 1
    variance = rss / free if free > 0 else float("nan")
    at = {names[j]: k for k, j in enumerate(kept)}

    def row(name: str, value: float, spread: float) -> tuple:
        se = math.sqrt(variance * spread) if free > 0 else None
        t = value / se if se else None
        return name, float(value), se, plain(t), t_tail(float(t), free) if t is not None else None, False

    rows = [row("const", const, 1 / n + means @ inverse @ means)]
    for name in names:
        k = at.get(name)
        rows.append((name, None, None, None, None, True) if k is None else row(name, beta[k], inverse[k, k]))
    table = spark.createDataFrame(rows, "variable string, coefficient double, se double, t double, p_value double, aliased boolean")
    r2 = 1 - rss / total if total > 0 else None
    tested = r2 is not None and free > 0 and rank > 0 and rss > 0
    f = (total - rss) / rank / variance if tested else None
    fit = spark.createDataFrame(
        [(
            int(n), rank, int(free), math.sqrt(variance) if free > 0 else None, plain(r2),
            plain(1 - (1 - r2) * (n - 1) / free if r2 is not None and free > 0 else None), plain(f),
            f_tail(float(f), rank, free) if tested else None,
        )],
        "n long, df_model int, df_residual long, sigma double, r2 double, adj_r2 double, f double, p_value double",
    )
    return table.withColumn("sig", F.when(~F.col("aliased"), labels.significance_stars("p_value"))), fit


# --- squared hinge -----------------------------------------------------------


def linear_value(column: str, weights: np.ndarray) -> Column:
    """``weights[0]`` plus the product of the rest with a vector column."""
    own = F.array(*[F.lit(float(w)) for w in weights[1:]])
    products = F.zip_with(vector_to_array(column), own, lambda a, b: a * b)
    return F.lit(float(weights[0])) + F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def squared_hinge(
    df: DataFrame, c: float, column: str = "features", label: str = "label", tol: float = 1e-8, steps: int = 100
) -> np.ndarray:
    """Constant and weights that minimise ``|w|^2 / 2 + c * sum(max(0, 1 - y f(x))^2)``, labels 0 and 1.

    Finite Newton steps: each takes one aggregate, X'X and X'y over the rows inside the
    margin, which make the next step a linear system. The constant is penalised like a
    weight. A step that does not lower the loss is halved. Stops when the gradient is
    below ``tol`` relative to its first size.
    """
    rows = df.select(vector_to_array(column).alias("x"), F.col(label).cast("double").alias("label"))
    width = rows.select(F.size("x").alias("n")).first()["n"] + 1

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, and X'X and X'y of the rows inside the margin of ``w``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, lost = np.zeros((width + 1, width + 1)), 0.0
            for batch in batches:
                x, y = _matrix(batch.column(0), width - 1), batch.column(1).to_numpy() * 2.0 - 1.0
                slack = 1.0 - y * (w[0] + x @ w[1:])
                inside = slack > 0
                lost += float(slack[inside] @ slack[inside])
                z = np.column_stack([np.ones(inside.sum()), x[inside], y[inside]])
                total += z.T @ z
            flat = np.append(total.ravel(), lost)
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["g"])

        parts = rows.mapInArrow(run, "g array<double>")
        flat = np.asarray(parts.agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).first()["g"])
        products = flat[:-1].reshape(width + 1, width + 1)
        return float(w @ w) / 2 + c * float(flat[-1]), products[:width, :width], products[:width, width]

    w = np.zeros(width)
    loss, xx, xy = look(w)
    first = None
    for _ in range(steps):
        gradient = w + 2 * c * (xx @ w - xy)
        size = float(np.linalg.norm(gradient))
        first = first or size
        if size <= tol * max(first, 1e-300):
            break
        step = np.linalg.solve(np.eye(width) + 2 * c * xx, 2 * c * xy) - w
        share = 1.0
        while True:
            trial = w + share * step
            found = look(trial)
            if found[0] <= loss or share < 1e-6:
                break
            share /= 2
        if found[0] >= loss and np.allclose(trial, w, rtol=1e-12, atol=1e-15):
            break
        w, (loss, xx, xy) = trial, found
    return w
