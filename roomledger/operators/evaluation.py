"""Metrics of scored rows, from counts per score rather than from sorted rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.exact import ratio
from roomledger.operators import ordered

# The cutoff grid .20, .25, ... .60 and the decimals it is shown with.
CUTOFFS = tuple(float(t) for t in np.arange(0.20, 0.65, 0.05))


def _by_score(df: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )


def auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC: pairs won plus half the ties; NULL when one class is absent."""
    keys = list(by)
    cum = ordered.running_totals(
        _by_score(df, label, score, keys), [F.col(score)], {"_below": F.col("_neg")}, keys
    )
    won = F.col("_pos").cast("double") * (F.col("_below") - F.col("_neg") / 2)
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return cum.groupBy(*keys).agg(F.try_divide(F.sum(won), pairs).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score, from the strictest cutoff down."""
    cum = ordered.running_totals(
        _by_score(df, label, score, []),
        [F.desc(score)],
        {"_tp": F.col("_pos"), "_fp": F.col("_neg")},
        grand=True,
    )
    return cum.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("_fp").cast("double"), F.col("_fp_total").cast("double")).alias("fpr"),
        F.try_divide(F.col("_tp").cast("double"), F.col("_tp_total").cast("double")).alias("tpr"),
    )


def threshold_sweep(
    df: DataFrame, label: str = "label", score: str = "score", cutoffs: Sequence[float] = CUTOFFS
) -> DataFrame:
    """Precision, recall and F1 (3 decimals) at every cutoff, ``score >= cutoff``.

    Scores are first counted per interval of the grid, so the grid multiplies a
    handful of counts and not the rows.
    """
    slot = F.lit(0)
    for t in cutoffs:
        slot = slot + (F.col(score) >= t).cast("int")
    counts = df.select(slot.alias("_slot"), F.col(label).alias("_y")).groupBy("_slot", "_y").agg(
        F.count(F.lit(1)).alias("_n")
    )
    cells = []
    for i, t in enumerate(cutoffs):
        above = F.col("_slot") > i
        tp = F.sum(F.when(above & (F.col("_y") == 1), F.col("_n")).otherwise(0))
        fp = F.sum(F.when(above & (F.col("_y") == 0), F.col("_n")).otherwise(0))
        fn = F.sum(F.when(~above & (F.col("_y") == 1), F.col("_n")).otherwise(0))
        cells.append(
            F.struct(
                F.lit(round(t, 2)).alias("threshold"),
                _rate(tp, tp + fp, 3).alias("precision"),
                _rate(tp, tp + fn, 3).alias("recall"),
                _rate(tp * 2, tp * 2 + fp + fn, 3).alias("f1"),
            )
        )
    return counts.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def _rate(num: Column, den: Column, scale: int) -> Column:
    return F.coalesce(ratio(num, den, scale, half_even=True), F.lit(0.0))


def best_row(df: DataFrame, value: str, first: str, highest: bool = True) -> DataFrame:
    """The row with the extreme of ``value``; on ties the lowest ``first`` wins."""
    order = F.col(value).desc() if highest else F.col(value).asc()
    return df.orderBy(order, F.col(first).asc()).limit(1)


def with_prediction(df: DataFrame, score: str, cutoff: float, strict: bool = False) -> DataFrame:
    test = F.col(score) > cutoff if strict else F.col(score) >= cutoff
    return df.withColumn("prediction", test.cast("int"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2 x 2 table, one row per actual class."""
    counts = df.groupBy(F.col(label).alias("actual")).pivot(prediction, [0, 1]).count().na.fill(0, ["0", "1"])
    return counts.withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


def class_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = (), scale: int = 4
) -> DataFrame:
    """Per class precision, recall, F1 and support, with the overall accuracy."""
    counts = _outcomes(df, label, prediction, by)
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    right = _rate(tp + tn, tp + tn + fp + fn, scale)

    def row(cls: int, hit: Column, false: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(cls).alias("class"),
            _rate(hit, hit + false, scale).alias("precision"),
            _rate(hit, hit + missed, scale).alias("recall"),
            _rate(hit * 2, hit * 2 + false + missed, scale).alias("f1"),
            (hit + missed).alias("support"),
            right.alias("accuracy"),
        )

    return counts.select(*by, F.inline(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))))


def binary_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = (), scale: int = 4
) -> DataFrame:
    """Accuracy and the positive class's precision, recall and F1 in one row per group."""
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    return _outcomes(df, label, prediction, by).select(
        *by,
        _rate(tp + tn, tp + tn + fp + fn, scale).alias("accuracy"),
        _rate(tp, tp + fp, scale).alias("precision"),
        _rate(tp, tp + fn, scale).alias("recall"),
        _rate(tp * 2, tp * 2 + fp + fn, scale).alias("f1"),
    )


def _outcomes(df, label, prediction, by):
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("_tp"),
        F.count_if((y == 0) & (p == 1)).alias("_fp"),
        F.count_if((y == 1) & (p == 0)).alias("_fn"),
        F.count_if((y == 0) & (p == 0)).alias("_tn"),
    )


def sensitivity(df: DataFrame, label: str = "label", prediction: str = "prediction", positive: int = 0) -> DataFrame:
    """Accuracy, and recall of the class that is called positive."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        _rate(F.count_if(y == p), F.count(F.lit(1)), 4).alias("accuracy"),
        _rate(F.count_if((y == positive) & (p == positive)), F.count_if(y == positive), 4).alias("sensitivity"),
    )


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """R² as 1 - SSE/SST, squared correlation, RMSE and MAE."""
    miss = F.col(prediction) - F.col(label)
    sse, n = F.sum(miss * miss), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.round(1 - F.try_divide(sse, F.var_pop(label) * n), 4).alias("r2"),
        F.round(F.pow(F.corr(prediction, label), 2), 4).alias("r2_corr"),
        F.round(F.sqrt(F.avg(miss * miss)), 2).alias("rmse"),
        F.round(F.avg(F.abs(miss)), 2).alias("mae"),
    )


def hosmer_lemeshow(
    df: DataFrame, label: str = "label", score: str = "score", key: str = "reservation_id", groups: int = 10
) -> DataFrame:
    """Observed and expected events per equal-sized group of the score order."""
    ranked = ordered.global_row_number(df.select(key, label, score), [F.col(score), F.col(key)])
    group = ordered.ntile(F.col("rn"), F.col("n_rows"), groups)
    table = ranked.groupBy(group.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("observed"),
        F.sum(score).alias("_expected"),
        F.avg(score).alias("_mean"),
    )
    part = (F.col("observed") - F.col("_expected")) ** 2
    spread = F.col("n") * F.col("_mean") * (1 - F.col("_mean"))
    return table.select(
        "decile",
        "n",
        "observed",
        F.round("_expected", 6).alias("expected"),
        F.round(F.try_divide(part, spread), 6).alias("chi_square_part"),
    )
