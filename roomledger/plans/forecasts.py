"""Daily series, baselines and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.operators import forecasting as fc
from roomledger.plans.registry import half_up, plan, sum_money
from roomledger.sources.testdata import load_bookings as load


def series(spark, path):
    return fc.daily_series(load(spark, path, "check_in_date", "total_amount", "is_cancelled"))


_SERIES = f""", ts AS (SELECT check_in_date AS ds, {sum_money('total_amount')} AS y FROM bookings WHERE is_cancelled = 0 GROUP BY 1),
 lg AS (SELECT ds, y, LAG(y, 7) OVER (ORDER BY ds) AS y_lag, ROW_NUMBER() OVER (ORDER BY ds DESC) AS back FROM ts),
 sp AS (SELECT MIN(ds) AS first, MAX(ds) AS last FROM ts),
 co AS (SELECT CAST(last - 90 - i * 90 AS DATE) AS cutoff FROM sp, (SELECT CAST(UNNEST(RANGE(0, 1000)) AS INT) AS i) WHERE CAST(last - 90 - i * 90 AS DATE) >= CAST(first + 450 AS DATE)),
 cv AS (SELECT cutoff, ds, CAST(ds - cutoff AS INT) AS horizon, y, y_lag AS yhat FROM lg JOIN co ON ds > cutoff AND ds <= CAST(cutoff + 90 AS DATE) WHERE y_lag IS NOT NULL),
 cm AS (SELECT horizon, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse, {half_up('SUM(ABS(CAST(ROUND((y - yhat) * 100) AS BIGINT)))', '(COUNT(*) * 100)', 4)} AS mae, AVG(ABS(y - yhat) / NULLIF(ABS(y), 0)) AS mape FROM cv GROUP BY horizon)"""


@plan("fc_daily_series", _SERIES + " SELECT ds, y FROM ts ORDER BY ds")
def fc_daily_series(spark, path):
    return series(spark, path)


@plan("win_lag", _SERIES + " SELECT ds, y, y_lag FROM lg")
def win_lag(spark, path):
    return fc.lagged(series(spark, path))


@plan("win_trailing_horizon", _SERIES + " SELECT ds, y FROM lg WHERE back <= 90")
def win_trailing_horizon(spark, path):
    return fc.trailing(series(spark, path))


@plan("fc_seasonal_naive", _SERIES + " SELECT ROUND(SQRT(AVG((y - y_lag) * (y - y_lag))), 2) AS baseline_rmse FROM lg WHERE back <= 90")
def fc_seasonal_naive(spark, path):
    return fc.seasonal_naive_rmse(series(spark, path))


@plan(
    "fc_future_frame",
    _SERIES + " SELECT ds FROM ts UNION ALL SELECT CAST(last + i AS DATE) FROM sp, (SELECT CAST(UNNEST(RANGE(1, 91)) AS INT) AS i)",
)
def fc_future_frame(spark, path):
    return fc.future_frame(series(spark, path))


@plan("fc_cutoffs", _SERIES + " SELECT cutoff FROM co")
def fc_cutoffs(spark, path):
    return fc.cutoffs(series(spark, path))


@plan(
    "fc_cv_metrics",
    _SERIES + " SELECT horizon, ROUND(rmse, 4) AS rmse, mae, ROUND(mape, 6) AS mape FROM cm",
)
def fc_cv_metrics(spark, path):
    metrics = fc.cv_metrics(fc.naive_cv(series(spark, path)))
    return metrics.select(
        "horizon", F.round("rmse", 4).alias("rmse"), "mae", F.round("mape", 6).alias("mape")
    )


@plan(
    "fc_cv_summary",
    _SERIES + " SELECT ROUND(AVG(rmse), 2) AS rmse, ROUND(AVG(mae), 2) AS mae, ROUND(AVG(mape), 4) AS mape FROM cm",
)
def fc_cv_summary(spark, path):
    return fc.cv_summary(fc.cv_metrics(fc.naive_cv(series(spark, path))))


_ROLLING = """, dy AS (SELECT horizon, COUNT(*) AS n, SUM((y - yhat) * (y - yhat)) AS s2, SUM(ABS(y - yhat)) AS s1, SUM(ABS(y - yhat) / NULLIF(ABS(y), 0)) AS sp FROM cv GROUP BY horizon),
 ru AS (SELECT *, SUM(n) OVER o AS upto, SUM(n) OVER () AS everything, SUM(s2) OVER o AS u2, SUM(s1) OVER o AS u1, SUM(sp) OVER o AS up FROM dy WINDOW o AS (ORDER BY horizon)),
 en AS (SELECT horizon, GREATEST(CAST(FLOOR(0.1 * everything) AS BIGINT), 1) AS w, upto, u2, u1, up FROM ru),
 rl AS (SELECT e.horizon,
   SQRT((e.u2 - (r.u2 - r.s2 * (r.upto - (e.upto - e.w)) / r.n)) / e.w) AS rmse,
   (e.u1 - (r.u1 - r.s1 * (r.upto - (e.upto - e.w)) / r.n)) / e.w AS mae,
   (e.up - (r.up - r.sp * (r.upto - (e.upto - e.w)) / r.n)) / e.w AS mape
  FROM en e JOIN ru r ON r.upto - r.n <= e.upto - e.w AND e.upto - e.w < r.upto WHERE e.upto >= e.w)"""


@plan(
    "fc_cv_metrics_rolling",
    _SERIES + _ROLLING + " SELECT horizon, ROUND(rmse, 4) AS rmse, ROUND(mae, 4) AS mae, ROUND(mape, 6) AS mape FROM rl",
)
def fc_cv_metrics_rolling(spark, path):
    metrics = fc.rolling_cv_metrics(fc.naive_cv(series(spark, path)))
    return metrics.select(
        "horizon", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape")
    )


@plan(
    "fc_cv_summary_rolling",
    _SERIES + _ROLLING + " SELECT ROUND(AVG(rmse), 2) AS rmse, ROUND(AVG(mae), 2) AS mae, ROUND(AVG(mape), 4) AS mape FROM rl",
)
def fc_cv_summary_rolling(spark, path):
    return fc.cv_summary(fc.rolling_cv_metrics(fc.naive_cv(series(spark, path))))


@plan("fc_interval_coverage")
def fc_interval_coverage(spark, path):
    return fc.coverage(series(spark, path))


@plan("fc_decomposable")
def fc_decomposable(spark, path):
    return fc.forecast(series(spark, path), history=True)


@plan("fc_model_comparison")
def fc_model_comparison(spark, path):
    return fc.comparison(series(spark, path))
