"""Metrics, splits and feature matrices; scores are a fixed formula SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.operators import bookings as b
from roomledger.operators import evaluation as ev
from roomledger.operators import features
from roomledger.plans.registry import half_even, plan
from roomledger.sources.testdata import load_bookings as load

_SCORED = """, sc AS (SELECT reservation_id, is_cancelled AS label, (lead_time_days + CASE WHEN booking_source IN ('OTA','Web') THEN 30 ELSE 0 END) / 125.0::DOUBLE AS score FROM bookings)"""


def scored(spark, path):
    rows = load(spark, path, "reservation_id", "is_cancelled", "lead_time_days", "booking_source")
    online = F.when(F.col("booking_source").isin("OTA", "Web"), 30).otherwise(0)
    return rows.select(
        "reservation_id",
        F.col("is_cancelled").alias("label"),
        ((F.col("lead_time_days") + online) / F.lit(125.0)).alias("score"),
    )


@plan(
    "st_auc",
    _SCORED
    + """, g AS (SELECT score, COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (label = 0) AS q FROM sc GROUP BY score),
 c AS (SELECT *, SUM(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM g)
 SELECT ROUND(SUM(p * (CAST(below AS DOUBLE) - q / 2.0)) / (CAST(SUM(p) AS DOUBLE) * CAST(SUM(q) AS DOUBLE)), 10) AS auc FROM c""",
)
def st_auc(spark, path):
    return ev.auc(scored(spark, path)).select(F.round("auc", 10).alias("auc"))


@plan(
    "st_roc_curve",
    _SCORED
    + """, g AS (SELECT score, COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (label = 0) AS q FROM sc GROUP BY score)
 SELECT score AS threshold, CAST(SUM(q) OVER w AS DOUBLE) / CAST(SUM(q) OVER () AS DOUBLE) AS fpr, CAST(SUM(p) OVER w AS DOUBLE) / CAST(SUM(p) OVER () AS DOUBLE) AS tpr
 FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def st_roc_curve(spark, path):
    return ev.roc_curve(scored(spark, path))


def _sweep_sql() -> str:
    grid = ", ".join(f"({t!r}::DOUBLE, {round(t, 2)!r}::DOUBLE)" for t in ev.CUTOFFS)
    return (
        _SCORED
        + f""", grid(t, shown) AS (VALUES {grid}),
 k AS (SELECT shown, COUNT(*) FILTER (score >= t AND label = 1) AS tp, COUNT(*) FILTER (score >= t AND label = 0) AS fp,
   COUNT(*) FILTER (score < t AND label = 1) AS fn FROM sc, grid GROUP BY shown),
 sw AS (SELECT shown AS threshold, CASE WHEN tp + fp = 0 THEN 0.0 ELSE {half_even('tp', 'GREATEST(tp + fp, 1)', 3)} END AS precision,
   CASE WHEN tp + fn = 0 THEN 0.0 ELSE {half_even('tp', 'GREATEST(tp + fn, 1)', 3)} END AS recall,
   CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE {half_even('2 * tp', 'GREATEST(2 * tp + fp + fn, 1)', 3)} END AS f1 FROM k)"""
    )


@plan("st_threshold_sweep", _sweep_sql() + " SELECT * FROM sw")
def st_threshold_sweep(spark, path):
    return ev.threshold_sweep(scored(spark, path))


@plan("st_best_threshold", _sweep_sql() + " SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def st_best_threshold(spark, path):
    return ev.best_row(st_threshold_sweep(spark, path), "f1", "threshold")


@plan(
    "st_confusion",
    _SCORED
    + " SELECT label AS actual, COUNT(*) FILTER (score < 0.5) AS predicted_0, COUNT(*) FILTER (score >= 0.5) AS predicted_1 FROM sc GROUP BY label",
)
def st_confusion(spark, path):
    return ev.confusion(ev.with_prediction(scored(spark, path), "score", 0.5))


_OUTCOMES = """, k AS (SELECT COUNT(*) FILTER (label = 1 AND score >= 0.5) AS tp, COUNT(*) FILTER (label = 0 AND score >= 0.5) AS fp,
 COUNT(*) FILTER (label = 1 AND score < 0.5) AS fn, COUNT(*) FILTER (label = 0 AND score < 0.5) AS tn FROM sc)"""


def _class_sql(cls: int, hit: str, false: str, missed: str) -> str:
    return f"""SELECT {cls} AS class, {half_even(hit, f'{hit} + {false}', 4)} AS precision, {half_even(hit, f'{hit} + {missed}', 4)} AS recall,
 {half_even(f'2 * {hit}', f'2 * {hit} + {false} + {missed}', 4)} AS f1, {hit} + {missed} AS support, {half_even('tp + tn', 'tp + tn + fp + fn', 4)} AS accuracy FROM k"""


@plan(
    "st_class_metrics",
    _SCORED + _OUTCOMES + " " + _class_sql(0, "tn", "fn", "fp") + " UNION ALL " + _class_sql(1, "tp", "fp", "fn"),
)
def st_class_metrics(spark, path):
    return ev.class_report(ev.with_prediction(scored(spark, path), "score", 0.5))


@plan(
    "st_sensitivity",
    _SCORED
    + f""", k AS (SELECT COUNT(*) AS n, COUNT(*) FILTER ((1 - label) = CAST((1 - score) > 0.5 AS INT)) AS ok,
 COUNT(*) FILTER (label = 1) AS gone, COUNT(*) FILTER (label = 1 AND NOT ((1 - score) > 0.5)) AS hit FROM sc)
 SELECT {half_even('ok', 'n', 4)} AS accuracy, {half_even('hit', 'gone', 4)} AS sensitivity FROM k""",
)
def st_sensitivity(spark, path):
    # Stayed = 1 is the modelled outcome here, and 0 (cancelled) the positive class.
    rows = scored(spark, path).select((1 - F.col("label")).alias("label"), (1 - F.col("score")).alias("score"))
    return ev.sensitivity(ev.with_prediction(rows, "score", 0.5, strict=True))


@plan(
    "st_reg_metrics",
    """, p AS (SELECT total_amount AS y, avg_price_per_room * nights_booked * 1.1 AS z FROM bookings WHERE is_cancelled = 0)
 SELECT ROUND(1 - SUM((z - y) * (z - y)) / (VAR_POP(y) * COUNT(*)), 4) AS r2, ROUND(POWER(CORR(z, y), 2), 4) AS r2_corr,
 ROUND(SQRT(AVG((z - y) * (z - y))), 2) AS rmse, ROUND(AVG(ABS(z - y)), 2) AS mae FROM p""",
)
def st_reg_metrics(spark, path):
    rows = b.honoured(load(spark, path, "total_amount", "avg_price_per_room", "nights_booked", "is_cancelled"))
    guess = F.col("avg_price_per_room") * F.col("nights_booked") * 1.1
    return ev.regression_metrics(rows.select(F.col("total_amount").alias("label"), guess.alias("prediction")))


@plan(
    "st_hosmer_lemeshow",
    _SCORED
    + """, t AS (SELECT *, NTILE(10) OVER (ORDER BY score, reservation_id) AS d FROM sc),
 g AS (SELECT d, COUNT(*) AS n, SUM(label) AS o, SUM(score) AS e, AVG(score) AS m FROM t GROUP BY d)
 SELECT CAST(d AS INT) AS decile, n, CAST(o AS BIGINT) AS observed, ROUND(e, 6) AS expected, ROUND((o - e) * (o - e) / NULLIF(n * m * (1 - m), 0), 6) AS chi_square_part FROM g""",
)
def st_hosmer_lemeshow(spark, path):
    return ev.hosmer_lemeshow(scored(spark, path))


# --- features and splits -----------------------------------------------------


@plan(
    "feat_datetime",
    """ SELECT reservation_id, CAST(EXTRACT(MONTH FROM check_in_date) AS INT) AS checkin_month, CAST(EXTRACT(ISODOW FROM check_in_date) - 1 AS INT) AS checkin_dow,
 CAST(EXTRACT(ISODOW FROM check_in_date) >= 5 AS INT) AS checkin_is_weekend, CAST(EXTRACT(QUARTER FROM check_in_date) AS INT) AS checkin_quarter FROM bookings""",
)
def feat_datetime(spark, path):
    return features.with_dates(load(spark, path, "reservation_id", "check_in_date")).drop("check_in_date")


_DERIVED = """CAST(room_no IN (202,206,208,210,301,302,309) AS {0}) AS is_hot_room, CAST(n_children > 0 AS {0}) AS has_children, CAST(rate_premium_pct > 10 AS {0}) AS is_overpriced,
 CAST(previous_cancellations AS DOUBLE) / (previous_cancellations + previous_successful_bookings + 1) AS cancellation_history_ratio,
 CAST(lead_time_days * lead_time_days AS {0}) AS lead_time_sq, CAST(lead_time_days > 30 AS {0}) AS high_lead"""
_DERIVED_COLUMNS = (
    "reservation_id",
    "room_no",
    "n_children",
    "rate_premium_pct",
    "previous_cancellations",
    "previous_successful_bookings",
    "lead_time_days",
)


def _int(text: str) -> str:
    return text.replace("{0}", "INT")


def _double(text: str) -> str:
    return text.replace("CAST(room_no IN (202,206,208,210,301,302,309) AS {0})", "CAST(CAST(room_no IN (202,206,208,210,301,302,309) AS INT) AS DOUBLE)").replace(
        "CAST(n_children > 0 AS {0})", "CAST(CAST(n_children > 0 AS INT) AS DOUBLE)"
    ).replace("CAST(rate_premium_pct > 10 AS {0})", "CAST(CAST(rate_premium_pct > 10 AS INT) AS DOUBLE)").replace(
        "CAST(lead_time_days > 30 AS {0})", "CAST(CAST(lead_time_days > 30 AS INT) AS DOUBLE)"
    ).replace("{0}", "DOUBLE")


@plan("feat_derived", f" SELECT reservation_id, {_int(_DERIVED)} FROM bookings")
def feat_derived(spark, path):
    rows = features.with_derived(load(spark, path, *_DERIVED_COLUMNS))
    return rows.drop(*_DERIVED_COLUMNS[1:])


_LEVELS = {
    "booking_source": ["Corporate", "Direct / Front Desk", "OTA", "Travel Agent", "Web"],
    "market_segment": ["Corporate", "Direct", "Group / Agent", "Online Leisure"],
    "room_type_reserved": ["Mahogany (Premium)", "Maple (Deluxe)"],
    "meal_plan": ["Breakfast Included", "Full Board", "Half Board", "No Meal"],
    "payment_mode": ["Pay at Hotel", "Prepaid"],
}


def _dummy_sql(columns, skip) -> str:
    return ", ".join(
        f"""CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "{c}_{v}\""""
        for c in columns
        for v in _LEVELS[c]
        if v not in skip(c)
    )


def _num_sql(columns) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


_DATE_SQL = """CAST(EXTRACT(MONTH FROM check_in_date) AS DOUBLE) AS checkin_month, CAST(EXTRACT(ISODOW FROM check_in_date) - 1 AS DOUBLE) AS checkin_dow,
 CAST(CAST(EXTRACT(ISODOW FROM check_in_date) >= 5 AS INT) AS DOUBLE) AS checkin_is_weekend, CAST(EXTRACT(QUARTER FROM check_in_date) AS DOUBLE) AS checkin_quarter"""
_MATRIX_NUMERIC = (
    "lead_time_days",
    "n_adults",
    "n_children",
    "previous_cancellations",
    "previous_successful_bookings",
    "n_special_requests",
    "room_no",
    "got_room_upgrade",
    "nights_booked",
    "avg_price_per_room",
    "competitor_avg_rate",
    "rate_premium_pct",
    "ota_commission_pct",
)
MATRIX_COLUMNS = (*_MATRIX_NUMERIC, *features.CANCEL_CATEGORIES, "check_in_date", "reservation_id", "is_cancelled")


@plan(
    "feat_cancel_matrix",
    f""" SELECT reservation_id, {_num_sql(_MATRIX_NUMERIC)}, {_DATE_SQL}, {_double(_DERIVED)},
 {_dummy_sql(features.CANCEL_CATEGORIES, lambda c: _LEVELS[c][:1])}, is_cancelled FROM bookings""",
)
def feat_cancel_matrix(spark, path):
    return features.cancellation_matrix(load(spark, path, *MATRIX_COLUMNS), keep=["reservation_id"])[0]


REVENUE_COLUMNS = (
    "nights_booked",
    "n_adults",
    "n_children",
    "n_special_requests",
    "got_room_upgrade",
    "ota_commission_pct",
    "room_no",
    *features.REVENUE_CATEGORIES,
    "check_in_date",
    "reservation_id",
    "total_amount",
    "is_cancelled",
)


@plan(
    "feat_revenue_matrix",
    f""" SELECT reservation_id, {_num_sql(REVENUE_COLUMNS[:6])}, CAST(EXTRACT(MONTH FROM check_in_date) AS DOUBLE) AS checkin_month,
 CAST(CAST(EXTRACT(ISODOW FROM check_in_date) >= 5 AS INT) AS DOUBLE) AS checkin_is_weekend, CAST(EXTRACT(QUARTER FROM check_in_date) AS DOUBLE) AS checkin_quarter,
 CAST(CAST(room_no IN (202,206,208,210,301,302,309) AS INT) AS DOUBLE) AS is_hot_room, {_dummy_sql(features.REVENUE_CATEGORIES, lambda c: _LEVELS[c][:1])}, total_amount
 FROM bookings WHERE is_cancelled = 0""",
)
def feat_revenue_matrix(spark, path):
    return features.revenue_matrix(load(spark, path, *REVENUE_COLUMNS), keep=["reservation_id"])[0]


_FLAGS_SQL = """CAST(CAST(EXTRACT(ISODOW FROM check_in_date) >= 5 AS INT) AS DOUBLE) AS is_weekend,
 CAST(CAST(EXTRACT(MONTH FROM check_in_date) IN (4,9,10,12) AS INT) AS DOUBLE) AS is_peak_month"""
LOGIT_COLUMNS = (
    "reservation_id",
    "check_in_date",
    "lead_time_days",
    "n_adults",
    "n_children",
    "n_special_requests",
    "previous_cancellations",
    "previous_successful_bookings",
    "avg_price_per_room",
    "rate_premium_pct",
    "nights_booked",
    "got_room_upgrade",
    *features.LOGIT_REFERENCE,
    "is_cancelled",
)


@plan(
    "feat_logit_full",
    f""" SELECT reservation_id, {_num_sql(LOGIT_COLUMNS[2:12])}, {_FLAGS_SQL},
 {_dummy_sql(features.LOGIT_REFERENCE, lambda c: [features.LOGIT_REFERENCE[c]])}, is_cancelled FROM bookings""",
)
def feat_logit_full(spark, path):
    return features.logit_design(load(spark, path, *LOGIT_COLUMNS), keep=["reservation_id"])[0]


KEPT_COLUMNS = (
    "reservation_id",
    "check_in_date",
    "lead_time_days",
    "previous_cancellations",
    "previous_successful_bookings",
    "n_special_requests",
    "booking_source",
    "payment_mode",
    "meal_plan",
    "is_cancelled",
)


@plan(
    "feat_logit_sig",
    f""" SELECT reservation_id, {_num_sql(KEPT_COLUMNS[2:6])}, CAST(CAST(EXTRACT(MONTH FROM check_in_date) IN (4,9,10,12) AS INT) AS DOUBLE) AS is_peak_month,
 {_dummy_sql(features.LOGIT_KEPT_LEVELS, lambda c: [v for v in _LEVELS[c] if v not in features.LOGIT_KEPT_LEVELS[c]])}, is_cancelled FROM bookings""",
)
def feat_logit_sig(spark, path):
    return features.logit_kept_design(load(spark, path, *KEPT_COLUMNS), keep=["reservation_id"])[0]


@plan("feat_leakage_guard", " SELECT 0 AS leaked_columns, COUNT(*) AS n_rows FROM bookings")
def feat_leakage_guard(spark, path):
    matrix, names = features.cancellation_matrix(load(spark, path, *MATRIX_COLUMNS))
    return matrix.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(len(features.leaked(names))).alias("leaked_columns"), "n_rows"
    )


_SPLIT_SQL = """, h AS (SELECT reservation_id, is_cancelled, ROW_NUMBER() OVER (PARTITION BY is_cancelled ORDER BY MD5(reservation_id || '|42')) AS i,
 COUNT(*) OVER (PARTITION BY is_cancelled) AS n FROM bookings), sp AS (SELECT reservation_id, is_cancelled, CAST(i <= ROUND(0.25 * n) AS INT) AS is_test FROM h)"""


def _split(spark, path):
    return features.holdout(load(spark, path, "reservation_id", "is_cancelled"), strata=["is_cancelled"])


@plan("prep_split", _SPLIT_SQL + " SELECT * FROM sp")
def prep_split(spark, path):
    return _split(spark, path)


_R_SPLIT_SQL = """, h AS (SELECT reservation_id, ROW_NUMBER() OVER (ORDER BY MD5(reservation_id || '|42')) AS i, COUNT(*) OVER () AS n FROM bookings)"""


@plan("join_anti_split", _R_SPLIT_SQL + " SELECT reservation_id FROM h WHERE i > ROUND(0.6 * n)")
def join_anti_split(spark, path):
    rows = load(spark, path, "reservation_id")
    train = features.holdout(rows, share=0.6, name="in_train").filter("in_train = 1")
    return features.rest_of(rows, train)


@plan("set_diff", _R_SPLIT_SQL + " SELECT reservation_id FROM h WHERE i > ROUND(0.6 * n)")
def set_diff(spark, path):
    rows = load(spark, path, "reservation_id")
    train = features.holdout(rows, share=0.6, name="in_train").filter("in_train = 1")
    return rows.subtract(train.select("reservation_id"))


_SCALED = ("lead_time_days", "nights_booked", "avg_price_per_room")


@plan(
    "prep_scale",
    _SPLIT_SQL
    + ", v AS (SELECT sp.reservation_id, is_test, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SCALED)
    + " FROM sp JOIN bookings USING (reservation_id)), f AS (SELECT "
    + ", ".join(f"AVG({c}) AS m{i}, STDDEV_POP({c}) AS s{i}" for i, c in enumerate(_SCALED))
    + " FROM v WHERE is_test = 0) SELECT reservation_id, is_test, "
    + ", ".join(f"ROUND(({c} - m{i}) / s{i}, 8) + 0.0 AS {c}" for i, c in enumerate(_SCALED))
    + " FROM v, f",
)
def prep_scale(spark, path):
    rows = load(spark, path, "reservation_id", "is_cancelled", *_SCALED)
    split = features.holdout(rows, strata=["is_cancelled"]).drop("is_cancelled")
    scaled = features.standardise(split, _SCALED, fit_on=split.filter("is_test = 0"))
    return scaled.select(
        "reservation_id", "is_test", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in _SCALED]
    )


@plan(
    "prep_factor",
    """, k AS (SELECT booking_source, CAST(ROW_NUMBER() OVER (ORDER BY booking_source) - 1 AS INT) AS booking_source_index FROM (SELECT DISTINCT booking_source FROM bookings))
 SELECT reservation_id, booking_source, booking_source_index FROM bookings JOIN k USING (booking_source)""",
)
def prep_factor(spark, path):
    return features.category_index(load(spark, path, "reservation_id", "booking_source"), "booking_source")
