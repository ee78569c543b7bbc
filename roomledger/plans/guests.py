"""Guest-grain queries: RFM, lifetime value, concentration."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.functions.exact import money as money_of
from roomledger.operators import guests, ordered
from roomledger.plans.registry import (
    cents,
    half_even,
    half_up,
    mean_int,
    mean_money,
    money,
    plain_mean,
    plan,
    sum_money,
)
from roomledger.plans.reporting import SNAPSHOT
from roomledger.sources.testdata import load_bookings as load

GUEST = "primary_guest_name"
_RFM_COLUMNS = (
    GUEST,
    "check_in_date",
    "reservation_id",
    "total_amount",
    "stayed_room_nights",
    "n_special_requests",
    "is_cancelled",
)


@plan(
    "q07_rfm_features",
    f""" SELECT primary_guest_name, CAST(DATE '{SNAPSHOT}' - MAX(check_in_date) AS INT) AS recency_days, COUNT(DISTINCT reservation_id) AS frequency,
 {sum_money('total_amount')} AS monetary_total, {mean_money('total_amount')} AS avg_booking_value, {mean_int('is_cancelled', 4)} AS historical_cancel_rate,
 {mean_int('n_special_requests', 2)} AS avg_special_requests FROM bookings GROUP BY primary_guest_name ORDER BY monetary_total DESC""",
)
def q07_rfm_features(spark, path):
    cols = (GUEST, "check_in_date", "reservation_id", "total_amount", "is_cancelled", "n_special_requests")
    return guests.rfm_features(load(spark, path, *cols), SNAPSHOT)


@plan(
    "v_guest_lifetime_value",
    f""" SELECT primary_guest_name, COUNT(DISTINCT reservation_id) AS total_bookings, {sum_money('total_amount')} AS lifetime_revenue,
 {mean_money('total_amount')} AS avg_booking_value, MAX(check_in_date) AS last_stay_date, CAST(DATE '{SNAPSHOT}' - MAX(check_in_date) AS INT) AS recency_days,
 {mean_int('is_cancelled', 4)} AS cancel_rate, CAST(SUM(n_special_requests) AS BIGINT) AS total_special_requests FROM bookings GROUP BY primary_guest_name""",
)
def v_guest_lifetime_value(spark, path):
    cols = (GUEST, "check_in_date", "reservation_id", "total_amount", "is_cancelled", "n_special_requests")
    return guests.lifetime_value(load(spark, path, *cols), SNAPSHOT)


_FEATURES = f"""SELECT primary_guest_name, COUNT(*) AS bookings, {sum_money('total_amount')} AS total_revenue,
 CAST(SUM({cents('total_amount')}) AS DOUBLE) / (COUNT(*) * 100.0::DOUBLE) AS avg_revenue, {plain_mean('is_cancelled')} AS cancel_rate,
 CAST(SUM(stayed_room_nights) AS BIGINT) AS nights FROM bookings GROUP BY primary_guest_name"""


@plan("agg_guest_features", " " + _FEATURES)
def agg_guest_features(spark, path):
    cols = (GUEST, "reservation_id", "total_amount", "is_cancelled", "stayed_room_nights")
    return guests.guest_value_features(load(spark, path, *cols))


@plan("smp_without_repl", f", f AS ({_FEATURES}) SELECT * FROM f ORDER BY MD5(primary_guest_name), primary_guest_name LIMIT 4000")
def smp_without_repl(spark, path):
    return guests.sample_guests(agg_guest_features(spark, path))


_BASE = f"""SELECT primary_guest_name, MAX(check_in_date) AS last_stay, COUNT(*) AS frequency, {sum_money('total_amount')} AS monetary,
 {plain_mean('stayed_room_nights')} AS avg_nights, {plain_mean('n_special_requests')} AS n_special_req
 FROM bookings WHERE is_cancelled = 0 GROUP BY primary_guest_name"""
_CANCEL = f"SELECT primary_guest_name, {plain_mean('is_cancelled')} AS cancel_rate FROM bookings GROUP BY primary_guest_name"


@plan("agg_rfm_base", " " + _BASE)
def agg_rfm_base(spark, path):
    return guests.rfm_base(load(spark, path, *_RFM_COLUMNS))


@plan("join_cancel_hist", f", r AS ({_BASE}), c AS ({_CANCEL}) SELECT r.*, c.cancel_rate FROM r JOIN c USING (primary_guest_name)")
def join_cancel_hist(spark, path):
    rows = load(spark, path, *_RFM_COLUMNS)
    return guests.with_cancel_history(guests.rfm_base(rows), rows)


_TABLE = f""", rb AS ({_BASE}), rc AS ({_CANCEL}),
 rt AS (SELECT rb.*, rc.cancel_rate, CAST(DATE '{SNAPSHOT}' - last_stay AS INT) AS recency_days FROM rb JOIN rc USING (primary_guest_name)),
 re AS (SELECT QUANTILE_CONT(CAST(recency_days AS DOUBLE), 0.2) AS e1, QUANTILE_CONT(CAST(recency_days AS DOUBLE), 0.4) AS e2,
   QUANTILE_CONT(CAST(recency_days AS DOUBLE), 0.6) AS e3, QUANTILE_CONT(CAST(recency_days AS DOUBLE), 0.8) AS e4 FROM rt),
 rk AS (SELECT rt.*, ROW_NUMBER() OVER (ORDER BY frequency, primary_guest_name) AS fr, ROW_NUMBER() OVER (ORDER BY monetary, primary_guest_name) AS mr,
   COUNT(*) OVER () AS n FROM rt),
 rs AS (SELECT rk.*, CAST(5 - CAST(recency_days > e1 AS INT) - CAST(recency_days > e2 AS INT) - CAST(recency_days > e3 AS INT) - CAST(recency_days > e4 AS INT) AS INT) AS r,
   CAST(GREATEST(1, (5 * (fr - 1) + n - 2) // (n - 1)) AS INT) AS f, CAST(GREATEST(1, (5 * (mr - 1) + n - 2) // (n - 1)) AS INT) AS m FROM rk, re),
 rfm AS (SELECT primary_guest_name, last_stay, frequency, monetary, avg_nights, n_special_req, cancel_rate, recency_days, r, f, m, r + f + m AS rfm_score FROM rs),
 tiers AS (SELECT *, CASE WHEN rfm_score >= 13 THEN 'VIP' WHEN r >= 4 AND f >= 3 THEN 'Loyal' WHEN r <= 2 AND f >= 3 THEN 'At Risk'
   WHEN f = 1 AND r >= 3 THEN 'New' ELSE 'Lapsed' END AS tier FROM rfm)"""


@plan("win_rank_first", _TABLE + " SELECT primary_guest_name, monetary, mr AS monetary_rank FROM rk")
def win_rank_first(spark, path):
    base = guests.rfm_base(load(spark, path, *_RFM_COLUMNS)).select(GUEST, "monetary")
    ranked = ordered.global_row_number(base, [F.col("monetary"), F.col(GUEST)], "monetary_rank")
    return ranked.drop("n_rows")


@plan("win_quintile", _TABLE + " SELECT primary_guest_name, r, f, m FROM rfm")
def win_quintile(spark, path):
    return guests.rfm_scores(load(spark, path, *_RFM_COLUMNS), SNAPSHOT).select(GUEST, "r", "f", "m")


@plan("udf_tier", _TABLE + " SELECT primary_guest_name, rfm_score, tier FROM tiers")
def udf_tier(spark, path):
    scored = guests.rfm_scores(load(spark, path, *_RFM_COLUMNS), SNAPSHOT)
    return guests.assign_tier(scored).select(GUEST, "rfm_score", "tier")


@plan("seg_rfm", _TABLE + " SELECT * FROM tiers")
def seg_rfm(spark, path):
    return guests.assign_tier(guests.rfm_scores(load(spark, path, *_RFM_COLUMNS), SNAPSHOT))


@plan(
    "agg_tier_profile",
    _TABLE
    + f""", p AS (SELECT tier, COUNT(*) AS n_guests, SUM({cents('monetary')}) AS rev, {mean_money('monetary', 2, True)} AS avg_revenue,
 {mean_int('recency_days', 2, True)} AS avg_recency, {mean_int('frequency', 2, True)} AS avg_frequency, ROUND_EVEN(AVG(cancel_rate), 2) AS avg_cancel FROM tiers GROUP BY tier),
 w AS (SELECT *, SUM(n_guests) OVER () AS an, SUM(rev) OVER () AS ar FROM p)
 SELECT tier, n_guests, avg_revenue, {money('rev')} AS total_revenue, avg_recency, avg_frequency, avg_cancel, {half_even('n_guests * 100', 'an', 1)} AS pct_guests,
 {half_even('rev * 100', 'ar', 1)} AS pct_revenue, CASE tier WHEN 'VIP' THEN 'Personalised loyalty reward + early access to offers'
 WHEN 'Loyal' THEN 'Targeted upsell (room upgrade, meal plan)' WHEN 'At Risk' THEN 'Proactive win-back email within 30 days'
 WHEN 'New' THEN 'Welcome sequence + incentive for second stay' ELSE 'Reactivation offer or remove from active CRM' END AS recommended_action
 FROM w ORDER BY avg_revenue DESC""",
)
def agg_tier_profile(spark, path):
    return guests.tier_profile(seg_rfm(spark, path))


@plan(
    "agg_repeat_guests",
    f""", g AS (SELECT primary_guest_name, COUNT(*) AS n FROM bookings GROUP BY 1)
 SELECT COUNT(*) AS guests, COUNT(*) FILTER (n > 1) AS repeat_guests, {half_up('SUM(n - 1)', 'SUM(n)', 4)} AS repeat_booking_share FROM g""",
)
def agg_repeat_guests(spark, path):
    return guests.repeat_guests(load(spark, path, GUEST))


_VALUE = f"""SELECT primary_guest_name, SUM({cents('total_amount')}) AS t, COUNT(*) AS bookings FROM bookings WHERE is_cancelled = 0 GROUP BY 1"""
_ALL_VALUE = f"SELECT primary_guest_name, SUM({cents('total_amount')}) AS t FROM bookings GROUP BY 1"
_PARETO_COLUMNS = (GUEST, "total_amount", "is_cancelled")


@plan(
    "q10_pareto_centile",
    f""", g AS ({_VALUE}), r AS (SELECT *, NTILE(100) OVER (ORDER BY t DESC, primary_guest_name) AS c FROM g),
 s AS (SELECT CASE WHEN c <= 18 THEN 'Top 18%' ELSE 'Bottom 82%' END AS guest_tier, COUNT(*) AS guests, SUM(t) AS rev FROM r GROUP BY 1),
 w AS (SELECT *, SUM(rev) OVER () AS a FROM s) SELECT guest_tier, guests, {money('rev')} AS revenue, {half_up('rev * 100', 'a', 1)} AS pct_of_total_revenue FROM w""",
)
def q10_pareto_centile(spark, path):
    return guests.pareto_tiers(load(spark, path, *_PARETO_COLUMNS))


@plan(
    "win_ntile",
    f""", g AS ({_VALUE}) SELECT primary_guest_name, {money('t')} AS lifetime_revenue, bookings,
 CAST(NTILE(100) OVER (ORDER BY t DESC, primary_guest_name) AS INT) AS centile FROM g""",
)
def win_ntile(spark, path):
    return guests.revenue_centiles(load(spark, path, *_PARETO_COLUMNS))


_CURVE = f""", g AS ({_ALL_VALUE}), c AS (SELECT primary_guest_name, t, ROW_NUMBER() OVER o AS rn, COUNT(*) OVER () AS n,
 CAST(SUM(t) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(SUM(t) OVER () AS DOUBLE) AS share
 FROM g WINDOW o AS (ORDER BY t DESC, primary_guest_name))"""


@plan(
    "win_cumsum_share",
    _CURVE + f" SELECT primary_guest_name, {money('t')} AS revenue, rn, n AS n_rows, share AS cum_share FROM c",
)
def win_cumsum_share(spark, path):
    return guests.cumulative_share(load(spark, path, *_PARETO_COLUMNS))


@plan(
    "win_pareto_downsample",
    _CURVE
    + """, s AS (SELECT CAST(UNNEST(RANGE(0, 100)) AS INT) AS step), m AS (SELECT COUNT(*) AS n FROM g),
 p AS (SELECT step, CASE WHEN step = 99 THEN n - 1 ELSE CAST(FLOOR(step * ((n - 1) / 99.0::DOUBLE)) AS BIGINT) END + 1 AS at FROM s, m)
 SELECT step, ROUND_EVEN(rn / CAST(n AS DOUBLE), 4) AS x, ROUND_EVEN(share, 4) AS y FROM p JOIN c ON c.rn = p.at""",
)
def win_pareto_downsample(spark, path):
    return guests.pareto_points(load(spark, path, *_PARETO_COLUMNS))


def _top(q: str) -> str:
    return half_even(f"SUM(CASE WHEN rn <= FLOOR(n * {q}::DOUBLE) THEN t ELSE 0 END)", "SUM(t)", 4)


@plan(
    "win_top_share",
    _CURVE
    + f""" SELECT MAX(n) AS n_guests, {_top('0.10')} AS top_10pct_revenue_share, {_top('0.18')} AS top_18pct_revenue_share,
 {_top('0.20')} AS top_20pct_revenue_share FROM c""",
)
def win_top_share(spark, path):
    return guests.top_shares(load(spark, path, *_PARETO_COLUMNS))
