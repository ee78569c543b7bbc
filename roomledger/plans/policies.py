"""Deposit, timing and overbooking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.operators import bookings as b
from roomledger.operators import guests, policy, stats
from roomledger.plans.bundle import side_by_side
from roomledger.plans.registry import LEAD_CASE, cents, half_even, mean_int, money, plan
from roomledger.sources.testdata import load_bookings as load

_DEPOSIT_COLUMNS = ("booking_source", "lead_time_days", "is_cancelled", "avg_price_per_room", "nights_booked")


def _deposit_sql(keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f""", t AS (SELECT *, {LEAD_CASE} AS lead_bucket FROM bookings WHERE booking_source IN ('OTA','Web') AND lead_time_days > 30),
 s AS (SELECT {lead}COUNT(*) AS n, CAST(SUM(is_cancelled) AS BIGINT) AS x, SUM(CASE WHEN is_cancelled = 1 THEN {cents('avg_price_per_room')} * nights_booked ELSE 0 END) AS lost,
   SUM({cents('avg_price_per_room')}) AS p, SUM(nights_booked) AS k FROM t {group}),
 c AS (SELECT *, CAST(FLOOR(n * 0.40::DOUBLE) AS BIGINT) AS conv FROM s),
 d AS (SELECT *, CAST(TRUNC(conv * (CAST(x AS DOUBLE) / CAST(n AS DOUBLE) - 0.05::DOUBLE)) AS BIGINT) AS saved FROM c)
 SELECT {lead}n AS target_bookings, x AS current_cancel_n, {half_even('x', 'n', 4)} AS current_cancel_rate, {money('lost')} AS booked_value_lost,
 conv AS converted_bookings, saved AS estimated_cancels_saved,
 ROUND(saved * (CAST(p AS DOUBLE) / (n * 100.0::DOUBLE) * (CAST(k AS DOUBLE) / CAST(n AS DOUBLE))), 2) AS estimated_revenue_recovered FROM d"""


@plan("agg_deposit_policy", _deposit_sql(""))
def agg_deposit_policy(spark, path):
    return policy.deposit_policy(load(spark, path, *_DEPOSIT_COLUMNS))


@plan("agg_deposit_policy_by", _deposit_sql("booking_source, lead_bucket"))
def agg_deposit_policy_by(spark, path):
    return policy.deposit_policy_by(load(spark, path, *_DEPOSIT_COLUMNS))


@plan(
    "agg_cancel_timing",
    """, f AS (SELECT LEAST(GREATEST(cancel_days_before_arrival / CAST(lead_time_days AS DOUBLE), 0.0), 1.0) AS x
 FROM bookings WHERE is_cancelled = 1 AND lead_time_days > 0), e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM f),
 p AS (SELECT CAST(LEAST(FLOOR((x - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, lo, hi FROM f, e)
 SELECT bin, lo + bin * ((hi - lo) / 30) AS left_edge, COUNT(*) AS n FROM p GROUP BY bin, lo, hi""",
)
def agg_cancel_timing(spark, path):
    rows = load(spark, path, "cancel_days_before_arrival", "lead_time_days", "is_cancelled")
    return stats.histogram(policy.cancel_timing(rows), "cancel_fraction", 30)


@plan(
    "agg_km_survival",
    """, d AS (SELECT GREATEST(lead_time_days - CASE WHEN is_cancelled = 1 THEN GREATEST(cancel_days_before_arrival, 0) ELSE 0 END, 0) AS day,
 CAST(SUM(is_cancelled) AS BIGINT) AS events, COUNT(*) AS leaving FROM bookings WHERE lead_time_days IS NOT NULL GROUP BY 1),
 r AS (SELECT *, CAST(SUM(leaving) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM d),
 s AS (SELECT *, 1 - events / CAST(at_risk AS DOUBLE) AS step FROM r)
 SELECT day, events, at_risk, ROUND(CASE WHEN MAX(CAST(step <= 0 AS INT)) OVER u = 1 THEN 0.0
   ELSE EXP(SUM(CASE WHEN step > 0 THEN LN(step) ELSE 0.0 END) OVER u) END, 8) AS survival FROM s
 WINDOW u AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def agg_km_survival(spark, path):
    rows = load(spark, path, "cancel_days_before_arrival", "lead_time_days", "is_cancelled")
    return policy.survival_curve(rows).withColumn("survival", F.round("survival", 8))


_LAW = """, g AS (SELECT r.*, 14 + o.overbook_by AS rooms_accepted, o.overbook_by FROM r, (SELECT CAST(UNNEST(RANGE(0, 7)) AS INT) AS overbook_by) o),
 c AS (SELECT g.*, k.k FROM g JOIN (SELECT CAST(UNNEST(RANGE(0, 21)) AS INT) AS k) k ON k.k <= rooms_accepted),
 m AS (SELECT *, CAST(FACTORIAL(rooms_accepted) AS DOUBLE) / (CAST(FACTORIAL(k) AS DOUBLE) * CAST(FACTORIAL(rooms_accepted - k) AS DOUBLE))
   * POWER(arrive, k) * POWER(1 - arrive, rooms_accepted - k) AS pmf FROM c)"""
_RATE = """1 - SUM(is_cancelled) / CAST(COUNT(*) AS DOUBLE) AS arrive,
 CAST(SUM(CASE WHEN is_cancelled = 0 THEN CAST(ROUND(avg_price_per_room * 100) AS BIGINT) END) AS DOUBLE) / (COUNT(CASE WHEN is_cancelled = 0 THEN 1 END) * 100.0::DOUBLE) AS rate"""


def _overbook_sql(key: str) -> str:
    lead, group = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f""", r AS (SELECT {lead}{_RATE} FROM bookings {group}){_LAW},
 a AS (SELECT {lead}rate, overbook_by, rooms_accepted, SUM(pmf * k) AS arr, SUM(CASE WHEN k > 14 THEN pmf ELSE 0 END) AS wp, SUM(pmf * GREATEST(k - 14, 0)) AS wo
   FROM m GROUP BY {lead}rate, overbook_by, rooms_accepted),
 ob AS (SELECT {lead}overbook_by, rooms_accepted, ROUND(arr, 2) AS mean_arrivals, ROUND(wp, 4) AS walkout_prob, ROUND(wo, 3) AS mean_walkouts,
   ROUND(LEAST(arr, 14.0) * rate - wo * rate * 3.0, 2) AS expected_net_rev FROM a)"""


@plan("pol_overbooking", _overbook_sql("") + " SELECT * FROM ob")
def pol_overbooking(spark, path):
    return policy.overbooking(load(spark, path, "is_cancelled", "avg_price_per_room"))


@plan("pol_overbooking_by_source", _overbook_sql("booking_source") + " SELECT * FROM ob")
def pol_overbooking_by_source(spark, path):
    rows = load(spark, path, "booking_source", "is_cancelled", "avg_price_per_room")
    return policy.overbooking(rows, ["booking_source"])


@plan(
    "pol_overbooking_by_weekday",
    _overbook_sql("weekday").replace("FROM bookings GROUP", "FROM (SELECT *, CAST(EXTRACT(ISODOW FROM check_in_date) - 1 AS INT) AS weekday FROM bookings) GROUP")
    + " SELECT * FROM ob",
)
def pol_overbooking_by_weekday(spark, path):
    rows = load(spark, path, "check_in_date", "is_cancelled", "avg_price_per_room")
    return policy.overbooking(rows.withColumn("weekday", F.weekday("check_in_date")), ["weekday"])


@plan(
    "win_idxmax",
    _overbook_sql("booking_source")
    + """, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY booking_source ORDER BY CASE WHEN walkout_prob <= 0.02 THEN 0 ELSE 1 END,
 CASE WHEN walkout_prob <= 0.02 THEN expected_net_rev ELSE 0 END DESC, overbook_by) AS i FROM ob)
 SELECT booking_source, overbook_by AS optimal_overbook, walkout_prob AS optimal_walkout_prob, expected_net_rev AS optimal_net_rev FROM o WHERE i = 1""",
)
def win_idxmax(spark, path):
    return policy.best_level(pol_overbooking_by_source(spark, path), ["booking_source"])


@plan(
    "pol_overbooking_season",
    f""", r AS (SELECT CASE WHEN EXTRACT(MONTH FROM check_in_date) IN (4,9,10,12) THEN 'Peak (Apr/Sep/Oct/Dec)' ELSE 'Off-peak (Jan–Mar, May–Aug, Nov)' END AS season,
 {_RATE}, {half_even('SUM(is_cancelled)', 'COUNT(*)', 4)} AS cancel_rate FROM bookings GROUP BY 1){_LAW}
 SELECT season, cancel_rate, ROUND(SUM(CASE WHEN k > 14 THEN pmf ELSE 0 END), 4) AS walkout_prob_at_2 FROM m WHERE overbook_by = 2 GROUP BY season, cancel_rate""",
)
def pol_overbooking_season(spark, path):
    return policy.overbooking_by_season(load(spark, path, "check_in_date", "is_cancelled"))


_HONOURED_CENTS = f"SUM(CASE WHEN is_cancelled = 0 THEN {cents('total_amount')} END)"


@plan(
    "join_kpi_assemble",
    _overbook_sql("")
    + f""", gv AS (SELECT primary_guest_name, SUM({cents('total_amount')}) AS t FROM bookings GROUP BY 1),
 gr AS (SELECT t, ROW_NUMBER() OVER (ORDER BY t DESC, primary_guest_name) AS rn, COUNT(*) OVER () AS n FROM gv),
 k1 AS (SELECT COUNT(*) AS bookings, {mean_int('is_cancelled', 3, True)} AS cancellation_rate, CAST({_HONOURED_CENTS} // 100 AS BIGINT) AS total_revenue,
   CAST({_HONOURED_CENTS} // (100 * SUM(1 - is_cancelled)) AS BIGINT) AS avg_booking_value FROM bookings),
 k2 AS (SELECT {half_even('SUM(CASE WHEN rn <= FLOOR(n * 0.18::DOUBLE) THEN t ELSE 0 END)', 'SUM(t)', 4)} AS top18_revenue_share FROM gr),
 k3 AS (SELECT overbook_by AS optimal_overbook FROM ob ORDER BY CASE WHEN walkout_prob <= 0.02 THEN 0 ELSE 1 END,
   CASE WHEN walkout_prob <= 0.02 THEN expected_net_rev ELSE 0 END DESC, overbook_by LIMIT 1)
 SELECT * FROM k1, k2, k3""",
)
def join_kpi_assemble(spark, path):
    rows = load(spark, path, "primary_guest_name", "total_amount", "avg_price_per_room", "is_cancelled")
    share = guests.top_shares(rows).select(F.col("top_18pct_revenue_share").alias("top18_revenue_share"))
    return side_by_side([b.kpis(rows), share, policy.best_level(policy.overbooking(rows)).select("optimal_overbook")])
