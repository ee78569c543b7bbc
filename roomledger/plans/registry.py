"""Registry of named queries: a callable on (session, folder) and optional SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query; ``sql`` starts after the ``bookings`` CTE."""

    def add(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = BOOKINGS_CTE + sql
        return fn

    return add


# --- SQL text helpers: exact rounding from integers, as the operators do -----


def cents(column: str) -> str:
    return f"CAST(ROUND({column} * 100) AS BIGINT)"


def money(total: str) -> str:
    return f"CAST({total} AS DOUBLE) / 100.0"


def sum_money(column: str) -> str:
    return money(f"SUM({cents(column)})")


def half_up(num: str, den: str, scale: int) -> str:
    """Half-up rounding of a non-negative integer ratio."""
    p = 10**scale
    return f"CAST((2 * {p} * ({num}) + ({den})) // (2 * ({den})) AS DOUBLE) / {p}.0"


def half_even(num: str, den: str, scale: int) -> str:
    """Half-even rounding of a non-negative integer ratio."""
    p = 10**scale
    n, d = f"({p} * ({num}))", f"({den})"
    up = f"(2 * {n} + {d}) // (2 * {d})"
    tie = f"(2 * {n}) % (2 * {d}) = {d}"
    return f"CAST({up} - CASE WHEN {tie} AND ({up}) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / {p}.0"


def mean_money(column: str, scale: int = 2, even: bool = False) -> str:
    fn = half_even if even else half_up
    return fn(f"SUM({cents(column)})", f"(COUNT({column}) * 100)", scale)


def mean_int(column: str, scale: int, even: bool = False) -> str:
    fn = half_even if even else half_up
    return fn(f"SUM({column})", f"COUNT({column})", scale)


def plain_mean(column: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE) / CAST(COUNT({column}) AS DOUBLE)"


LEAD_CASE = """CASE WHEN lead_time_days BETWEEN 0 AND 7 THEN '0-7 days'
 WHEN lead_time_days BETWEEN 8 AND 14 THEN '8-14 days' WHEN lead_time_days BETWEEN 15 AND 30 THEN '15-30 days'
 WHEN lead_time_days BETWEEN 31 AND 60 THEN '31-60 days' ELSE '60+ days' END"""

LEAD_CUT = """CASE WHEN lead_time_days > 0 AND lead_time_days <= 7 THEN 0 WHEN lead_time_days > 7 AND lead_time_days <= 14 THEN 1
 WHEN lead_time_days > 14 AND lead_time_days <= 30 THEN 2 WHEN lead_time_days > 30 AND lead_time_days <= 60 THEN 3
 WHEN lead_time_days > 60 AND lead_time_days <= 999 THEN 4 END"""


def lead_cut_name(names: tuple[str, ...], slot: str = "slot") -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {slot} {arms} END"


BOOKINGS_CTE = """WITH li AS (SELECT l_orderkey, COUNT(*) AS n_lines, MIN(l_partkey) AS p_key FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS k, c.c_name AS g, CAST(o.o_orderdate AS DATE) AS ci,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Corporate' WHEN '2-HIGH' THEN 'Direct / Front Desk'
      WHEN '3-MEDIUM' THEN 'OTA' WHEN '4-NOT SPECIFIED' THEN 'Travel Agent' ELSE 'Web' END AS src,
    c.c_mktsegment AS acct, CAST((o.o_orderkey * 7919) % 91 AS INT) AS lead,
    CAST(COALESCE(li.n_lines, 1) AS INT) AS nights,
    COALESCE(p.p_type, 'STANDARD') AS ptype,
    CAST(ROUND(COALESCE(p.p_retailprice, 1000.0) * 100) AS BIGINT) AS pc,
    (o.o_orderkey * 104729) % 1000 AS u, (o.o_orderkey * 1299709) % 997 AS h
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = li.p_key),
s1 AS (
  SELECT base.*, CAST(FLOOR(pc * (90 + h % 31) / 100) AS BIGINT) AS cc,
    CASE WHEN src IN ('Corporate','Direct / Front Desk') OR h % 100 >= 62 THEN 'Pay at Hotel' ELSE 'Prepaid' END AS pay,
    CASE WHEN src IN ('OTA','Web') THEN CAST(150 + h % 51 AS INT) ELSE 0 END AS comm10,
    CASE WHEN u < 60 + 5*lead + CASE WHEN src IN ('OTA','Web') THEN 150 ELSE 0 END THEN 1 ELSE 0 END AS x
  FROM base),
s2 AS (SELECT s1.*, CASE WHEN x = 1 THEN 0 ELSE pc * nights END AS lodg FROM s1),
s3 AS (SELECT s2.*, CAST(ROUND(lodg * 12 / 100) AS BIGINT) AS tax FROM s2),
s4 AS (SELECT s3.*, lodg + tax AS tot, CAST(ROUND((lodg + tax) * (1000 - comm10) / 1000) AS BIGINT) AS net FROM s3),
bookings AS (
  SELECT 'Test Inn' AS hotel, CONCAT('R', CAST(100000 + k AS VARCHAR(20))) AS reservation_id,
    ci - lead AS booking_date, ci AS check_in_date, ci + GREATEST(CASE WHEN x = 1 THEN 0 ELSE nights END, 1) AS check_out_date,
    src AS booking_source,
    CASE WHEN src IN ('OTA','Web') THEN 'Online Leisure' WHEN src = 'Travel Agent' THEN 'Group / Agent' WHEN src = 'Corporate' THEN 'Corporate' ELSE 'Direct' END AS market_segment,
    CASE WHEN src IN ('Corporate','OTA') THEN acct END AS corporate_name, lead AS lead_time_days, g AS primary_guest_name,
    CAST(1 + h % 3 AS INT) AS n_adults, CAST((h % 7) % 3 AS INT) AS n_children,
    CONCAT(CAST(1 + h % 3 AS VARCHAR(9)), '(A) ', CAST((h % 7) % 3 AS VARCHAR(9)), '(C)') AS pax,
    CAST(COALESCE(SUM(x) OVER w, 0) AS INT) AS previous_cancellations, CAST(COALESCE(SUM(1 - x) OVER w, 0) AS INT) AS previous_successful_bookings,
    CAST(h % 6 AS INT) AS n_special_requests,
    CASE h % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'Early Check-In' WHEN 2 THEN 'Late Check-Out' WHEN 3 THEN 'High Floor' WHEN 4 THEN 'Extra Bed' ELSE 'Quiet Room' END AS special_request_detail,
    CAST(201 + h % 14 AS INT) AS room_no,
    CASE WHEN ptype IN ('PROMO','LARGE') AND h % 17 <> 0 THEN 'Mahogany (Premium)' ELSE 'Maple (Deluxe)' END AS room_type_reserved,
    CASE WHEN ptype IN ('PROMO','LARGE') THEN 'Mahogany (Premium)' ELSE 'Maple (Deluxe)' END AS room_type_assigned,
    CASE WHEN h % 17 = 0 THEN 1 ELSE 0 END AS got_room_upgrade,
    CASE h % 4 WHEN 0 THEN 'Breakfast Included' WHEN 1 THEN 'No Meal' WHEN 2 THEN 'Half Board' ELSE 'Full Board' END AS meal_plan,
    nights AS nights_booked, CASE WHEN x = 1 THEN 0 ELSE nights END AS stayed_room_nights,
    CAST(pc AS DOUBLE)/100 AS avg_price_per_room, CAST(cc AS DOUBLE)/100 AS competitor_avg_rate,
    ROUND(CAST(pc - cc AS DOUBLE) / cc * 100, 2) AS rate_premium_pct, pay AS payment_mode, CAST(comm10 AS DOUBLE)/10 AS ota_commission_pct,
    CAST(lodg AS DOUBLE)/100 AS total_lodging_amount, CAST(tax AS DOUBLE)/100 AS total_lodging_taxes, CAST(tot AS DOUBLE)/100 AS total_amount, CAST(net AS DOUBLE)/100 AS net_revenue,
    CASE WHEN src IN ('Corporate','Direct / Front Desk') THEN CAST(tot AS DOUBLE)/100 ELSE CAST(0 AS DOUBLE) END AS paid_at_hotel_amount,
    CASE WHEN src IN ('Corporate','Direct / Front Desk') THEN CAST(0 AS DOUBLE) ELSE CAST(tot AS DOUBLE)/100 END AS paid_to_ota_amount,
    x AS is_cancelled, CASE WHEN x = 1 THEN CAST(FLOOR(lead * (h % 101) / 100) AS INT) ELSE -1 END AS cancel_days_before_arrival
  FROM s4 WINDOW w AS (PARTITION BY g ORDER BY ci, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
