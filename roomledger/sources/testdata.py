"""Adapter: orders, customer, lineitem and part -> the bookings fact table.

One booking per order. Only the joins the requested columns need are built:
``orders`` with ``customer`` always, the line aggregate for lengths of stay, and
``part`` for rates and amounts. Join strategy is left to the optimizer, which
broadcasts a side only when its measured size is below the threshold and
otherwise shuffles, with adaptive splitting of skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.operators.guests import guest_history
from roomledger.sources.schema import COLUMNS

HISTORY = frozenset({"previous_cancellations", "previous_successful_bookings"})
FROM_PART = frozenset(
    {
        "room_type_reserved",
        "room_type_assigned",
        "avg_price_per_room",
        "competitor_avg_rate",
        "rate_premium_pct",
        "total_lodging_amount",
        "total_lodging_taxes",
        "total_amount",
        "net_revenue",
        "paid_at_hotel_amount",
        "paid_to_ota_amount",
    }
)
FROM_LINES = FROM_PART | {"nights_booked", "stayed_room_nights", "check_out_date"}

# The columns that are read; a given schema saves reading file footers first.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint",
    "part": "p_partkey bigint, p_type string, p_retailprice double",
}

# How the adapter maps order attributes to booking attributes.
SOURCE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Corporate' WHEN '2-HIGH' THEN 'Direct / Front Desk' "
    "WHEN '3-MEDIUM' THEN 'OTA' WHEN '4-NOT SPECIFIED' THEN 'Travel Agent' ELSE 'Web' END"
)
REQUESTS = "array('None', 'Early Check-In', 'Late Check-Out', 'High Floor', 'Extra Bed', 'Quiet Room')"
MEALS = "array('Breakfast Included', 'No Meal', 'Half Board', 'Full Board')"
DELUXE, PREMIUM = "'Maple (Deluxe)'", "'Mahogany (Premium)'"

# Booking column -> expression over the joined and derived columns. Amounts end in
# whole cents (_c) until they are shown.
EXPRESSIONS = {
    "hotel": "'Test Inn'",
    "reservation_id": "concat('R', cast(100000 + order_key AS string))",
    "booking_date": "date_sub(check_in, lead)",
    "check_in_date": "check_in",
    "check_out_date": "date_add(check_in, greatest(if(cancelled = 1, 0, nights), 1))",
    "booking_source": "source",
    "market_segment": (
        "CASE source WHEN 'OTA' THEN 'Online Leisure' WHEN 'Web' THEN 'Online Leisure' WHEN 'Corporate' THEN 'Corporate' "
        "WHEN 'Travel Agent' THEN 'Group / Agent' ELSE 'Direct' END"
    ),
    "corporate_name": "CASE WHEN source IN ('Corporate', 'OTA') THEN c_mktsegment END",
    "lead_time_days": "lead",
    "primary_guest_name": "c_name",
    "n_adults": "cast(1 + h % 3 AS int)",
    "n_children": "cast((h % 7) % 3 AS int)",
    "pax": "concat(1 + h % 3, '(A) ', (h % 7) % 3, '(C)')",
    "n_special_requests": "cast(h % 6 AS int)",
    "special_request_detail": f"{REQUESTS}[cast(h % 6 AS int)]",
    "room_no": "cast(201 + h % 14 AS int)",
    "room_type_reserved": f"if(coalesce(p_type, '') IN ('PROMO', 'LARGE') AND h % 17 <> 0, {PREMIUM}, {DELUXE})",
    "room_type_assigned": f"if(coalesce(p_type, '') IN ('PROMO', 'LARGE'), {PREMIUM}, {DELUXE})",
    "got_room_upgrade": "if(h % 17 = 0, 1, 0)",
    "meal_plan": f"{MEALS}[cast(h % 4 AS int)]",
    "nights_booked": "nights",
    "stayed_room_nights": "if(cancelled = 1, 0, nights)",
    "avg_price_per_room": "cast(rate_c AS double) / 100",
    "competitor_avg_rate": "cast(rival_c AS double) / 100",
    "rate_premium_pct": "round(cast(rate_c - rival_c AS double) / rival_c * 100, 2)",
    "payment_mode": "if(pays_direct OR h % 100 >= 62, 'Pay at Hotel', 'Prepaid')",
    "ota_commission_pct": "cast(commission10 AS double) / 10",
    "total_lodging_amount": "cast(lodging_c AS double) / 100",
    "total_lodging_taxes": "cast(total_c - lodging_c AS double) / 100",
    "total_amount": "cast(total_c AS double) / 100",
    "net_revenue": "cast(cast(round(total_c * (1000 - commission10) / 1000) AS bigint) AS double) / 100",
    "paid_at_hotel_amount": "if(pays_direct, cast(total_c AS double) / 100, 0.0D)",
    "paid_to_ota_amount": "if(pays_direct, 0.0D, cast(total_c AS double) / 100)",
    "is_cancelled": "cancelled",
    "cancel_days_before_arrival": "if(cancelled = 1, cast(floor(lead * (h % 101) / 100) AS int), -1)",
}


def load_bookings(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Bookings with the given columns (all 37 when none are named)."""
    wanted = list(columns) or list(COLUMNS)
    needed = set(wanted)
    base = _base(spark, path, needed)
    if needed & HISTORY:
        # Four narrow columns of two tables; the wide row is neither sorted nor stored.
        narrow = _base(spark, path, set()).selectExpr(
            "c_name AS _g", "check_in AS _day", "order_key AS _k", "cancelled AS _x"
        )
        past = guest_history(narrow, "_g", ("_day", "_k"), "_x").select("_k", *sorted(needed & HISTORY))
        base = base.join(past, F.col("order_key") == F.col("_k"), "left")
    return base.selectExpr(*[c if c in HISTORY else f"{EXPRESSIONS[c]} AS {c}" for c in wanted])


def _base(spark: SparkSession, path: str, needed: set[str]) -> DataFrame:
    def table(name: str, *exprs: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet").selectExpr(*exprs)

    base = table(
        "orders",
        "o_orderkey AS order_key",
        "o_custkey",
        "cast(o_orderdate AS date) AS check_in",
        f"{SOURCE} AS source",
        "cast((o_orderkey * 7919) % 91 AS int) AS lead",
        "(o_orderkey * 104729) % 1000 AS u",
        "(o_orderkey * 1299709) % 997 AS h",
    )
    customer = table("customer", "c_custkey", "c_name", "c_mktsegment")
    base = base.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    derived = [
        "*",
        "source IN ('Corporate', 'Direct / Front Desk') AS pays_direct",
        "if(source IN ('OTA', 'Web'), cast(150 + h % 51 AS int), 0) AS commission10",
        "if(u < 60 + 5 * lead + if(source IN ('OTA', 'Web'), 150, 0), 1, 0) AS cancelled",
    ]
    if needed & FROM_LINES:
        lines = (
            table("lineitem", "l_orderkey", "l_partkey")
            .groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_partkey").alias("first_part"))
        )
        base = base.join(lines, F.col("order_key") == F.col("l_orderkey"), "left")
        derived.append("cast(coalesce(n_lines, 1) AS int) AS nights")
    if needed & FROM_PART:
        part = table("part", "p_partkey", "p_type", "cast(round(coalesce(p_retailprice, 1000.0D) * 100) AS bigint) AS p_cents")
        base = base.join(part, F.col("first_part") == F.col("p_partkey"), "left")
        # An order without a known part has the default rate.
        derived.append("coalesce(p_cents, 100000) AS rate_c")
    base = base.selectExpr(*derived)
    if needed & FROM_PART:
        base = base.selectExpr(
            "*",
            "cast(floor(rate_c * (90 + h % 31) / 100) AS bigint) AS rival_c",
            "if(cancelled = 1, 0, rate_c * nights) AS lodging_c",
        ).selectExpr("*", "lodging_c + cast(round(lodging_c * 12 / 100) AS bigint) AS total_c")
    return base
