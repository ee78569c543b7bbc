"""The bookings fact table: 37 columns, one row per reservation."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _DOUBLE, _DATE = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()

BOOKINGS = T.StructType(
    [
        T.StructField("hotel", _STRING),
        T.StructField("reservation_id", _STRING, False),
        T.StructField("booking_date", _DATE),
        T.StructField("check_in_date", _DATE, False),
        T.StructField("check_out_date", _DATE),
        T.StructField("booking_source", _STRING),
        T.StructField("market_segment", _STRING),
        T.StructField("corporate_name", _STRING),
        T.StructField("lead_time_days", _INT),
        T.StructField("primary_guest_name", _STRING),
        T.StructField("n_adults", _INT),
        T.StructField("n_children", _INT),
        T.StructField("pax", _STRING),
        T.StructField("previous_cancellations", _INT),
        T.StructField("previous_successful_bookings", _INT),
        T.StructField("n_special_requests", _INT),
        T.StructField("special_request_detail", _STRING),
        T.StructField("room_no", _INT),
        T.StructField("room_type_reserved", _STRING),
        T.StructField("room_type_assigned", _STRING),
        T.StructField("got_room_upgrade", _INT),
        T.StructField("meal_plan", _STRING),
        T.StructField("nights_booked", _INT),
        T.StructField("stayed_room_nights", _INT),
        T.StructField("avg_price_per_room", _DOUBLE),
        T.StructField("competitor_avg_rate", _DOUBLE),
        T.StructField("rate_premium_pct", _DOUBLE),
        T.StructField("payment_mode", _STRING),
        T.StructField("ota_commission_pct", _DOUBLE),
        T.StructField("total_lodging_amount", _DOUBLE),
        T.StructField("total_lodging_taxes", _DOUBLE),
        T.StructField("total_amount", _DOUBLE),
        T.StructField("net_revenue", _DOUBLE),
        T.StructField("paid_at_hotel_amount", _DOUBLE),
        T.StructField("paid_to_ota_amount", _DOUBLE),
        T.StructField("is_cancelled", _INT, False),
        T.StructField("cancel_days_before_arrival", _INT),
    ]
)

COLUMNS = tuple(BOOKINGS.names)

# Columns every analysis relies on.
REQUIRED = (
    "reservation_id",
    "booking_source",
    "market_segment",
    "lead_time_days",
    "previous_cancellations",
    "previous_successful_bookings",
    "n_special_requests",
    "room_type_reserved",
    "meal_plan",
    "avg_price_per_room",
    "competitor_avg_rate",
    "rate_premium_pct",
    "net_revenue",
    "cancel_days_before_arrival",
    "is_cancelled",
)
