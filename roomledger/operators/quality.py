"""Data-quality checks on the bookings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions import labels
from roomledger.functions.exact import cents
from roomledger.sources.schema import REQUIRED


def shape(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Row count, column count and how many required columns are missing."""
    absent = [c for c in required if c not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(len(absent)).alias("n_missing")
    )


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def rules() -> dict[str, Column]:
    """Name -> condition that holds for a row that breaks the rule."""
    col = F.col
    gone, kept = col("is_cancelled") == 1, col("is_cancelled") == 0
    amounts = ["total_lodging_amount", "total_lodging_taxes", "total_amount", "net_revenue"]
    any_money = None
    for name in amounts:
        test = col(name) != 0
        any_money = test if any_money is None else any_money | test
    split = cents("total_amount") - cents("paid_at_hotel_amount") - cents("paid_to_ota_amount")
    net = F.round(cents("total_amount") * (100 - col("ota_commission_pct")) / 100) - cents("net_revenue")
    premium = (
        (cents("avg_price_per_room") - cents("competitor_avg_rate")) * 100
        / F.nullif(cents("competitor_avg_rate"), F.lit(0))
    ) - col("rate_premium_pct")
    segment = labels.lookup(col("booking_source"), labels.SEGMENT_OF_SOURCE)
    return {
        "cancelled_has_revenue": gone & any_money,
        "cancelled_has_nights": gone & (col("stayed_room_nights") != 0),
        "honoured_has_cancel_day": kept & (col("cancel_days_before_arrival") != -1),
        "total_not_lodging_plus_tax": cents("total_lodging_amount") + cents("total_lodging_taxes")
        != cents("total_amount"),
        "tax_not_12_percent": F.abs(
            cents("total_lodging_amount") * 12 - cents("total_lodging_taxes") * 100
        ) > 100,
        "net_not_after_commission": F.abs(net) > 1,
        "payments_do_not_add_up": split != 0,
        "premium_off": F.abs(premium) > 0.01,
        "booking_date_off": F.date_sub("check_in_date", col("lead_time_days")) != col("booking_date"),
        "lead_time_out_of_range": ~col("lead_time_days").between(0, 180),
        "segment_not_of_source": ~col("market_segment").eqNullSafe(segment),
    }


def violations(df: DataFrame) -> DataFrame:
    """One row per rule with the number of rows that break it; one pass over the data."""
    checks = rules()
    counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    return counted.unpivot([], list(checks), "rule", "violations")


def suspicious_payouts(df: DataFrame, floor: float = -1000.0) -> DataFrame:
    return df.filter(F.col("paid_to_ota_amount") < floor).select(
        "booking_source", "corporate_name", "total_amount", "paid_to_ota_amount"
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.unpivot([], names, "column_name", "nulls").filter("nulls > 0")
