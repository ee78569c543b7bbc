"""The five named views over a bookings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomledger.operators import bookings, guests


def build(df: DataFrame, snapshot: str) -> dict[str, DataFrame]:
    return {
        "v_guest_lifetime_value": guests.lifetime_value(df, snapshot),
        "v_lead_time_risk": bookings.lead_time_risk(df),
        "v_monthly_revpar": bookings.monthly_revpar(df),
        "v_revenue_daily": bookings.revenue_daily(df),
        "v_source_performance": bookings.source_performance(df),
    }


def register(spark: SparkSession, df: DataFrame, snapshot: str) -> list[str]:
    views = build(df, snapshot)
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return list(views)
