"""Booking-grain reports: cancellations, revenue, occupancy, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions import dates, labels
from roomledger.functions.exact import cents, mean_int, mean_money, money, plain_mean, product, ratio, sum_money, wide_ratio

ROOMS = 14  # Fixed value: rooms in the inventory.


def honoured(df: DataFrame) -> DataFrame:
    return df.filter("is_cancelled = 0")


def _share(part: Column, scale: int = 1, half_even: bool = False) -> Column:
    """Percentage of a column's total; only for already aggregated, small results."""
    return wide_ratio(product(part, F.lit(100)), F.sum(part).over(Window.partitionBy()), scale, half_even=half_even)


# --- cancellations -----------------------------------------------------------


def cancellation_by_source(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("booking_source", "market_segment")
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            F.sum("is_cancelled").alias("cancellations"),
            mean_int("is_cancelled", 4).alias("cancellation_rate"),
            mean_int("lead_time_days", 1).alias("avg_lead_time_days"),
        )
        .orderBy(F.desc("cancellation_rate"), "booking_source")
    )


def lead_buckets(df: DataFrame) -> DataFrame:
    """Closed buckets with lead 0 in the first; ordered by their shortest lead time."""
    return (
        df.groupBy(labels.lead_bucket_closed().alias("lead_time_bucket"))
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            F.sum("is_cancelled").alias("cancellations"),
            mean_int("is_cancelled", 4).alias("cancellation_rate"),
            F.min("lead_time_days").alias("_first"),
        )
        .orderBy("_first")
        .drop("_first")
    )


def lead_buckets_cut(
    df: DataFrame, names: tuple[str, ...] = labels.LEAD_NAMES_DASH
) -> DataFrame:
    """Half-open ``(lo, hi]`` buckets; rows outside them are not counted."""
    return (
        df.withColumns({"_slot": labels.lead_bucket_cut_index(), "lead_bucket": labels.lead_bucket_cut(names=names)})
        .filter("_slot IS NOT NULL")
        .groupBy("_slot", "lead_bucket")
        .agg(
            mean_int("is_cancelled", 4, half_even=True).alias("cancellation_rate"),
            F.count(F.lit(1)).alias("bookings"),
        )
        .orderBy("_slot")
        .drop("_slot")
    )


def lead_time_risk(df: DataFrame) -> DataFrame:
    """``revenue_at_risk`` sums amounts that are 0 once cancelled; the booked value is next to it."""
    gone = F.col("is_cancelled") == 1
    value = F.when(gone, cents("avg_price_per_room") * F.col("nights_booked")).otherwise(0)
    return df.groupBy(labels.lead_bucket_closed().alias("lead_bucket")).agg(
        F.count(F.lit(1)).alias("bookings"),
        mean_int("is_cancelled", 4).alias("cancellation_rate"),
        money(F.sum(F.when(gone, cents("total_amount")).otherwise(0))).alias("revenue_at_risk"),
        money(F.sum(value)).alias("booked_value_at_risk"),
    )


def outcome_by_history(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("previous_cancellations")
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            mean_int("is_cancelled", 4).alias("cancellation_rate"),
        )
        .orderBy("previous_cancellations")
    )


def rate_by(
    df: DataFrame, dims: Sequence[str], target: str = "is_cancelled", name: str = "cancellation_rate"
) -> DataFrame:
    """Unrounded mean of a 0/1 target by any dimensions, with group sizes."""
    return df.groupBy(*dims).agg(plain_mean(target).alias(name), F.count(F.lit(1)).alias("bookings"))


def rates_by_each(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``rate_by`` for several single dimensions in one scan (one grouping set each)."""
    sets = [[F.col(d)] for d in dims]
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for d in dims:
        used = F.grouping(d) == 0
        which = F.when(used, d).otherwise(which)
        value = F.when(used, F.col(d).cast("string")).otherwise(value)
    return df.groupingSets(sets, *dims).agg(
        which.alias("dimension"),
        value.alias("level"),
        plain_mean("is_cancelled").alias("cancellation_rate"),
        F.count(F.lit(1)).alias("bookings"),
    ).select("dimension", "level", "cancellation_rate", "bookings")


def global_rates(df: DataFrame, segment: str = "OTA") -> DataFrame:
    mine = F.when(F.col("booking_source") == segment, F.col("is_cancelled"))
    return df.agg(
        plain_mean("is_cancelled").alias("overall_rate"), plain_mean(mine).alias("segment_rate")
    )


# --- revenue -----------------------------------------------------------------


def monthly_revenue(df: DataFrame) -> DataFrame:
    return (
        honoured(df)
        .groupBy(dates.month_start("check_in_date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            sum_money("total_amount").alias("gross_revenue"),
            sum_money("net_revenue").alias("net_revenue_after_commission"),
            mean_money("total_amount").alias("avg_booking_value"),
            mean_money("avg_price_per_room").alias("avg_daily_rate"),
        )
        .orderBy("month")
    )


def source_net_revenue(df: DataFrame) -> DataFrame:
    tenths = F.round(F.col("ota_commission_pct") * 10).cast("long")
    grouped = (
        honoured(df)
        .groupBy("booking_source")
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            F.sum(cents("total_amount")).alias("_gross"),
            F.sum(cents("net_revenue")).alias("_net"),
            ratio(F.sum(tenths), F.count(tenths) * 10, 1).alias("avg_commission_pct"),
        )
    )
    return grouped.select(
        "booking_source",
        "bookings",
        _share(F.col("bookings")).alias("pct_of_bookings"),
        money(F.col("_gross")).alias("gross_revenue"),
        money(F.col("_net")).alias("net_revenue"),
        money(F.col("_gross") - F.col("_net")).alias("commission_paid"),
        _share(F.col("_net")).alias("pct_of_net_revenue"),
        "avg_commission_pct",
    ).orderBy(F.desc("net_revenue"))


def net_per_booking(df: DataFrame) -> DataFrame:
    tenths = F.round(F.col("ota_commission_pct") * 10).cast("long")
    grouped = (
        honoured(df)
        .groupBy("booking_source")
        .agg(
            F.count("reservation_id").alias("bookings"),
            F.sum(cents("total_amount")).alias("_gross"),
            F.sum(cents("net_revenue")).alias("_net"),
            F.try_divide(F.sum(tenths).cast("double"), F.count(tenths) * F.lit(10.0)).alias("avg_commission"),
        )
    )
    each = F.col("bookings") * 100
    return grouped.select(
        "booking_source",
        "bookings",
        money(F.col("_gross")).alias("gross_revenue"),
        money(F.col("_net")).alias("net_revenue"),
        "avg_commission",
        money(F.col("_gross") - F.col("_net")).alias("commission_paid"),
        ratio(F.col("_net"), each, 2, half_even=True).alias("net_per_booking"),
        ratio(F.col("_gross"), each, 2, half_even=True).alias("gross_per_booking"),
    ).orderBy(F.desc("net_revenue"))


def revenue_daily(df: DataFrame) -> DataFrame:
    return (
        honoured(df)
        .groupBy(F.col("check_in_date").alias("ds"))
        .agg(
            sum_money("total_amount").alias("y"),
            sum_money("net_revenue").alias("net_y"),
            F.count(F.lit(1)).alias("bookings"),
            mean_money("avg_price_per_room").alias("adr"),
        )
        .orderBy("ds")
    )


def source_performance(df: DataFrame) -> DataFrame:
    return df.groupBy("booking_source", "market_segment").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.sum("is_cancelled").alias("cancellations"),
        mean_int("is_cancelled", 4).alias("cancellation_rate"),
        sum_money("total_amount").alias("gross_revenue"),
        sum_money("net_revenue").alias("net_revenue"),
        mean_int("lead_time_days", 1).alias("avg_lead_time"),
    )


def source_share(df: DataFrame) -> DataFrame:
    grouped = honoured(df).groupBy("booking_source").agg(F.sum(cents("total_amount")).alias("_rev"))
    return grouped.select(
        "booking_source",
        money(F.col("_rev")).alias("revenue"),
        _share(F.col("_rev"), half_even=True).alias("pct_of_revenue"),
    ).orderBy(F.desc("revenue"))


def source_month_fact(df: DataFrame) -> DataFrame:
    return (
        honoured(df)
        .groupBy("booking_source", dates.month_label("check_in_date").alias("month"))
        .agg(F.count("reservation_id").alias("bookings"), sum_money("total_amount").alias("revenue"))
        .orderBy("booking_source", "month")
    )


def kpis(df: DataFrame) -> DataFrame:
    """One row; the money fields are truncated to whole units."""
    kept = F.when(F.col("is_cancelled") == 0, cents("total_amount"))
    revenue, n = F.sum(kept), F.count(kept)
    return df.agg(
        F.count(F.lit(1)).alias("bookings"),
        mean_int("is_cancelled", 3, half_even=True).alias("cancellation_rate"),
        F.floor(revenue / 100).alias("total_revenue"),
        F.floor(F.try_divide(revenue.cast("double"), n * F.lit(100.0))).alias("avg_booking_value"),
    )


def revenue_by(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Sum, mean and row count; NULL amounts are left out of sum and mean only."""
    value = cents(amount)
    return (
        df.groupBy(key)
        .agg(
            money(F.sum(value)).alias("total_revenue"),
            F.try_divide(F.sum(value).cast("double"), F.count(value) * F.lit(100.0)).alias("mean_revenue"),
            F.count(F.lit(1)).alias("n_bookings"),
        )
        .orderBy(F.desc("total_revenue"))
    )


def corporate_top(df: DataFrame) -> DataFrame:
    name = F.col("corporate_name")
    return (
        df.filter(name.isNotNull() & (name != ""))
        .groupBy("corporate_name")
        .agg(sum_money("total_lodging_amount").alias("revenue"), F.count(F.lit(1)).alias("bookings"))
        .orderBy(F.desc("revenue"))
    )


# --- occupancy ---------------------------------------------------------------


def daily_revpar(df: DataFrame, rooms: int = ROOMS) -> DataFrame:
    price = cents("avg_price_per_room")
    daily = (
        honoured(df)
        .groupBy(F.col("check_in_date").alias("date"))
        .agg(
            F.sum("stayed_room_nights").alias("rooms_sold"),
            F.sum(price).alias("_rate"),
            F.count(price).alias("_n"),
        )
    )
    per_day = F.col("_n") * 100
    return daily.select(
        "date",
        "rooms_sold",
        ratio(F.col("_rate"), per_day, 2).alias("avg_daily_rate"),
        ratio(F.col("rooms_sold"), F.lit(rooms), 4).alias("occupancy_rate"),
        wide_ratio(product(F.col("_rate"), F.col("rooms_sold")), product(per_day, F.lit(rooms)), 2).alias("revpar"),
    ).orderBy("date")


def monthly_revpar(df: DataFrame, rooms: int = ROOMS) -> DataFrame:
    monthly = _monthly_rooms(df, dates.month_start("check_in_date"), rooms)
    per_room = F.col("_n") * 100
    return monthly.select(
        "month",
        ratio(F.col("_rate"), per_room, 2).alias("adr"),
        "rooms_sold",
        "total_capacity",
        ratio(F.col("rooms_sold"), F.col("total_capacity"), 4).alias("occupancy_rate"),
        wide_ratio(product(F.col("_rate"), F.col("rooms_sold")), product(per_room, F.col("total_capacity")), 2).alias("revpar"),
    ).orderBy("month")


def monthly_revpar_clipped(df: DataFrame, rooms: int = ROOMS) -> DataFrame:
    """RevPAR with occupancy limited to [0, 1] before it is multiplied."""
    monthly = _monthly_rooms(df, dates.month_start("check_in_date"), rooms)
    sold = F.least(F.greatest("rooms_sold", F.lit(0)), F.col("total_capacity"))
    per_room = F.col("_n") * 100
    return monthly.select(
        F.date_format("month", "yyyy-MM").alias("month"),
        ratio(F.col("_rate"), per_room, 2, half_even=True).alias("adr"),
        "rooms_sold",
        dates.days_in_month("month").alias("days_in_month"),
        F.col("total_capacity").alias("capacity"),
        ratio(sold, F.col("total_capacity"), 4, half_even=True).alias("occupancy"),
        wide_ratio(product(F.col("_rate"), sold), product(per_room, F.col("total_capacity")), 2, half_even=True).alias("revpar"),
    ).orderBy("month")


def _monthly_rooms(df: DataFrame, month: Column, rooms: int) -> DataFrame:
    price = cents("avg_price_per_room")
    return (
        honoured(df)
        .groupBy(month.alias("month"))
        .agg(
            F.sum("stayed_room_nights").alias("rooms_sold"),
            F.sum(price).alias("_rate"),
            F.count(price).alias("_n"),
        )
        .withColumn("total_capacity", dates.days_in_month("month") * rooms)
    )


def room_performance(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("room_no", "room_type_assigned")
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            F.sum("stayed_room_nights").alias("total_nights"),
            mean_int("is_cancelled", 3).alias("cancellation_rate"),
            mean_money("avg_price_per_room").alias("avg_nightly_rate"),
            sum_money("net_revenue").alias("total_net_revenue"),
        )
        .orderBy(F.desc("total_bookings"), "room_no", "room_type_assigned")
    )


# --- frequencies -------------------------------------------------------------


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def proportions(df: DataFrame, column: str, scale: int | None = None) -> DataFrame:
    """Frequency and percentage per value; the total is taken over the small result."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    pct = (
        F.col("n") / total * 100
        if scale is None
        else ratio(F.col("n") * 100, total, scale, half_even=True)
    )
    return counts.select(column, "n", pct.alias("pct"))


def having_at_least(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
