"""Guest grain: booking history, lifetime value, RFM scores and tiers, Pareto."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions import dates, labels
from roomledger.functions.exact import cents, mean_int, mean_money, money, plain_mean, product, ratio, sum_money, wide_ratio
from roomledger.operators import ordered
from roomledger.session import checkpoint_dir

GUEST = "primary_guest_name"


def guest_history(
    df: DataFrame,
    guest: str = GUEST,
    order_by: Sequence[str] = ("check_in_date", "reservation_id"),
    outcome: str = "is_cancelled",
) -> DataFrame:
    """Prior cancellations and prior successful stays of the guest at each booking."""
    gone = F.col(outcome).cast("long")
    sums = ordered.running_totals(
        df, [F.col(c) for c in order_by], {"_gone": gone, "_kept": 1 - gone}, [guest]
    )
    return sums.withColumns(
        {
            "previous_cancellations": (F.col("_gone") - gone).cast("int"),
            "previous_successful_bookings": (F.col("_kept") - (1 - gone)).cast("int"),
        }
    ).drop("_gone", "_kept")


def rfm_features(df: DataFrame, snapshot: str) -> DataFrame:
    """Recency, frequency and money per guest over all bookings."""
    return (
        df.groupBy(GUEST)
        .agg(
            dates.days_since(snapshot, F.max("check_in_date")).alias("recency_days"),
            F.countDistinct("reservation_id").alias("frequency"),
            sum_money("total_amount").alias("monetary_total"),
            mean_money("total_amount").alias("avg_booking_value"),
            mean_int("is_cancelled", 4).alias("historical_cancel_rate"),
            mean_int("n_special_requests", 2).alias("avg_special_requests"),
        )
        .orderBy(F.desc("monetary_total"), GUEST)
    )


def lifetime_value(df: DataFrame, snapshot: str) -> DataFrame:
    return df.groupBy(GUEST).agg(
        F.countDistinct("reservation_id").alias("total_bookings"),
        sum_money("total_amount").alias("lifetime_revenue"),
        mean_money("total_amount").alias("avg_booking_value"),
        F.max("check_in_date").alias("last_stay_date"),
        dates.days_since(snapshot, F.max("check_in_date")).alias("recency_days"),
        mean_int("is_cancelled", 4).alias("cancel_rate"),
        F.sum("n_special_requests").alias("total_special_requests"),
    )


def guest_value_features(df: DataFrame) -> DataFrame:
    """Clustering input: one row per guest over all bookings."""
    return df.groupBy(GUEST).agg(
        F.count("reservation_id").alias("bookings"),
        sum_money("total_amount").alias("total_revenue"),
        F.try_divide(
            F.sum(cents("total_amount")).cast("double"), F.count("total_amount") * F.lit(100.0)
        ).alias("avg_revenue"),
        plain_mean("is_cancelled").alias("cancel_rate"),
        F.sum("stayed_room_nights").alias("nights"),
    )


def repeat_guests(df: DataFrame) -> DataFrame:
    """How many guests come back, and the share of rows that repeat a guest name."""
    per_guest = df.groupBy(GUEST).agg(F.count(F.lit(1)).alias("n"))
    return per_guest.agg(
        F.count(F.lit(1)).alias("guests"),
        F.count_if(F.col("n") > 1).alias("repeat_guests"),
        ratio(F.sum(F.col("n") - 1), F.sum("n"), 4).alias("repeat_booking_share"),
    )


# --- RFM -----------------------------------------------------------------


def rfm_base(df: DataFrame) -> DataFrame:
    """Honoured stays per guest."""
    return (
        df.filter("is_cancelled = 0")
        .groupBy(GUEST)
        .agg(
            F.max("check_in_date").alias("last_stay"),
            F.count("reservation_id").alias("frequency"),
            sum_money("total_amount").alias("monetary"),
            plain_mean("stayed_room_nights").alias("avg_nights"),
            plain_mean("n_special_requests").alias("n_special_req"),
        )
    )


def with_cancel_history(rfm: DataFrame, df: DataFrame) -> DataFrame:
    """Join the cancel rate over all bookings of the guest."""
    rates = df.groupBy(GUEST).agg(plain_mean("is_cancelled").alias("cancel_rate"))
    return rfm.join(rates, GUEST)


def rfm_table(df: DataFrame) -> DataFrame:
    """``rfm_base`` with the cancel rate, in one pass over the bookings.

    Equal to joining the two aggregates, as guests without an honoured stay drop out.
    """
    kept = F.col("is_cancelled") == 0
    only = lambda c: F.when(kept, F.col(c))
    return (
        df.groupBy(GUEST)
        .agg(
            F.max(only("check_in_date")).alias("last_stay"),
            F.count(only("reservation_id")).alias("frequency"),
            F.count_if(kept).alias("_kept"),
            sum_money(only("total_amount")).alias("monetary"),
            plain_mean(only("stayed_room_nights")).alias("avg_nights"),
            plain_mean(only("n_special_requests")).alias("n_special_req"),
            plain_mean("is_cancelled").alias("cancel_rate"),
        )
        .filter("_kept > 0")
        .drop("_kept")
    )


def recency_score(df: DataFrame, recency: str = "recency_days", buckets: int = 5) -> DataFrame:
    """Quintiles on interpolated edges, best (most recent) = ``buckets``.

    Recency is in whole days, so the value counts are bounded by the calendar; the
    edges are one row. Equal neighbouring edges are an error, as no bucket would
    lie between them.
    """
    counts = df.groupBy(recency).agg(F.count(F.lit(1)).alias("_w"))
    probs = [i / buckets for i in range(buckets + 1)]
    edges = counts.agg(
        F.percentile(recency, F.array(*[F.lit(p) for p in probs]), F.col("_w")).alias("_edges")
    )
    distinct = F.array_distinct("_edges")
    checked = edges.select(
        F.when(F.size(distinct) == buckets + 1, F.col("_edges"))
        .otherwise(F.raise_error(F.lit("quantile edges of recency are not unique")))
        .alias("_edges")
    )
    value = F.col(recency)
    score = F.lit(buckets)
    for i in range(1, buckets):
        score = score - (value > F.col("_edges")[i]).cast("int")
    return df.join(F.broadcast(checked)).withColumn("r", score).drop("_edges")


def rank_scores(df: DataFrame, scores: dict[str, str], buckets: int = 5) -> DataFrame:
    """Quintiles of the first-come rank of each value (value -> score); ties are broken by guest name.

    A rank is beyond the edge of bucket ``b`` if it is above ``1 + b (n - 1) / buckets``; so
    the rows at these ranks are all that is needed, and every row is compared with them.
    """
    def edges(n: int) -> list[int]:
        return [1 + b * (n - 1) // buckets for b in range(1, buckets)]

    _, found = ordered.order_statistics(df, GUEST, dict.fromkeys(scores, edges))
    name = df.schema[GUEST].dataType
    for value, score in scores.items():
        own = F.struct(F.col(value).cast("double").alias("v"), F.col(GUEST).alias("t"))
        above = [(own > F.struct(F.lit(v).alias("v"), F.lit(t).cast(name).alias("t"))).cast("int") for v, t in found[value]]
        df = df.withColumn(score, reduce(lambda a, b: a + b, above, F.lit(1)))
    return df


def rfm_scores(df: DataFrame, snapshot: str) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    base = rfm_table(df).withColumn("recency_days", dates.days_since(snapshot, "last_stay")).checkpoint()
    scored = rank_scores(base, {"frequency": "f", "monetary": "m"})
    return recency_score(scored).withColumn("rfm_score", F.col("r") + F.col("f") + F.col("m"))


def assign_tier(rfm: DataFrame) -> DataFrame:
    return rfm.withColumn("tier", labels.tier())


def tier_profile(rfm: DataFrame) -> DataFrame:
    """Per tier sizes, means and shares; five rows at most, so totals are a tiny window."""
    whole = Window.partitionBy()
    grouped = rfm.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_guests"),
        F.sum(cents("monetary")).alias("_rev"),
        mean_money("monetary", half_even=True).alias("avg_revenue"),
        mean_int("recency_days", 2, half_even=True).alias("avg_recency"),
        mean_int("frequency", 2, half_even=True).alias("avg_frequency"),
        F.bround(F.avg("cancel_rate"), 2).alias("avg_cancel"),
    )
    return (
        grouped.select(
            "tier",
            "n_guests",
            "avg_revenue",
            money(F.col("_rev")).alias("total_revenue"),
            "avg_recency",
            "avg_frequency",
            "avg_cancel",
            wide_ratio(product(F.col("n_guests"), F.lit(100)), F.sum("n_guests").over(whole), 1, half_even=True).alias("pct_guests"),
            wide_ratio(product(F.col("_rev"), F.lit(100)), F.sum("_rev").over(whole), 1, half_even=True).alias("pct_revenue"),
        )
        .withColumn("recommended_action", labels.lookup(F.col("tier"), labels.ACTION_OF_TIER))
        .orderBy(F.desc("avg_revenue"))
    )


# --- revenue concentration -------------------------------------------------


def guest_revenue(df: DataFrame, honoured_only: bool = False) -> DataFrame:
    source = df.filter("is_cancelled = 0") if honoured_only else df
    return source.groupBy(GUEST).agg(
        F.sum(cents("total_amount")).alias("revenue_c"), F.count(F.lit(1)).alias("bookings")
    )


def revenue_centiles(df: DataFrame, buckets: int = 100) -> DataFrame:
    """NTILE of guests by honoured revenue, highest first."""
    ranked = ordered.global_row_number(
        guest_revenue(df, honoured_only=True), [F.desc("revenue_c"), F.col(GUEST)]
    )
    return ranked.select(
        GUEST,
        money(F.col("revenue_c")).alias("lifetime_revenue"),
        "bookings",
        ordered.ntile(F.col("rn"), F.col("n_rows"), buckets).alias("centile"),
    )


def pareto_tiers(df: DataFrame, top: int = 18) -> DataFrame:
    rest = 100 - top
    label = F.when(F.col("centile") <= top, f"Top {top}%").otherwise(f"Bottom {rest}%")
    grouped = revenue_centiles(df).groupBy(label.alias("guest_tier")).agg(
        F.count(F.lit(1)).alias("guests"), F.sum(cents("lifetime_revenue")).alias("_rev")
    )
    share = ratio(F.col("_rev") * 100, F.sum("_rev").over(Window.partitionBy()), 1)
    return grouped.select(
        "guest_tier", "guests", money(F.col("_rev")).alias("revenue"), share.alias("pct_of_total_revenue")
    ).orderBy(F.desc("revenue"))


def cumulative_share(df: DataFrame) -> DataFrame:
    """Pareto curve over all guests: position, cumulative share of guests and revenue."""
    cum = ordered.running_totals(
        guest_revenue(df),
        [F.desc("revenue_c"), F.col(GUEST)],
        {"rn": F.lit(1).cast("long"), "cum": F.col("revenue_c")},
        grand=True,
    )
    return cum.select(
        GUEST,
        money(F.col("revenue_c")).alias("revenue"),
        "rn",
        F.col("rn_total").alias("n_rows"),
        F.try_divide(F.col("cum").cast("double"), F.col("cum_total").cast("double")).alias("cum_share"),
    )


def pareto_points(df: DataFrame, points: int = 100) -> DataFrame:
    """The curve at ``points`` evenly spaced positions, repeated ones kept."""
    curve = cumulative_share(df)
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    span = F.col("n_rows") - 1
    # Evenly spaced floats truncated to positions, with the end point exact.
    spaced = F.floor(F.col("step") * (span / F.lit(float(points - 1))))
    at = F.when(F.col("step") == points - 1, span).otherwise(spaced)
    grid = curve.filter("rn = 1").select("n_rows", steps.alias("step")).select(
        "step", (at + 1).alias("rn")
    )
    return curve.join(F.broadcast(grid), "rn").select(
        "step",
        F.bround(F.col("rn") / F.col("n_rows"), 4).alias("x"),
        F.bround("cum_share", 4).alias("y"),
    )


def top_shares(df: DataFrame, quantiles: Sequence[float] = (0.10, 0.18, 0.20)) -> DataFrame:
    """Revenue share of the top ``int(n * q)`` guests over all guests."""
    ranked = ordered.global_row_number(guest_revenue(df), [F.desc("revenue_c"), F.col(GUEST)])
    total = F.sum("revenue_c")
    cols = [F.max("n_rows").alias("n_guests")]
    for q in quantiles:
        inside = F.col("rn") <= F.floor(F.col("n_rows") * F.lit(q))
        part = F.coalesce(F.sum(F.when(inside, F.col("revenue_c"))), F.lit(0))
        cols.append(ratio(part, total, 4, half_even=True).alias(f"top_{round(q * 100)}pct_revenue_share"))
    return ranked.agg(*cols)


def sample_guests(features: DataFrame, size: int = 4000) -> DataFrame:
    """``size`` guests without replacement, in a reproducible hash order."""
    return features.orderBy(F.md5(GUEST), GUEST).limit(size)
