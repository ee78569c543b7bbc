"""Leakage-safe feature building, splits, scaling and category coding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions import dates
from roomledger.functions.exact import cents
from roomledger.operators import ordered

TARGET = "is_cancelled"

# Rooms in high demand.
HOT_ROOMS = (202, 206, 208, 210, 301, 302, 309)

# Identifiers, free text and columns known only after the outcome.
NOT_FEATURES = (
    "hotel",
    "reservation_id",
    "primary_guest_name",
    "corporate_name",
    "booking_date",
    "check_in_date",
    "check_out_date",
    "pax",
    "special_request_detail",
    "stayed_room_nights",
    "total_amount",
    "total_lodging_amount",
    "total_lodging_taxes",
    "net_revenue",
    "paid_at_hotel_amount",
    "paid_to_ota_amount",
    "cancel_days_before_arrival",
    "room_type_assigned",
)
LEAKS = ("total_amount", "net_revenue", "stayed_room", "cancel_days", "paid_at_hotel", "paid_to_ota", "lodging")

# Categoricals that become dummies.
CANCEL_CATEGORIES = ("booking_source", "market_segment", "room_type_reserved", "meal_plan", "payment_mode")
REVENUE_CATEGORIES = ("booking_source", "market_segment", "room_type_reserved", "meal_plan")
REVENUE_NUMERIC = (
    "nights_booked",
    "n_adults",
    "n_children",
    "n_special_requests",
    "got_room_upgrade",
    "ota_commission_pct",
    "checkin_month",
    "checkin_is_weekend",
    "checkin_quarter",
    "is_hot_room",
)

# Design of the inference models and their reference levels.
LOGIT_NUMERIC = (
    "lead_time_days",
    "n_adults",
    "n_children",
    "n_special_requests",
    "previous_cancellations",
    "previous_successful_bookings",
    "avg_price_per_room",
    "rate_premium_pct",
    "nights_booked",
    "is_weekend",
    "is_peak_month",
    "got_room_upgrade",
)
LOGIT_REFERENCE = {
    "booking_source": "OTA",
    "room_type_reserved": "Maple (Deluxe)",
    "payment_mode": "Prepaid",
    "meal_plan": "Breakfast Included",
}
LOGIT_KEPT_NUMERIC = (
    "lead_time_days",
    "previous_cancellations",
    "previous_successful_bookings",
    "n_special_requests",
    "is_peak_month",
)
LOGIT_KEPT_LEVELS = {
    "booking_source": ("Corporate", "Direct / Front Desk", "Travel Agent", "Web"),
    "payment_mode": ("Pay at Hotel",),
    "meal_plan": ("No Meal",),
}

# Columns known before the stay, and parts of names that give the outcome away.
SIGNALS = (
    "reservation_id",
    "lead_time_days",
    "n_special_requests",
    "previous_cancellations",
    "previous_successful_bookings",
    "n_adults",
    "n_children",
    "booking_source",
    "market_segment",
    "room_type_reserved",
    "meal_plan",
    "payment_mode",
    "avg_price_per_room",
    "rate_premium_pct",
    "nights_booked",
    "got_room_upgrade",
)

MAX_LEVELS = 1000


def prebooking_signals(df: DataFrame) -> DataFrame:
    day = "check_in_date"
    return df.select(
        *SIGNALS,
        F.month(day).alias("checkin_month"),
        dates.dow_sunday0(day).alias("checkin_dow"),
        dates.weekend_fri_sat(day).alias("is_weekend"),
        dates.peak_month(day).alias("is_peak_month"),
        TARGET,
    )


def without_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*NOT_FEATURES)


def leaked(names: Sequence[str]) -> list[str]:
    """Feature names that carry the outcome."""
    return [n for n in names if any(part in n.lower() for part in LEAKS)]


def stayed_flag(amount: str = "total_amount") -> Column:
    return F.when(F.col(amount) == 0, 0).otherwise(1)


def history_ratio() -> Column:
    gone, kept = F.col("previous_cancellations"), F.col("previous_successful_bookings")
    return gone.cast("double") / (gone + kept + 1)


def premium_pct(price: str = "avg_price_per_room", rival: str = "competitor_avg_rate") -> Column:
    return F.round((cents(price) - cents(rival)).cast("double") / F.nullif(cents(rival), F.lit(0)) * 100, 2)


def with_dates(df: DataFrame, day: str = "check_in_date") -> DataFrame:
    return df.withColumns(
        {
            "checkin_month": F.month(day),
            "checkin_dow": dates.dow_monday0(day),
            "checkin_is_weekend": dates.weekend_fri_sun(day),
            "checkin_quarter": F.quarter(day),
        }
    )


def with_hot_room(df: DataFrame) -> DataFrame:
    return df.withColumn("is_hot_room", F.col("room_no").isin(*HOT_ROOMS).cast("int"))


def with_derived(df: DataFrame) -> DataFrame:
    lead = F.col("lead_time_days")
    return with_hot_room(df).withColumns(
        {
            "has_children": (F.col("n_children") > 0).cast("int"),
            "is_overpriced": (F.col("rate_premium_pct") > 10).cast("int"),
            "cancellation_history_ratio": history_ratio(),
            "lead_time_sq": lead * lead,
            "high_lead": (lead > 30).cast("int"),
        }
    )


# --- categories --------------------------------------------------------------


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct levels per category, read in one pass.

    Only domain-like columns may be coded; the aggregate keeps at most
    ``MAX_LEVELS + 1`` levels per column and too many of them is an error.
    """
    long = df.select(F.inline(F.array(*[_named(c) for c in columns])))
    distinct = long.filter("level IS NOT NULL").distinct().limit(MAX_LEVELS * len(columns) + 1)
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in distinct.collect():
        found[row["name"]].append(row["level"])
    for name, values in found.items():
        if len(values) > MAX_LEVELS:
            raise ValueError(f"{name} has more than {MAX_LEVELS} levels")
    return {name: sorted(values) for name, values in found.items()}


def _named(column: str) -> Column:
    return F.struct(F.lit(column).alias("name"), F.col(column).cast("string").alias("level"))


def drop_first(found: dict[str, list[str]]) -> dict[str, list[str]]:
    return {c: values[1:] for c, values in found.items()}


def drop_reference(found: dict[str, list[str]], reference: dict[str, str]) -> dict[str, list[str]]:
    return {c: [v for v in values if v != reference.get(c)] for c, values in found.items()}


def dummies(kept: dict[str, Sequence[str]]) -> list[Column]:
    """0/1 columns named ``<column>_<level>``; NULL counts as no level."""
    return [
        F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)).alias(f"{c}_{level}")
        for c, values in kept.items()
        for level in values
    ]


def category_index(df: DataFrame, column: str) -> DataFrame:
    """Codes 0, 1, ... in alphabetical order of the levels; null has none.

    The levels, at most ``MAX_LEVELS``, become part of the expression: no row moves.
    """
    names = levels(df, [column])[column]
    place = F.array_position(F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.col(column).cast("string"))
    return df.withColumn(f"{column}_index", (place - 1).cast("int"))


# --- matrices ----------------------------------------------------------------


def cancellation_matrix(
    df: DataFrame, found: dict[str, list[str]] | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """All usable features with dummies (first level dropped), and their names."""
    full = with_derived(with_dates(df))
    kinds = drop_first(found or levels(df, CANCEL_CATEGORIES))
    skip = {*NOT_FEATURES, *CANCEL_CATEGORIES, TARGET, *keep}
    numeric = [c for c in full.columns if c not in skip]
    coded = dummies(kinds)
    out = full.select(*keep, *[F.col(c).cast("double").alias(c) for c in numeric], *coded, TARGET)
    names = [c for c in out.columns if c not in {TARGET, *keep}]
    _guard(names)
    return out, names


def revenue_matrix(
    df: DataFrame, found: dict[str, list[str]] | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Honoured bookings with features of the amount, without the nightly rate."""
    kept = df.filter("is_cancelled = 0")
    full = with_hot_room(with_dates(kept))
    kinds = drop_first(found or levels(kept, REVENUE_CATEGORIES))
    numeric = [F.col(c).cast("double").alias(c) for c in REVENUE_NUMERIC]
    out = full.select(*keep, *numeric, *dummies(kinds), "total_amount")
    names = [c for c in out.columns if c not in {"total_amount", *keep}]
    _guard(names)
    return out, names


def _guard(names: Sequence[str]) -> None:
    bad = leaked(names)
    if bad:
        raise ValueError(f"outcome columns among the features: {bad}")


def logit_design(
    df: DataFrame, found: dict[str, list[str]] | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Full inference design: numeric predictors and reference-coded dummies."""
    kinds = drop_reference(found or levels(df, list(LOGIT_REFERENCE)), LOGIT_REFERENCE)
    return _design(df, LOGIT_NUMERIC, kinds, keep)


def logit_kept_design(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The fixed parsimonious design of eleven variables."""
    return _design(df, LOGIT_KEPT_NUMERIC, LOGIT_KEPT_LEVELS, keep)


def _design(df, numeric, kinds, keep):
    day = "check_in_date"
    flagged = df.withColumns({"is_weekend": dates.weekend_fri_sun(day), "is_peak_month": dates.peak_month(day)})
    out = flagged.select(*keep, *[F.col(c).cast("double").alias(c) for c in numeric], *dummies(kinds), TARGET)
    return out, [c for c in out.columns if c not in {TARGET, *keep}]


# --- split and scale ---------------------------------------------------------


def holdout(
    df: DataFrame,
    share: float = 0.25,
    strata: Sequence[str] = (),
    key: str = "reservation_id",
    seed: int = 42,
    name: str = "is_test",
) -> DataFrame:
    """Exact, reproducible hold-out: the lowest hashes of key and seed per stratum."""
    return ordered.lowest_by_hash(df, F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), share, strata, name)


def rest_of(df: DataFrame, taken: DataFrame, key: str = "reservation_id") -> DataFrame:
    """Rows that are not in the other frame."""
    return df.join(taken.select(key), key, "left_anti")


def standardise(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, population: bool = True
) -> DataFrame:
    """Z-scores with mean and sd of ``fit_on``; a constant column becomes 0.

    The statistics are one row, attached by broadcast.
    """
    sd = F.stddev_pop if population else F.stddev_samp
    source = df if fit_on is None else fit_on
    fitted = source.agg(
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[sd(c).alias(f"_s{i}") for i, c in enumerate(columns)],
    )
    joined = df.join(F.broadcast(fitted))
    scaled = {
        c: F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(0.0)
        for i, c in enumerate(columns)
    }
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    test = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(test)
