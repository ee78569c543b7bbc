"""Descriptive statistics in a bounded number of passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions import labels
from roomledger.functions.exact import no_negative_zero
from roomledger.operators import ordered
from roomledger.session import checkpoint_dir


def correlation(df: DataFrame, columns: Sequence[str], scale: int | None = 3) -> DataFrame:
    """Pearson matrix in long form over rows complete in every column.

    Only the upper triangle is computed, all pairs in a single aggregate.
    """
    clean = df.na.drop(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = clean.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    triples = []
    for i, (a, b) in enumerate(pairs):
        triples += [(a, b, F.col(f"c{i}")), (b, a, F.col(f"c{i}"))]
    triples += [(a, a, F.lit(1.0)) for a in columns]
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("r")) for a, b, v in triples]
    )
    long = row.select(F.inline(cells))
    value = F.col("r") if scale is None else no_negative_zero(F.round("r", scale))
    return long.select("a", "b", value.alias("r"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sd, min, quartiles and max per column, one row per column."""
    # Explode once instead of scanning per column.
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    # One scan: equal values are merged, and all figures come from the stored counts.
    checkpoint_dir(df.sparkSession)
    counts = ordered.value_counts(df.select(F.inline(cells)), "value", ["column_name"]).checkpoint()
    quart = ordered.quantiles(counts, "value", (0.25, 0.5, 0.75), ["column_name"], weight="_n")
    n = F.sum("_n")
    moments = counts.groupBy("column_name").agg(
        n.alias("count"),
        (F.sum(F.col("value") * F.col("_n")) / n).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    # A row per column, whatever the rows of the table.
    off = F.col("value") - F.col("mean")
    spread = counts.join(F.broadcast(moments.select("column_name", "mean")), "column_name").groupBy("column_name").agg(
        F.sqrt(F.try_divide(F.sum(off * off * F.col("_n")), n - 1)).alias("std")
    )
    moments = moments.join(spread, "column_name")
    return moments.join(quart, "column_name").select(
        "column_name",
        "count",
        F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"),
        "min",
        F.round("q0", 4).alias("p25"),
        F.round("q1", 4).alias("p50"),
        F.round("q2", 4).alias("p75"),
        "max",
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram from min to max; the maximum falls in the last bin."""
    rows = df.filter(F.col(value).isNotNull())
    span = rows.agg(
        F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.floor(F.try_divide(F.col(value) - F.col("_lo"), width))
    placed = rows.join(F.broadcast(span)).select(
        F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), "_lo", "_hi"
    )
    return (
        placed.groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        .select("bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"), "n")
    )


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Five-number summary per key and the rows beyond 1.5 IQR from the box."""
    # One scan: figures and outliers come from the stored counts of distinct values.
    checkpoint_dir(df.sparkSession)
    counts = ordered.value_counts(df, value, [key]).checkpoint()
    quart = ordered.quantiles(counts, value, (0.25, 0.5, 0.75), [key], weight="_n")
    ends = counts.groupBy(key).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    # Both sides have one row per key.
    box = quart.join(ends, key)
    reach = (F.col("q2") - F.col("q0")) * 1.5
    rows = counts.join(box.select(key, (F.col("q0") - reach).alias("_lo"), (F.col("q2") + reach).alias("_hi")), key)
    far = (F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))
    outside = rows.groupBy(key).agg(F.sum(F.when(far, F.col("_n")).otherwise(0)).alias("outliers"))
    return box.join(outside, key).select(
        key,
        "min",
        F.round("q0", 4).alias("q1"),
        F.round("q1", 4).alias("median"),
        F.round("q2", 4).alias("q3"),
        "max",
        "outliers",
    )


def above_median(df: DataFrame, value: str, name: str = "tier", high="High", low="Low") -> DataFrame:
    """Label rows by a strict comparison with the median (one broadcast row)."""
    median = ordered.quantiles(df, value, (0.5,)).select(F.col("q0").alias("_median"))
    label = F.when(F.col(value) > F.col("_median"), high).otherwise(low)
    return df.join(F.broadcast(median)).withColumn(name, label).drop("_median")


def log_log_slope(
    df: DataFrame,
    key: str = "booking_source",
    price: str = "avg_price_per_room",
    rival: str = "competitor_avg_rate",
    quantity: str = "nights_booked",
    min_rows: int = 100,
) -> DataFrame:
    """Per key the slope and R² of ln(quantity) on ln(price / rival)."""
    rows = df.filter(F.col(price) > 0).select(
        key,
        F.ln(F.col(price) / F.greatest(F.col(rival), F.lit(1.0))).alias("x"),
        F.ln(F.greatest(F.col(quantity), F.lit(1)).cast("double")).alias("y"),
    )
    fitted = rows.groupBy(key).agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_r2("y", "x").alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )
    return fitted.filter(F.col("n") >= min_rows).select(
        key,
        no_negative_zero(F.round("slope", 3)).alias("elasticity"),
        F.round("r2", 4).alias("r2"),
        "n",
        labels.elasticity_label(F.col("slope")).alias("interpretation"),
    )
