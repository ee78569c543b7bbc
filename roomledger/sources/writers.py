"""Sinks for reports and extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


MONTH = "check_in_month"
_MODE = "spark.sql.sources.partitionOverwriteMode"


def _by_month(df: DataFrame, pieces: int) -> DataFrame:
    """Rows with their month, each month spread over several tasks: a busy one is not one task's work."""
    spread = df.withColumn(MONTH, F.date_format("check_in_date", "yyyy-MM"))
    return spread.repartition(MONTH, F.pmod(F.xxhash64("reservation_id"), F.lit(pieces)))


def write_bookings(df: DataFrame, path: str, pieces: int = 16) -> None:
    """Parquet by check-in month, so that date filters prune folders."""
    _by_month(df, pieces).write.mode("overwrite").partitionBy(MONTH).parquet(path)


def save_table(df: DataFrame, name: str, path: str | None = None, pieces: int = 16) -> None:
    """A catalog table of bookings, partitioned by check-in month; an earlier one is replaced.

    Without ``path`` its files are in the warehouse.
    """
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    writer = _by_month(df, pieces).write.mode("overwrite").partitionBy(MONTH)
    (writer.option("path", path) if path else writer).saveAsTable(name, format="parquet")


def replace_months(df: DataFrame, name: str, pieces: int = 16) -> None:
    """Puts these rows in place of the months they belong to; other months stay as they are."""
    conf = df.sparkSession.conf
    rows = _by_month(df, pieces).select(*df.sparkSession.table(name).columns)
    # An insert into a catalog table takes the mode from the session alone.
    before = conf.get(_MODE)
    conf.set(_MODE, "dynamic")
    try:
        rows.write.insertInto(name, overwrite=True)
    finally:
        conf.set(_MODE, before)


def write_sample(df: DataFrame, path: str, n: int = 50, key: str = "reservation_id") -> None:
    """The first ``n`` rows by key as one CSV file."""
    sample_rows(df, n, key).coalesce(1).write.mode("overwrite").csv(path, header=True)


def sample_rows(df: DataFrame, n: int = 50, key: str = "reservation_id") -> DataFrame:
    """First ``n`` rows by key, for a sample file."""
    return df.orderBy(key).limit(n)
