"""Readers with fixed schemas; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.sources.schema import BOOKINGS


def read_csv(spark: SparkSession, path: str, schema: T.StructType = BOOKINGS) -> DataFrame:
    """CSV with a header row; fails at once when the path does not exist."""
    return (
        spark.read.schema(schema)
        .option("enforceSchema", "false")
        .option("mode", "FAILFAST")
        .csv(path, header=True)
    )


def read_table(spark: SparkSession, name: str = "bookings") -> DataFrame:
    return spark.table(name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "bookings",
    *,
    partition_column: str = "check_in_date",
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table, read in parallel slices of one column.

    Bounds that are not given are asked of the database: one row with the column's least
    and greatest value. Only a table without a value there is read in one piece.
    """
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **(properties or {})}
    if lower is None or upper is None:
        ends = f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}) ends"
        found = spark.read.format("jdbc").options(**{**options, "dbtable": ends}).load().first()
        lower = lower if lower is not None else found[0] and str(found[0])
        upper = upper if upper is not None else found[1] and str(found[1])
    if lower is not None and upper is not None:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": lower,
            "upperBound": upper,
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def read_many_csv(
    spark: SparkSession, root: str, files: Iterable[str], schema: T.StructType = BOOKINGS
) -> DataFrame:
    """Row-bind CSV files by column name; files that do not exist are skipped.

    Columns a file lacks are NULL. ``source_file`` keeps the file's name.
    """
    frames = []
    for name in files:
        try:
            one = spark.read.csv(f"{root}/{name}", header=True)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in one.columns]
        frames.append(one.select(*typed, F.lit(name).alias("source_file")))
    if not frames:
        raise FileNotFoundError(f"none of the files exist under {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def snake_case(df: DataFrame) -> DataFrame:
    """Bring ``Title_Case`` or ``Dotted.Names`` headers to the schema's spelling."""
    return df.toDF(*[c.strip().rstrip(".").replace(".", "_").replace(" ", "_").lower() for c in df.columns])
