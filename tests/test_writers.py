from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.plans import reporting
from roomledger.sources import readers, writers


def test_bookings_are_written_by_month_and_pruned(spark, bookings, tmp_path):
    target = str(tmp_path / "bookings")
    writers.write_bookings(bookings, target)
    back = spark.read.parquet(target)
    assert back.count() == bookings.count()
    month = back.selectExpr("min(check_in_month)").first()[0]
    one = back.filter(back.check_in_month == month)
    assert "PartitionFilters: [isnotnull(check_in_month" in one._jdf.queryExecution().executedPlan().toString()
    assert 0 < one.count() < back.count()


def test_table_with_one_month_replaced(spark, bookings, tmp_path):
    spark.catalog.dropTempView("bookings")
    writers.save_table(bookings, "kept_bookings", str(tmp_path / "table"))
    month = spark.table("kept_bookings").selectExpr(f"max({writers.MONTH})").first()[0]
    changed = bookings.filter(F.date_format("check_in_date", "yyyy-MM") == month).withColumn("lead_time_days", F.lit(-5))
    writers.replace_months(changed, "kept_bookings")
    table = readers.read_table(spark, "kept_bookings")
    assert table.count() == bookings.count()
    assert table.filter(F.col(writers.MONTH) == month).select("lead_time_days").distinct().collect() == [(-5,)]
    assert table.filter("lead_time_days = -5").count() == changed.count() > 0
    one = table.filter(F.col(writers.MONTH) == month)
    assert f"PartitionFilters: [isnotnull({writers.MONTH}" in one._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE kept_bookings")


def test_named_month_files_only(spark, sf):
    got = reporting.monthly_files(spark, sf, ("March", "Absent", "July"))
    assert {r.source_month for r in got.select("source_month").distinct().collect()} == {"March", "July"}


def test_sample_is_one_file(spark, bookings, tmp_path):
    writers.write_sample(bookings, str(tmp_path / "sample"), 7)
    assert len(list((tmp_path / "sample").glob("*.csv"))) == 1
    want = [r.reservation_id for r in bookings.orderBy("reservation_id").limit(7).collect()]
    assert sorted(r.reservation_id for r in readers.read_csv(spark, str(tmp_path / "sample")).collect()) == want
