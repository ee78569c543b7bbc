"""Hand-made frames for the cases where two conventions differ."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roomledger.functions import dates, labels
from roomledger.functions.exact import mean_money, ratio
from roomledger.operators import bookings as b
from roomledger.operators import evaluation, features, forecasting, guests, policy, quality, stats
from roomledger.sources import readers


def _leads(spark):
    leads = [0, 1, 7, 8, 14, 15, 30, 31, 60, 61, 1000, None]
    return spark.createDataFrame([(x, 1) for x in leads], "lead_time_days int, is_cancelled int")


def test_closed_buckets_keep_zero_and_null(spark):
    got = {r.lead_time_bucket: r.bookings for r in b.lead_buckets(_leads(spark)).collect()}
    assert got == {"0-7 days": 3, "8-14 days": 2, "15-30 days": 2, "31-60 days": 2, "60+ days": 3}


def test_cut_buckets_drop_zero_over_999_and_null(spark):
    got = [r.bookings for r in b.lead_buckets_cut(_leads(spark)).collect()]
    assert got == [2, 2, 2, 2, 1]


@pytest.mark.parametrize(
    "day,sun0,mon0,fri_sat,fri_sun",
    [("2023-03-03", 5, 4, 1, 1), ("2023-03-04", 6, 5, 1, 1), ("2023-03-05", 0, 6, 0, 1), ("2023-03-06", 1, 0, 0, 0)],
)
def test_weekend_conventions(spark, day, sun0, mon0, fri_sat, fri_sun):
    df = spark.createDataFrame([(dt.date.fromisoformat(day),)], "d date")
    row = df.select(
        dates.dow_sunday0("d"), dates.dow_monday0("d"), dates.weekend_fri_sat("d"), dates.weekend_fri_sun("d")
    ).first()
    assert tuple(row) == (sun0, mon0, fri_sat, fri_sun)


def test_days_in_leap_february(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 3),), (dt.date(2023, 2, 3),)], "d date")
    assert [r[0] for r in df.select(dates.days_in_month("d")).collect()] == [29, 28]


def test_rounding_is_exact_and_guards_zero(spark):
    df = spark.createDataFrame([(100.01,), (100.02,)], "x double")
    row = df.agg(mean_money("x"), mean_money("x", half_even=True)).first()
    assert tuple(row) == (100.02, 100.02)
    df = spark.createDataFrame([(100.01,), (100.00,)], "x double")
    row = df.agg(mean_money("x"), mean_money("x", half_even=True)).first()
    assert tuple(row) == (100.01, 100.0)
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0), 2)).first()[0] is None


def test_pax_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([("2(A) 1(C)",), ("nonsense",)], "pax string")
    rows = df.select(labels.pax_adults(), labels.pax_children()).collect()
    assert [tuple(r) for r in rows] == [(2, 1), (None, None)]


def test_suspicious_payouts(spark):
    df = spark.createDataFrame(
        [("OTA", "a", 10.0, -1000.0), ("OTA", "b", 10.0, -1000.01)],
        "booking_source string, corporate_name string, total_amount double, paid_to_ota_amount double",
    )
    assert [r.corporate_name for r in quality.suspicious_payouts(df).collect()] == ["b"]


def test_blank_corporate_names_are_left_out(spark):
    df = spark.createDataFrame(
        [("x", 5.0), ("", 7.0), (None, 9.0), ("x", 1.5)], "corporate_name string, total_lodging_amount double"
    )
    assert [tuple(r) for r in b.corporate_top(df).collect()] == [("x", 6.5, 2)]


def test_elasticity_needs_100_rows(spark):
    def source(name, n):
        return [(name, 100.0 + i % 7, 100.0, 1 + i % 3) for i in range(n)]

    df = spark.createDataFrame(
        source("few", 99) + source("enough", 100),
        "booking_source string, avg_price_per_room double, competitor_avg_rate double, nights_booked int",
    )
    assert [r.booking_source for r in stats.log_log_slope(df).collect()] == ["enough"]


def test_equal_recency_edges_raise(spark):
    df = spark.createDataFrame([(3,), (3,), (3,), (4,)], "recency_days int")
    with pytest.raises(Exception, match="not unique"):
        guests.recency_score(df).collect()


def test_history_counts_only_earlier_bookings(spark):
    day = dt.date(2020, 1, 1)
    rows = [("g", day + dt.timedelta(days=i), f"R{i}", x) for i, x in enumerate([1, 0, 0, 1])]
    rows += [("g", day, "R0a", 1), ("h", day, "R9", 0)]
    df = spark.createDataFrame(
        rows, "primary_guest_name string, check_in_date date, reservation_id string, is_cancelled int"
    )
    got = {r.reservation_id: (r.previous_cancellations, r.previous_successful_bookings) for r in guests.guest_history(df).collect()}
    assert got == {"R0": (0, 0), "R0a": (1, 0), "R1": (2, 0), "R2": (2, 1), "R3": (2, 2), "R9": (0, 0)}


def test_guest_with_only_cancellations_has_no_rfm_row(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame(
        [("a", day, "R1", 0.0, 0, 1, 1), ("b", day, "R2", 5.0, 2, 0, 0), ("b", day, "R3", 0.0, 0, 2, 1)],
        "primary_guest_name string, check_in_date date, reservation_id string, total_amount double,"
        "stayed_room_nights int, n_special_requests int, is_cancelled int",
    )
    one = guests.rfm_table(df).orderBy("primary_guest_name").collect()
    two = guests.with_cancel_history(guests.rfm_base(df), df).collect()
    assert [r.primary_guest_name for r in one] == ["b"]
    assert one[0].asDict() == two[0].asDict()
    assert one[0].cancel_rate == 0.5


def test_auc_with_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert evaluation.auc(df).first()[0] == pytest.approx(0.875)
    assert evaluation.auc(df.filter("label = 1")).first()[0] is None


def test_auc_by_group_matches_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"m{i % 2}", int(rng.integers(0, 2)), float(rng.integers(0, 9)) / 9) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    got = {r.model: r.auc for r in evaluation.auc(df, by=["model"]).collect()}
    for m in ("m0", "m1"):
        pos = [s for k, y, s in rows if k == m and y]
        neg = [s for k, y, s in rows if k == m and not y]
        want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
        assert got[m] == pytest.approx(want)


def test_sweep_without_predictions_is_zero(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.1)], "label int, score double")
    rows = evaluation.threshold_sweep(df).collect()
    assert len(rows) == 9
    assert {(r.precision, r.recall, r.f1) for r in rows} == {(0.0, 0.0, 0.0)}
    best = evaluation.best_row(evaluation.threshold_sweep(df), "f1", "threshold").first()
    assert best.threshold == 0.2


def test_lag_is_positional(spark):
    days = [1, 2, 4, 5]  # day 3 is missing
    df = spark.createDataFrame([(dt.date(2020, 1, d), float(d)) for d in days], "ds date, y double")
    got = {r.ds.day: r.y_lag for r in forecasting.lagged(df, 2).collect()}
    assert got == {1: None, 2: None, 4: 1.0, 5: 2.0}


def test_cutoffs_stop_at_the_initial_window(spark):
    start = dt.date(2022, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(days=i), 1.0) for i in range(730)], "ds date, y double")
    got = sorted(r.cutoff for r in forecasting.cutoffs(df).collect())
    last = start + dt.timedelta(days=729)
    assert got == [last - dt.timedelta(days=90 + 90 * i) for i in (2, 1, 0)]
    short = df.limit(1)
    assert forecasting.cutoffs(short).count() == 0


def test_overbooking_law(spark):
    df = spark.createDataFrame([(1, 10.0), (0, 10.0), (0, 10.0)], "is_cancelled int, avg_price_per_room double")
    rows = {r.overbook_by: r for r in policy.overbooking(df).collect()}
    assert rows[0].walkout_prob == 0.0 and rows[0].mean_arrivals == round(14 * 2 / 3, 2)
    assert rows[6].mean_arrivals == round(20 * 2 / 3, 2)
    assert all(rows[i].walkout_prob <= rows[i + 1].walkout_prob for i in range(6))
    nobody = df.withColumn("is_cancelled", F.lit(0))
    best = policy.best_level(policy.overbooking(nobody)).first()
    assert best.optimal_overbook == 0 and best.optimal_walkout_prob == 0.0


def test_best_level_falls_back_to_zero(spark):
    table = spark.createDataFrame(
        [(0, 0.5, 10.0), (1, 0.6, 99.0)], "overbook_by int, walkout_prob double, expected_net_rev double"
    )
    assert policy.best_level(table).first().optimal_overbook == 0


def test_survival_reaches_zero(spark):
    df = spark.createDataFrame(
        [(10, 1, 10), (10, 0, -1), (20, 1, 0)],
        "lead_time_days int, is_cancelled int, cancel_days_before_arrival int",
    )
    rows = policy.survival_curve(df).orderBy("day").collect()
    assert [(r.day, r.events, r.at_risk) for r in rows] == [(0, 1, 3), (10, 0, 2), (20, 1, 1)]
    assert [r.survival for r in rows] == pytest.approx([2 / 3, 2 / 3, 0.0])


def test_leakage_guard_names():
    assert features.leaked(["lead_time_days", "Total_Amount", "net_revenue"]) == ["Total_Amount", "net_revenue"]


def test_missing_columns_and_missing_files(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "reservation_id int")
    assert "booking_source" in quality.missing_columns(df)
    with pytest.raises(FileNotFoundError):
        readers.read_many_csv(spark, str(tmp_path), ["May.csv"])
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "none.csv")).count()


def test_csv_union_fills_missing_columns(spark, tmp_path):
    (tmp_path / "May.csv").write_text("reservation_id,booking_source,lead_time_days\nR1,OTA,3\n")
    (tmp_path / "June.csv").write_text("lead_time_days,reservation_id\n9,R2\n")
    got = readers.read_many_csv(spark, str(tmp_path), ["May.csv", "June.csv", "July.csv"])
    rows = {r.reservation_id: (r.booking_source, r.lead_time_days, r.source_file) for r in got.collect()}
    assert rows == {"R1": ("OTA", 3, "May.csv"), "R2": (None, 9, "June.csv")}


def test_header_spelling(spark):
    df = spark.createDataFrame([(1, 2)], "`Booking.Source` int, `Room.No.` int")
    assert readers.snake_case(df).columns == ["booking_source", "room_no"]


def test_ratios_of_large_sums(spark):
    from roomledger.functions.exact import product, wide_ratio

    row = spark.sql("SELECT 1000000000000000L AS c, 1000000000L AS n")
    share = wide_ratio(product(F.col("c"), F.col("n")), product(F.col("c"), F.col("n") * 3), 4)
    assert row.select(share.alias("x")).first()[0] == 0.3333


def test_overbooking_beyond_twenty_rooms(spark):
    from math import comb

    from roomledger.operators import policy

    rows = [(1 if i < 5 else 0, 100.0, "2024-04-01") for i in range(100)]
    df = spark.createDataFrame(rows, "is_cancelled int, avg_price_per_room double, check_in_date string").withColumn(
        "check_in_date", F.to_date("check_in_date")
    )
    want = round(sum(comb(32, k) * 0.95**k * 0.05 ** (32 - k) for k in (31, 32)), 4)
    level = policy.overbooking(df, rooms=30, levels=3).filter("overbook_by = 2").first()
    assert level["walkout_prob"] == want
    assert policy.overbooking_by_season(df, level=2, rooms=30).first()["walkout_prob_at_2"] == want
