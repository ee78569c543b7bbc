"""Properties the bookings table and the analyses must have."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.operators import features, guests, policy, quality
from roomledger.sources.schema import BOOKINGS, COLUMNS


def test_width_types_and_required(bookings):
    assert tuple(bookings.columns) == COLUMNS and len(COLUMNS) == 37
    assert [f.dataType for f in bookings.schema] == [f.dataType for f in BOOKINGS]
    assert quality.missing_columns(bookings) == []


def test_no_rule_is_broken(bookings):
    assert {r.rule: r.violations for r in quality.violations(bookings).collect() if r.violations} == {}


def test_rates_are_plausible(bookings):
    overall = bookings.agg(F.avg("is_cancelled")).first()[0]
    assert 0.2 < overall < 0.5
    by = {r[0]: r[1] for r in bookings.groupBy("booking_source").agg(F.avg("is_cancelled")).collect()}
    assert by["OTA"] > by["Direct / Front Desk"]
    long = {r[0]: r[1] for r in bookings.groupBy(F.col("lead_time_days") > 30).agg(F.avg("is_cancelled")).collect()}
    assert long[True] > long[False]


def test_feature_matrices_do_not_leak(bookings):
    cancel, names = features.cancellation_matrix(bookings)
    assert features.leaked(names) == [] and cancel.count() == bookings.count()
    revenue, names = features.revenue_matrix(bookings)
    assert not [n for n in names if "avg_price" in n]
    assert revenue.filter("total_amount <= 0").count() == 0
    assert revenue.count() < bookings.count()


def test_tiers_are_known(bookings):
    tiers = {r[0] for r in guests.assign_tier(guests.rfm_scores(bookings, "2002-01-01")).select("tier").distinct().collect()}
    assert tiers <= {"VIP", "Loyal", "At Risk", "New", "Lapsed"}


def test_optimal_level_in_range(bookings):
    assert 0 <= policy.best_level(policy.overbooking(bookings)).first().optimal_overbook <= 6
