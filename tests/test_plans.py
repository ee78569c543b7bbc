"""Shape of the plans: pushdown, pruning, no Python, no pair joins over rows."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from roomledger.operators import models, neighbours
from roomledger.sources.testdata import load_bookings

PLANS = contract.queries()
REPORTS = [
    "q02_cancel_by_source",
    "q03_lead_buckets",
    "q04_monthly_revenue",
    "q05_source_net_revenue",
    "q06_daily_revpar",
    "q07_rfm_features",
    "q08_room_performance",
    "v_monthly_revpar",
    "v_guest_lifetime_value",
    "agg_kpis",
    "agg_rate_by_dim",
    "agg_deposit_policy",
    "st_threshold_sweep",
    "agg_elasticity",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", REPORTS)
def test_reports_stay_in_the_jvm_and_never_pair_rows(spark, sf, name):
    text = plan_of(PLANS[name](spark, sf))
    assert not re.search(r"EvalPython|InPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", ["q05_source_net_revenue", "agg_kpis", "v_revenue_daily"])
def test_single_partition_steps_come_after_the_aggregate(spark, sf, name):
    lines = plan_of(PLANS[name](spark, sf)).splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert all(any("HashAggregate" in line for line in lines[i:]) for i in single)


def test_only_needed_tables_and_columns_are_read(spark, sf):
    text = plan_of(load_bookings(spark, sf, "booking_source", "is_cancelled"))
    assert "lineitem" not in text and "part.parquet" not in text
    assert "o_orderdate" not in text and "c_name" not in text
    text = plan_of(load_bookings(spark, sf, "booking_source", "nights_booked"))
    assert "lineitem" in text and "part.parquet" not in text


def test_split_does_not_shuffle_the_rows(spark, bookings):
    from roomledger.operators import features

    marked = features.holdout(bookings, strata=["is_cancelled"])
    text = plan_of(marked)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_named_model_queries_exist():
    assert neighbours.MAX_CELLS <= 1000 and models.KNN_K == 15
    assert {"ml_benchmark", "rg_benchmark", "bi_dashboard_bundle"} <= set(PLANS)


def test_named_model_queries_use_full_settings_and_all_models(spark, monkeypatch):
    from roomledger.plans import bundle, learning

    asked = []

    def benchmark(split, names=None, rounds=None):
        asked.append((tuple(names or ()), rounds))
        return (None, {})

    monkeypatch.setattr(models, "classifier_benchmark", benchmark)
    monkeypatch.setattr(models, "regressor_benchmark", benchmark)
    released = []

    class Stored:
        def release(self):
            released.append(self)

    monkeypatch.setattr(learning, "cancellation_split", lambda spark, path: Stored())
    monkeypatch.setattr(learning, "revenue_split", lambda spark, path: Stored())
    names = ("ml_rf", "ml_gbt", "ml_gbt_leafy", "ml_gbt_sub", "rg_rf", "rg_gbt_leafy", "rg_gbt_sub", "ml_benchmark", "rg_benchmark")
    for name in names:
        PLANS[name](spark, "")
    assert len(asked) == len(names) == len(released) and all(rounds is None for _, rounds in asked)
    assert asked[-2:] == [((), None), ((), None)]
    monkeypatch.setattr(learning, "load", lambda spark, path: None)
    monkeypatch.setattr(bundle, "dashboard", lambda df, snapshot, classifiers=None, regressors=None: (classifiers, regressors))
    assert PLANS["bi_dashboard_bundle"](spark, "") == (None, None)
