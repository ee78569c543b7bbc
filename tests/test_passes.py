"""Fits read their bookings once, and keep per-row work in arrays."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from roomledger.operators import inference, segmentation
from roomledger.plans import catalog, learning
from roomledger.sources.testdata import load_bookings


@pytest.mark.parametrize(
    "query", ["ml_nb", "ml_logreg", "ml_dt", "ml_dt_stayed", "ml_dt_stayed_default", "rg_tier_tree", "st_logit_fit_quality"]
)
def test_bookings_are_read_once(spark, sf, monkeypatch, query):
    seen = spark.sparkContext.accumulator(0)

    def counted(spark, path, *columns):
        rows = load_bookings(spark, path, *columns)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(learning, "load", counted)
    assert catalog.queries()[query](spark, sf).collect()
    designs = 2 if query == "st_logit_fit_quality" else 1
    assert seen.value == designs * load_bookings(spark, sf, "reservation_id").count()


def test_products_are_not_built_row_by_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, label double")
    rows = inference.assemble(df, ["a", "b", "c"], ["label"]).cache()

    def refused(*_):
        raise AssertionError("an expression per pair of columns")

    monkeypatch.setattr(inference.F, "transform", refused)
    one = np.column_stack([np.ones(200), x])
    np.testing.assert_allclose(inference.cross_products(df, ["a", "b", "c"]), one.T @ one, rtol=1e-12)
    w = inference.squared_hinge(rows, 0.5)
    sign = 2 * y - 1
    slack = np.maximum(0, 1 - sign * (one @ w))
    np.testing.assert_allclose(w - one.T @ (slack * sign), 0, atol=1e-6)  # the gradient
    rows.unpersist()


def test_nulls_count_as_zero_in_products(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0), (None, 5.0)], "a double, b double")
    np.testing.assert_allclose(inference.cross_products(df, ["a", "b"]), [[3, 3, 8], [3, 5, 6], [8, 6, 34]])


def test_nearest_centres_hold_no_array_per_row_and_centre():
    rng = np.random.default_rng(4)
    x, centres = rng.normal(size=(20_000, 5)), rng.normal(size=(7, 5))
    centres[6] = centres[2]  # a tie goes to the first
    tracemalloc.start()
    at, far = segmentation._nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    square = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (at == square.argmin(axis=1)).all() and (far == square.min(axis=1)).all()
    assert peak < 12 * x.shape[0] * 8
