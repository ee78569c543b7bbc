"""Ordered operators against brute force, with hot keys, ties and NULL keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomledger.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            # one key holds more than a third of the rows, and one key is NULL
            "g": [("hot" if i % 5 < 2 else None if i % 5 == 2 else f"k{i % 11}") for i in range(n)],
            "v": rng.integers(0, 20, n),
        }
    )
    return pdf, spark.createDataFrame(pdf.astype({"g": object}), "id long, g string, v long").repartition(5)


def test_global_row_number(rows):
    pdf, df = rows
    got = ordered.global_row_number(df, [F.desc("v"), F.col("id")]).toPandas().sort_values("rn")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got["rn"].tolist() == list(range(1, len(pdf) + 1))
    assert got["id"].tolist() == want["id"].tolist()
    assert set(got["n_rows"]) == {len(pdf)}


def test_running_totals_by_hot_and_null_keys(rows):
    pdf, df = rows
    got = ordered.running_totals(
        df, [F.col("v"), F.col("id")], {"cum": F.col("v"), "rn": F.lit(1).cast("long")}, ["g"]
    ).toPandas()
    want = pdf.fillna({"g": "-"}).sort_values(["v", "id"])
    want["cum"] = want.groupby("g")["v"].cumsum()
    want["rn"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(merged) == len(pdf)
    assert (merged["cum"] == merged["cum_w"]).all()
    assert (merged["rn"] == merged["rn_w"]).all()


def test_running_totals_with_grand_total(rows):
    pdf, df = rows
    got = ordered.running_totals(df, [F.col("id")], {"cum": F.col("v")}, grand=True).toPandas().sort_values("id")
    assert got["cum"].tolist() == pdf["v"].cumsum().tolist()
    assert set(got["cum_total"]) == {pdf["v"].sum()}


@pytest.mark.parametrize("n,buckets", [(1, 5), (4, 5), (7, 5), (100, 7), (1495, 100)])
def test_ntile_matches_definition(spark, n, buckets):
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"), F.lit(n).alias("n"))
    got = df.select("rn", ordered.ntile(F.col("rn"), F.col("n"), buckets).alias("t")).orderBy("rn").toPandas()["t"]
    q, r = divmod(n, buckets)
    want = [i + 1 for i in range(buckets) for _ in range(q + (i < r))]
    assert got.tolist() == want


@pytest.mark.parametrize("n", [5, 6, 7, 11, 50, 121])
def test_rank_buckets_match_pandas_qcut(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"), F.lit(n).alias("n"))
    got = (
        df.select("rn", ordered.equal_rank_bucket(F.col("rn"), F.col("n"), 5).alias("b")).orderBy("rn").toPandas()["b"]
    )
    want = pd.qcut(pd.Series(np.arange(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert got.tolist() == want.tolist()


def test_one_row_gets_a_bucket(spark):
    df = spark.range(1, 2).select(F.col("id").alias("rn"), F.lit(1).alias("n"))
    assert df.select(ordered.equal_rank_bucket(F.col("rn"), F.col("n"), 5)).first()[0] == 1


def test_quantiles_match_numpy(rows):
    pdf, df = rows
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = ordered.quantiles(df, "v", probs).first()
    assert np.allclose(list(got), np.quantile(pdf["v"], probs))
    by = ordered.quantiles(df, "v", probs, ["g"]).toPandas()
    hot = by[by["g"] == "hot"].iloc[0, 1:].to_numpy(float)
    assert np.allclose(hot, np.quantile(pdf[pdf["g"] == "hot"]["v"], probs))


def test_lowest_by_hash_is_exact_per_stratum(rows):
    pdf, df = rows
    strata = df.filter("g IS NOT NULL")
    marked = ordered.lowest_by_hash(strata, F.col("id").cast("string"), 0.25, ["g"]).toPandas()
    share = marked.groupby("g")["is_test"].agg(["sum", "count"])
    assert (share["sum"] == (share["count"] * 0.25 + 0.5).astype(int)).all()
    again = ordered.lowest_by_hash(strata.repartition(7), F.col("id").cast("string"), 0.25, ["g"]).toPandas()
    assert set(marked[marked.is_test == 1]["id"]) == set(again[again.is_test == 1]["id"])


@pytest.mark.parametrize("sliver", [100_000, 0])
def test_order_statistics_with_ties(spark, monkeypatch, sliver):
    monkeypatch.setattr(ordered, "SLIVER", sliver)
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"name": [f"g{i:05d}" for i in rng.permutation(n)], "few": rng.geometric(0.6, n), "many": rng.gamma(2.0, 50.0, n).round(2) - 20})
    df = spark.createDataFrame(pdf).repartition(4).checkpoint()
    ranks = [1, 2, n // 5, n // 5, n // 2, n - 1, n]
    count, got = ordered.order_statistics(df, "name", {"few": lambda _: ranks, "many": lambda k: [k, 1]})
    assert count == n
    for column, wanted in (("few", ranks), ("many", [n, 1])):
        rows = sorted(zip(pdf[column].astype(float), pdf["name"]))
        assert got[column] == [rows[k - 1] for k in wanted]


def test_rank_scores_sort_nothing_globally(spark, bookings):
    from roomledger.operators import guests

    scored = guests.rfm_scores(bookings, "2002-01-01")
    assert "rangepartitioning" not in scored._jdf.queryExecution().executedPlan().toString()
    rows = scored.select("primary_guest_name", "frequency", "monetary", "f", "m").toPandas()
    for value, score in (("frequency", "f"), ("monetary", "m")):
        order = rows.sort_values([value, "primary_guest_name"]).reset_index(drop=True)
        n = len(order)
        assert order[score].tolist() == [max(1, -(-5 * k // (n - 1))) for k in range(n)]


def test_order_statistics_of_an_empty_table(spark):
    none = spark.createDataFrame([], "name string, v double")
    assert ordered.order_statistics(none, "name", {"v": lambda n: [1]}) == (0, {"v": []})
