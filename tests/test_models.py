"""Fits against closed forms or brute force on small fixtures."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from roomledger.operators import evaluation, forecasting, inference, models, neighbours, segmentation


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 3))
    x[:, 2] = x[:, 0] + 0.3 * x[:, 2]
    p = 1 / (1 + np.exp(-(0.4 + x[:, 0] - 0.7 * x[:, 1])))
    y = (rng.uniform(size=n) < p).astype(int)
    amount = 50 + 8 * x[:, 0] - 3 * x[:, 1] + rng.normal(size=n)
    rows = pd.DataFrame(x, columns=["a", "b", "c"])
    rows["is_cancelled"], rows["amount"] = y, amount
    rows["reservation_id"] = [f"R{i:04d}" for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample).repartition(4).checkpoint()


def test_logit_matches_newton(spark, sample, frame):
    names = ["a", "b", "c"]
    model = inference.fit_logit(frame, names)
    got = inference.coefficients(spark, model, names, scale=None).toPandas().set_index("variable")
    x = np.column_stack([sample[names], np.ones(len(sample))])
    y = sample["is_cancelled"].to_numpy()
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        info = (x * (p * (1 - p))[:, None]).T @ x
        beta += np.linalg.solve(info, x.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    order = [*names, "const"]
    assert np.allclose(got.loc[order, "coefficient"], beta, atol=1e-6)
    assert np.allclose(got.loc[order, "se"], se, atol=1e-5)
    assert np.allclose(got.loc[order, "or_ci_high"], np.exp(beta + 1.959964 * se), rtol=1e-4)
    # score equations: residuals are orthogonal to the design
    scored = inference.predict(model, frame, names, ["reservation_id", "is_cancelled"]).toPandas()
    assert abs((scored["is_cancelled"] - scored["score"]).sum()) < 1e-5
    quality = inference.fit_quality(spark, model).first()
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    base = y.mean()
    null = len(y) * (base * np.log(base) + (1 - base) * np.log(1 - base))
    assert quality.pseudo_r2 == pytest.approx(1 - ll / null, abs=1e-4)
    assert quality.aic == pytest.approx(2 * 4 - 2 * ll, abs=0.06)


@pytest.mark.parametrize("centred", [False, True])
def test_vif_matches_auxiliary_regressions(spark, sample, frame, centred):
    names = ["a", "b", "c"]
    got = {r.variable: r.vif for r in inference.vif(spark, frame, names, centred).collect()}
    x = sample[names].to_numpy()
    for j, name in enumerate(names):
        others = np.delete(x, j, 1)
        if centred:
            others = np.column_stack([others, np.ones(len(x))])
        rest = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        total = ((x[:, j] - (x[:, j].mean() if centred else 0)) ** 2).sum()
        assert got[name] == pytest.approx(total / (rest**2).sum(), abs=0.01)


def test_backward_selection_matches_brute_force_path(spark, sample, frame):
    terms = {"a": ["a"], "bc": ["b", "c"], "label": ["is_cancelled"]}
    steps, chosen = inference.backward_selection(spark, frame, terms, "amount")

    def aic(kept):
        cols = [c for t in kept for c in terms[t]]
        x = np.column_stack([np.ones(len(sample)), *[sample[c] for c in cols]])
        rest = sample["amount"] - x @ np.linalg.lstsq(x, sample["amount"], rcond=None)[0]
        return len(sample) * np.log((rest**2).mean()) + 2 * x.shape[1]

    kept = list(terms)
    want = [aic(kept)]
    while kept:
        best = min((aic([t for t in kept if t != out]), out) for out in kept)
        if best[0] >= want[-1]:
            break
        kept.remove(best[1])
        want.append(best[0])
    assert [r.aic for r in steps.orderBy("step").collect()] == pytest.approx(want, abs=1e-6)
    assert {r.variable for r in chosen.collect()} == {"const", *[c for t in kept for c in terms[t]]}


def _vector_frame(spark, x, labels, prefix):
    rows = [(f"{prefix}{i:04d}", Vectors.dense(v.tolist()), float(t)) for i, (v, t) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, ["reservation_id", "features", "label"])


@pytest.mark.parametrize("entries", [0, 10**6])
def test_neighbours_match_brute_force_with_copies_and_hot_cells(spark, monkeypatch, entries):
    monkeypatch.setattr(neighbours, "BLOCK", 40)  # forces several blocks per cell
    monkeypatch.setattr(neighbours, "BROADCAST_CELLS", entries)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    x[:170] = x[0]  # a third are copies of one row
    x[170:330] = x[170:330] * 0.05 + 3  # a dense cell
    q = np.vstack([x[:60], rng.normal(size=(60, 3))])
    y = rng.integers(0, 2, 500)
    train, test = _vector_frame(spark, x, y, "T"), _vector_frame(spark, q, np.zeros(len(q)), "Q")
    k = 5
    got = neighbours.nearest(train, test, k, "reservation_id", "label").toPandas()
    assert (got.groupby("reservation_id").size() == k).all() and got["reservation_id"].nunique() == len(q)
    for i in range(len(q)):
        mine = got[got["reservation_id"] == f"Q{i:04d}"].sort_values("rank")
        d = np.linalg.norm(x - q[i], axis=1)
        order = np.lexsort((np.arange(500), np.round(d, 9)))[:k]
        assert np.allclose(mine["distance"], d[order])
        assert mine["neighbour"].tolist() == [f"T{j:04d}" for j in order]


@pytest.mark.parametrize("entries", [0, 10**6])
def test_neighbours_with_a_hundred_ties_at_the_last_place(spark, monkeypatch, entries):
    monkeypatch.setattr(neighbours, "BROADCAST_CELLS", entries)
    rng = np.random.default_rng(9)
    angle = rng.uniform(0, 2 * np.pi, 30)
    far = rng.normal(size=(50, 4)) * 5 + 40
    # 100 references at the same distance of the query, by signs and order of 1, 2, 3, 4.
    ring = np.array([np.array(s) * np.array(o) for o in itertools.permutations((1.0, 2.0, 3.0, 4.0)) for s in itertools.product((1, -1), repeat=4)])
    ring = ring[rng.permutation(len(ring))[:100]]
    close = np.column_stack([0.1 * np.cos(angle), 0.1 * np.sin(angle), 0 * angle, 0 * angle])[:3]
    x = np.vstack([far, ring, close])
    train, test = _vector_frame(spark, x, np.arange(len(x)) % 2, "T"), _vector_frame(spark, np.zeros((1, 4)), [0], "Q")
    got = neighbours.nearest(train, test, 15, "reservation_id", "label").orderBy("rank").collect()
    distance = np.linalg.norm(x, axis=1)
    want = np.lexsort((np.arange(len(x)), distance))[:15]
    assert [r.neighbour for r in got] == [f"T{j:04d}" for j in want]


def test_many_starts_share_passes_and_find_the_best(spark):
    rng = np.random.default_rng(12)
    middle = np.array([[0, 0], [8, 0], [0, 8], [9, 9]], dtype=float)
    x = np.vstack([rng.normal(m, 0.4, size=(60, 2)) for m in middle])
    vectors = _vector_frame(spark, x, np.zeros(len(x)), "B").repartition(3)
    found = segmentation.many_kmeans(vectors, [1, 2, 4], restarts=5)
    assert found[1].cost == pytest.approx(((x - x.mean(0)) ** 2).sum())
    want = sum(((p - p.mean(0)) ** 2).sum() for p in x.reshape(4, 60, 2))
    assert found[4].cost == pytest.approx(want) and found[1].cost > found[2].cost > found[4].cost
    halves = min(
        sum(((x[np.array(g) == s] - x[np.array(g) == s].mean(0)) ** 2).sum() for s in (0, 1))
        for g in ([k in part for k in range(4) for _ in range(60)] for part in ((0,), (1,), (2,), (3,), (0, 1), (0, 2), (0, 3)))
    )
    assert found[2].cost <= halves + 1e-6
    placed = found[4].transform(vectors).toPandas()
    assert placed.groupby(placed["reservation_id"].str[1:].astype(int) // 60)["segment"].nunique().tolist() == [1] * 4
    assert sorted(placed["segment"].unique()) == [0, 1, 2, 3]
    assert segmentation.many_kmeans(vectors.limit(0), [2]) == {}


def test_fewer_references_than_neighbours(spark):
    x = np.array([[0.0], [1.0], [2.0]])
    train, test = _vector_frame(spark, x, [1, 0, 1], "T"), _vector_frame(spark, x[:1], [0], "Q")
    got = neighbours.nearest(train, test, 15, "reservation_id", "label")
    assert got.count() == 3
    assert neighbours.vote(got, "reservation_id").first().score == pytest.approx(2 / 3)


@pytest.fixture(scope="module")
def revenue(frame):
    return models.make_split(frame.select("reservation_id", "a", "b", "c", "amount"), ["a", "b", "c"], "amount", False)


def test_split_is_exact_and_scaled_on_train(sample, revenue):
    assert revenue.test.count() == 150 and revenue.n_train == 450
    scaled = np.array([r.scaled.toArray() for r in revenue.train.select("scaled").collect()])
    assert np.allclose(scaled.mean(0), 0) and np.allclose(scaled.std(0), 1)


def test_linear_and_ridge_match_closed_form(revenue):
    rows = revenue.train.select("scaled", "label").collect()
    x = np.array([r.scaled.toArray() for r in rows])
    y = np.array([r.label for r in rows])
    yc = y - y.mean()
    for name, alpha in (("Linear Regression", 0.0), ("Ridge", models.RIDGE_ALPHA)):
        _, model = models.score_regressor(revenue, name)
        want = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ yc)
        assert np.allclose(model.coefficients.toArray(), want, atol=2e-3)


def test_regressors_rank_by_rmse(revenue):
    table, _ = models.regressor_benchmark(revenue, ["Linear Regression", "Ridge", "Lasso"])
    rows = table.collect()
    assert [r.rmse for r in rows] == sorted(r.rmse for r in rows)
    assert all(0.9 < r.r2 <= 1 for r in rows)


def test_classifiers_beat_chance(spark, frame):
    split = models.make_split(
        frame.select("reservation_id", "a", "b", "c", "is_cancelled"), ["a", "b", "c"], "is_cancelled", True
    )
    kinds = ["Logistic Regression", "Naive Bayes", "KNN (k=15)", "Decision Tree", "Gradient Boosting"]
    table, fitted = models.classifier_benchmark(split, kinds, rounds=3)
    rows = table.collect()
    assert [r.auc for r in rows] == sorted((r.auc for r in rows), reverse=True)
    assert all(0.6 < r.auc < 1 for r in rows)
    top = models.importances(spark, fitted["Decision Tree"], split.names, top=2).collect()
    assert len(top) == 2 and top[0].importance >= top[1].importance


def test_full_settings_are_the_defaults(revenue):
    defaults = models.classifiers(revenue)
    rounds = {n: e.rounds for n, (_, e) in defaults.items() if "Boosting" in n}
    assert rounds == {"Gradient Boosting": 200, "Boosting, leafy": 400, "Boosting, subsampled": 400}
    assert defaults["Random Forest"][1].trees == 300
    assert {n: e.rounds for n, (_, e) in models.regressors(revenue).items() if "Boosting" in n} == {
        "Boosting, leafy": 500,
        "Boosting, subsampled": 500,
    }


def test_squared_hinge_has_no_gradient_left(revenue, sample, frame):
    split = models.make_split(
        frame.select("reservation_id", "a", "b", "c", "is_cancelled"), ["a", "b", "c"], "is_cancelled", True
    )
    rows = split.train.select("scaled", "label").collect()
    x = np.column_stack([np.ones(len(rows)), [r.scaled.toArray() for r in rows]])
    y = np.array([2 * r.label - 1 for r in rows])
    for c in (0.5, 1e-3):
        w = inference.squared_hinge(split.train, c, "scaled")
        slack = np.maximum(0, 1 - y * (x @ w))
        assert np.abs(w - 2 * c * x.T @ (y * slack)).max() < 1e-6


def test_every_model_runs_and_beats_chance(spark, frame):
    split = models.make_split(
        frame.select("reservation_id", "a", "b", "c", "is_cancelled"), ["a", "b", "c"], "is_cancelled", True
    )
    table, fitted = models.classifier_benchmark(split, rounds=5)
    rows = table.collect()
    assert len(rows) == 9 and all(0.55 < r.auc < 1 for r in rows)
    top = models.importances(spark, fitted["Random Forest"], split.names).collect()
    assert len(top) == 3 and sum(r.importance for r in top) == pytest.approx(1.0)
    assert models.importances(spark, fitted["Linear SVM"], split.names).collect() == []
    scored, _ = models.score_classifier(split, "Random Forest", 5)
    assert {r.reservation_id for r in scored.collect()} == {r.reservation_id for r in split.test.collect()}


def test_elbow_falls_and_starts_at_total(spark, sample, frame):
    vectors = segmentation.scaled_vectors(frame, ["a", "b"], population=False)
    rows = segmentation.elbow(spark, vectors, ks=range(1, 4), restarts=3).orderBy("k").collect()
    assert rows[0].wss == pytest.approx(2 * (len(sample) - 1), abs=1e-3)
    assert rows[0].wss > rows[1].wss > rows[2].wss
    projected, explained = segmentation.project(vectors, ["reservation_id"])
    assert projected.count() == len(sample) and sum(explained) == pytest.approx(1.0)
    assert segmentation.divisive(vectors, 3).select("hc_cluster").distinct().count() == 3


def test_forecast_beats_the_lag_on_a_trending_season(spark):
    rng = np.random.default_rng(1)
    t = np.arange(760)
    y = 1000 + t + 200 * np.sin(2 * np.pi * t / 365.25) + 150 * (t % 7 >= 4) + rng.normal(0, 60, len(t))
    rows = [(dt.date(2022, 1, 1) + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, y)]
    series = spark.createDataFrame(rows, "ds date, y double")
    row = forecasting.comparison(series).first()
    assert row.model_rmse < row.naive_cv_rmse
    ahead = forecasting.forecast(series).toPandas()
    assert len(ahead) == 90 and (ahead["yhat_lower"] < ahead["yhat_upper"]).all()
    assert ahead["ds"].min() == rows[-1][0] + dt.timedelta(days=1)


def test_forecast_per_series(spark):
    days = [dt.date(2022, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [(s, d, 10.0 * k + i) for k, s in enumerate("xy") for i, d in enumerate(days)]
    series = spark.createDataFrame(rows, "source string, ds date, y double")
    got = forecasting.forecast(series, 7, by=("source",)).toPandas()
    assert got.groupby("source").size().to_dict() == {"x": 7, "y": 7}


def test_forecast_fit_minimises_its_objective_over_days(spark):
    rng = np.random.default_rng(3)
    t = np.arange(500)
    y = 50 + 0.1 * t + 0.3 * np.maximum(t - 240, 0) + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, len(t))
    first = dt.date(2022, 1, 1)
    rows = [(first + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, y)]
    series = spark.createDataFrame(rows, "ds date, y double")
    got = forecasting.forecast(series, 5, history=True).toPandas().sort_values("ds")
    day = t + float((first - dt.date(1970, 1, 1)).days)
    s = t / t.max()
    waves = [f(2 * np.pi * k * day / p) for p, n in ((365.25, 10), (7.0, 3)) for k in range(1, n + 1) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones_like(s), s, *[np.maximum(s - a, 0) for a in np.linspace(0, 0.8, 26)[1:]], *waves])
    target = y / np.abs(y).max()
    # Brute force: accelerated proximal steps over the rows, with the noise of the fit before.
    noise = target.var()
    for _ in range(3):
        beta = z = np.zeros(x.shape[1])
        width, momentum = np.linalg.norm(x, 2) ** 2 + noise * forecasting.PRECISION.max(), 1.0
        for _ in range(60_000):
            step = z - (x.T @ (x @ z - target) + noise * forecasting.PRECISION * z) / width
            part = step[forecasting.CHANGES]
            step[forecasting.CHANGES] = np.sign(part) * np.maximum(np.abs(part) - noise / forecasting.CHANGE_SCALE / width, 0)
            after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            z, beta, momentum = step + (momentum - 1) / after * (step - beta), step, after
        noise = (target - x @ beta).var()
    assert len(got) == 505
    assert np.allclose(got["yhat"].to_numpy()[:500], x @ beta * np.abs(y).max(), atol=0.02)
    assert np.allclose(got["yhat"], got["trend"] + got["yearly"] + got["weekly"])
    moments = np.column_stack([x, target])
    found = forecasting.solve((moments.T @ moments).ravel())
    changes = found[forecasting.CHANGES]
    assert 0 < np.count_nonzero(changes) < 15
    # No gradient is left: zero at the smooth columns, within the penalty at the changes.
    wide = got["yhat_upper"].to_numpy() - got["yhat_lower"].to_numpy()
    assert np.allclose(wide[:500], wide[0]) and (np.diff(wide[499:]) > 0).all()


def test_sparse_part_meets_its_conditions():
    rng = np.random.default_rng(5)
    for penalty in (0.0, 0.5, 5.0, 500.0):
        x = rng.normal(size=(40, 8))
        x[:, 3] = x[:, 2]  # a column twice
        x[:, 5] = 0
        gram, target = x.T @ x, x.T @ rng.normal(size=40) * 3
        b = forecasting.sparse_part(gram, target, penalty)
        pull = target - gram @ b
        assert (np.abs(pull) <= penalty + 1e-6).all()
        assert np.allclose(pull[b != 0], penalty * np.sign(b[b != 0]), atol=1e-6)


def test_rolling_metrics_follow_the_definition(spark):
    rng = np.random.default_rng(6)
    rows = [(int(h), float(v), 0.0) for h in range(1, 31) for v in rng.normal(10, 3, rng.integers(1, 6))]
    scored = spark.createDataFrame(rows, "horizon int, y double, yhat double")
    for share in (0.1, 0.37, 1.0, 0.001):
        got = {r.horizon: r for r in forecasting.rolling_cv_metrics(scored, share).collect()}
        w = max(1, int(share * len(rows)))
        want = {}
        for h in range(1, 31):
            # Each error counts as its day's mean; take the last w errors up to the day.
            means = [np.mean([v * v for k, v, _ in rows if k == d]) for d in range(1, h + 1) for k, _, _ in rows if k == d]
            if len(means) >= w:
                want[h] = np.sqrt(np.mean(means[-w:]))
        assert set(got) == set(want) and all(got[h].rmse == pytest.approx(v) for h, v in want.items())


def test_ols_summary_matches_closed_form_and_reports_aliases(spark, sample, frame):
    design = frame.withColumn("one", F.lit(3.0)).withColumn("sum_ab", F.col("a") + F.col("b"))
    names = ["one", "a", "b", "sum_ab", "c"]
    table, fit = inference.ols_summary(spark, design, names, "amount")
    got = {r.variable: r for r in table.collect()}
    assert {n for n, r in got.items() if r.aliased} == {"one", "sum_ab"} and got["one"].coefficient is None
    x = np.column_stack([np.ones(len(sample)), sample[["a", "b", "c"]]])
    y = sample["amount"].to_numpy()
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    free = len(y) - 4
    rss = ((y - x @ beta) ** 2).sum()
    se = np.sqrt(rss / free * np.diag(np.linalg.inv(x.T @ x)))
    order = ["const", "a", "b", "c"]
    assert np.allclose([got[n].coefficient for n in order], beta) and np.allclose([got[n].se for n in order], se)
    assert np.allclose([got[n].t for n in order], beta / se) and got["a"].p_value < 1e-12 < got["c"].p_value
    row, total = fit.first(), ((y - y.mean()) ** 2).sum()
    assert (row.n, row.df_model, row.df_residual) == (600, 3, free)
    assert row.r2 == pytest.approx(1 - rss / total) and row.sigma == pytest.approx((rss / free) ** 0.5)
    assert row.f == pytest.approx((total - rss) / 3 / (rss / free)) and row.p_value == pytest.approx(0, abs=1e-12)


def test_tails_of_t_and_f():
    # Closed forms: Cauchy, two degrees of freedom, and F with two.
    for t in (0.1, 1.0, 3.5, 40.0):
        assert inference.t_tail(t, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(t), abs=1e-12)
        assert inference.t_tail(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-12)
        assert inference.f_tail(t, 2, 9) == pytest.approx((1 + 2 * t / 9) ** -4.5, abs=1e-12)
        assert inference.f_tail(t * t, 1, 30) == pytest.approx(inference.t_tail(t, 30), abs=1e-12)
    assert inference.t_tail(1.959963984540054, 1e7) == pytest.approx(0.05, abs=1e-6)


def test_variable_selection_joins_its_tables_once(spark, sf, monkeypatch):
    from roomledger.plans import learning

    plans = []
    real = inference.cross_products

    def seen(df, names):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, names)

    monkeypatch.setattr(inference, "cross_products", seen)
    learning.st_select_variables(spark, sf).collect()
    assert len(plans) == 1 and "Join" not in plans[0]


def test_open_cells_repeat_vectors_for_some_visits_at_a_time():
    """Queries whose reach opens every cell: the batches that leave the task stay small."""
    n, cells, sent = 600, 200, []
    asked = pd.DataFrame({"id": range(n), "vec": list(np.zeros((n, 4))), "home": 0, "reach": np.inf})

    class Frame:
        dtypes = [("id", "bigint")]

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802 - as the frame names it
            sent.extend(run(iter([asked])))

    neighbours._open_cells(Frame(), "id", np.random.default_rng(2).normal(size=(cells, 4)), np.ones(cells))
    visits = pd.concat(sent)
    assert len(visits) == n * (cells - 1) == len(visits[["id", "cell"]].drop_duplicates())
    assert max(len(p) for p in sent) <= 10_000


def test_bound_of_the_nearest_holds_them_all():
    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(20, 5)).round(1), rng.normal(size=(3000, 5)).round(1)
    far = np.linalg.norm(q[:, None] - x[None], axis=2)
    row, at, exact = neighbours._ranked(q, x, 15)
    for i in range(20):
        assert at[row == i].tolist() == np.lexsort((np.arange(3000), far[i]))[:15].tolist()
        assert np.allclose(exact[row == i], np.sort(far[i])[:15])
