"""Trees against recursive brute force, and the distributed steps against the bounded group."""

from __future__ import annotations

import itertools
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from roomledger.operators import models, trees

RNG = np.random.default_rng(8)
N, P = 400, 5


@pytest.fixture(scope="module")
def data():
    x = np.column_stack([RNG.normal(size=N), RNG.integers(0, 4, N), RNG.integers(0, 2, N), RNG.normal(size=N).round(1), np.ones(N)])
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] + x[:, 1] - 2 * x[:, 2])))
    y = (RNG.random(N) < p).astype(float)
    amount = np.round(40 + 9 * x[:, 0] * x[:, 2] - 3 * x[:, 1] + RNG.normal(size=N), 2)
    test = (np.arange(N) % 4 == 0).astype(int)
    return x, y, amount, test


@pytest.fixture(scope="module")
def stored(spark, data):
    x, y, amount, test = data
    rows = [(f"R{i}", Vectors.dense(x[i]), float(y[i]), float(amount[i]), int(test[i])) for i in range(N)]
    frame = spark.createDataFrame(rows, ["reservation_id", "features", "label", "amount", "is_test"])
    cuts = trees.cut_points(frame.filter("is_test = 0"))
    out = {k: trees.binned(frame, cuts, "reservation_id", k).repartition(3).checkpoint() for k in ("label", "amount")}
    return cuts, out


def arrays(frame):
    rows = frame.filter("is_test = 0").orderBy("uid").collect()
    codes = np.array([list(r.bins) for r in rows])
    return codes, np.array([r.label for r in rows]), np.array([r.uid for r in rows])


def test_bins_keep_the_order_of_values(data, stored):
    x, *_ = data
    cuts, frames = stored
    rows = frames["label"].collect()
    assert len(rows) == N
    codes = np.array([list(r.bins) for r in rows])
    want = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)])
    assert sorted(map(tuple, codes.tolist())) == sorted(map(tuple, want.tolist()))
    # Few distinct values: each has a bin of its own.
    assert len(set(codes[:, 1].tolist())) == 4 and len(set(codes[:, 4].tolist())) == 1


def brute_split(codes, y, w, features, least=1):
    best = (-np.inf, None, None)
    for f in features:
        for c in sorted(set(codes[:, f].tolist())):
            left = codes[:, f] <= c
            if min(left.sum(), (~left).sum()) < least:
                continue
            score = (w * y)[left].sum() ** 2 / w[left].sum() + (w * y)[~left].sum() ** 2 / w[~left].sum()
            if score > best[0]:
                best = (score, f, c)
    return best


def brute_tree(codes, y, w, tree, path, tries, forest):
    """Nested (feature, cut, left, right) or a mean."""
    mean = (w * y).sum() / w.sum()
    if y.min() == y.max():
        return mean
    order = trees.feature_order(tree, np.array([path]), codes.shape[1], forest.seed)[0]
    for first in range(0, len(order), tries):
        score, f, c = brute_split(codes, y, w, sorted(order[first : first + tries].tolist()))
        if f is not None:
            left = codes[:, f] <= c
            return (
                f, c,
                brute_tree(codes[left], y[left], w[left], tree, 2 * path, tries, forest),
                brute_tree(codes[~left], y[~left], w[~left], tree, 2 * path + 1, tries, forest),
            )
    return mean


def nested(tree, k=0):
    if tree.feature[k] < 0:
        return tree.value[k]
    return tree.feature[k], tree.cut[k], nested(tree, tree.left[k]), nested(tree, tree.right[k])


@pytest.mark.parametrize(("label", "tries"), [("label", 2), ("label", 5), ("amount", 2)])
def test_forest_trees_equal_recursion(stored, label, tries):
    codes, y, uid = arrays(stored[1][label])
    y = np.rint(y * 2**20)
    forest = trees.Forest(trees=3)
    for t in range(3):
        w = trees.draws(uid, t, forest.seed).astype(float)
        k = w > 0
        got = trees.grow_rows(codes[k].astype(np.uint8), y[k], w[k], t, 1, tries, forest)
        assert nested(got) == brute_tree(codes[k], y[k], w[k], t, 1, tries, forest)


@pytest.mark.parametrize("label", ["label", "amount"])
def test_forest_in_steps_equals_the_bounded_group(stored, label):
    frame = stored[1][label]
    forest = trees.Forest(trees=4, tries=2)
    whole, parts = (trees.forest_scores(frame, P, forest, bound) for bound in (1 << 16, 60))
    one, two = ({r.id: (r.label, r.score) for r in x[0].collect()} for x in (whole, parts))
    assert len(one) == N // 4 and two == {k: (a, pytest.approx(b)) for k, (a, b) in one.items()}
    codes, y, uid = arrays(frame)
    test = frame.filter("is_test = 1").orderBy("uid").collect()
    scale = trees.target_scale(frame.filter("is_test = 0"))
    votes = []
    for t in range(4):
        w = trees.draws(uid, t, forest.seed).astype(float)
        tree = trees.grow_rows(codes[w > 0].astype(np.uint8), np.rint(y * scale)[w > 0], w[w > 0], t, 1, 2, forest)
        votes.append(tree.predict(np.array([list(r.bins) for r in test], dtype=np.uint8)) / scale)
    assert np.allclose([one[r.id][1] for r in test], np.mean(votes, axis=0))
    gains = {r.feature: r.gain for r in whole[1].collect()}
    assert set(gains) == set(range(P)) and gains[4] == 0 and min(gains[0], gains[1]) > 0


def test_deep_tree_fits_its_rows(stored):
    codes, y, _ = arrays(stored[1]["amount"])
    tree = trees.grow_rows(codes.astype(np.uint8), np.rint(y * 1024), np.ones(len(y)), 0, 1, P, trees.Forest())
    for key, group in itertools.groupby(sorted(zip(map(tuple, codes.tolist()), range(len(y)))), key=lambda r: r[0]):
        rows = [k for _, k in group]
        got = tree.predict(np.array([key], dtype=np.uint8))[0]
        assert got == pytest.approx(np.mean(np.rint(y[rows] * 1024)))


SETTINGS = {
    "leafy": trees.Boost(3, 0.3, trees.Growth(leaves=7, min_rows=10, min_weight=1e-3)),
    "shares": trees.Boost(3, 0.3, trees.Growth(depth=3, min_weight=1.0, l2=1.0), row_share=0.7, column_share=0.6),
    "by count": trees.Boost(3, 0.3, trees.Growth(depth=2, by_count=True)),
}


@pytest.mark.parametrize("classify", [True, False])
@pytest.mark.parametrize("name", SETTINGS)
def test_boosting_in_steps_equals_the_bounded_group(stored, name, classify, monkeypatch):
    monkeypatch.setattr(trees, "RESUME", 2)
    frame = stored[1]["label" if classify else "amount"]
    whole, steps = (trees.boost(frame, P, SETTINGS[name], classify, bound) for bound in (1 << 16, 0))
    assert whole.base == steps.base and len(whole.trees) == 3
    for a, b in zip(whole.trees, steps.trees, strict=True):
        assert nested(a) == nested(b) and max(a.feature) >= 0


def test_first_boosting_split_equals_brute_force(stored):
    codes, y, _ = arrays(stored[1]["label"])
    fit = trees.boost(stored[1]["label"], P, trees.Boost(1, 0.1, trees.Growth(leaves=2, min_rows=20)), True)
    p = y.mean()
    w = np.full(len(y), p * (1 - p))
    score, f, c = brute_split(codes, (y - p) / w, w, range(P), least=20)
    tree = fit.trees[0]
    assert (tree.feature[0], tree.cut[0]) == (f, c) and fit.base == pytest.approx(np.log(p / (1 - p)))
    left = codes[:, f] <= c
    assert tree.value[tree.left[0]] == pytest.approx(0.1 * (y - p)[left].sum() / w[left].sum())


def test_leaf_wise_trees_fit_better_than_shallow_ones(stored):
    codes, y, _ = arrays(stored[1]["label"])

    def loss(growth):
        fit = trees.boost(stored[1]["label"], P, trees.Boost(5, 0.3, growth), True)
        raw = fit.base + sum(t.predict(codes.astype(np.uint8)) for t in fit.trees)
        assert all(sum(f < 0 for f in t.feature) <= 31 for t in fit.trees)
        return np.log1p(np.exp(-np.where(y == 1, raw, -raw))).mean()

    assert loss(trees.Growth(leaves=31)) <= loss(trees.Growth(leaves=31, depth=5)) + 1e-9


def brute_links(tree):
    """Smallest penalty at which some pruned subtree is as good as the whole, by listing all subtrees."""
    risk = [min(t, n - t) for n, t in zip(tree.n, tree.total, strict=True)]

    def every(k):
        yield risk[k], 1, frozenset([k])
        if tree.feature[k] >= 0:
            for (a, b, s), (c, d, t) in itertools.product(list(every(tree.left[k])), list(every(tree.right[k]))):
                yield a + c, b + d, s | t

    return list(every(0))


def test_pruning_gives_the_best_subtree_for_every_penalty(stored):
    tree = trees.grow_tree(stored[1]["label"], P, trees.Growth(depth=4, min_split=20, min_rows=7))
    codes, y, _ = arrays(stored[1]["label"])
    assert tree.n[0] == len(y) and tree.total[0] == y.sum()
    _, f, c = brute_split(codes, y, np.ones(len(y)), range(P), least=7)
    assert (tree.feature[0], tree.cut[0]) == (f, c)
    options = brute_links(tree)
    penalties = [a for a, _ in trees.prune_sequence(tree)]
    assert penalties == sorted(penalties) and 1 < len(penalties)
    root = min(tree.total[0], tree.n[0] - tree.total[0])
    for complexity in (0.0, 0.005, 0.01, 0.03, 0.1, 0.5, 2.0):
        got = trees.prune(tree, complexity)
        leaves = [k for k, f in enumerate(got.feature) if f < 0]
        cost = sum(min(got.total[k], got.n[k] - got.total[k]) for k in leaves)
        least = min(r + complexity * root * size for r, size, _ in options)
        assert cost + complexity * root * len(leaves) == pytest.approx(least)
        # Of equally good subtrees the smallest one.
        assert len(leaves) == min(size for r, size, _ in options if r + complexity * root * size <= least + 1e-9)


def test_tree_without_rows_or_splits(spark):
    none = spark.createDataFrame([], trees.ROWS)
    assert trees.boost(none, 2, trees.Boost(2), True).trees == []
    one = spark.createDataFrame([(k, int(k > 2), float(k < 3), bytearray([k]), str(k)) for k in (1, 2, 3)], trees.ROWS)
    assert trees.grow_tree(one, 1, trees.Growth()).feature == [-1]
    assert [r.score for r in trees.forest_scores(one, 1, trees.Forest(trees=12))[0].collect()] == [1.0]
    assert trees.predict_trees(one, trees.boost(one, 1, trees.Boost(2), False).trees, 1.0).filter(F.col("raw") != 1.0).count() == 0


def test_boosting_step_is_one_short_job(spark, stored):
    """Depth 3 asks for the sums of three levels per round; the children below come from their parent's sums."""
    sc = spark.sparkContext
    jobs = {}
    for rounds in (1, 4):
        sc.setJobGroup(f"boost-{rounds}", "boost")
        trees.boost(stored[1]["label"], P, trees.Boost(rounds, 0.1, trees.Growth(depth=3, by_count=True)), True, 0)
        jobs[rounds] = len(sc.statusTracker().getJobIdsForGroup(f"boost-{rounds}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[4] - jobs[1] == 3 * 3


def test_split_of_whole_sums_beyond_32_bits():
    n = np.array([[10, 10, 10]])
    total = np.array([[-(2**50), 0, 2**50]])
    split = trees.best_split(n, n << 40, total, trees.Growth(), 1.0)
    assert (split.feature, split.cut) == (0, 0) and split.gain > 0


def test_forest_gains_count_the_splits_above_the_bound(stored):
    frame = stored[1]["label"]
    forest = trees.Forest(trees=4, tries=2)
    whole, parts = ({r.feature: r.gain for r in trees.forest_scores(frame, P, forest, bound)[1].collect()} for bound in (1 << 16, 60))
    assert parts == {k: pytest.approx(v) for k, v in whole.items()}


def test_order_by_node_then_code():
    few = trees._node_order(np.array([1, 0, 1, 0, 0]), np.array([3, 200, 1, 7, 7], dtype=np.uint8), 2)
    assert few.tolist() == [3, 4, 1, 2, 0]
    many = trees._node_order(np.array([70_000, 5, 70_000]), np.array([2, 9, 1], dtype=np.uint8), 1 << 17)
    assert many.tolist() == [1, 2, 0]


def test_boosting_of_a_hundred_thousand_rows_needs_no_job_per_step(spark):
    """Above 2**16 rows; the same trees as by steps."""
    bins = F.concat(*[F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))), 2, "0")) for k, m in enumerate((9, 2, 40))])
    label = F.pmod(F.xxhash64("id", F.lit(1)) + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)), F.lit(2)).cast("double")
    rows = spark.range(70_000).select(
        F.xxhash64("id").alias("uid"), F.lit(0).alias("is_test"), label.alias("label"), bins.alias("bins"), F.col("id").cast("string").alias("id")
    ).cache()
    rows.count()
    settings, sc = trees.Boost(5, 0.3, trees.Growth(leaves=6, min_rows=20), row_share=0.9, column_share=0.7), spark.sparkContext
    sc.setJobGroup("boost-many", "boost")
    fit = trees.boost(rows, 3, settings, True)
    assert len(sc.statusTracker().getJobIdsForGroup("boost-many")) < 5
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert fit.trees == trees.boost(rows, 3, settings, True, 0).trees
    assert len(fit.trees) == 5 and any(len(t.feature) > 3 for t in fit.trees)
    rows.unpersist()


def test_the_longest_fits_start_first(spark, monkeypatch):
    monkeypatch.setattr(models, "PARALLEL", 1)
    split = SimpleNamespace(stored=spark.range(1), binned=lambda: None, n_train=9, names=["a", "b"], label_sd=1.0)
    begun = []
    names = list(models.classifiers(split))
    done = models._fit_all(split, lambda split, name, rounds: begun.append(name), names, None)
    assert [n for n, _ in done] == names
    assert {*begun[:3]} == {"Gradient Boosting", "Boosting, leafy", "Boosting, subsampled"} and begun[3] == "Random Forest"


def test_bundles_add_up_to_the_sums_of_every_feature():
    rng = np.random.default_rng(4)
    widths = np.array([2, 256, 3, 2, 1, 17, 2])
    columns = np.stack([rng.integers(0, w, 500) for w in widths]).astype(np.uint8)
    weight = rng.integers(-(2**40), 2**40, 500).astype(float)
    for most in (1, 30, 1 << 12):
        bundles = trees._Bundles.of(widths, most)
        assert sorted(f for m in bundles.members for f in m) == list(range(7))
        packed, out = bundles.cells(columns), np.zeros((2, 7, 256))
        for i, size in enumerate(bundles.sizes):
            counts = np.stack([np.bincount(packed[i], x, size) for x in (None, weight)])
            bundles.spread(i, counts, bundles.members_of(i), out)
        for f in range(7):
            assert out[:, f].tolist() == [np.bincount(columns[f], x, 256).tolist() for x in (None, weight)]
            assert bundles.codes(packed, np.full(500, f), np.arange(500)).tolist() == columns[f].tolist()


def test_boosting_of_three_hundred_thousand_rows_needs_no_job_per_step(spark):
    """Above 2**18 rows, as a sixth of the bookings of 1 GB has."""
    bins = F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(30))), 2, "0"))
    label = (F.pmod(F.xxhash64("id"), F.lit(30)) * 7 % 5 > 2).cast("double")
    rows = spark.range(300_000).select(
        F.xxhash64("id").alias("uid"), F.lit(0).alias("is_test"), label.alias("label"), bins.alias("bins"), F.lit("").alias("id")
    )
    sc = spark.sparkContext
    sc.setJobGroup("boost-300", "boost")
    fit = trees.boost(rows, 1, trees.Boost(6, 0.3, trees.Growth(leaves=6, min_rows=20)), True)
    assert len(sc.statusTracker().getJobIdsForGroup("boost-300")) < 5
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(fit.trees) == 6 and all(t.n[0] == 300_000 for t in fit.trees)


def test_forest_cuts_by_cells_equal_cuts_by_sort(monkeypatch):
    rng = np.random.default_rng(5)
    codes = np.stack([rng.integers(0, k, 900) for k in (2, 250, 9, 31)], axis=1).astype(np.uint8)
    y, w = rng.integers(0, 9, 900).astype(float), rng.integers(1, 4, 900).astype(float)
    for tries in (2, 4):
        grown = []
        for cells in (0, 4, 1 << 20):
            monkeypatch.setattr(trees, "CELLS_A_ROW", cells)
            grown.append(trees.grow_rows(codes, y, w, 3, 1, tries, trees.Forest(depth=70)))
        assert grown[0] == grown[1] == grown[2] and len(grown[0].feature) > 500


def test_trees_of_a_group_are_dealt_evenly(spark):
    rows = spark.range(5, 13).select(F.col("id").cast("int").alias("tree"))
    dealt = rows.repartition(8, trees._salt(spark, range(5, 13), 8))
    assert dealt.groupBy(F.spark_partition_id()).count().count() == 8


def test_forest_tree_of_three_hundred_thousand_rows_is_one_group(spark, monkeypatch):
    """Above 2**18 drawn rows: no job per level."""
    monkeypatch.setattr(trees, "_top_levels", lambda *a: pytest.fail("split by jobs"))
    bins = F.unhex(F.lpad(F.hex(F.pmod("id", F.lit(30))), 2, "0"))
    rows = spark.range(450_000).select(
        F.xxhash64("id").alias("uid"), (F.col("id") < 60).cast("int").alias("is_test"),
        (F.col("id") % 30 > 11).cast("double").alias("label"), bins.alias("bins"), F.col("id").cast("string").alias("id"),
    )
    scores, _ = trees.forest_scores(rows, 1, trees.Forest(trees=2))
    assert {(r.label, r.score) for r in scores.collect()} == {(0.0, 0.0), (1.0, 1.0)}
