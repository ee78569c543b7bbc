"""A neighbour search beyond the travelling bound brings back only references within a query's reach."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors

from roomledger.operators import neighbours


def test_no_candidate_beyond_reach(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, q, k = np.round(rng.normal(size=(400, 3)), 1), np.round(rng.normal(size=(60, 3)), 1), 4
    frame = lambda rows: spark.createDataFrame([(i, float(i % 2), Vectors.dense(v)) for i, v in enumerate(rows)], ["id", "label", "features"])
    found = []
    visit = neighbours._visit

    def spied(*args):
        out = visit(*args).cache()
        found.append(out.collect())
        return out

    monkeypatch.setattr(neighbours, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(neighbours, "_visit", spied)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    got = neighbours.nearest(frame(x), frame(q), k, "id", "label").collect()

    merged = [i for i in range(len(x)) if sum((x[:i] == x[i]).all(1)) < k]
    far = np.linalg.norm(q[:, None] - x[None, merged], axis=2)
    for i in range(len(q)):
        want = sorted(zip(far[i].tolist(), merged))[:k]
        mine = sorted((r["distance"], r["neighbour"]) for r in got if r["id"] == i)
        assert [n for _, n in mine] == [n for _, n in want]
    first, rest = found
    reach = {}
    for r in first:
        reach.setdefault(r["id"], []).append(r["distance"])
    bound = {i: max(d) for i, d in reach.items() if len(d) >= k}
    assert rest and all(r["distance"] <= bound.get(r["id"], np.inf) for r in rest)
