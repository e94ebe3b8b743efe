"""Kinds of books in leaves: the same books as by brute force; shared parts of the recommender computed once."""

import numpy as np
import pytest

from marginalia.operators import recommend
from marginalia.plans import registry


@pytest.mark.parametrize("seed", range(6))
def test_leaves_find_what_brute_force_finds(seed):
    rng = np.random.default_rng(seed)
    readers, kinds, keys, per = 40, 500, 12 if seed % 2 else 300, 3
    values = (rng.random((kinds, keys)) < 4 / keys) * rng.integers(1, 4, (kinds, keys)) / 4
    weights = (rng.random((readers, keys)) < 0.7) * rng.integers(-4, 5, (readers, keys)) / 2
    count = rng.integers(1, 4, kinds)
    ids = np.concatenate([np.sort(x) for x in np.split(rng.permutation(count.sum()), np.cumsum(count)[:-1])])
    reader = np.repeat(np.arange(readers), 300)
    at = rng.integers(0, len(ids), len(reader))
    leaves = recommend._Leaves(values, count, ids, weights)
    got = sorted(zip(*(x.tolist() for x in leaves.best(weights, reader, at, per)), strict=True))
    cents = recommend._cents(weights @ values.T)[:, np.repeat(np.arange(kinds), count)]
    cents[reader, at] = 0
    want = [(u, int(ids[i]), int(row[i])) for u, row in enumerate(cents) for i in np.lexsort((ids, -row))[:per] if row[i] > 0]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["recommend_topk", "recommend_filtered_1y"])
def test_recommenders_read_the_history_once_for_each_use(spark, name):
    """The last plan begins from computed parts: no scan of the lines is left in it, and the driver holds less of it."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan


def test_preferences_broadcast_no_books(spark):
    plan = registry.QUERIES["pref_histograms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [book_id" not in plan and "SortMergeJoin [book_id" in plan
