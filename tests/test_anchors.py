"""Pruned dense pairs hold every pair, whatever the vectors and anchors are."""

import itertools

import numpy as np
import pytest

from kinfold.operators import anchors, dense

SCHEMA = "row_id long, embedding array<double>"


def clustered(n=240, d=8, clusters=12, spread=0.15):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((clusters, d))
    return [(k, (centre[k % clusters] + spread * rng.standard_normal(d)).tolist()) for k in range(n)]


def on_the_edge(n=60, step=0.1):
    """Points on a circle whose neighbours are as far apart as the threshold: every bound is met with equality."""
    return [(k, [float(np.cos(k * step)), float(np.sin(k * step))]) for k in range(n)]


CASES = {
    "clusters": clustered(),
    "circle": on_the_edge(),
    "no clusters": [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(1).standard_normal((150, 16)))],
    "one hot vector": [(k, [1.0, 2.0, 3.0]) for k in range(80)] + clustered(120, 3, 6)[80:],
    "opposite": [(k, [(-1.0) ** k, 1e-9 * k]) for k in range(40)],
    "scales": [(k, [1e-200 * (k + 1), 1e-200]) for k in range(20)] + [(20 + k, [1e200, 1e200 * k]) for k in range(20)],
}


def brute(data, threshold):
    unit = {}
    for i, v in data:
        w = np.array(v) / np.abs(v).max()
        unit[i] = w / np.linalg.norm(w)
    scores = {(i, j): float(unit[i] @ unit[j]) for i, j in itertools.combinations(sorted(unit), 2)}
    sure = {p for p, s in scores.items() if s > threshold + 1e-12}
    return sure, {p for p, s in scores.items() if s > threshold - 1e-12}, scores


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("threshold, count, block_rows", [(0.8, 9, 2000), (float(np.cos(0.1)), 5, 7), (0.0, 3, 40)])
def test_no_pair_is_lost_and_none_is_found_twice(spark, name, threshold, count, block_rows):
    data = CASES[name]
    plan = anchors.planned(spark.createDataFrame(data, SCHEMA), threshold, anchors=count)
    found = anchors.similar_pairs(plan, threshold, block_rows).collect()
    got = {(r.i, r.j): r.score for r in found}
    sure, possible, scores = brute(data, threshold)
    assert len(got) == len(found)
    assert sure <= got.keys() <= possible
    assert all(abs(got[p] - scores[p]) < 1e-9 for p in got)


def test_clusters_are_pruned_and_the_count_says_how_much(spark):
    data = clustered()
    taken, all_pairs = anchors.planned(spark.createDataFrame(data, SCHEMA), 0.9, anchors=12).counts()
    assert all_pairs == len(data) * (len(data) - 1) // 2
    assert len(brute(data, 0.9)[0]) <= taken < all_pairs / 3


def test_groups_equal_those_without_bounds(spark):
    df = spark.createDataFrame(CASES["clusters"], SCHEMA)
    want = {tuple(r) for r in dense.similar_groups(df, 0.8).collect()}
    plan = anchors.planned(df, 0.8, anchors=9)
    assert {tuple(r) for r in anchors.similar_groups(plan, 0.8, 25).collect()} == want


def test_rows_without_a_direction_have_no_pairs(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0])]
    plan = anchors.planned(spark.createDataFrame(data, SCHEMA), 0.5)
    assert [tuple(r) for r in anchors.similar_pairs(plan, 0.5).collect()] == [(1, 2, 1.0)]
    assert plan.counts() == (1, 1)


def test_an_empty_table_has_no_pairs(spark):
    plan = anchors.planned(spark.createDataFrame([], SCHEMA), 0.5)
    assert anchors.similar_pairs(plan, 0.5).isEmpty() and anchors.similar_groups(plan, 0.5).isEmpty()
    assert plan.counts() == (0, 0)


def test_a_negative_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        anchors.planned(spark.createDataFrame([], SCHEMA), -0.1)
