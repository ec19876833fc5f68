import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from support import as_set

from kinfold.operators import dense, sparse, sweep
from kinfold.operators.buckets import bucket_pairs, crossing_pairs
from kinfold.operators.components import connected_components


def brute_components(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {(n, c) for n, c in label.items()}


def bigram_counts(text):
    w = text.lower().split()
    return Counter(zip(w, w[1:]))


def brute_pairs(texts, threshold):
    vectors = {i: bigram_counts(t) for i, t in texts}
    length = {i: math.sqrt(sum(c * c for c in v.values())) for i, v in vectors.items()}
    out = {}
    for i, j in itertools.combinations(sorted(vectors), 2):
        product = sum(c * vectors[j][t] for t, c in vectors[i].items())
        if product and product / (length[i] * length[j]) > threshold:
            out[i, j] = product / (length[i] * length[j])
    return out


@pytest.fixture(scope="module")
def texts():
    """Half of the rows are near copies of one text, some exact copies, the rest is unrelated."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(40)}" for _ in range(30)]
    made = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(200)}"
        made.append(" ".join(words))
    made += [made[0].upper()] * 5
    made += [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(2, 25))) for _ in range(50)]
    made += ["single", "", "single"]
    return list(enumerate(made))


@pytest.fixture(scope="module")
def vectors(spark, texts):
    return sparse.text_vectors(spark.createDataFrame(texts, "id long, t string"), "id", "t")


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_sparse_pairs_equal_brute_force(vectors, texts, threshold):
    want = brute_pairs(texts, threshold)
    for chunk in (4, 2048):
        got = {(r.i, r.j): r.score for r in sparse.similar_pairs(vectors, threshold, chunk).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("hot_bucket", [0, 5, 5_000])
def test_sparse_groups_do_not_depend_on_bucket_handling(vectors, texts, hot_bucket):
    got = sparse.similar_groups(vectors, 0.6, hot_bucket=hot_bucket, chunk=4)
    want = brute_components(list(brute_pairs(texts, 0.6)))
    assert {(r.member_id, r.group_id) for r in got.collect()} == want


def test_minhash_pairs_are_a_subset_with_high_recall(vectors, texts):
    exact = set(brute_pairs(texts, 0.8))
    found = {(r.i, r.j) for r in sparse.hashed_pairs(vectors, 0.8).collect()}
    assert found <= exact and len(found) >= 0.99 * len(exact)


def test_score_at_threshold_is_no_pair(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "id long, t string")
    vectors = sparse.text_vectors(df, "id", "t")  # three of four terms shared
    assert sparse.similar_pairs(vectors, 0.75).isEmpty()
    assert as_set(sparse.similar_pairs(vectors, 0.74)) == {(1, 2, 0.75)}


def test_bucket_pairs_meet_once_whatever_the_chunk(spark):
    data = [(1, n, 40) for n in range(40)] + [(2, n, 3) for n in (1, 5, 9)]
    postings = spark.createDataFrame(data, "term long, row_id long, size long")
    want = set(itertools.combinations(range(40), 2))
    for chunk in (1, 7, 100):
        pairs = [tuple(r) for r in bucket_pairs(postings, chunk=chunk).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_crossing_pairs_skip_pairs_inside_a_component(spark):
    postings = spark.createDataFrame([(1, n) for n in range(8)], "term long, row_id long")
    labels = spark.createDataFrame([(n, 0) for n in range(5)] + [(5, 5), (6, 5)], "row_id long, component long")
    component = {**{n: 0 for n in range(5)}, 5: 5, 6: 5, 7: 7}
    want = {
        (i, j) for i, j in itertools.combinations(range(8), 2) if component[i] != component[j]
    }
    for chunk in (2, 100):
        assert as_set(crossing_pairs(postings, labels, chunk=chunk)) == want


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 8))
    data = [(int(n), (base[n % 12] + 0.35 * rng.standard_normal(8)).tolist()) for n in range(90)]
    data.append((90, [0.0] * 8))
    return data, spark.createDataFrame(data, "row_id long, embedding array<double>")


def brute_dense(data, threshold):
    out = {}
    for (i, a), (j, b) in itertools.combinations(data, 2):
        length = np.linalg.norm(a) * np.linalg.norm(b)
        score = float(np.dot(a, b) / length) if length else 0.0
        if score > threshold:
            out[i, j] = score
    return out


@pytest.mark.parametrize("blocks", [1, 3, 5])
def test_dense_pairs_and_groups(points, blocks):
    data, df = points
    want = brute_dense(data, 0.8)
    got = {(r.i, r.j): r.score for r in dense.similar_pairs(df, 0.8, blocks=blocks).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
    groups = dense.similar_groups(df, 0.8, blocks=blocks)
    assert {(r.member_id, r.group_id) for r in groups.collect()} == brute_components(list(want))


def test_strongest_links_keep_every_threshold(points):
    data, df = points
    levels = sweep.threshold_list(0.5, 0.95, 6)
    links, counts = dense.strongest_links(df, levels[0], levels, blocks=3)
    assert links.count() < len(brute_dense(data, levels[0]))
    got = sweep.sweep_groups(links, counts, levels).orderBy("threshold").collect()
    for row, level in zip(got, levels, strict=True):
        pairs = brute_dense(data, level)
        groups = brute_components(list(pairs))
        n = len({c for _, c in groups})
        assert (row.groups, row.pairs) == (n, len(pairs))
        assert row.mean_group_size == pytest.approx(len(groups) / n if n else 0.0)


def test_sweep_is_zero_above_all_scores_and_falls(vectors):
    levels = sweep.threshold_list(0.6, 1.5, 10)
    pairs = sparse.similar_pairs(vectors, levels[0])
    got = sweep.sweep_pairs(sweep.level_counts(pairs, levels), levels).orderBy("threshold").collect()
    counts = [r.pairs for r in got]
    assert len(got) == 10 and counts == sorted(counts, reverse=True) and counts[0] > 0
    assert (counts[-1], got[-1].mean_score) == (0, 0.0)


def test_hyperplane_pairs_have_exact_scores(points):
    data, df = points
    exact = brute_dense(data, 0.9)
    found = {(r.i, r.j): r.score for r in dense.hashed_pairs(df, 0.9).collect()}
    assert found.keys() <= exact.keys() and len(found) >= 0.99 * len(exact)
    assert all(abs(found[p] - exact[p]) < 1e-9 for p in found)


def components_of(spark, edges, schema="i long, j long"):
    return {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, schema)).collect()}


def test_long_chain_is_one_component(spark, monkeypatch):
    monkeypatch.setattr("kinfold.operators.components.LOCAL_EDGES", 50)
    order = list(range(2001))
    random.Random(5).shuffle(order)
    got = components_of(spark, [(order[n], order[n + 1]) for n in range(2000)])
    assert got == {(n, 0) for n in range(2001)}


def test_components_do_not_depend_on_order_or_direction(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = [e for e in edges if e[0] != e[1]]
    want = brute_components(edges)
    assert components_of(spark, edges) == want
    assert components_of(spark, [(b, a) for a, b in reversed(edges)]) == want


def test_components_with_text_nodes_and_keys(spark):
    assert components_of(spark, [("b", "c"), ("c", "a"), ("x", "y")], "i string, j string") == {
        ("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"),
    }
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (1, 1, 2), (1, 3, 4)], "k int, i long, j long")
    got = connected_components(edges, keys=["k"]).select("k", "node", "component")
    assert as_set(got) == {
        (0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3),
    }


def test_no_edges_no_components(spark):
    assert components_of(spark, []) == set()
