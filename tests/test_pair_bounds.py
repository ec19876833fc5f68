"""Pairs that cannot be used are not sought: bounds where prefixes meet, and the threshold of what reads them."""

import collections
import itertools
import random

import pytest

from kinfold.operators import linkage, sparse

RECORD = "record_id long, source_description string, target_id string"


def cosine(a, b):
    x, y = (collections.Counter(itertools.pairwise(t.split())) for t in (a, b))
    length = sum(n * n for n in x.values()) * sum(n * n for n in y.values())
    return sum(n * y[t] for t, n in x.items()) / length**0.5 if length else 0.0


def vectors_of(rows, data):
    return sparse.text_vectors(rows(list(enumerate(data)), "id long, text string"), "id", "text")


def candidates(vectors, threshold):
    return {(r.i, r.j) for r in sparse._prefix_pairs(*sparse._split_postings(vectors, threshold, 2048), threshold, 2048).collect()}


def test_a_short_text_is_no_candidate_of_a_long_one_that_holds_it(rows):
    long = [f"a{k}" for k in range(60)]
    vectors = vectors_of(rows, [" ".join(long), " ".join(long[:6]), " ".join([*long[:50], "z"])])
    assert candidates(vectors, 0.5) == {(0, 2)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_no_pair_is_lost_where_lengths_and_counts_differ(rows, threshold):
    rng = random.Random(11)
    base = [f"w{rng.randrange(25)}" for _ in range(80)]
    data = []
    for _ in range(150):
        start, size = rng.randrange(60), rng.randrange(2, 40)
        words = base[start : start + size]
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        data.append(" ".join(words * rng.choice([1, 1, 1, 2, 7])))
    got = {(r.i, r.j) for r in sparse.similar_pairs(vectors_of(rows, data), threshold).collect()}
    scores = {(i, j): cosine(data[i], data[j]) for i, j in itertools.combinations(range(len(data)), 2)}
    assert {p for p, s in scores.items() if s > threshold + 1e-9} <= got
    assert got <= {p for p, s in scores.items() if s > threshold - 1e-9} and len(got) > 50


def test_candidates_above_are_those_of_all_candidates(rows, monkeypatch):
    rng = random.Random(4)
    base = " ".join(f"w{k}" for k in range(12)).split()
    data = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(12)] = f"x{rng.randrange(6)}"
        data.append((k, " ".join(words) if k % 9 else rng.choice(["hot text here", None]), rng.choice("abc")))
    records, sought = rows(data, RECORD), []
    similar = sparse.similar_pairs
    monkeypatch.setattr(sparse, "similar_pairs", lambda vectors, t: sought.append(t) or similar(vectors, t))
    found = {tuple(r) for r in linkage.candidate_pairs(records, [("target_id",)]).collect()}
    for above in (0.2, 0.8, 1.0):
        got = linkage.candidate_pairs(records, [("target_id",)], above=above).collect()
        assert {tuple(r) for r in got} == {f for f in found if f[2] > above} and len(got) == len({*got})
    assert sought == [0.5, 0.5, 0.8, 1.0]
