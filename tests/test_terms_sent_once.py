import collections
import itertools
import random

import pytest

from kinfold.operators import sparse


def texts(seed=3, n=120):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if k % 3 and out:
            words = rng.choice(out).split()
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        else:
            words = [f"w{int(rng.random() ** 3 * 40)}" for _ in range(rng.randrange(1, 30))]
        out.append(" ".join(words))
    return out


def cosine(a, b):
    x, y = (collections.Counter(itertools.pairwise(t.split())) for t in (a, b))
    length = sum(n * n for n in x.values()) * sum(n * n for n in y.values())
    return sum(n * y[t] for t, n in x.items()) / length**0.5 if length else 0.0


@pytest.mark.parametrize(("most", "chunk"), [(0, 4), (5, 4), (5, 2048), (1 << 19, 4)])
def test_any_number_of_frequent_terms_finds_all_pairs(rows, monkeypatch, most, chunk):
    """Before, every term was joined with its number of rows."""
    data = texts()
    frequent = sparse.frequent_terms
    monkeypatch.setattr(sparse, "frequent_terms", lambda vectors: frequent(vectors, most, 2))
    vectors = sparse.text_vectors(rows(list(enumerate(data)), "id long, text string"), "id", "text")
    got = {(r.i, r.j) for r in sparse.similar_pairs(vectors, 0.5, chunk).collect()}
    pairs = itertools.combinations(range(len(data)), 2)
    want = {(i, j) for i, j in pairs if cosine(data[i], data[j]) > 0.5 + 1e-12}
    assert got == want and len(want) > 20


def test_frequent_terms_are_bounded_and_ties_stay_together(rows):
    held = {1: 9, 2: 5, 3: 5, 4: 2}
    data = [(k, {"terms": [t for t, n in held.items() if k < n]}) for k in range(9)]
    vectors = rows(data, "row_id long, vec struct<terms:array<long>>")
    for most, want, rest in [(4, [1, 2, 3, 4], 1), (3, [1, 2, 3], 2), (2, [1], 5), (0, [], 9)]:
        terms, n, other = sparse.frequent_terms(vectors, most, 2)
        assert (terms.tolist(), n.tolist(), other) == (want, [held[t] for t in want], rest)


def test_prefixes_are_found_without_a_shuffle(rows):
    vectors = sparse.text_vectors(rows(list(enumerate(texts())), "id long, text string"), "id", "text")
    known, n, _ = sparse.frequent_terms(vectors)
    plan = sparse.prefix_postings(vectors, 0.5, known, n)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
