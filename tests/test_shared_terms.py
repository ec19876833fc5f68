"""What prefixes have in common bounds pairs once more, and shuffle files of written tables."""

import collections
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F
from support import as_set

from kinfold.operators import sparse
from kinfold.sources import worktable


def cosine(a, b):
    x, y = (collections.Counter(itertools.pairwise(t.split())) for t in (a, b))
    length = sum(n * n for n in x.values()) * sum(n * n for n in y.values())
    return sum(n * y[t] for t, n in x.items()) / length**0.5 if length else 0.0


def drawn(seed, n=90):
    """Variants of a few texts, so that cosines lie on both sides of any threshold."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(40)] for _ in range(4)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(40)] = f"x{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


def vectors_of(rows, data):
    return sparse.text_vectors(rows(data, "id long, text string"), "id", "text")


def test_texts_with_one_term_in_common_are_no_candidates(rows):
    """Before, long texts that met in one rare term were compared."""
    texts = [(k, " ".join(["same start", *(f"t{k}x{n}" for n in range(60))])) for k in range(9)]
    texts.append((9, texts[0][1] + " end"))
    vectors = vectors_of(rows, texts)
    got = sparse._prefix_pairs(*sparse._split_postings(vectors, 0.5, 2048), 0.5, 2048)
    assert as_set(got) == {(0, 9)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9])
@pytest.mark.parametrize("chunk", [4, 2048])
def test_no_pair_is_lost_by_the_terms_in_common(rows, threshold, chunk):
    data = drawn(3)
    got = as_set(sparse.similar_pairs(vectors_of(rows, list(enumerate(data))), threshold, chunk).select("i", "j"))
    scores = {(i, j): cosine(data[i], data[j]) for i, j in itertools.combinations(range(len(data)), 2)}
    assert {p for p, s in scores.items() if s > threshold + 1e-9} <= got
    assert got <= {p for p, s in scores.items() if s > threshold - 1e-9}


def test_rows_that_share_an_id_lose_no_pair(rows):
    data = [(k % 40, text) for k, text in enumerate(drawn(8))]
    got = as_set(sparse.similar_pairs(vectors_of(rows, data), 0.6).select("i", "j"))
    met = [(min(i, j), max(i, j), cosine(a, b)) for (i, a), (j, b) in itertools.combinations(data, 2) if i != j]
    assert {(i, j) for i, j, s in met if s > 0.6 + 1e-9} <= got <= {(i, j) for i, j, s in met if s > 0.6 - 1e-9}


def test_shuffle_files_go_when_a_table_is_written(spark):
    """Before, they stayed until the driver collected garbage."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for name in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before, set_before = shuffles(), spark.conf.get(worktable.CLEANUP)
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(r.k for r in worktable.materialize(rows).collect()) == [*range(7)]
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(worktable.CLEANUP) == set_before
