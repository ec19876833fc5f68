import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import scoring, sparse


def cosine(a, b):
    product = sum(n * b.get(t, 0) for t, n in a.items())
    length = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
    return product / length if length else 0.0


@pytest.fixture(scope="module")
def drawn(spark):
    """Vectors whose terms agree in their low 16 bits, repeated terms, an empty one, and an id that occurs twice."""
    rng = random.Random(5)
    data = []
    for n in range(40):
        terms = sorted({rng.randrange(8) + (rng.randrange(4) << 40) for _ in range(12)})
        data.append((n, {t: rng.choice([1, 1, 1, 4]) for t in terms}))
    data += [(40, {}), (3, {1: 2, 5: 1})]
    rows = [(n, sorted(v), [v[t] for t in sorted(v)], sum(c * c for c in v.values())) for n, v in data]
    df = spark.createDataFrame(rows, "row_id long, terms array<long>, counts array<int>, norm2 long")
    return data, df.select("row_id", F.struct("terms", "counts", "norm2").alias("vec"))


@pytest.mark.parametrize("above", [None, 0.3, 0.7])
def test_scores_equal_brute_force(spark, drawn, above):
    data, vectors = drawn
    names = list(itertools.combinations(range(41), 2))
    want = sorted(
        (i, j, round(cosine(a, b), 12))
        for i, j in names
        for m, a in data
        for n, b in data
        if (m, n) == (i, j) and (above is None or cosine(a, b) > above)
    )
    got = scoring.score_pairs(spark.createDataFrame(names, "i long, j long"), vectors, above).collect()
    assert sorted((r.i, r.j, round(r.score, 12)) for r in got) == want


def test_a_vector_is_sent_once_for_each_block_and_not_for_each_pair(spark):
    pairs = spark.range(1, 3001).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"))
    rows = spark.range(3001).select(F.col("id").alias("row_id"), F.lit(1).alias("payload"))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(scoring.LEAST_BLOCKS))
    placed, needed = scoring._dealt(pairs, rows, block("i"), block("j"))
    assert placed.count() == 3000
    assert needed.where("row_id = 0").count() <= scoring.LEAST_BLOCKS
    assert needed.count() <= 3000 + scoring.LEAST_BLOCKS
