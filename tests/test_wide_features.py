import pytest
from support import as_set

from kinfold.operators import linkage
from kinfold.operators.linkage import STRING, FieldSpec

FIELDS = [FieldSpec("text"), FieldSpec("name", STRING)]
LONG = " ".join(f"w{n}" for n in range(90))


def test_long_texts_are_scored_apart_from_the_pairs(spark, monkeypatch):
    data = [
        (1, LONG, "ab"), (2, LONG + " x", "ab"), (3, LONG, "ac"), (4, "", "x"), (5, None, "y"), (6, "MISSING", None),
        (7, "a b c", "ab"), (8, "a b d", "b"), (8, "a b c", "b"), (9, "word", "b"),
    ]
    records = spark.createDataFrame(data, "record_id long, text string, name string")
    names = [(i, j) for i in range(1, 10) for j in range(i + 1, 10)] + [(1, 2)]
    pairs = spark.createDataFrame(names, "i long, j long")
    sent, score = [], linkage.sparse.score_pairs
    monkeypatch.setattr(linkage.sparse, "score_pairs", lambda p, v: sent.append(p) or score(p, v))

    def features(terms):
        monkeypatch.setattr(linkage, "INLINE_TERMS", terms)
        return sorted(map(str, linkage.pair_features(pairs, records, FIELDS).collect()))

    inline = features(10**6)
    assert not sent
    assert features(0) == inline
    assert len(sent) == 1


def test_a_stand_in_is_equal_where_texts_are(rows):
    texts = ["", "a", "b" * 63, "b" * 64, "b" * 65, None]
    found = rows([(t,) for t in texts * 2], "t string").select(linkage._stand_in(linkage.F.col("t")))
    got = as_set(found)
    assert len(got) == len(texts) and all(t is None or len(t) <= 64 for (t,) in got)


@pytest.mark.parametrize("terms", [0, 10**6])
def test_no_pairs(spark, monkeypatch, terms):
    monkeypatch.setattr(linkage, "INLINE_TERMS", terms)
    records = spark.createDataFrame([(1, LONG, "a")], "record_id long, text string, name string")
    assert linkage.pair_features(spark.createDataFrame([], "i long, j long"), records, FIELDS).isEmpty()
