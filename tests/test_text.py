from pyspark.sql import functions as F

from kinfold.functions.text import (
    clean_text,
    composite_key,
    contains_ignore_case,
    shorten,
    strip,
    text_to_compare,
    word_bigrams,
    words,
)
from kinfold.functions.vectors import bigram_vector, cosine, parse_vector, sparse_cosine, sparse_side


def one(rows, value, expression, kind="string"):
    return rows([(value,)], f"t {kind}").select(expression(F.col("t"))).first()[0]


def test_clean_text(rows):
    cases = {
        None: "",
        " ": "MISSING",
        "": "MISSING",
        "a\tb": "a b",
        "a\x0bb": "ab",
        "a b": "a b",
        "\x00": "MISSING",
        "  x \r\n y ": "x y",
    }
    for raw, want in cases.items():
        assert one(rows, raw, clean_text) == want, repr(raw)


def test_strip_knows_unicode_blanks(rows):
    assert one(rows, "  a b\n", strip) == "a b"


def test_text_to_compare(rows):
    df = rows(
        [(None, "d", "t"), ("x", None, "t"), ("x", "d", None)], "s string, d string, t string"
    )
    got = [r[0] for r in df.select(text_to_compare(F.col("s"), F.col("d"), F.col("t"))).collect()]
    assert got == [None, "x -  | Developed by t", "x - d | Developed by "]


def test_composite_key(rows):
    df = rows([(" a ", None, "c", "1")], "a string, b string, c string, d string")
    parts = [F.col(c) for c in "abcd"]
    assert df.select(composite_key(parts)).first()[0] == "a||||c||1"
    spaced = rows([("a \n b",)], "a string")
    assert spaced.select(composite_key([F.col("a")])).first()[0] == "a \n b"
    assert spaced.select(composite_key([F.col("a")], clean=True)).first()[0] == "a b"


def test_contains_takes_the_pattern_literally(rows):
    check = lambda v, p: one(rows, v, lambda c: contains_ignore_case(c, p))
    assert check("An ORG here", "org") is True
    assert check(None, "org") is False
    assert check("100 percent", "0%p") is False
    assert check("a_b", "A_B") is True
    assert check("axb", "a_b") is False


def test_shorten(rows):
    assert one(rows, "x" * 100, shorten) == "x" * 100
    assert one(rows, "x" * 101, shorten) == "x" * 100 + "..."


def test_bigrams_and_vectors(rows):
    df = rows([("A b, a B a",), ("one",), (None,)], "t string").select(
        word_bigrams(words(F.col("t"))).alias("b"), bigram_vector(words(F.col("t"))).alias("v")
    )
    full, short, absent = df.collect()
    assert full["b"] == ["a b", "b a", "a b", "b a"]
    assert sorted(full["v"]["counts"]) == [2, 2] and full["v"]["norm2"] == 8
    assert short["b"] == [] and short["v"]["norm2"] == 0
    assert absent["v"]["terms"] == []


def test_sparse_cosine_uses_counts(rows):
    df = rows([("a b a b a b c", "a b a b d"), ("one", "one two")], "x string, y string").select(
        sparse_cosine(
            sparse_side(bigram_vector(words(F.col("x")))), sparse_side(bigram_vector(words(F.col("y"))))
        )
    )
    # x: ab 3, ba 2, bc 1; y: ab 2, ba 1, bd 1
    got = [r[0] for r in df.collect()]
    assert abs(got[0] - 8 / (14**0.5 * 6**0.5)) < 1e-12
    assert got[1] == 0.0


def test_dense_cosine(rows):
    df = rows([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] == 0.0


def test_parse_vector(rows):
    assert one(rows, "[0.5, -1, 2e-1]", parse_vector) == [0.5, -1.0, 0.2]
