from kinfold.operators import embed


def test_terms_of_a_text_are_counted_where_it_stands(rows):
    data = [(1, "a b a b c"), (2, "a b"), (2, "A b!"), (None, "a b"), (None, "a b"), (3, None), (4, "one"), (5, "")]
    got = embed.text_terms(rows(data, "id long, text string"), "id", "text")
    want = {(1, "a b", 2), (1, "b a", 1), (1, "b c", 1), (2, "a b", 2), (None, "a b", 2)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    alone = embed.text_terms(rows(data[:2], "id long, text string"), "id", "text")
    assert "Aggregate" not in alone._jdf.queryExecution().executedPlan().toString()
