import itertools

from support import as_set

from kinfold.operators import buckets, linkage, predicates
from kinfold.operators.predicates import FIRST_WORDS, MINHASH, PREFIX, Predicate


def test_pairs_of_small_rows_are_joined_in_as_many_tasks_as_pairs_ask_for(rows):
    """Before, tasks were told by the bytes of the rows, so few of them made all pairs."""
    postings = rows([(k, "hot" if k < 60 else f"t{k % 7}") for k in range(100)], "row_id long, term string")
    sized = buckets.with_bucket_size(postings)
    parts = buckets.task_count(sized, task_pairs=100)
    assert parts == -(-(60 * 60 + sum(n * n for n in (5, 6, 6, 6, 6, 6, 5))) // 200)
    got = buckets.bucket_pairs(sized, chunk=8, parts=parts)
    assert f"{parts}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    table = {r.row_id: r.term for r in postings.collect()}
    assert as_set(got) == {(i, j) for i, j in itertools.combinations(table, 2) if table[i] == table[j]}
    assert buckets.task_count(sized.limit(0)) > 0 and buckets.bucket_pairs(sized.limit(0), parts=2).isEmpty()


def test_a_text_is_cut_into_words_once(rows):
    records = rows([(1, "A b, c"), (2, None)], "record_id long, name string")
    used = [Predicate(PREFIX, "name", 2), Predicate(FIRST_WORDS, "name", 2), *(Predicate(MINHASH, "name", b) for b in (1, 2, 3))]
    found = predicates.own_keys(records, used)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert found.columns == ["record_id", "name", *(p.key for p in used)]


def test_words_of_a_few_large_files_are_cut_on_all_cores(spark):
    """Before, one task cut the texts of a file that is read as a whole."""
    records = spark.range(0, 200, 1, 1).selectExpr("id AS record_id", "concat('word', id % 3, ' w', id) AS name")
    plan = predicates.rarest_words(records, "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    assert as_set(predicates.rarest_words(records, "name")) == {(k, f"word{k % 3}") for k in range(200)}


def test_pairs_of_several_blocks_are_made_once_and_not_shuffled(rows):
    """Before, all pairs were shuffled to tell apart those of several blocks."""
    data = [(k, f"a{k % 3}", f"b{k % 4}" if k % 5 else None, f"t{k % 30}") for k in range(60)]
    records = rows(data, "record_id long, x string, y string, text string")
    got = linkage.block_pairs(records, [("x",), ("y",)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    posted = rows([(1, "t", 2), (2, "t", 2)], "row_id long, term string, size long")
    assert "Aggregate [i#" in plan(buckets.bucket_pairs(posted)) and "Aggregate [i#" not in plan(got)
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len({*pairs})
    firsts = {r[1:]: r[0] for r in reversed(data)}
    want = {(firsts[r[1:]], r[0]) for r in data if firsts[r[1:]] != r[0]}
    met = itertools.combinations([r for r in data if firsts[r[1:]] == r[0]], 2)
    want |= {(a[0], b[0]) for a, b in met if a[1] == b[1] or (a[2] is not None and a[2] == b[2])}
    assert {*pairs} == want


def test_pairs_of_repeated_ids_are_distinct(rows):
    data = [(1, "a", "b", "u"), (1, "a", "c", "v"), (2, "a", "b", "w"), (3, "d", "c", "x")]
    records = rows(data, "record_id long, x string, y string, text string")
    got = [tuple(r) for r in linkage.block_pairs(records, [("x",), ("y",)]).collect()]
    assert sorted(got) == [(1, 2), (1, 3)]
