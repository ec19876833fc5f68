import uuid

import pytest

from kinfold.operators import answers, content, embed
from kinfold.sources.worktable import work_folder
from support import as_set

PROMPTS = "group_id long, part int, prompt string"
FIELDS = "title string"


@pytest.fixture
def store(spark):
    return f"{work_folder(spark)}/answers-{uuid.uuid4().hex}"


def titled(failing=(), log=None):
    """A provider that raises for the prompts in ``failing`` and notes in a folder what it was asked."""

    def make():
        def call(texts):
            if log is not None:
                for text in texts:
                    (log / uuid.uuid4().hex).write_text(text)
            if any(t in failing for t in texts):
                raise TimeoutError("busy")
            return [{"title": t.upper()} for t in texts]

        return call

    return make


def asked(log):
    return sorted(p.read_text() for p in log.iterdir())


def test_second_run_asks_only_what_failed(rows, store, tmp_path):
    texts = [f"prompt {k}" for k in range(30)]
    prompts = rows([(k, 0, t) for k, t in enumerate(texts)], PROMPTS)
    first, second, third = (tmp_path / n for n in "abc")
    for folder in (first, second, third):
        folder.mkdir()
    answers.ask(prompts, titled(texts[::3], first), store, "m", in_flight=4)
    partial = answers.answered(prompts, store, "m", FIELDS)
    assert {r["group_id"] for r in partial.collect() if not r["complete"]} == set(range(0, 30, 3))
    answers.ask(prompts, titled((), second), store, "m")
    answers.ask(prompts, titled((), third), store, "m")
    assert asked(first) == sorted(texts) and asked(second) == sorted(texts[::3]) and asked(third) == []
    found = answers.answered(prompts, store, "m", FIELDS).collect()
    assert {(r["title"], r["tries"], r["complete"]) for r in found} == {
        (t.upper(), 2 if k % 3 == 0 else 1, True) for k, t in enumerate(texts)
    }


def test_equal_prompts_are_asked_once_and_models_apart(rows, store, tmp_path):
    prompts = rows([(1, 0, "same"), (2, 0, "same"), (2, 1, "other"), (3, 0, None)], PROMPTS)
    answers.ask(prompts, titled((), tmp_path), store, "m")
    assert asked(tmp_path) == ["other", "same"]
    assert answers.pending(prompts, store, "another").count() == 2
    found = as_set(answers.answered(prompts, store, "m", FIELDS).select("group_id", "part", "title", "complete"))
    assert found == {(1, 0, "SAME", True), (2, 0, "SAME", True), (2, 1, "OTHER", True), (3, 0, None, False)}


def test_a_prompt_that_always_fails_is_given_up(rows, store):
    prompts = rows([(1, 0, "bad"), (2, 0, "good")], PROMPTS)
    for _ in range(4):
        answers.ask(prompts, titled(["bad"]), store, "m", attempts=2)
    found = as_set(answers.answered(prompts, store, "m", FIELDS))
    assert found == {(1, 0, "bad", None, 2, False), (2, 0, "good", "GOOD", 1, True)}


def test_a_failing_batch_fails_alone_and_no_prompts_are_fine(rows, store):
    prompts = rows([(k, 0, str(k)) for k in range(6)], PROMPTS).coalesce(1)
    answers.ask(prompts, titled(["3"]), store, "m", batch=2)
    assert answers.pending(prompts, store, "m").count() == 2
    answers.ask(rows([], PROMPTS), titled(), store, "m")
    assert answers.answered(rows([], PROMPTS), store, "m", FIELDS).collect() == []


ROWS = "row_id long, text_to_compare string"


def test_changed_text_gets_a_new_vector(rows):
    provider = embed.HashedBigrams(8)
    before = rows([(1, "red car here"), (2, "blue car here"), (3, "blue car here")], ROWS)
    after = rows([(1, "green boat there"), (2, "blue car here"), (3, "blue car here"), (4, None)], ROWS)
    store = content.made(before, provider)
    assert store.count() == 2
    assert as_set(content.changes(after, store, provider)) == {(1, 1, 1)}
    merged = content.merged(after, store, provider)
    found = {r["row_id"]: r["embedding"] for r in content.embedded(after, merged, provider).collect()}
    fresh = {r["row_id"]: r["embedding"] for r in embed.embed_table(after, provider).collect()}
    assert found == fresh and set(found) == {1, 2, 3}


def test_only_lacking_texts_reach_the_provider(rows):
    class Marking(embed.HashedBigrams):
        def embed(self, df, text_col, out_col):
            assert {r[0] for r in df.select(text_col).collect()} == {"new text now"}
            return super().embed(df, text_col, out_col)

    plain = embed.HashedBigrams(8)
    store = content.made(rows([(1, "old text now")], ROWS), plain)
    after = rows([(1, "old text now"), (2, "new text now"), (3, "new text now")], ROWS)
    assert content.merged(after, store, Marking(8)).count() == 2


def test_a_new_version_replaces_the_store(rows):
    provider = embed.HashedBigrams(8)
    df = rows([(1, "some text here"), (2, "")], ROWS)
    store = content.made(df, provider, "1")
    assert as_set(content.changes(df, store, provider, "2")) == {(0, 2, 2)}
    merged = content.merged(df, store, provider, "2")
    assert {r["embedding_version"] for r in merged.collect()} == {"2"}
    assert content.merged(rows([], ROWS), store, provider).collect() == []
