import json

import numpy as np
import pytest
from support import as_set
from pyspark.sql import functions as F

from kinfold.operators import dedup, embed, extract, linkage, review, sparse, unify
from kinfold.operators.linkage import STRING, FieldSpec
from kinfold.operators.ordinals import sliced, with_ordinal, with_part
from kinfold.plans import link
from kinfold.plans.queries import QUERIES
from kinfold.sources import files
from kinfold.sources.schemas import RELATIONSHIP_COLUMNS, RELATIONSHIP_HEADERS

REL = (
    "row_id long, document_number string, source_type string, source_id string, "
    "source_english_id string, source_description string, relationship_type string, "
    "relationship_description string, target_id string, target_english_id string, "
    "target_description string"
)


def rel(n, doc="1", kind="DEVELOPED_BY", **over):
    row = dict(
        row_id=n, document_number=doc, source_type="Innovation", source_id=f"P{n}",
        source_english_id=f"name {n}", source_description=f"text {n}", relationship_type=kind,
        relationship_description="line", target_id="S1", target_english_id="Org 1",
        target_description=None,
    )
    row.update(over)
    return tuple(row.values())


def test_type_filter_keeps_missing_types_and_spares_the_focus_domain(rows):
    data = [rel(n, source_type=t) for n, t in enumerate([None, "Organization", "Innovation"])]
    df = rows(data, REL)
    got = extract.combined(df, df).select("document_number", "row_id", "domain_order")
    assert as_set(got) == {
        ("FOC1", 0, 0), ("FOC1", 1, 0), ("FOC1", 2, 0), ("COMP1", 0, 1), ("COMP1", 2, 1),
    }
    assert extract.unfiltered(df, df).count() == 6


def test_focus_documents_take_whole_documents(rows):
    df = rows(
        [rel(1, "a", target_id="F1"), rel(2, "a"), rel(3, "b"), rel(4, "c", target_description="of MYORG")],
        REL,
    )
    got = extract.focus_documents(df, extract.Focus("F1", "myorg"))
    assert {r.row_id for r in got.collect()} == {1, 2, 4}


def test_null_descriptions_are_one_value(rows):
    df = rows([(3, None), (1, "a"), (2, None), (4, "a"), (5, "b"), (6, None)], "row_id long, d string")
    assert {r.row_id for r in dedup.first_of_each(df, "d").collect()} == {1, 2, 5}
    assert {r.row_id for r in dedup.all_duplicates(df, "d").collect()} == {1, 2, 3, 4, 6}


@pytest.mark.parametrize("slice_rows", [3, 1000])
def test_ordinals_do_not_depend_on_slices(rows, slice_rows):
    data = [(g, v) for g in (1, 2) for v in [5, 900, 6, 7, 2, 1000, 1, 3, 4, 8]] + [(3, 42)]
    got = with_ordinal(rows(data, "group_id long, row_id long"), slice_rows=slice_rows)
    for g in (1, 2, 3):
        values = sorted(v for h, v in data if h == g)
        found = {r.row_id: r.ordinal for r in got.where(F.col("group_id") == g).collect()}
        assert found == {v: n for n, v in enumerate(values, 1)}


def test_slices_follow_the_rows_and_not_the_values(rows):
    data = [(1, (p << 33) + k) for p in (0, 1, 700, 701, 1 << 20) for k in range(400)] + [(g, g) for g in range(2, 200)]
    df = rows(data, "group_id long, row_id long").repartition(4, "row_id")
    found, slices = sliced(df, "group_id", "row_id", 100)
    sizes = [r["count"] for r in found.groupBy("_slice").count().collect()]
    assert slices == 22 and len(sizes) >= 18 and max(sizes) <= 200 and sum(sizes) == len(data)
    got = with_ordinal(df, slice_rows=100).where("group_id = 1").collect()
    assert {r.row_id: r.ordinal for r in got} == {v: n for n, (g, v) in enumerate(sorted(data)[:2000], 1)}


def test_rows_without_a_group_have_no_ordinal(rows):
    df = rows([(1, 1), (None, 2), (1, 3), (None, 4)], "group_id long, row_id long")
    for slice_rows in (1, 100):
        assert as_set(with_ordinal(df, slice_rows=slice_rows)) == {(1, 1, 1), (1, 3, 2)}


def test_parts_hold_every_row(rows):
    df = rows([(1, n) for n in range(100)] + [(2, 1)], "group_id long, row_id long")
    got = with_part(df, "group_id", "row_id", 10).collect()
    assert len(got) == 101
    assert len({r.part for r in got if r.group_id == 1}) == 10
    assert {r.part for r in got if r.group_id == 2} == {0}


MEMBER = "group_id long, row_id long, source_english_id string, source_description string, text_to_compare string, relationship_description string"


def members(rows, ids, group=1, part_members=500):
    data = [(group, n, f"name {n}", "d" * (n % 30), f"text {n}", "line") for n in ids]
    return review.numbered_members(rows(data, MEMBER), part_members)


def test_prompt_numbers_members_in_id_order(rows):
    m = members(rows, [40, 7, 12])
    assert review.validation_prompts(m).first().prompt == "1. text 7\n\n2. text 12\n\n3. text 40\n\n"
    assert review.summary_prompts(m).first().prompt.split("\n")[0] == "1. name 7: ddddddd. line"
    parts = review.validation_prompts(members(rows, [40, 7, 12], part_members=2)).orderBy("part").collect()
    assert [r.prompt for r in parts] == ["1. text 7\n\n2. text 12\n\n", "3. text 40\n\n"]


def test_verdicts_name_ordinals(rows):
    m = members(rows, [40, 7, 12])
    wrong = review.flagged(rows([(1, 0, [2], "no")], review.VERDICT_SCHEMA))
    assert {r.row_id for r in review.apply_verdicts(m, wrong).collect()} == {7, 40}
    by_id = rows([(1, 12, "no")], "group_id long, ordinal int, reasoning string")
    assert {r.row_id for r in review.apply_verdicts(m, by_id, "member_id").collect()} == {7, 40}


def test_members_are_numbered_afresh_after_review(rows):
    wrong = rows([(1, 2, "")], "group_id long, ordinal int, reasoning string")
    kept = review.renumbered(review.apply_verdicts(members(rows, [40, 7, 12, 50]), wrong), 2)
    prompts = review.summary_prompts(kept).orderBy("part").collect()
    assert [[line.split(":")[0] for line in p.prompt.split("\n")] for p in prompts] == [["1. name 7", "2. name 40"], ["3. name 50"]]


@pytest.mark.parametrize("gone", [[1], [1, 2], []])
def test_header_is_whole_without_the_first_part(rows, gone):
    m = members(rows, [1, 2, 3, 4, 5, 6], part_members=2)
    wrong = rows([(1, n, "") for n in gone] or [(9, 1, "")], "group_id long, ordinal int, reasoning string")
    kept = review.apply_verdicts(m, wrong)
    relationships = rows([rel(1)], REL).withColumn("domain_order", F.lit(0))
    documents = unify.group_documents(kept, relationships)
    header = unify.unified_headers(kept, documents, relationships, "S1").collect()
    assert len(header) == 1
    assert (header[0].canonical_name, header[0].canonical_description) == ("name 6", "d" * 6)
    assert header[0].total_mentions == 6 - len(gone)


def test_part_summaries_are_reduced_to_one(rows):
    def make_model():
        def answer(prompts):
            return [{"title": p.split(": ")[0], "description": str(p.count("\n") + 1)} for p in prompts]

        return answer

    parts = [(1, n, f"t{n}", "d") for n in range(7)] + [(2, 3, "alone", "kept")]
    got = review.reduced_summaries(rows(parts, review.SUMMARY_SCHEMA), make_model, fan_in=3).collect()
    assert {r.group_id for r in got} == {1, 2} and len(got) == 2
    assert {(r.title, r.description) for r in got if r.group_id == 2} == {("alone", "kept")}


def test_group_left_with_one_member_disappears(rows):
    wrong = rows([(1, 1, ""), (1, 3, "")], "group_id long, ordinal int, reasoning string")
    assert review.apply_verdicts(members(rows, [40, 7, 12]), wrong).isEmpty()
    assert members(rows, [9]).isEmpty()


def test_model_runs_in_batches_with_typed_answers(rows):
    def make_model():
        def answer(prompts):
            assert len(prompts) <= 2
            return [{"false_positives": [len(prompts)], "reasoning": p[:8]} for p in prompts]

        return answer

    data = [(g, n, "n", "d", f"text {n}", "r") for g in range(5) for n in (g * 10, g * 10 + 1)]
    prompts = review.validation_prompts(review.numbered_members(rows(data, MEMBER))).coalesce(1)
    got = review.run_reviewer(prompts, make_model, batch=2).collect()
    assert len(got) == 5 and all(r.false_positives[0] in (1, 2) for r in got)
    assert {r.reasoning for r in got} == {f"1. text " for _ in range(5)}


def test_rule_review_keeps_the_canonical_member(rows):
    texts = [(1, "a b c d"), (2, "a b c d e"), (3, "p q r s")]
    data = [(1, n, f"name {n}", t, t, "r") for n, t in texts]
    df = rows(data, MEMBER)
    m = review.numbered_members(df)
    vectors = sparse.text_vectors(df, "row_id", "source_description")
    assert review.canonical_members(m).first().canonical_id == 2
    assert {r.ordinal for r in review.rule_verdicts(m, vectors, 0.7).collect()} == {3}


def test_canonical_member_with_missing_and_equal_descriptions(rows):
    data = [(1, 5, "n", None, "t", "r"), (1, 3, "n", None, "t", "r"), (2, 9, "n", "aa", "t", "r"), (2, 8, "n", "bb", "t", "r")]
    assert as_set(review.canonical_members(rows(data, MEMBER))) == {(1, 3), (2, 8)}


def organizations(rows, data, focus="S1"):
    relationships = rows(data, REL).withColumn("domain_order", F.lit(0))
    named = rows([(1, "name 1")], "group_id long, source_english_id string")
    documents = unify.group_documents(named, relationships)
    profiles = unify.organization_profiles(documents, relationships)
    role = unify.focus_roles(named, profiles, focus).first().focus_role
    return {r.org_id: r for r in profiles.collect()}, role, relationships


def test_self_collaboration_is_two_mentions_of_one_organization(rows):
    orgs, role, relationships = organizations(
        rows,
        [rel(1), rel(2, kind="COLLABORATION", source_id="S9", source_english_id="A", target_id="S9", target_english_id="B")],
    )
    assert (orgs["S9"].mentions, orgs["S9"].collaboration, orgs["S9"].name) == (2, True, "A")
    assert [r.collaboration_partner for r in unify.collaborations(relationships).collect()] == ["B", "B"]
    assert role == "developer"


def test_roles(rows):
    both = [rel(1), rel(2, kind="COLLABORATION", source_id="S1", source_english_id="X", target_id="S2")]
    orgs, role, _ = organizations(rows, both)
    assert role == "developer+collaborator" and orgs["S1"].developed_by and orgs["S1"].collaboration
    assert organizations(rows, both, "S2")[1] == "collaborator"
    assert organizations(rows, both, "S3")[1] == "unknown"


def test_other_documents_and_other_types_do_not_count(rows):
    orgs, _, _ = organizations(rows, [rel(1), rel(2, "2", target_id="S5"), rel(3, kind="USES", target_id="S6"), rel(4, target_id="S7")])
    assert orgs.keys() == {"S1", "S7"}


def test_unified_records_are_whole_in_parts(rows):
    data = [rel(1), rel(2)] + [
        rel(n, kind="COLLABORATION", source_id="S1", source_english_id="X", target_id=f"S{n}") for n in range(10, 60)
    ]
    relationships = rows(data, REL).withColumn("domain_order", F.lit(0))
    m = members(rows, [1, 2])
    documents = unify.group_documents(m, relationships)
    for size in (10, 1000):
        got = unify.unified_records(m, review.rule_summaries(m), documents, relationships, "S1", size)
        parts = got.collect()
        assert sum(len(r.aliases or []) for r in parts) == 2
        partners = [
            x.collaboration_partner for r in parts for o in r.collaborators or [] if o.org_id == "S1" for x in o.mentions
        ]
        # two developer mentions and fifty collaborations
        assert len(partners) == 52
        assert {o.org_id for r in parts for o in r.collaborators or []} == {"S1"} | {f"S{n}" for n in range(10, 60)}
        assert {r.focus_role for r in parts} == {"developer+collaborator"}
        assert (len(parts) == 1) == (size == 1000)


def test_unified_records_take_a_models_titles(rows):
    relationships = rows([rel(1), rel(2)], REL).withColumn("domain_order", F.lit(0))
    m = members(rows, [1, 2])
    documents = unify.group_documents(m, relationships)
    group = m.first()["group_id"]
    titles = rows([(group, "A model's title", "said in full")], "group_id long, title string, description string")
    got = unify.unified_records(m, review.rule_summaries(m), documents, relationships, "S1", titles=titles)
    assert {r.canonical_name for r in got.collect()} == {"A model's title"}


def test_network_filters(rows):
    df = rows([rel(1), rel(2, "2", source_id="P1"), rel(3, kind="USES", source_id=None)], REL)
    assert as_set(unify.network_edges(df)) == {("P1", "S1", "DEVELOPED_BY", 2, 2)}
    assert unify.network_edges(df, ["USES"]).isEmpty()
    assert {r.node_id for r in unify.network_nodes(df, ["Organization"]).collect()} == {"S1"}


def test_key_completeness(rows):
    df = rows([("a", "b", "c"), (" ", "b", "c"), (None, "b", "c"), ("a", "b", " ")], "source_id string, source_english_id string, source_description string")
    assert linkage.key_complete(df).count() == 1
    assert tuple(linkage.key_complete_stats(df).first()) == (4, 1, 3)


def test_nul_violations(rows):
    df = rows([(1, "a\x00", "b"), (2, "a", None)], "record_id long, x string, y string")
    assert as_set(linkage.nul_violations(df)) == {(1, "x")}


def test_minimum_size(rows):
    for n, want in [(0, "none"), (1, "none"), (2, "few"), (9, "few"), (10, "ok"), (40, "ok")]:
        assert linkage.enough_records(rows([(i,) for i in range(n)], "record_id long")) == want
    empty = rows([], "record_id long, source_description string")
    assert link.link(empty).report.isEmpty()


def test_sample_size():
    assert [linkage.sample_size(n) for n in (0, 2, 5, 1000)] == [0, 0, 5, 15000]


RECORD = "record_id long, source_description string, document_number string"
SPECS = [FieldSpec("source_description"), FieldSpec("document_number", STRING)]


def test_pair_features(rows):
    records = rows([(1, "a b c", "doc1"), (2, "a b d", "doc2"), (3, "MISSING", ""), (4, "a b c", "doc1")], RECORD)
    pairs = rows([(1, 2), (1, 3), (1, 4)], "i long, j long")
    got = {(r.i, r.j): tuple(r)[2:] for r in linkage.pair_features(pairs, records, SPECS).collect()}
    assert got[1, 2] == (pytest.approx(0.5), 0, 0.75, 0)
    assert got[1, 3] == (0.0, 1, 0.0, 1) and got[1, 4] == (1.0, 0, 1.0, 0)


def test_copies_are_candidates_with_each_other(rows):
    same = "same words in this text"
    data = [(n, same, f"d{n}") for n in range(20)] + [(30, "same words in this note", "d"), (31, "something else", "d")]
    got = as_set(linkage.candidate_pairs(rows(data, RECORD), [("source_description",)]).select("i", "j"))
    assert got == {(a, b) for a in range(20) for b in range(a + 1, 20)} | {(0, 30)}


BLOCKED = "record_id long, source_description string, target_id string, document_number string"


def test_records_of_a_block_are_candidates_whatever_the_first_record_is(rows):
    same = "same words in this text"
    data = [(1, same, "a", "d1"), (2, same, "b", "d2"), (3, same, "b", "d2"), (4, same, "b", "d3"), (5, same, None, "d3")]
    data += [(6, "quite another one", "b", "d2"), (7, None, "b", "d2"), (8, None, "b", "d2")]
    records = rows(data, BLOCKED)
    plain = as_set(linkage.candidate_pairs(records, []).select("i", "j"))
    found = linkage.candidate_pairs(records, blocks=linkage.BLOCKS)
    assert as_set(found.select("i", "j")) - plain == {(2, 3), (2, 4), (4, 5)}
    assert {r.cosine for r in found.where("i = 2").collect()} == {1.0}
    apart = linkage.candidate_pairs(records, blocks=[("target_id",)])
    assert {(r.i, r.j): r.cosine for r in apart.where("j = 6").collect()} == {(2, 6): 0.0, (4, 6): 0.0}
    assert linkage.block_pairs(records.limit(0), linkage.BLOCKS).isEmpty()


def test_blocks_of_many_rows_lose_no_pair(rows):
    data = [(n, "text", f"t{n % 2}", f"d{n // 40}") for n in range(120)]
    records = rows(data, BLOCKED)
    classes = {}
    for n, *values in data:
        classes.setdefault(tuple(values), []).append(n)
    heads = {v[0]: k for k, v in classes.items()}
    want = {(v[0], n) for v in classes.values() for n in v[1:]}
    want |= {(a, b) for a in heads for b in heads if a < b and (heads[a][1] == heads[b][1] or heads[a][2] == heads[b][2])}
    assert as_set(linkage.block_pairs(records, linkage.BLOCKS)) == want


@pytest.mark.parametrize("slices", [1, 4, 64])
@pytest.mark.parametrize("beta", [0.5, 1.0, 2.0])
def test_optimal_threshold_equals_a_plain_scan(rows, slices, beta):
    rng = np.random.default_rng(5)
    scores = np.concatenate([np.round(rng.random(80), 2), np.full(60, 0.97)])
    ordered = np.sort(scores)[::-1]
    expected, k = ordered.cumsum(), np.arange(1, len(ordered) + 1)
    recall, precision = expected / expected[-1], expected / k
    value = (1 + beta**2) * precision * recall / (beta**2 * precision + recall)
    df = rows([(float(s),) for s in scores], "score double")
    got = linkage.optimal_threshold(df, beta, slices).first()
    assert got.threshold == pytest.approx(ordered[value.argmax()])
    assert got.value == pytest.approx(value.max())


def test_threshold_rule(rows):
    df = rows([(0.9,), (0.1,)], "score double")
    assert linkage.choose_threshold(df, 0.3) == 0.3
    assert linkage.choose_threshold(df, trained_now=False) == 0.5
    assert linkage.choose_threshold(df) == pytest.approx(0.9)


def test_partition(rows):
    records = rows([(n,) for n in range(1, 6)], "record_id long")
    scored = rows([(1, 2, 0.9), (2, 3, 0.7), (4, 5, 0.5)], "i long, j long, score double")
    got = {r.record_id: (r.cluster_id, r.confidence_score) for r in linkage.partition(records, scored, 0.5).collect()}
    assert got[1] == (1, 0.9) and got[2] == (1, pytest.approx(0.8)) and got[3] == (1, 0.7)
    assert got[4] == (4, 1.0) and got[5] == (5, 1.0)
    assert linkage.partition(records, scored, 0.5, singletons=False).count() == 3


def test_linkage_run_separates_labelled_copies(rows, spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    data = []
    for n in range(12):
        text = " ".join(f"{w}{n}" for w in words)
        data += [(2 * n, text, f"doc{n}"), (2 * n + 1, text + " more", f"doc{n}")]
    records = rows(data, RECORD)
    for c in ("source_company", "source_id", "source_english_id", "target_english_id"):
        records = records.withColumn(c, F.lit("x"))
    labels = rows(
        [(2 * n, 2 * n + 1, True) for n in range(6)] + [(2 * n, 2 * n + 2, False) for n in range(6)],
        "i long, j long, is_match boolean",
    )
    run = link.link(records, labels, fields=SPECS)
    clusters = {r.record_id: r.cluster_id for r in run.report.collect()}
    assert all(clusters[2 * n] == clusters[2 * n + 1] == 2 * n for n in range(12))
    files.save_model(run.model, str(tmp_path / "model"))
    again = link.link(records, model=files.load_model(str(tmp_path / "model")), fields=SPECS)
    assert again.threshold == 0.5 and again.report.count() == 24


def test_label_candidates_are_the_least_sure_open_pairs(rows):
    scored = rows([(1, 2, 0.5), (1, 3, 0.55), (1, 4, 0.9)], "i long, j long, score double")
    labelled = rows([(1, 2)], "i long, j long")
    assert [r.j for r in linkage.label_candidates(scored, labelled, 1).collect()] == [3]


def test_provider_batches_and_metadata(rows):
    def make_encoder():
        def encode(texts):
            assert len(texts) <= 3
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    df = rows([(n, "x" * n) for n in range(8)] + [(9, None)], "row_id long, text_to_compare string").coalesce(1)
    got = embed.embed_table(df, embed.BatchProvider("lengths", make_encoder, batch=3)).orderBy("row_id").collect()
    assert [r.embedding for r in got] == [[float(n), 1.0] for n in range(8)]
    assert {(r.embedding_provider, r.embedding_dimension) for r in got} == {("lengths", 2)}
    assert embed.embed_table(df.limit(0), embed.HashedBigrams(8)).isEmpty()


def test_stored_embeddings_are_reused(rows):
    df = rows([(1, "a b"), (2, "c d")], "row_id long, text_to_compare string")
    stored = embed.embed_table(df.where("row_id = 1"), embed.HashedBigrams(8)).withColumn("embedding_provider", F.lit("old"))
    names = lambda d: {r.row_id: r.embedding_provider for r in d.collect()}
    assert names(embed.embed_missing(df, stored, embed.HashedBigrams(8))) == {1: "old", 2: "hashed_bigrams_8"}
    assert set(names(embed.embed_missing(df, stored, embed.HashedBigrams(8), recreate=True)).values()) == {"hashed_bigrams_8"}


def test_projection_is_centred_and_has_stable_signs(rows):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((60, 4)) * [5, 2, 1, 0.5] + 10
    df = rows([(n, v.tolist()) for n, v in enumerate(data)], "row_id long, embedding array<double>")
    points, ratios = embed.project_2d(df)
    centred = data - data.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in axes[:2]]
    got = np.array([[r.x, r.y] for r in points.orderBy("row_id").collect()])
    assert np.allclose(got, centred @ np.array(axes).T)
    assert np.allclose(ratios, (s**2 / (s**2).sum())[:2])
    assert embed.project_2d(df, limit=10)[0].count() == 10


def test_csv_round_trip(rows, spark, tmp_path):
    data = [rel(1, source_description='say "hi",\nthere'), rel(2, source_description=None)]
    df = rows(data, REL)
    headed = df.select(*[F.col(c).alias(h) for c, h in zip(RELATIONSHIP_COLUMNS, RELATIONSHIP_HEADERS, strict=True)])
    files.write_csv(headed, str(tmp_path / "rel"))
    back = files.read_relationships(spark, str(tmp_path / "rel"))
    assert as_set(back) == as_set(df.select(*RELATIONSHIP_COLUMNS))
    files.write_csv(df.select("row_id", F.array("source_id", F.lit(None)).alias("ids")), str(tmp_path / "nested"))
    nested = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "nested"))
    assert json.loads(nested.where("row_id = 1").first().ids) == ["P1", None]
    with pytest.raises(ValueError, match="source id"):
        files.write_csv(headed.drop("source id"), str(tmp_path / "short"))
        files.read_relationships(spark, str(tmp_path / "short"))


def test_nan_becomes_null(rows):
    df = rows([([(float("nan"), "x")], float("nan"))], "a array<struct<v:double,t:string>>, b double")
    assert files.scrub_nan(df).first().a[0].v is None and files.scrub_nan(df).first().b is None


def test_cluster_and_label_json(spark, tmp_path):
    row = dict.fromkeys(RELATIONSHIP_HEADERS, "x")
    path = tmp_path / "clusters.json"
    path.write_text(json.dumps([[row, row], [row]], indent=2))
    got = files.read_clusters(spark, str(path))
    assert sorted((r.cluster_id, r.position) for r in got.collect()) == [(0, 0), (0, 1), (1, 0)]
    path = tmp_path / "labels.json"
    pair = [{"source_id": "a"}, {"source_id": "b"}]
    path.write_text(json.dumps({"match": [{"__class__": "tuple", "__value__": pair}, pair], "distinct": []}))
    labels = files.read_labelled_pairs(spark, str(path))
    assert [[i.source_id for i in r["items"]] for r in labels.collect()] == [["a", "b"], ["a", "b"]]
    files.write_labelled_pairs(labels, str(tmp_path / "saved"))
    assert as_set(files.read_saved_labels(spark, str(tmp_path / "saved")).select("is_match", "entry")) == {(True, 0), (True, 1)}


def test_missing_file_is_an_error(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        link.link_file(spark, "/tmp/no-such-file.csv")


def test_scored_pairs_hold_every_pair_of_a_block(rows, spark, tmp_path):
    """Two further copies of a text in one document are scored, though the first copy is elsewhere."""
    same = "the very same words stand in this text"
    data = [(1, same, "x", "a"), (2, same, "x", "b"), (3, same, "y", "b"), (4, same, "y", "c")]
    data += [(k, f"quite another text number {k} about {k * k}", "x", "a") for k in range(5, 12)]
    docs = rows([(*r, len(r[1])) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = as_set(QUERIES["D_pair_scores"](spark, str(tmp_path)).select("i", "j"))
    assert {(1, 2), (1, 3), (1, 4), (2, 3)} <= pairs and (2, 4) not in pairs


def test_linkage_run_compares_seven_fields(spark):
    report = QUERIES["R_linkage_run"](spark, "/root/testdata/sf0.001")
    ids = [r.record_id for r in report.collect()]
    records = QUERIES["R_linkage_records"](spark, "/root/testdata/sf0.001")
    assert sorted(ids) == sorted(r.record_id for r in records.collect())
    assert 1 < report.select("cluster_id").distinct().count() < len(ids)
