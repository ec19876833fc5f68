"""Every operator as a query over the driver's tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.text import clean_text, composite_key
from kinfold.functions.vectors import cosine, parse_vector
from kinfold.operators import (
    agglomerate,
    anchors,
    answers,
    content,
    dedup,
    dense,
    embed,
    evaluate,
    extract,
    forest,
    linkage,
    predicates,
    review,
    sparse,
    stats,
    sweep,
    unify,
)
from kinfold.operators.linkage import STRING, FieldSpec
from kinfold.operators.predicates import FIRST_WORDS, MINHASH, PREFIX, RARE, WHOLE, Predicate
from kinfold.plans import link, resolve
from kinfold.sources import testbed
from kinfold.sources.files import json_columns
from kinfold.sources.worktable import materialize, work_folder

Query = Callable[[SparkSession, str], DataFrame]

R_THRESHOLD = 0.7
R_REVIEW = 0.7
D_THRESHOLD = 0.8
D_EVALUATED = 0.9
D_LINK = 0.9
D_CANDIDATES = 0.5
V_THRESHOLD = 0.4
D_LEVELS = sweep.threshold_list(0.6, 0.99, 30)
V_LEVELS = sweep.threshold_list(0.36, 0.6, 30)
D_FIELDS = [FieldSpec("source_description"), FieldSpec("document_number", STRING)]
D_BLOCKS = [("source_description",)]
D_DOCUMENT_BLOCKS = [("source_description", "document_number")]
D_AVERAGE = 0.7
D_PREDICATES = [
    Predicate(WHOLE, "source_description"),
    Predicate(PREFIX, "source_description", 8),
    Predicate(PREFIX, "source_description", 20),
    Predicate(FIRST_WORDS, "source_description", 5),
    Predicate(RARE, "source_description"),
    Predicate(WHOLE, "document_number"),
]
D_BANDS = [Predicate(MINHASH, "source_description", band) for band in range(1, 7)]
SAMPLED_GROUPS = 5
ASKED_PAIRS = 20

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- shared stages -----------------------------------------------------------------------------


def _combined(spark, folder):
    return extract.combined(*testbed.domains(spark, folder))


def _written_domains(spark, folder):
    """Both domains of relationships that are joined and written once."""
    return testbed.by_domain(materialize(testbed.relationships(spark, folder), "relationships"))


def _unfiltered(spark, folder):
    return extract.unfiltered(*testbed.domains(spark, folder))


def _resolution(spark, folder) -> resolve.Resolution:
    return resolve.resolve(_combined(spark, folder), R_THRESHOLD)


def _validated(spark, folder) -> DataFrame:
    return resolve.validated(_resolution(spark, folder), R_REVIEW)


def _raw_documents(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups before review, their documents, and all relationships."""
    domains = _written_domains(spark, folder)
    run = resolve.resolve(extract.combined(*domains), R_THRESHOLD)
    relationships = extract.unfiltered(*domains)
    placed = run.groups.select("group_id", F.col("member_id").alias("row_id"))
    named = placed.join(run.rows.select("row_id", "source_english_id"), "row_id")
    documents = materialize(unify.group_documents(named, relationships), "documents")
    return run.groups, documents, relationships


def _unified(spark, folder):
    domains = _written_domains(spark, folder)
    relationships = extract.unfiltered(*domains)
    kept = resolve.validated(resolve.resolve(extract.combined(*domains), R_THRESHOLD), R_REVIEW)
    return (*resolve.unified_inputs(kept, relationships), relationships)


def _first_texts(spark, folder):
    return dedup.first_of_each(testbed.text_records(spark, folder), "source_description")


def _text_vectors(rows: DataFrame) -> DataFrame:
    return sparse.text_vectors(rows, "row_id", "source_description")


def _first_pairs(spark, folder, threshold: float) -> DataFrame:
    return sparse.similar_pairs(_text_vectors(_first_texts(spark, folder)), threshold)


def _d_groups(spark, folder, threshold: float) -> DataFrame:
    return sparse.similar_groups(_text_vectors(testbed.text_records(spark, folder)), threshold)


def _clusters(spark, folder) -> DataFrame:
    groups = _d_groups(spark, folder, D_EVALUATED)
    return evaluate.item_clusters(groups.toDF("cluster_id", "item_key"))


def _judged(spark, folder) -> DataFrame:
    return evaluate.judged_pairs(testbed.labelled_pairs(spark, folder), _clusters(spark, folder))


def _item_texts(spark, folder) -> DataFrame:
    return testbed.table(spark, folder, "documents").select(F.col("doc_id").alias("item_key"), "text")


def _d_records(spark, folder) -> DataFrame:
    return testbed.text_records(spark, folder).withColumnRenamed("row_id", "record_id")


def _d_scored(spark, folder, above: float | None = None, linked: float | None = None) -> DataFrame:
    """Candidates with their cosine standing in for a match probability; with ``above``, those that exceed it.

    With ``linked``, those of texts that cosines above it connect.
    """
    pairs = linkage.candidate_pairs(
        _d_records(spark, folder), D_BLOCKS, min_cosine=D_CANDIDATES, above=above, linked=linked
    )
    return pairs.select("i", "j", F.col("cosine").alias("score"))


def _d_clusters(spark, folder) -> DataFrame:
    records = _d_records(spark, folder)
    return linkage.partition(records, _d_scored(spark, folder, above=D_LINK), D_LINK).join(
        records.select("record_id", "document_number", "source_company"), "record_id"
    )


def _d_labels(spark, folder) -> DataFrame:
    return testbed.labelled_pairs(spark, folder).toDF("is_match", "i", "j")


# --- A sources -----------------------------------------------------------------------------------


@query
def R_relationships(spark, folder):
    return testbed.relationships(spark, folder)


@query
def V_parse_vectors(spark, folder):
    text = testbed.vectors(spark, folder).select("row_id", F.to_json("embedding").alias("text"))
    vector = parse_vector(F.col("text"))
    parsed = text.select("row_id", vector.alias("v"))
    return parsed.select(
        "row_id",
        F.size("v").cast("long").alias("dimension"),
        F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x), 4).alias("total"),
    )


@query
def D_embed_incremental(spark, folder):
    rows = testbed.text_records(spark, folder).select(
        "row_id", F.col("source_description").alias("text_to_compare")
    )
    provider = embed.HashedBigrams()
    stored = embed.embed_table(
        rows.where(F.length("text_to_compare") >= 1000), provider
    ).withColumn("embedding_provider", F.lit("stored"))
    merged = embed.embed_missing(rows, materialize(stored, "stored"), provider)
    return merged.select("row_id", "embedding_provider", "embedding_dimension")


def _content_store(spark, folder) -> tuple[DataFrame, DataFrame, embed.EmbeddingProvider]:
    """Texts, and a store made when odd documents were drafts, so that their texts have changed since."""
    rows = testbed.text_records(spark, folder).select(
        "row_id", F.col("source_description").alias("text_to_compare")
    )
    draft = F.concat("text_to_compare", F.lit(" (draft)"))
    before = rows.withColumn(
        "text_to_compare", F.when(F.col("row_id") % 2 == 0, F.col("text_to_compare")).otherwise(draft)
    )
    provider = embed.HashedBigrams(64)
    return rows, materialize(content.made(before, provider), "store"), provider


@query
def D_embed_changes(spark, folder):
    return content.changes(*_content_store(spark, folder))


@query
def D_embed_content(spark, folder):
    """Every row with the store's state before and after the merge."""
    rows, store, provider = _content_store(spark, folder)
    after = materialize(content.merged(rows, store, provider), "merged")
    found = content.embedded(rows, after, provider)
    known = store.select("text_digest", F.lit(True).alias("_known"))
    return found.join(known, "text_digest", "left").select(
        "row_id",
        "text_digest",
        F.col("_known").isNotNull().alias("reused"),
        "embedding_dimension",
    )


# --- B filters and projections -------------------------------------------------------------------


@query
def R_combined(spark, folder):
    return _combined(spark, folder)


@query
def R_text_to_compare(spark, folder):
    return _combined(spark, folder).select("row_id", "text_to_compare")


@query
def R_unfiltered(spark, folder):
    return _unfiltered(spark, folder)


@query
def R_focus_documents(spark, folder):
    _, comparison = testbed.domains(spark, folder)
    rows = extract.developed_by(comparison, extract.COMPARISON_DOMAIN)
    return extract.focus_documents(rows, testbed.FOCUS).select(
        "row_id", "document_number", "target_id", "target_english_id"
    )


@query
def R_key_complete(spark, folder):
    rows = linkage.key_complete(linkage.innovations(_combined(spark, folder)))
    return rows.select("row_id", *linkage.KEY_FIELDS)


@query
def R_key_complete_stats(spark, folder):
    return linkage.key_complete_stats(linkage.innovations(_combined(spark, folder)))


@query
def R_linkage_records(spark, folder):
    return linkage.linkage_records(_combined(spark, folder))


@query
def R_nul_violations(spark, folder):
    return linkage.nul_violations(linkage.linkage_records(_combined(spark, folder)))


@query
def R_clean_text(spark, folder):
    columns = ["source_description", "target_english_id", "target_description"]
    return _unfiltered(spark, folder).select("row_id", *[clean_text(F.col(c)).alias(c) for c in columns])


@query
def D_clean_text(spark, folder):
    cleaned = clean_text(F.col("source_description"))
    return testbed.text_records(spark, folder).select("row_id", cleaned.alias("cleaned"))


@query
def E_composite_key(spark, folder):
    parts = ["source_id", "source_description", "target_id", "document_number"]
    key = composite_key([F.col(c) for c in parts])
    return _unfiltered(spark, folder).select("row_id", key.alias("item_key"))


@query
def V_embedding_metadata(spark, folder):
    rows = embed.with_metadata(testbed.vectors(spark, folder), "table")
    return rows.select("row_id", "embedding_provider", "embedding_dimension")


# --- C pairs -------------------------------------------------------------------------------------


@query
def V_similar_pairs(spark, folder):
    return rounded(dense.similar_pairs(testbed.vectors(spark, folder), V_THRESHOLD), "score")


@query
def V_similar_pairs_pruned(spark, folder):
    plan = anchors.planned(testbed.vectors(spark, folder), V_THRESHOLD)
    return rounded(anchors.similar_pairs(plan, V_THRESHOLD), "score")


@query
def V_groups_pruned(spark, folder):
    plan = anchors.planned(testbed.vectors(spark, folder), V_THRESHOLD)
    return anchors.similar_groups(plan, V_THRESHOLD)


@query
def D_similar_pairs(spark, folder):
    return rounded(_first_pairs(spark, folder, 0.6), "score")


@query
def D_similar_pairs_lsh(spark, folder):
    vectors = _text_vectors(_first_texts(spark, folder))
    return rounded(sparse.hashed_pairs(vectors, D_THRESHOLD), "score")


@query
def R_similar_pairs(spark, folder):
    rows = dedup.first_of_each(
        _combined(spark, folder), "source_description", ["domain_order", "row_id"]
    )
    return rounded(sparse.similar_pairs(_text_vectors(rows), R_THRESHOLD), "score")


# --- E dedup, groups, sweeps ---------------------------------------------------------------------


@query
def R_dedup_first(spark, folder):
    rows = dedup.first_of_each(
        _combined(spark, folder), "source_description", ["domain_order", "row_id"]
    )
    return rows.select("row_id", "document_number", "source_description")


@query
def D_dedup_first(spark, folder):
    return _first_texts(spark, folder).select("row_id", "document_number", "n_chars")


@query
def R_exact_duplicates(spark, folder):
    rows = dedup.all_duplicates(_combined(spark, folder), "source_description")
    return rows.drop("embedding", "source_text").select(
        "row_id", "document_number", "source_description"
    )


@query
def D_exact_duplicates(spark, folder):
    rows = dedup.all_duplicates(testbed.text_records(spark, folder), "source_description")
    return rows.select("row_id", "document_number", "n_chars")


@query
def V_groups(spark, folder):
    return dense.similar_groups(testbed.vectors(spark, folder), V_THRESHOLD)


@query
def D_groups(spark, folder):
    return _d_groups(spark, folder, D_THRESHOLD)


@query
def D_groups_dedup(spark, folder):
    return sparse.similar_groups(_text_vectors(_first_texts(spark, folder)), D_THRESHOLD)


@query
def R_groups(spark, folder):
    return _resolution(spark, folder).groups


@query
def V_sweep_pairs(spark, folder):
    _, counts = dense.strongest_links(testbed.vectors(spark, folder), V_LEVELS[0], V_LEVELS)
    return rounded(sweep.sweep_pairs(counts, V_LEVELS), "threshold", "mean_score")


@query
def V_sweep_groups(spark, folder):
    links, counts = dense.strongest_links(testbed.vectors(spark, folder), V_LEVELS[0], V_LEVELS)
    return rounded(sweep.sweep_groups(links, counts, V_LEVELS), "threshold", "mean_group_size")


@query
def D_sweep_pairs(spark, folder):
    counts = sweep.level_counts(_first_pairs(spark, folder, D_LEVELS[0]), D_LEVELS)
    return rounded(sweep.sweep_pairs(counts, D_LEVELS), "threshold", "mean_score")


@query
def D_sweep_groups(spark, folder):
    links, counts = forest.condensed(_first_pairs(spark, folder, D_LEVELS[0]), D_LEVELS)
    return rounded(
        sweep.sweep_groups(forest.spanning(links), counts, D_LEVELS), "threshold", "mean_group_size"
    )


@query
def D_forest_levels(spark, folder):
    """Edges of the maximum spanning forest above each threshold: rows less groups."""
    links, _ = forest.condensed(_first_pairs(spark, folder, D_LEVELS[0]))
    edges = sweep.level_counts(forest.spanning(links), D_LEVELS)
    levels = sweep.sweep_pairs(edges, D_LEVELS).select("threshold", F.col("pairs").alias("edges"))
    return rounded(levels, "threshold")


@query
def R_group_sample(spark, folder):
    run = _resolution(spark, folder)
    drawn = embed.group_sample(run.groups, SAMPLED_GROUPS).withColumnRenamed("member_id", "row_id")
    text = F.concat(F.substring("text_to_compare", 1, 100), F.lit("..."))
    return drawn.join(run.rows, "row_id").select("group_id", "row_id", text.alias("text"))


# --- F vectors -----------------------------------------------------------------------------------


@query
def V_cosine(spark, folder):
    rows = testbed.vectors(spark, folder)
    following = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("next"))
    score = cosine(F.col("embedding"), F.col("next"))
    return rows.join(following, "row_id").select("row_id", F.round(score, 6).alias("score"))


@query
def D_text_vectors(spark, folder):
    return embed.text_terms(testbed.text_records(spark, folder), "row_id", "source_description")


@query
def R_embed(spark, folder):
    rows = _combined(spark, folder).select("row_id", "text_to_compare")
    return embed.embed_table(rows, embed.HashedBigrams(64))


@query
def V_pca_2d(spark, folder):
    points, _ = embed.project_2d(testbed.vectors(spark, folder))
    return rounded(points, "x", "y")


@query
def V_points_by_group(spark, folder):
    rows = testbed.vectors(spark, folder)
    points, _ = embed.project_2d(rows)
    groups = dense.similar_groups(rows, V_THRESHOLD)
    return embed.points_by_group(points, groups).select("row_id", "group_id")


# --- H review and summary ------------------------------------------------------------------------


@query
def R_validation_prompts(spark, folder):
    return review.validation_prompts(resolve.members(_resolution(spark, folder)))


@query
def R_resumed_answers(spark, folder):
    """Two runs of a reviewer that first fails for every prompt whose digest begins with 0 to 4."""
    prompts = materialize(review.validation_prompts(resolve.members(_resolution(spark, folder))), "prompts")
    store = f"{work_folder(spark)}/kinfold/answers-{uuid.uuid4().hex}"

    def make_reviewer(steady: bool):
        def judge(texts: list[str]) -> list[dict]:
            import hashlib

            if not steady and any(hashlib.sha256(t.encode()).hexdigest()[0] in "01234" for t in texts):
                raise TimeoutError("no answer")
            return [{"false_positives": [], "reasoning": f"{len(t)} characters"} for t in texts]

        return judge

    for steady in (False, True):
        answers.ask(prompts, lambda steady=steady: make_reviewer(steady), store, "fixed")
    found = answers.answered(prompts, store, "fixed", "false_positives array<int>, reasoning string")
    return found.select("group_id", "part", "reasoning", "tries", "complete")


@query
def R_verdicts(spark, folder):
    run = _resolution(spark, folder)
    return review.rule_verdicts(resolve.members(run), run.vectors, R_REVIEW).select(
        "group_id", "ordinal"
    )


@query
def R_validated_members(spark, folder):
    return _validated(spark, folder).select("group_id", "row_id", "ordinal")


@query
def R_validated_groups(spark, folder):
    run = _resolution(spark, folder)
    rows = review.member_rows(resolve.validated(run, R_REVIEW), run.rows)
    return rows.drop("domain_order", "source_type", "relationship_type")


@query
def R_summary_prompts(spark, folder):
    return review.summary_prompts(_validated(spark, folder))


@query
def R_summaries(spark, folder):
    return review.rule_summaries(_validated(spark, folder))


@query
def R_canonical_member(spark, folder):
    run = _resolution(spark, folder)
    return review.canonical_members(resolve.members(run))


# --- C, E unified records ------------------------------------------------------------------------


@query
def R_group_documents(spark, folder):
    return _raw_documents(spark, folder)[1]


@query
def R_group_relationships(spark, folder):
    _, documents, relationships = _raw_documents(spark, folder)
    rows = unify.group_relationships(documents, unify.with_repeated(relationships))
    return unify.relationship_counts(rows)


@query
def R_collaborations(spark, folder):
    return unify.collaborations(_unfiltered(spark, folder)).select(
        "row_id", "document_number", "org_id", "org_name", "collaboration_partner"
    )


@query
def R_org_profile(spark, folder):
    _, documents, relationships = _raw_documents(spark, folder)
    return unify.organization_profiles(documents, relationships)


@query
def R_focus_role(spark, folder):
    groups, documents, relationships = _raw_documents(spark, folder)
    profiles = unify.organization_profiles(documents, relationships)
    return unify.focus_roles(groups, profiles, testbed.FOCUS.org_id)


@query
def R_unified(spark, folder):
    kept, _, documents, relationships = _unified(spark, folder)
    return unify.unified_headers(kept, documents, relationships, testbed.FOCUS.org_id)


@query
def R_unified_organizations(spark, folder):
    """Organizations of the unified records, in long form."""
    _, _, documents, relationships = _unified(spark, folder)
    return unify.organization_profiles(documents, relationships)


@query
def R_unified_mentions(spark, folder):
    """Mentions of the unified records, in long form: one row a group and mention."""
    _, _, documents, relationships = _unified(spark, folder)
    said = documents.select("group_id", "document_number").join(
        unify.mentions(relationships), "document_number"
    )
    return said.select("group_id", "row_id", "side", "org_id", "relationship_type", "document_number")


@query
def R_unified_aliases(spark, folder):
    return _validated(spark, folder).select(
        "group_id", "row_id", F.col("source_english_id").alias("alias")
    )


@query
def R_unified_documents(spark, folder):
    _, _, documents, relationships = _unified(spark, folder)
    return unify.mentioned_documents(documents, relationships)


@query
def R_unified_json(spark, folder):
    kept, summaries, documents, relationships = _unified(spark, folder)
    return json_columns(
        unify.unified_records(kept, summaries, documents, relationships, testbed.FOCUS.org_id)
    )


@query
def R_network_nodes(spark, folder):
    return unify.network_nodes(_unfiltered(spark, folder))


@query
def R_network_edges(spark, folder):
    return unify.network_edges(_unfiltered(spark, folder))


# --- G linkage -----------------------------------------------------------------------------------


@query
def R_sample_size(spark, folder):
    records = linkage.linkage_records(_combined(spark, folder))
    n = F.col("records").cast("decimal(20,0)")
    cap = F.lit(linkage.SAMPLE_CAP).cast("long")
    quarter = F.floor(n * (n - 1) / 4).cast("long")
    return records.agg(F.count("*").alias("records")).withColumn(
        "sample_size", F.least(cap, quarter)
    )


@query
def R_pair_features(spark, folder):
    records = materialize(linkage.linkage_records(_combined(spark, folder)), "records")
    pairs = linkage.candidate_pairs(records, min_cosine=R_THRESHOLD, blocks=linkage.BLOCKS)
    features = linkage.pair_features(pairs.select("i", "j"), records)
    return rounded(features, *[f"{f.name}_similarity" for f in linkage.FIELDS])


@query
def R_candidates_blocked(spark, folder):
    records = materialize(linkage.linkage_records(_combined(spark, folder)), "records")
    return rounded(
        linkage.candidate_pairs(records, min_cosine=R_THRESHOLD, blocks=linkage.BLOCKS), "cosine"
    )


def _r_labels(records: DataFrame) -> DataFrame:
    """``(is_match, i, j)``: every record with the first one of its source, which matches, and with the
    first one of its document if that has another source."""
    slim = records.select("record_id", "source_id", "document_number")

    def with_first(key: str) -> DataFrame:
        first = slim.groupBy(key).agg(F.min(F.struct("record_id", "source_id")).alias("first"))
        return slim.join(first, key).where(F.col("first.record_id") < F.col("record_id"))

    pair = [F.col("first.record_id").alias("i"), F.col("record_id").alias("j")]
    same = with_first("source_id").select(F.lit(True).alias("is_match"), *pair)
    other = with_first("document_number").where(F.col("first.source_id") != F.col("source_id"))
    return same.unionByName(other.select(F.lit(False).alias("is_match"), *pair))


@query
def R_linkage_run(spark, folder):
    records = materialize(linkage.linkage_records(_combined(spark, folder)), "records")
    return link.link(records, labels=_r_labels(records), min_cosine=R_THRESHOLD).report


@query
def R_linkage_report(spark, folder):
    records = materialize(linkage.linkage_records(_combined(spark, folder)), "records")
    pairs = linkage.candidate_pairs(records, linkage.BLOCKS, min_cosine=R_THRESHOLD)
    scored = pairs.select("i", "j", F.col("cosine").alias("score"))
    clusters = linkage.partition(records, scored, R_THRESHOLD)
    return rounded(linkage.linkage_report(clusters, records), "confidence_score")


@query
def D_candidates_blocked(spark, folder):
    pairs = linkage.candidate_pairs(_d_records(spark, folder), D_BLOCKS, min_cosine=D_CANDIDATES)
    return rounded(pairs, "cosine")


@query
def D_pair_features(spark, folder):
    records = _d_records(spark, folder)
    pairs = linkage.candidate_pairs(records, D_BLOCKS, min_cosine=D_CANDIDATES).select("i", "j")
    features = linkage.pair_features(pairs, records, D_FIELDS)
    return rounded(features, *[f"{f.name}_similarity" for f in D_FIELDS])


@query
def D_pair_scores(spark, folder):
    records = _d_records(spark, folder)
    labels = _d_labels(spark, folder)
    sample = linkage.training_sample(labels, linkage.sample_size(records.count()))
    training = materialize(linkage.pair_features(sample, records, D_FIELDS), "training")
    model = linkage.train_scorer(training, D_FIELDS)
    candidates = linkage.candidate_pairs(records, D_DOCUMENT_BLOCKS, min_cosine=D_CANDIDATES)
    pairs = candidates.select("i", "j")
    return linkage.score_pairs(linkage.pair_features(pairs, records, D_FIELDS), model)


@query
def D_optimal_threshold(spark, folder):
    return rounded(linkage.optimal_threshold(_d_scored(spark, folder)), "threshold", "value")


@query
def D_linkage_clusters(spark, folder):
    clusters = linkage.partition(_d_records(spark, folder), _d_scored(spark, folder, above=D_LINK), D_LINK)
    return rounded(clusters, "confidence_score")


@query
def D_linkage_average(spark, folder):
    records = _d_records(spark, folder)
    clusters = agglomerate.average_partition(
        records, _d_scored(spark, folder, linked=D_AVERAGE), D_AVERAGE, same=["source_description"]
    )
    return rounded(clusters, "confidence_score")


def _d_matches(spark, folder) -> DataFrame:
    return _d_labels(spark, folder).where("is_match").select("i", "j")


@query
def D_predicate_costs(spark, folder):
    """What each block predicate costs, and the labelled matches that it finds."""
    keyed = predicates.with_keys(_d_records(spark, folder), D_PREDICATES)
    found = predicates.found_matches(keyed, _d_matches(spark, folder), D_PREDICATES)
    bit = lambda k: F.count_if(F.col("found").bitwiseAND(F.lit(1 << k).cast("long")) != 0)
    counts = found.agg(*(bit(k).alias(p.name) for k, p in enumerate(D_PREDICATES)))
    each = F.array(*(F.struct(F.lit(p.name).alias("predicate"), F.col(p.name).alias("matches")) for p in D_PREDICATES))
    return predicates.predicate_costs(keyed, D_PREDICATES).join(counts.select(F.inline(each)), "predicate")


@query
def D_block_choice(spark, folder):
    """The greedy choice of block predicates, up to a recall of 0.95 on the labelled matches."""
    keyed = predicates.with_keys(_d_records(spark, folder), D_PREDICATES)
    choices = predicates.chosen_predicates(keyed, _d_matches(spark, folder), D_PREDICATES)
    return rounded(predicates.choice_table(choices, keyed), "recall")


@query
def D_block_choice_bands(spark, folder):
    """As ``D_block_choice``, with MinHash bands among the predicates."""
    every = [*D_PREDICATES, *D_BANDS]
    keyed = predicates.with_keys(_d_records(spark, folder), every)
    choices = predicates.chosen_predicates(keyed, _d_matches(spark, folder), every, recall=1.0)
    return rounded(predicates.choice_table(choices, keyed), "recall")


@query
def D_predicate_pairs(spark, folder):
    """Candidate pairs of the prefix and the rarest-word predicates."""
    used = [p for p in D_PREDICATES if p.kind == RARE or (p.kind, p.size) == (PREFIX, 20)]
    keyed = predicates.with_keys(_d_records(spark, folder), used)
    return linkage.block_pairs(keyed, [(p.key,) for p in used])


@query
def D_label_candidates(spark, folder):
    labels = _d_labels(spark, folder)
    asked = linkage.label_candidates(_d_scored(spark, folder), labels, ASKED_PAIRS)
    return rounded(asked, "score")


@query
def D_linkage_run(spark, folder):
    records = _d_records(spark, folder)
    missing = [c for c in ("source_id", "source_english_id", "target_english_id")]
    padded = records.withColumns({c: F.lit(None).cast("string") for c in missing})
    run = link.link(padded, labels=_d_labels(spark, folder), fields=D_FIELDS, min_cosine=D_CANDIDATES)
    return run.report


@query
def D_cluster_header(spark, folder):
    return stats.cluster_headers(_d_clusters(spark, folder))


@query
def D_cluster_size_stats(spark, folder):
    return rounded(stats.cluster_size_stats(_d_clusters(spark, folder)), "mean", "std")


@query
def D_cross_document(spark, folder):
    headers = stats.cluster_headers(_d_clusters(spark, folder))
    return rounded(stats.cross_document(headers), "cross_document_percent")


@query
def D_duplicates_summary(spark, folder):
    headers = stats.cluster_headers(_d_clusters(spark, folder))
    return rounded(stats.duplicates_summary(headers), "average_cluster_size")


@query
def D_first_clusters(spark, folder):
    rows = _d_clusters(spark, folder).select("cluster_id", "record_id", "document_number")
    return stats.first_clusters(rows)


# --- I evaluation --------------------------------------------------------------------------------


@query
def E_labelled_pairs(spark, folder):
    return testbed.labelled_pairs(spark, folder)


@query
def E_truth_pairs(spark, folder):
    entries = testbed.labelled_pairs(spark, folder).select(
        "is_match", F.array(F.col("k2"), F.col("k1")).alias("items")
    )
    return evaluate.truth_pairs(entries, F.col("item"))


@query
def E_label_summary(spark, folder):
    return rounded(stats.label_summary(testbed.labelled_pairs(spark, folder)), "match_percent")


@query
def E_label_samples(spark, folder):
    return stats.label_samples(testbed.labelled_pairs(spark, folder), _item_texts(spark, folder))


@query
def E_item_cluster(spark, folder):
    return _clusters(spark, folder)


@query
def E_predicted_pairs(spark, folder):
    return evaluate.predicted_pair_counts(_clusters(spark, folder))


@query
def E_confusion(spark, folder):
    return evaluate.confusion(_judged(spark, folder))


@query
def E_pairwise_metrics(spark, folder):
    rates = ["precision", "recall", "f1_score", "accuracy"]
    return rounded(evaluate.pairwise_metrics(evaluate.confusion(_judged(spark, folder))), *rates)


@query
def E_truth_clusters(spark, folder):
    return evaluate.truth_clusters(testbed.labelled_pairs(spark, folder))


@query
def E_contingency(spark, folder):
    truth = evaluate.truth_clusters(testbed.labelled_pairs(spark, folder))
    return evaluate.contingency(truth, _clusters(spark, folder))


@query
def E_cluster_metrics(spark, folder):
    truth = evaluate.truth_clusters(testbed.labelled_pairs(spark, folder))
    cells = evaluate.contingency(truth, _clusters(spark, folder))
    return rounded(evaluate.cluster_metrics(cells), *evaluate.METRICS)


@query
def E_overlap(spark, folder):
    counts = evaluate.overlap(testbed.labelled_pairs(spark, folder), _clusters(spark, folder))
    return rounded(counts, "overlap_percent")


@query
def E_examples(spark, folder):
    return evaluate.examples(_judged(spark, folder), _item_texts(spark, folder))


@query
def E_report(spark, folder):
    clusters = materialize(_clusters(spark, folder), "clusters")
    full = evaluate.report(testbed.labelled_pairs(spark, folder), clusters)
    return rounded(
        full.select("pairwise_metrics.*", "cluster_metrics.*", "summary.*"),
        "precision",
        "recall",
        "f1_score",
        "accuracy",
        *evaluate.METRICS,
    )


def _keyed(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Labelled pairs, unordered and with repeats, and clusters of relationships under composite keys.

    A relationship is a match of the first one of its source and none of the first one of its document, if
    that has another source. Clusters hold the relationships of a description.
    """
    parts = ["source_id", "source_description", "target_id", "document_number"]
    key = composite_key([F.col(c) for c in parts])
    rows = _unfiltered(spark, folder).select("row_id", *parts, key.alias("item_key"))
    rows = materialize(rows, "keyed")

    def with_first(by: str) -> DataFrame:
        first = rows.groupBy(by).agg(F.min(F.struct("row_id", "source_id", "item_key")).alias("first"))
        return rows.join(first, by).where(F.col("first.row_id") < F.col("row_id"))

    pair = [F.col("first.item_key").alias("k1"), F.col("item_key").alias("k2")]
    same = with_first("source_id").select(F.lit(True).alias("is_match"), *pair)
    other = with_first("document_number").where(F.col("first.source_id") != F.col("source_id"))
    pairs = same.unionByName(other.select(F.lit(False).alias("is_match"), *pair))
    whole = rows.groupBy("source_description").agg(F.min("row_id").alias("cluster_id"))
    found = evaluate.item_clusters(rows.join(whole, "source_description"))
    return pairs, found


@query
def E_key_pairs(spark, folder):
    return evaluate.canonical_pairs(_keyed(spark, folder)[0], "k1", "k2")


@query
def E_key_truth(spark, folder):
    pairs, _, names = evaluate.on_ids(_keyed(spark, folder)[0])
    return evaluate.named_clusters(evaluate.truth_clusters(pairs), names)


@query
def E_key_confusion(spark, folder):
    pairs, clusters, _ = evaluate.on_ids(*_keyed(spark, folder))
    return evaluate.confusion(evaluate.judged_pairs(pairs, clusters))


@query
def E_key_overlap(spark, folder):
    pairs, clusters, _ = evaluate.on_ids(*_keyed(spark, folder))
    return rounded(evaluate.overlap(pairs, clusters), "overlap_percent")
