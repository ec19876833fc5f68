"""Learned record linkage: typed fields, candidate pairs, trained scorer, threshold, clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.text import MISSING, clean_text, shorten, strip, words
from kinfold.functions.vectors import bigram_vector, sparse_cosine, sparse_side
from kinfold.operators import sparse
from kinfold.operators.buckets import bucket_pairs, task_count, with_bucket_size
from kinfold.operators.components import connected_components
from kinfold.operators.dedup import text_key
from kinfold.operators.extract import INNOVATION
from kinfold.sources.worktable import materialize

KEY_FIELDS = ["source_id", "source_english_id", "source_description"]
TEXT, STRING = "text", "string"
#: Block keys of a linkage run: records that agree in all columns of a key are compared.
BLOCKS = (("source_description", "target_id"), ("source_description", "document_number"))
SAMPLE_CAP = 15_000
DEFAULT_THRESHOLD = 0.5
MIN_RECORDS = 2
FEW_RECORDS = 10
SCORE_SLICES = 512
#: What the mean of rounded scores can exceed the largest of the scores by.
LINK_SLACK = 1e-8
#: Vectors with more terms than this, on average, are not sent with every pair.
INLINE_TERMS = 64


@dataclass(frozen=True)
class FieldSpec:
    """One compared field: long texts by word-bigram cosine, short strings by edit distance."""

    name: str
    kind: str = TEXT


FIELDS = [
    FieldSpec("source_id"),
    FieldSpec("source_english_id"),
    FieldSpec("source_description"),
    FieldSpec("relationship_description"),
    FieldSpec("target_id"),
    FieldSpec("target_english_id"),
    FieldSpec("document_number", STRING),
]


def _complete(fields: Sequence[str]) -> Column:
    ok = F.lit(True)
    for f in fields:
        text = F.col(f).cast("string")
        ok = ok & text.isNotNull() & (strip(text) != "")
    return ok


def innovations(df: DataFrame) -> DataFrame:
    return df.where(F.col("source_type") == INNOVATION)


def key_complete(df: DataFrame, fields: Sequence[str] = KEY_FIELDS) -> DataFrame:
    """Rows whose key fields are all present and not blank."""
    return df.where(_complete(fields))


def key_complete_stats(df: DataFrame, fields: Sequence[str] = KEY_FIELDS) -> DataFrame:
    """One row: ``total``, ``complete``, ``removed``."""
    ok = F.coalesce(_complete(fields), F.lit(False))
    return df.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("complete"), F.count_if(~ok).alias("removed")
    )


def linkage_records(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Cleaned record per complete innovation row; the company is ``Unknown`` without that column."""
    company = clean_text(
        F.col("source_company") if "source_company" in df.columns else F.lit("Unknown")
    )
    cleaned = [
        "source_id",
        "source_english_id",
        "source_description",
        "relationship_description",
        "target_id",
        "target_english_id",
    ]
    return key_complete(innovations(df)).select(
        F.col(id_col).alias("record_id"),
        *[clean_text(F.col(c)).alias(c) for c in cleaned],
        F.coalesce(F.col("document_number").cast("string"), F.lit("")).alias("document_number"),
        company.alias("source_company"),
    )


def nul_violations(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """``(record_id, field)`` of every text field that still holds a NUL character."""
    fields = [c for c in records.columns if c != id_col]
    hits = F.filter(
        F.array(*[F.when(F.instr(F.col(c), "\u0000") > 0, F.lit(c)) for c in fields]),
        lambda x: x.isNotNull(),
    )
    return records.select(id_col, F.explode(hits).alias("field"))


def enough_records(records: DataFrame) -> str:
    """``none``, ``few`` or ``ok``, from a look at ten rows at most."""
    n = records.limit(FEW_RECORDS).count()
    return "none" if n < MIN_RECORDS else "few" if n < FEW_RECORDS else "ok"


def block_pairs(
    records: DataFrame, blocks: Sequence[Sequence[str]], id_col: str = "record_id"
) -> DataFrame:
    """``(i, j)``, ``i < j``: the pairs of records that agree in every column of a block key.

    A key with a null, empty or missing value makes no block. Records equal in all columns but the id
    are one class: classes meet through their smallest records, in chunks of a block, and each further
    record of a class is paired with its smallest. A class of any size adds one pair a copy; no pair
    between different records is lost, whatever the size of the block.
    """

    def term(number: int, key: Sequence[str]) -> Column:
        values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
        whole = ~F.array_contains(F.array(*[v.isin("", MISSING) for v in values]), True)
        return F.when(whole, F.sha2(F.to_json(F.array(F.lit(str(number)), *values)), 256))

    fields = [c for c in records.columns if c != id_col]
    terms = F.array(*[term(n, key) for n, key in enumerate(blocks)])
    keyed = records.select(
        F.col(id_col).alias("row_id"),
        F.sha2(F.to_json(F.struct(*fields)), 256).alias("_class"),
        F.filter(terms, lambda t: t.isNotNull()).alias("_terms"),
    )
    keyed = materialize(keyed.where(F.size("_terms") > 0), "blocks")
    firsts = keyed.groupBy("_class").agg(
        F.min("row_id").alias("first"), F.min_by("_terms", "row_id").alias("_terms")
    )
    postings = firsts.select(F.col("first").alias("row_id"), F.posexplode("_terms").alias("_at", "term"), "_terms")
    postings = postings.select("row_id", "term", F.slice("_terms", F.lit(1), F.col("_at")).alias("_before"))
    copies = (
        keyed.join(firsts.select("_class", "first"), "_class")
        .where(F.col("row_id") != F.col("first"))
        .select(F.col("first").alias("i"), F.col("row_id").alias("j"))
    )
    sized = materialize(with_bucket_size(postings), "postings")
    # A pair is made in the first block that both share, so pairs need no shuffle; ids of two classes may be equal, though.
    first_met = ~F.arrays_overlap("a._before", "b._before")
    once = not sparse.ids_differ(firsts.withColumnRenamed("first", "row_id"))
    return bucket_pairs(sized, parts=task_count(sized), condition=first_met, once=once).unionByName(copies)


def _connected_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    """The vectors in a pair with a cosine above ``threshold``, with their component of such pairs as ``part``."""
    strong = materialize(sparse.similar_pairs(vectors, threshold), "strong")
    parts = connected_components(strong).toDF("row_id", "part")
    return materialize(vectors.join(parts, "row_id"), "connected")


def candidate_pairs(
    records: DataFrame,
    blocks: Sequence[Sequence[str]],
    text_col: str = "source_description",
    min_cosine: float = 0.5,
    id_col: str = "record_id",
    above: float | None = None,
    linked: float | None = None,
) -> DataFrame:
    """``(i, j, cosine)``: the pairs worth scoring.

    The first record of every distinct text is compared with the other first records by an exact
    similarity join; each copy of a text is a candidate with that first record. A text held by a
    third of all records therefore adds one pair per copy, and every record stays connected. Records
    that share one of the ``blocks`` are candidates besides, whatever their cosine; without any block, copies of a text
    are compared with its first record alone. Where only the candidates with a cosine above ``above`` are used, as by
    ``partition``, the others are not sought. Where only candidates whose texts are connected by candidates with a
    cosine above ``linked`` are used, as by ``agglomerate.average_partition``, others of different texts need not be found.
    """
    keyed = materialize(records.select(F.col(id_col).alias("row_id"), text_key(text_col).alias("_key")), "keyed")
    firsts = keyed.groupBy("_key").agg(F.min("row_id").alias("first"))
    copies = (
        keyed.select("row_id", "_key")
        .join(firsts, "_key")
        .where(F.col("row_id") != F.col("first"))
        .select(F.col("first").alias("i"), F.col("row_id").alias("j"), F.lit(1.0).alias("cosine"))
    )
    texts = records.select(F.col(id_col).alias("row_id"), text_col)
    distinct = texts.join(firsts.select(F.col("first").alias("row_id")), "row_id", "left_semi")
    vectors = sparse.text_vectors(distinct, "row_id", text_col)
    used = F.lit(True) if above is None else F.col("cosine") > above
    least = min_cosine if above is None else max(min_cosine, above)
    if linked is not None and linked - LINK_SLACK > least:
        near = sparse.similar_pairs(_connected_vectors(vectors, linked - LINK_SLACK), least)
    else:
        near = sparse.similar_pairs(vectors, least)
    found = near.withColumnRenamed("score", "cosine").unionByName(copies).where(used)
    if not blocks:
        return found
    found = materialize(found, "near")
    more = block_pairs(records, blocks, id_col).join(found.select("i", "j"), ["i", "j"], "left_anti")
    text_of = keyed.select("row_id", "_key").join(firsts, "_key").select("row_id", "first")
    placed = more.join(text_of.toDF("i", "_x"), "i").join(text_of.toDF("j", "_y"), "j")
    placed = materialize(
        placed.select("i", "j", F.least("_x", "_y").alias("_lo"), F.greatest("_x", "_y").alias("_hi")), "blocked"
    )
    apart = placed.where("_lo < _hi").select(F.col("_lo").alias("i"), F.col("_hi").alias("j")).distinct()
    scores = sparse.score_pairs(apart, vectors).toDF("_lo", "_hi", "_score")
    cosine = F.when(F.col("_lo") == F.col("_hi"), 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    blocked = placed.join(scores, ["_lo", "_hi"], "left").select("i", "j", cosine.alias("cosine"))
    return found.unionByName(blocked.where(used))


def feature_names(fields: Sequence[FieldSpec]) -> list[str]:
    return [f"{f.name}_{suffix}" for f in fields for suffix in ("similarity", "missing")]


def _stand_in(text: Column) -> Column:
    """A long text's digest, a short text as it is: equal where texts are, and never longer than a digest."""
    return F.when(F.length(text) < 64, text).otherwise(F.sha2(text, 256))


def pair_features(
    pairs: DataFrame,
    records: DataFrame,
    fields: Sequence[FieldSpec] = tuple(FIELDS),
    id_col: str = "record_id",
) -> DataFrame:
    """Per pair and field a similarity in [0, 1] and a 0/1 missing flag.

    Equal values are fully similar; a field missing on a side has similarity 0. Vectors are made once
    per record that is in a pair. Short vectors join the pairs; those of a field whose vectors have more than
    ``INLINE_TERMS`` terms on average are scored in cells, each pair of different texts once.
    """
    pairs = materialize(pairs, "pairs")
    used = pairs.select(F.explode(F.array("i", "j")).alias(id_col)).distinct()
    texts = [f.name for f in fields if f.kind == TEXT]
    value = {f.name: F.col(f.name).cast("string") for f in fields}
    prepared = records.join(used, id_col, "left_semi").select(
        F.col(id_col).alias("_id"),
        *[_stand_in(value[f.name]).alias(f.name) if f.kind == TEXT else value[f.name].alias(f.name) for f in fields],
        *[bigram_vector(words(F.col(name))).alias(f"{name}_vec") for name in texts],
    )
    prepared = materialize(prepared, "prepared")
    means = [F.avg(F.size(f"{name}_vec.terms")).alias(name) for name in texts]
    mean = prepared.agg(*means).first().asDict() if texts else {}
    wide = [name for name in texts if (mean[name] or 0) > INLINE_TERMS]
    sides = [sparse_side(F.col(f"{name}_vec")).alias(f"{name}_vec") for name in texts if name not in wide]
    side = F.struct(*[f.name for f in fields], *sides)
    a = prepared.select(F.col("_id").alias("i"), side.alias("_a"))
    b = prepared.select(F.col("_id").alias("j"), side.alias("_b"))

    def ends(name: str) -> tuple[Column, Column, Column]:
        x, y = F.col(f"_a.{name}"), F.col(f"_b.{name}")
        absent = [F.coalesce(v, F.lit("")).isin("", MISSING) for v in (x, y)]
        return x, y, absent[0] | absent[1]

    def features(field: FieldSpec) -> list[Column]:
        x, y, missing = ends(field.name)
        if field.name in wide:
            near = F.col(f"_{field.name}_near")
        elif field.kind == TEXT:
            near = sparse_cosine(F.col(f"_a.{field.name}_vec"), F.col(f"_b.{field.name}_vec"))
        else:
            near = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
        similarity = F.when(missing, F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(near)
        return [
            similarity.alias(f"{field.name}_similarity"),
            missing.cast("int").alias(f"{field.name}_missing"),
        ]

    joined = pairs.join(a, "i").join(b, "j")
    for name in wide:
        x, y, missing = ends(name)
        placed = joined.withColumns({"_lo": F.least(x, y), "_hi": F.greatest(x, y)})
        joined = materialize(placed, "placed")
        apart = joined.where(~missing & (F.col("_lo") < F.col("_hi"))).select("_lo", "_hi").distinct()
        vectors = prepared.select(F.col(name).alias("row_id"), F.col(f"{name}_vec").alias("vec"))
        near = sparse.score_pairs(apart.toDF("i", "j"), vectors.dropDuplicates(["row_id"]))
        joined = joined.join(near.toDF("_lo", "_hi", f"_{name}_near"), ["_lo", "_hi"], "left").drop("_lo", "_hi")
    return joined.select(*pairs.columns, *[c for f in fields for c in features(f)])


def train_scorer(
    features: DataFrame, fields: Sequence[FieldSpec] = tuple(FIELDS), label_col: str = "is_match"
) -> PipelineModel:
    """Logistic regression over the pair features of labelled pairs."""
    stages = [
        VectorAssembler(inputCols=feature_names(fields), outputCol="_x"),
        LogisticRegression(
            featuresCol="_x",
            labelCol="_y",
            probabilityCol="_p",
            rawPredictionCol="_raw",
            predictionCol="_pred",
            regParam=0.001,
        ),
    ]
    return Pipeline(stages=stages).fit(features.withColumn("_y", F.col(label_col).cast("double")))


def score_pairs(features: DataFrame, model: PipelineModel) -> DataFrame:
    """``(i, j, score)``: probability of a match."""
    return model.transform(features).select("i", "j", vector_to_array("_p")[1].alias("score"))


def sample_size(records: int, cap: int = SAMPLE_CAP) -> int:
    """Labelled pairs to train on: at most a quarter of all pairs and ``cap``."""
    return min(cap, records * (records - 1) // 4)


def training_sample(pairs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` pairs drawn by a seeded hash of their ids; the same rows on every run."""
    text = F.concat_ws("-", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string"))
    return pairs.orderBy(F.md5(text)).limit(k)


def optimal_threshold(
    scored: DataFrame, recall_weight: float = 1.0, slices: int = SCORE_SLICES
) -> DataFrame:
    """One row ``(threshold, value)``: the score that maximises the expected F-beta.

    With pairs from the highest score down, ``E_k`` the sum of the first ``k`` scores and ``E`` of all:
    recall ``E_k / E``, precision ``E_k / k``, beta the recall weight; ties go to the higher score.
    Inside a run of equal scores the value has no inner maximum, so only distinct scores are rated.
    The running sums are taken inside score slices of about equal size and shifted by the slice totals,
    so no task sorts all scores.
    """
    distinct = materialize(
        scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("score").alias("e")), "scores"
    )
    shares = [k / slices for k in range(1, slices)]
    cuts = [] if distinct.isEmpty() or not shares else distinct.approxQuantile("score", shares, 0.1 / slices)
    inner = sorted(set(cuts))
    sliced = Bucketizer(
        splits=[-float("inf"), *inner, float("inf")] if inner else [-float("inf"), 0.0, float("inf")],
        inputCol="score",
        outputCol="slice",
    ).transform(distinct)
    totals = sliced.groupBy("slice").agg(F.sum("n").alias("sn"), F.sum("e").alias("se"))
    above = totals.agg(  # one short entry per slice, at most `slices` of them
        F.sort_array(F.collect_list(F.struct("slice", "sn", "se")), asc=False).alias("s"),
        F.sum("se").alias("all_e"),
    )
    shifts = above.select("all_e", F.posexplode("s").alias("at", "own"), "s").select(
        F.col("own.slice").alias("slice"),
        "all_e",
        F.aggregate(
            F.slice("s", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda t, x: t + x["sn"]
        ).alias("n0"),
        F.aggregate(F.slice("s", F.lit(1), F.col("at")), F.lit(0.0), lambda t, x: t + x["se"]).alias(
            "e0"
        ),
    )
    inside = (
        Window.partitionBy("slice")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    beta2 = float(recall_weight) ** 2
    rated = (
        sliced.withColumn("n_in", F.sum("n").over(inside))
        .withColumn("e_in", F.sum("e").over(inside))
        .join(F.broadcast(shifts), "slice")
        .select(
            "score",
            ((1 + beta2) * (F.col("e0") + F.col("e_in")) / (F.col("n0") + F.col("n_in") + beta2 * F.col("all_e"))).alias("value"),
        )
    )
    return (
        rated.agg(F.max(F.struct("value", "score")).alias("best"))
        .where(F.col("best").isNotNull())
        .select(F.col("best.score").alias("threshold"), F.col("best.value").alias("value"))
    )


def choose_threshold(
    scored: DataFrame, given: float | None = None, trained_now: bool = True, recall_weight: float = 1.0
) -> float:
    """The given threshold, the default for a loaded model, or the optimal one after training.

    Clusters take scores strictly above the threshold, so the optimal one is set just below the score
    that the optimum still includes.
    """
    if given is not None:
        return given
    if not trained_now:
        return DEFAULT_THRESHOLD
    best = optimal_threshold(scored, recall_weight).first()
    return DEFAULT_THRESHOLD if best is None else math.nextafter(best["threshold"], -math.inf)


def partition(
    records: DataFrame,
    scored: DataFrame,
    threshold: float,
    singletons: bool = True,
    id_col: str = "record_id",
) -> DataFrame:
    """``(cluster_id, record_id, confidence_score)``: components of the pairs above ``threshold``.

    The confidence of a member is the mean score of its pairs in the cluster; a record alone has 1.0.
    """
    edges = materialize(scored.where(F.col("score") > threshold).select("i", "j", "score"), "edges")
    confidence = (
        edges.select(F.explode(F.array("i", "j")).alias("node"), "score")
        .groupBy("node")
        .agg(F.avg("score").alias("confidence"))
    )
    placed = connected_components(edges).join(confidence, "node")
    ids = records.select(F.col(id_col).alias("node"))
    how = "left" if singletons else "inner"
    return ids.join(placed, "node", how).select(
        F.coalesce("component", "node").alias("cluster_id"),
        F.col("node").alias("record_id"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence_score"),
    )


def linkage_report(clusters: DataFrame, records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Clusters with their record fields, description shortened, best members first."""
    fields = records.withColumnRenamed(id_col, "record_id").select(
        "record_id",
        "document_number",
        "source_company",
        "source_id",
        "source_english_id",
        shorten(F.col("source_description")).alias("source_description"),
        "target_english_id",
    )
    return clusters.join(fields, "record_id").select(
        "cluster_id", "record_id", "confidence_score", *fields.columns[1:]
    ).orderBy(F.asc("cluster_id"), F.desc("confidence_score"), F.asc("record_id"))


def label_candidates(scored: DataFrame, labelled: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` unlabelled pairs the scorer is least sure about."""
    open_pairs = scored.join(labelled.select("i", "j"), ["i", "j"], "left_anti")
    return open_pairs.orderBy(F.abs(F.col("score") - 0.5), "i", "j").limit(k)
