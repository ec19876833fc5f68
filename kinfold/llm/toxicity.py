"""Toxicity: a counterfactual-regularised linear classifier.

Words that tell toxic texts are found by their document frequencies in the labelled training rows: the
``FEATURES`` words and prefixes with the largest likelihood ratios, and the identity terms. A logistic model over the
presence of these words is fitted on a bounded sample. For every labelled sentence with an identity
term, a counterfactual text swaps each identity term for another of its set, and the loss adds ``FAIRNESS`` times
the squared change of the score, so that mentions of a group alone move no score. Since the model is linear in
presence, the penalty acts on the difference of the two texts' features, prefixes included, and every identity
term has one template sentence besides.

What is fitted on is drawn from the labels first, two narrow columns: at most ``LABELLED`` rows by a hash of id and
label. The documents meet that bounded table alone and their texts are written once, for the word
statistics and for the sample. Scoring is one pass over all texts, each whole. Only the chosen words, their weights
and the sample's word numbers reach the driver.

Nulls and edges: a null or empty text has no words and scores by the intercept; null labels are not
trained on; an id with labels that disagree counts once for each; without both labels every text scores
the share of toxic ones (0 if none is labelled). Repeated rows score alike, extra columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import fold, materialize, text_of

FOLDS = 5
FEATURES = 400
#: Least training documents that hold a word.
LEAST_DOCS = 3
#: Bound on the labels that are drawn for training, and on the labelled rows that the weights are fitted on.
LABELLED = 20_000
TRAINING_ROWS = 6_000
FAIRNESS = 5.0
#: Weight of the squared weights, over the number of training rows.
L2 = 0.6
#: Least likelihood ratio of a feature, so that chance does not choose.
TELLING = 20.0
STEPS = 400
#: Letters of the prefixes that are features besides whole words.
PREFIX = 5
RATE = 0.15
SEED = 5

# Identity terms; each set's terms are swapped for one another.
IDENTITY_SETS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["muslim", "christian", "jewish", "hindu", "atheist"],
    ["black", "white", "asian", "latino"],
    ["gay", "straight", "lesbian", "transgender"],
    ["immigrants", "citizens", "refugees"],
    ["old", "young"],
    ["disabled", "deaf", "blind"],
]
TOKEN = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """The words of a text, and the prefixes of its longer ones (marked by ``~``)."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:PREFIX] + "~" for w in words if len(w) > PREFIX}


def swapped(text: str) -> str:
    """The counterfactual text: every identity term replaced by its set's next one."""
    swap = swaps()
    return TOKEN.sub(lambda m: swap.get(m[0], m[0]), text.lower())


@dataclass
class Model:
    intercept: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        z = self.intercept + sum(sorted(self.weights[t] for t in self.weights.keys() & terms_of(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = LABELLED) -> DataFrame:
    """``(key, text, toxic)`` of the rows of at most ``most`` labels outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull()).select(key, F.col("toxic").cast("int").alias("toxic"))
    known = known.where((fold(key, FOLDS) != 0) & F.col(key).isNotNull()).distinct()
    draw = F.xxhash64(F.col(key).cast("string"), "toxic", F.lit(SEED))
    drawn = known.orderBy(draw, key, "toxic").limit(most)
    # ``most`` rows of two numbers.
    return docs.select(key, text_of().alias("text")).join(F.broadcast(drawn), key)


def word_statistics(rows: DataFrame) -> DataFrame:
    """``(word, n, toxic)``: training documents, and toxic ones, that hold each word or prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"]
            )

    held = rows.select("text", "toxic").mapInArrow(run, "words array<string>, toxic int")
    held = held.select(F.explode("words").alias("word"), "toxic")
    return held.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def telling_words(stats: DataFrame, n: int, toxic: int, features: int = FEATURES) -> list[str]:
    """The words that tell most of the label, by the likelihood ratio of the 2 x 2 table of a word and
    the label (``n`` training documents, ``toxic`` of them toxic)."""
    held, both = F.col("n").cast("double"), F.col("toxic").cast("double")
    cells = [
        (both, held * toxic),
        (held - both, held * (n - toxic)),
        (toxic - both, (n - held) * toxic),
        (n - held - toxic + both, (n - held) * (n - toxic)),
    ]
    ratio = sum(F.when(o > 0, 2 * o * F.log(o * n / e)).otherwise(0.0) for o, e in cells)
    common = stats.where(F.col("n") >= LEAST_DOCS).withColumn("_ratio", ratio)
    top = common.where(F.col("_ratio") >= TELLING).orderBy(F.desc("_ratio"), "word").limit(features)
    return [r["word"] for r in top.select("word").collect()]


def swaps() -> dict[str, str]:
    """Each identity term's counterfactual: the next one of its set."""
    return {term: group[(k + 1) % len(group)] for group in IDENTITY_SETS for k, term in enumerate(group)}


def differences(present: list[np.ndarray], other: list[np.ndarray], vocabulary: list[str]) -> np.ndarray:
    """One row a labelled text that its counterfactual differs from: its features less those of the other.

    Each identity term has a template row besides, so that none is left free.
    """
    at = {w: k for k, w in enumerate(vocabulary)}
    numbers = lambda term: {at[w] for w in terms_of(term) if w in at}
    rows = [(numbers(term), numbers(swap)) for term, swap in swaps().items()]
    rows += [(set(own.tolist()), set(new.tolist())) for own, new in zip(present, other, strict=True)]
    rows = [(had, has) for had, has in rows if had != has]
    out = np.zeros((len(rows), len(vocabulary)))
    for row, (had, has) in enumerate(rows):
        out[row, sorted(had - has)] = 1.0
        out[row, sorted(has - had)] = -1.0
    return out


def fitted(present: list[np.ndarray], other: list[np.ndarray], toxic: np.ndarray, vocabulary: list[str]) -> Model:
    """Weights by full-batch Adam: logistic loss, L2, and the counterfactual penalty."""
    x = np.zeros((len(present), len(vocabulary)), dtype=np.float32)
    for row, words in enumerate(present):
        x[row, words] = 1.0
    change = differences(present, other, vocabulary)
    w, b = np.zeros(x.shape[1]), math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    balance = np.where(toxic == 1, 0.5 / max(toxic.mean(), 1e-6), 0.5 / max(1 - toxic.mean(), 1e-6))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        wrong = balance * (p - toxic) / len(toxic)
        shift = change @ w
        of_w = x.T @ wrong + L2 / len(toxic) * w + 2 * FAIRNESS * change.T @ shift / len(change)
        gradient = np.r_[of_w, wrong.sum()]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {word: float(k) for word, k in zip(vocabulary, w, strict=True)})


def sampled_features(
    rows: DataFrame, vocabulary: list[str], share: float, key: str = "doc_id", most: int = TRAINING_ROWS
) -> tuple[list[np.ndarray], np.ndarray]:
    """Word numbers and labels of the sample of ``sampled_pairs``."""
    present, _, toxic = sampled_pairs(rows, vocabulary, share, key, most)
    return present, toxic


def sampled_pairs(
    rows: DataFrame, vocabulary: list[str], share: float, key: str = "doc_id", most: int = TRAINING_ROWS
) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Word numbers, those of the counterfactuals, and labels of a sample of at most ``most`` training rows.

    Rows equal in id, text and label are one unit, which takes its count times ``share`` places, rounded
    up or down by a hash of the unit. Copies of a text under several ids are drawn apart.
    """
    at = {w: k for k, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda text: sorted(at[w] for w in at.keys() & terms_of(text))
        kind = pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [pa.array([numbers(t) for t in some], kind) for some in (texts, map(swapped, texts))]
            columns = [*found, *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=["words", "other", "toxic", "places", "drawn"])

    million = 1_000_000
    drawn = F.xxhash64(F.col(key).cast("string"), "text", "toxic", F.lit(SEED))
    units = rows.groupBy(key, "text", "toxic").agg(F.count("*").alias("_n")).withColumn("drawn", drawn)
    places = F.floor(F.col("_n") * F.lit(share) + F.pmod("drawn", F.lit(million)) / million).cast("long")
    chosen = units.select("text", "toxic", places.alias("places"), "drawn").where("places > 0")
    sample = chosen.mapInArrow(run, "words array<int>, other array<int>, toxic int, places long, drawn long")
    # One row a place; what chance drew beyond the bound goes by hashes of unit and place.
    place = F.explode(F.sequence(F.lit(1), F.col("places").cast("int"))).alias("_k")
    fields = ["words", "other", "toxic"]
    placed = sample.select(*fields, "drawn", place)
    bound = placed.orderBy(F.xxhash64("drawn", "_k"), *fields).limit(most).select(*fields)
    # Sorted here, so that the weights do not depend on the order in which tasks end.
    found = sorted((r["words"], r["other"], r["toxic"]) for r in bound.collect())
    present, other = ([np.array(r[k], dtype=int) for r in found] for k in (0, 1))
    return present, other, np.array([float(r[2]) for r in found])


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """A model from the labelled rows outside the held-out fold."""
    rows = materialize(training_rows(docs, labels, key), "training")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, toxic = counts["n"], counts["toxic"]
    if toxic in (0, n):
        return Model(30.0 if n and toxic else -30.0)
    terms = [term for group in IDENTITY_SETS for term in group]
    telling = [w for w in telling_words(word_statistics(rows), n, toxic) if w not in terms]
    vocabulary = telling + terms
    present, other, target = sampled_pairs(rows, vocabulary, min(1.0, TRAINING_ROWS / n), key)
    if len(target) == 0 or target.min() == target.max():
        return Model(math.log((toxic + 0.5) / (n - toxic + 0.5)))
    return fitted(present, other, target, vocabulary)


def scored(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``(key, score)`` of every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    slim = docs.select(key, text_of().alias("_text"))
    return slim.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, held_out, score, predicted)`` of every document."""
    scores = scored(docs, trained(docs, labels, key), key)
    held = (fold(key, FOLDS) == 0).alias("held_out")
    return scores.select(key, held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
