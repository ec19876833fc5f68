"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest
fitting rule decides. Every suffix of an url's host is looked up in a map of the rules, so the work for an
url depends on its labels and not on the number of rules. Urls that no rule fits are judged by boosted
trees that were trained on labelled urls: those that a rule decides. The trees see lexical features
only: lengths, depth, digit ratio, character entropy, parameter counts, and for the last labels of the
host how often labelled urls with that suffix are blocked, shrunk towards the overall rate.

Training takes a sample of at most about ``TRAINING_ROWS`` labelled urls; the suffix statistics are
counted over all of them, with map-side sums. Scoring is one pass without Python.

Nulls and edges: a null url, or one without ``://``, has an empty host and path and is scored like any
other; repeated rows are judged alike; without labelled urls of both kinds every open url is allowed;
extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize

Rule = tuple[str, str]

# The rules of the contract, as (verdict, host/path).
RULES: list[Rule] = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

TRAINING_ROWS = 20_000
TREES = 12
DEPTH = 4
SEED = 11
#: Labelled urls' worth of the overall block rate that each suffix's own rate is pooled with.
PRIOR = 20.0
LENGTHS = ["url_length", "host_length", "path_length", "query_length"]
SHAPE = ["depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "dashes", "marks"]
SUFFIX = ["tld_rate", "tld_seen", "domain_rate", "domain_seen"]
FEATURES = [*LENGTHS, *SHAPE, *SUFFIX]


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, url, host, path, query)``; empty strings where there is no ``://``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise(F.lit(""))
    split = pages.select(key, whole.alias("url"), rest.alias("_rest"))
    return split.select(
        key,
        "url",
        lower_ascii(F.regexp_extract("_rest", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def ruled(urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest fitting rule, null where none fits.

    Rules are split into host and path; each host's rules are tried from the longest path down, and the
    host's suffixes from the longest down. Longest means of the whole rule string; host labels come first
    to ties.
    """
    by_host: dict[str, list[Rule]] = {}
    for verdict, rule in rules:
        by_host.setdefault(rule.partition("/")[0], []).append((verdict, rule))
    entries = []
    for host, own in by_host.items():
        fields = [
            F.struct(
                F.lit(len(rule)).alias("size"),
                F.lit(rule).alias("rule"),
                F.lit("/" + rule.partition("/")[2]).alias("path"),
                F.lit(verdict).alias("verdict"),
            )
            for verdict, rule in own
        ]
        entries += [F.lit(host), F.array(*fields)]
    table = F.create_map(*entries)
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda at: F.array_join(F.slice(labels, at, F.size(labels)), "."),
    )
    fitting = F.filter(
        F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())),
        lambda r: F.col("path").startswith(r["path"]),
    )
    best = urls.withColumn("_best", F.array_max(fitting))
    return best.select(
        *urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict")
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.split(text, "")
    total = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda letter: (F.length(text) - F.length(F.replace(text, letter, F.lit("")))) / total
    return F.aggregate(
        F.filter(F.array_distinct(letters), lambda letter: letter != ""),
        F.lit(0.0),
        lambda sum_, letter: sum_ - share(letter) * F.log2(share(letter)),
    )


def lexical(urls: DataFrame) -> DataFrame:
    """Add the features that come from the url's own characters."""

    def count(column: str, characters: str) -> Column:
        return F.length(F.regexp_replace(column, f"[^{characters}]+", "")).cast("double")

    def ratio(column: str) -> Column:
        return count(column, "0-9") / F.greatest(F.length(column), F.lit(1))

    labels = F.split("host", r"\.")
    return urls.withColumns(
        {
            "url_length": F.length("url").cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "query_length": F.length("query").cast("double"),
            "depth": count("path", "/"),
            "labels": F.size(labels).cast("double"),
            "digit_ratio": ratio("url"),
            "host_digit_ratio": ratio("host"),
            "entropy": entropy(F.col("url")),
            "parameters": count("query", "="),
            "dashes": count("host", "-"),
            "marks": count("url", "#&?%_"),
            "_tld": F.get(labels, F.size(labels) - 1),
            "_domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    )


def suffix_statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """``(suffix, seen, rate)``: labelled urls with a suffix, and the pooled share that is blocked."""
    sums = labelled.groupBy(suffix).agg(F.count("*").alias("seen"), F.sum("label").alias("_blocked"))
    overall = sums.agg((F.sum("_blocked") / F.sum("seen")).alias("p")).first()["p"] or 0.0
    rate = (F.col("_blocked") + F.lit(PRIOR * overall)) / (F.col("seen") + F.lit(PRIOR))
    return sums.select(suffix, F.log1p("seen").alias("seen"), rate.alias("rate"))


def with_suffixes(urls: DataFrame, tlds: DataFrame, domains: DataFrame) -> DataFrame:
    """Add the suffix features; an unseen suffix has none seen and rate 0.5."""
    out = urls
    for name, stats in (("tld", tlds), ("domain", domains)):
        own = stats.select(
            F.col(f"_{name}"), F.col("rate").alias(f"{name}_rate"), F.col("seen").alias(f"{name}_seen")
        )
        out = out.join(own, f"_{name}", "left").fillna({f"{name}_rate": 0.5, f"{name}_seen": 0.0})
    return out


def trained(features: DataFrame, rows: int = TRAINING_ROWS) -> GBTClassificationModel | None:
    """Boosted trees on a sample of at most about ``rows`` labelled urls; None if one kind is missing.

    The sample is drawn by a hash of the url, so it is the same in every run.
    """
    labelled = features.where(F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    part = min(1.0, rows / sum(sizes.values()))
    chosen = labelled.where(F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(1_000_000)) < int(part * 1_000_000) + 1)
    # Both kinds weigh the same, so that an url without evidence is not condemned by their rates.
    weight = F.when(F.col("label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values())
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen)
    sample = materialize(vectors.select("features", "label", weight.alias("weight")), "urls")
    model = GBTClassifier(
        labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED
    )
    return model.fit(sample.coalesce(4))


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id") -> DataFrame:
    """``(key, host, path, rule, verdict, score)`` of every page; ``score`` is the trees' block probability."""
    urls = lexical(ruled(parsed(pages, key), rules))
    label = F.when(F.col("rule").isNotNull(), (F.col("rule_verdict") == "block").cast("double"))
    urls = materialize(urls.withColumn("label", label), "lexical")
    labelled = urls.where(F.col("label").isNotNull())
    stats = [materialize(suffix_statistics(labelled, s), "suffixes") for s in ("_tld", "_domain")]
    features = with_suffixes(urls, *stats)
    model = trained(features)
    if model is None:
        scored = features.withColumn("score", F.lit(0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    verdict = F.coalesce("rule_verdict", by_trees).alias("verdict")
    return scored.select(key, "host", "path", "rule", verdict, "score")
