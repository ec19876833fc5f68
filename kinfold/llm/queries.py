"""The registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import (
    alignment,
    langid,
    minhash,
    mixing,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash,
    topk,
    toxicity,
    url_filter,
    vector_codes,
)
from kinfold.llm.common import table
from kinfold.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda some: F.array_join(
        F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
    return secret_scan.scan(table(spark, folder, "documents")).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        count("novel").alias("n_novel"),
    )


def op3_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(table(spark, folder, "documents"), shingle=3, max_bits=2)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(table(spark, folder, "documents"))


def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    found = topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.allotted(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(table(spark, folder, "embeddings"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignments(table(spark, folder, "documents"))


def op13_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.components(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_minhash_dedup": op13_minhash_dedup,
}
