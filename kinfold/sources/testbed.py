"""Relationship, text, vector and label tables derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.extract import Focus
from kinfold.sources.worktable import by_size

LINE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_returnflag",
    "l_linestatus",
]
FOCUS = Focus("S0", "Supplier#000000000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _row_id() -> Column:
    """``(((order * 8 + line) * 100000 + part) * 10000 + supplier) * 64 + quantity``, modulo 2^64 as a long.

    Orders from 18,014,399 on make numbers beyond a long, which plain arithmetic refuses. An order counts 2^18 * 1953125,
    so it is added to the upper bits of the rest and shifted: numbers that a long holds are the same.
    """
    line = F.col("l_linenumber").cast("long")
    rest = ((line * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 64 + F.col("l_quantity").cast("long")
    upper = F.col("l_orderkey") * F.lit(1_953_125).cast("long") + F.shiftright(rest, 18)
    return F.shiftleft(upper, 18).bitwiseOR(rest.bitwiseAND(F.lit((1 << 18) - 1).cast("long")))


def relationships(spark: SparkSession, folder: str) -> DataFrame:
    """One relationship per order line: part or customer as source, supplier as target.

    Lines are dealt by order over as many tasks as their size asks for, and meet the orders first, in these tasks and
    while they are narrow; so what a task sorts does not grow with the table.
    """
    line = by_size(table(spark, folder, "lineitem").select(*LINE_COLUMNS), "l_orderkey")
    part = table(spark, folder, "part")
    supplier = table(spark, folder, "supplier")
    orders = table(spark, folder, "orders")
    joined = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    returned = F.col("l_returnflag") == "R"
    size = F.col("p_size")
    text = lambda c: F.col(c).cast("string")
    return joined.select(
        _row_id().alias("row_id"),
        text("l_orderkey").alias("document_number"),
        F.when(returned, "Organization")
        .when(size % 11 == 0, None)
        .when(size % 13 == 0, "Organization")
        .otherwise("Innovation")
        .alias("source_type"),
        F.when(returned, F.concat(F.lit("C"), text("o_custkey")))
        .otherwise(F.concat(F.lit("P"), text("p_partkey")))
        .alias("source_id"),
        F.when(returned, F.concat(F.lit("Customer "), text("o_custkey")))
        .otherwise(F.concat("p_name", F.lit(" "), "p_brand"))
        .alias("source_english_id"),
        F.when(
            size % 7 != 0,
            F.concat("p_name", F.lit(" "), "p_type", F.lit(" size "), text("p_size")),
        ).alias("source_description"),
        F.when(F.col("l_returnflag") == "A", "DEVELOPED_BY")
        .when(returned, "COLLABORATION")
        .otherwise("USES")
        .alias("relationship_type"),
        F.concat(
            F.lit("line "), text("l_linenumber"), F.lit(" status "), "l_linestatus"
        ).alias("relationship_description"),
        F.concat(F.lit("S"), text("s_suppkey")).alias("target_id"),
        F.when(F.col("l_linenumber") != 7, F.col("s_name")).alias("target_english_id"),
        F.when(
            ~(F.col("l_quantity") > 45), F.concat(F.lit("nation "), text("s_nationkey"))
        ).alias("target_description"),
        F.col("l_linestatus").alias("domain"),
    )


def domains(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The focus and the comparison domain of the relationships."""
    return by_domain(relationships(spark, folder))


def by_domain(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    focus, comparison = (rows.where(F.col("domain") == d).drop("domain") for d in ("F", "O"))
    return focus, comparison


def text_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records: the text is the description, the source is document and company."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("source_description"),
        F.col("source").alias("document_number"),
        F.col("source").alias("source_company"),
        F.col("lang").alias("target_id"),
        "n_chars",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


def labelled_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(is_match, k1, k2)`` over documents, one or two pairs per document.

    Every document is paired with the first one that has the same first 20 characters, a match when
    the lengths differ by at most 2 percent, and with its predecessor when the starts differ.
    """
    docs = table(spark, folder, "documents").select(
        "doc_id", F.substring("text", 1, 20).alias("start"), "n_chars"
    )
    first = docs.groupBy("start").agg(F.min(F.struct("doc_id", "n_chars")).alias("first"))
    gap = F.abs(F.col("first.n_chars") - F.col("n_chars"))
    same = (
        docs.join(first, "start")
        .where(F.col("first.doc_id") < F.col("doc_id"))
        .select(
            (gap * 50 <= F.greatest(F.col("first.n_chars"), F.col("n_chars"))).alias("is_match"),
            F.col("first.doc_id").alias("k1"),
            F.col("doc_id").alias("k2"),
        )
    )
    following = docs.select(
        (F.col("doc_id") - 1).alias("doc_id"),
        F.col("doc_id").alias("k2"),
        F.col("start").alias("start_2"),
    )
    other = (
        docs.join(following, "doc_id")
        .where(F.col("start") != F.col("start_2"))
        .select(F.lit(False).alias("is_match"), F.col("doc_id").alias("k1"), "k2")
    )
    return same.unionByName(other).distinct()
