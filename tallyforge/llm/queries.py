"""Queries of the text problems: pN_ names, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import cut, encode, leak, spelling
from tallyforge.session import read_table


def _spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spellings(read_table(spark, folder, "polls"), "firm")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.linked_pairs(_spellings(spark, folder)).select(F.col("a").alias("firm_a"), F.col("b").alias("firm_b"))


def p4_firms(spark: SparkSession, folder: str) -> DataFrame:
    return _spellings(spark, folder).withColumnsRenamed({"value": "firm"})


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(read_table(spark, folder, "documents"))


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text from its ids: the round trip through the vocabulary."""
    return encode.decode(p7_ids(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked_items(p8_found(spark, folder), read_table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut.cut_texts(read_table(spark, folder, "documents"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return cut.cut_rates(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_firms, p7_ids, p7_text, p8_found, p8_items, p9_found, p9_rates)}
ORACLE = {"p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
