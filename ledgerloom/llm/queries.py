"""Queries of the llm problems and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import abuse, address_match, canonical, linkage, mixing, packing, pii, tokens
from ledgerloom.runtime import durable, table


def p1_mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "policies"), table(spark, d, "canon_values"), "rec_id", ["status", "line_of_business", "state"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_mapped(spark, d).select("rec_id", "field_name", "canon_code")


def p5_linked(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "statement_lines"), table(spark, d, "clients"), table(spark, d, "policies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_linked(spark, d).select("line_id", "client_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return address_match.same_place(table(spark, d, "clients")).select(F.col("a").alias("rec_id_a"), F.col("b").alias("rec_id_b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(table(spark, d, "clients"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "clients")).select("rec_id", "redacted")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return durable(tokens.with_tokens(table(spark, d, "documents").select("doc_id", "source", "text")).drop("text"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_sized(spark, d), table(spark, d, "pack_sizes")).drop("filled")


def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scored(spark, d).where(F.col("score") >= abuse.ACCEPT).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p10_scored(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_packed": p8_packed,
    "p8_fill_report": p8_fill_report,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scored": p10_scored,
    "p10_rates": p10_rates,
}
SQL: dict[str, str] = {}
