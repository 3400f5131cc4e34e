"""Classified revenue: labels looked up, never guessed; exact totals with every category present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(rows: DataFrame, lookup: DataFrame, label: str) -> DataFrame:
    """rows with category by exact label; unresolved_reason where the label is not in the lookup (a small approved table)."""
    j = rows.join(F.broadcast(lookup.select(F.col("label").alias(label), "category").distinct()), label, "left")
    return j.withColumn("unresolved_reason", F.when(F.col("category").isNull(), "unknown_category_label")).withColumn("category", F.coalesce("category", F.lit("unclassified")))


def category_totals(classified: DataFrame, by: list[str], categories: list[str], amount: str = "amount") -> DataFrame:
    """One column per category, zero where there is none, and the total of all."""
    money = "decimal(18,2)"
    cols = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col(amount))), F.lit(0)).cast(money).alias(c) for c in categories]
    return classified.groupBy(*by).agg(*cols, F.coalesce(F.sum(amount), F.lit(0)).cast(money).alias("total"))


def received_totals(lines: DataFrame, by: list[str], amount: str = "amount") -> DataFrame:
    """Valid and excluded lines and their exact total, null where no line is valid; null groups stay groups."""
    return lines.groupBy(*by).agg(F.count(amount).cast("bigint").alias("valid_lines"), F.count_if(F.col(amount).isNull()).cast("bigint").alias("excluded_lines"), F.sum(amount).cast("decimal(18,2)").alias("received"))


def control_check(totals: DataFrame, stated: DataFrame, by: list[str]) -> DataFrame:
    """PASS, FAIL or NOT_RUN of each group's total against a stated one."""
    return totals.join(stated, by, "left").withColumn("check", F.when(F.col("stated").isNull(), "NOT_RUN").when(F.col("received") == F.col("stated"), "PASS").otherwise("FAIL"))
