"""Comparing runs with each other and with planted truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how many occurrences went, came and stayed. One pass over both sides with partial counts."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("side"))
    c = side(before, 0).unionByName(side(after, 1)).groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return c.select(*keys, F.greatest(F.col("a") - F.col("b"), F.lit(0)).cast("bigint").alias("resolved"),
                    F.greatest(F.col("b") - F.col("a"), F.lit(0)).cast("bigint").alias("fresh"), F.least("a", "b").cast("bigint").alias("unchanged"))


def detection_score(findings: DataFrame, planted: DataFrame, rows: DataFrame) -> DataFrame:
    """Per planted kind how many rows hold it and how many of these a finding of its rule hits, with false
    positives: clean rows (nothing planted) that a finding hits. findings (row_id, rule_id), planted (row_id, kind, rule_id)."""
    hits = findings.select("row_id", "rule_id").distinct().withColumn("hit", F.lit(True))
    marks = planted.select("row_id", "kind", "rule_id").distinct().join(hits, ["row_id", "rule_id"], "left")
    per_kind = marks.groupBy("kind").agg(F.count(F.lit(1)).cast("bigint").alias("planted"), F.count("hit").cast("bigint").alias("detected"))
    hit_rows = hits.select("row_id", "hit").distinct()
    clean = rows.select("row_id").join(planted.select("row_id").distinct(), "row_id", "left_anti").join(hit_rows, "row_id", "left")
    total = clean.agg(F.count(F.lit(1)).cast("bigint").alias("planted"), F.count("hit").cast("bigint").alias("detected"))
    return per_kind.unionByName(total.select(F.lit("(clean rows)").alias("kind"), "planted", "detected"))
