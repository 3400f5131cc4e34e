"""Gates before anything is read in earnest: columns that hold social security numbers, files that are not whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.identifiers import PRODUCER

DASHED, BARE = r"^\s*\d{3}[- ]\d{2}[- ]\d{4}\s*$", r"^\s*\d{9}\s*$"
SHAPED_FROM, BARE_FROM = 0.01, 0.90


def column_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: filled cells, and how many look like a dashed or a bare nine-digit number; one scan for all."""
    aggs = []
    for k, c in enumerate(columns):
        v = F.col(c).cast("string")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count_if(F.trim(v) != "").cast("bigint").alias("filled"), F.count_if(v.rlike(DASHED)).cast("bigint").alias("dashed"),
            F.count_if(v.rlike(BARE)).cast("bigint").alias("bare"), F.count_if(v.rlike(BARE) & ~F.trim(v).rlike(PRODUCER)).cast("bigint").alias("bare_not_producer")).alias(f"c{k}"))
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(columns))])).alias("x")).select("x.*")


def refuse_ssn(shares: DataFrame) -> DataFrame:
    blocked = (F.col("dashed") >= F.col("filled") * SHAPED_FROM) & (F.col("dashed") > 0) | ((F.col("bare") >= F.col("filled") * BARE_FROM) & (F.col("bare_not_producer") > 0))
    return shares.withColumn("blocked", blocked & (F.col("filled") > 0))


def completeness(received: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Per source rows received against rows expected: COMPLETE, SHORT, EXTRA or MISSING."""
    got = received.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("received_rows"))
    j = expected.join(got, key, "left")
    n = F.coalesce("received_rows", F.lit(0))
    return j.select(key, F.col("expected_rows").cast("bigint").alias("expected_rows"), n.cast("bigint").alias("received_rows"),
                    F.when(n == 0, "MISSING").when(n < F.col("expected_rows"), "SHORT").when(n > F.col("expected_rows"), "EXTRA").otherwise("COMPLETE").alias("state"))


def free_text_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column average length, most blanks in a cell, and whether a cell holds nine digits."""
    aggs = [F.struct(F.lit(c).alias("column_name"), F.sum(F.length(c)).cast("bigint").alias("chars"), F.count(c).cast("bigint").alias("cells"),
                     F.max(F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))).cast("bigint").alias("most_blanks"),
                     F.bool_or(F.col(c).rlike(r"\d{9}")).alias("nine_digits")).alias(f"c{k}") for k, c in enumerate(columns)]
    return rows.agg(*aggs).select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(columns))])).alias("x")).select("x.*")
