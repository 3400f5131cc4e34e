"""Recorded answers to bounded questions: looked up by a hash of the question, never asked anew.

Each distinct question is looked up once. What has no recorded answer stays open, and what must not leak
without an answer is withheld.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.redaction import health_hint
from ledgerloom.runtime import lookup_join

WITHHELD = "[redacted]"


def question_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def with_answers(rows: DataFrame, question: Column, recorded: DataFrame) -> DataFrame:
    """rows with the answer of their question from recorded (question, answer); null where there is none."""
    known = recorded.groupBy(F.col("question").alias("__q")).agg(F.max("answer").alias("answer"))
    return lookup_join(rows.withColumn("__q", question), known, ["__q"]).drop("__q")


def gate_notes(rows: DataFrame, column: str, recorded: DataFrame, least: float = 0.5) -> DataFrame:
    """Notes that hint at health stay only if a recorded answer (probability that they are personal) lies below least;
    digits are masked in the question. Others pass unchanged."""
    masked = F.regexp_replace(F.col(column), r"\d", "#")
    asked = with_answers(rows, question_hash(masked), recorded)
    hint = F.coalesce(health_hint(F.col(column)), F.lit(False))
    return asked.withColumn("withheld", hint & ~F.coalesce(F.col("answer") < least, F.lit(False))).withColumn(column, F.when(F.col("withheld"), F.lit(WITHHELD)).otherwise(F.col(column))).drop("answer")
