"""Load-ready tables: failing rows held out, warnings attached, households kept consistent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text


def without_errors(rows: DataFrame, key: str, findings: DataFrame) -> DataFrame:
    """Rows without a blocker or error; warning_ids holds the distinct warning rules in order, joined by bars, or null."""
    bad = findings.where(F.col("severity").isin("blocker", "error")).select(F.col("row_id").alias(key)).distinct()
    warned = findings.where("severity = 'warning'").groupBy(F.col("row_id").alias(key)).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), "|").alias("warning_ids"))
    return rows.join(bad, key, "left_anti").join(warned, key, "left")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest order of each trimmed key; map-side, so that a hot key is one row per task."""
    rest = F.struct(*rows.columns)
    return rows.where(F.col(key).isNotNull()).groupBy(text.strip(F.col(key)).alias("__k")).agg(F.min_by(rest, order).alias("r")).select("r.*")


def with_parent(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose parent is among parents, keys trimmed."""
    ids = parents.where(F.col(parent_key).isNotNull()).select(text.strip(F.col(parent_key)).alias("__p")).distinct()
    return rows.join(ids, text.strip(F.col(key)) == F.col("__p"), "left_semi")


def households(clients: DataFrame) -> DataFrame:
    """Per household its first client and its distinct members in file order."""
    named = clients.where("household_id is not null").groupBy("household_id", "client_id").agg(F.min("rec_id").alias("rec_id"))
    return named.groupBy("household_id").agg(
        F.min_by("client_id", "rec_id").alias("primary_client_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_id", "client_id"))), lambda m: m["client_id"]), "|").alias("members"),
        F.count(F.lit(1)).cast("bigint").alias("size"))


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their load types with a count of the cells that could not be: lost_cells."""
    lost = F.lit(0)
    out = rows
    for c, t in types.items():
        value = F.col(c).try_cast(t)
        lost = lost + (F.col(c).isNotNull() & value.isNull()).cast("int")
    out = out.withColumn("lost_cells", lost)
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def missing_required(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(row_id, field) for each required field that is null or blank."""
    gone = F.filter(F.array(*[F.when(F.coalesce(text.strip(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]), lambda c: c.isNotNull())
    return rows.select(F.col(key).alias("row_id"), F.explode(gone).alias("field"))
