"""Rows of a drop folder as canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.sources.drop import project

BOOK = {"client_id": "Client ID", "first_name": "Given", "last_name": "Family", "dob": "Birth Date", "zip": "Zip", "policy_id": "Policy #", "carrier": "Company", "carrier_member_id": "Member ID", "line_of_business": "Product",
        "effective_date": "Start", "termination_date": "End", "status": "Status", "writing_agent_npn": "Agent #"}
LINES = {"statement_period": "Period", "carrier_member_id": "Subscriber #", "member_name": "Member Name", "member_dob": "DOB", "policy_ref": "Policy", "agent_npn": "Agent", "amount": "Paid", "commission_type": "Type"}
CLIENT = ("client_id", "first_name", "last_name", "dob", "zip")
POLICY = ("policy_id", "client_id", "carrier", "carrier_member_id", "line_of_business", "effective_date", "termination_date", "status", "writing_agent_npn")


def row_number_id(df: DataFrame) -> DataFrame:
    """_rec: the place of a row in its file; with several files, files are kept apart by name first."""
    return df.withColumn("_rec", F.col("lineage.row_number"))


def book_tables(rows: DataFrame, columns: dict[str, str] = BOOK) -> tuple[DataFrame, DataFrame]:
    """(clients, policies) of a book file: policies are rows with a policy_id, clients the first row of each client_id that
    says anything about the client. Dates are read loosely; the rest stays text."""
    p = row_number_id(project(rows, columns))
    for c in ("dob", "effective_date", "termination_date"):
        p = p.withColumn(c, dates.parse_date_loose(F.col(c)))
    known = F.coalesce(*[F.col(c).cast("string") for c in CLIENT[1:]]).isNotNull()
    clients = p.where(known & F.col("client_id").isNotNull()).groupBy("client_id").agg(F.min_by(F.struct(*CLIENT[1:], "lineage", "_rec"), "_rec").alias("r")).select("client_id", "r.*").withColumnRenamed("_rec", "rec_id")
    policies = p.where("policy_id is not null").select(*POLICY, "lineage", F.col("_rec").alias("rec_id"))
    return clients, policies


def payment_lines(rows: DataFrame, columns: dict[str, str] = LINES) -> DataFrame:
    """Lines of all statement files; the carrier comes from the source's name, amounts and periods are normalized."""
    src = rows.where(F.col("source").startswith("statement_"))
    p = project(src, columns)
    return p.select(
        F.xxhash64("lineage").alias("line_id"), F.initcap(F.translate(F.regexp_replace("lineage.source_file", r"^statement_|\.\w+$", ""), "_", " ")).alias("carrier"),
        dates.statement_period(F.col("statement_period"), keep=True).alias("statement_period"), F.col("lineage.row_number").alias("line_no"), "carrier_member_id", "member_name", "member_dob", "policy_ref", "agent_npn",
        money.parse_money(F.col("amount"))["value"].alias("amount"), F.upper(text.strip(F.col("commission_type"))).alias("commission_type"), "lineage")
