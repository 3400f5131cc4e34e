"""References to records that do not exist, found without letting a hot key land in one task.

References are pre-aggregated per key and period (partial counts make a hot key one row per map task). Keys that
hold a large share of them are at most 1 / share by construction, so their groups meet broadcast facts; all other
groups take a shuffle anti-join against the keys that are sound, and only what is left is told apart. Groups
whose rows all share one fate are counted as they are; rows are looked at singly where a key is
removed, or first loaded, within the period, and where rows are asked for. Both halves are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import bounded, durable

#: A key is heavy when it holds more than this share of its references: at most 2,000 keys are.
HEAVY_SHARE = 1 / 2000


def norm_key(c: Column) -> Column:
    """Key without white space around it and without regard to letter case; null stays null."""
    return F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))


@dataclass(frozen=True)
class Reference:
    """One foreign key. scope columns are compared as written, null-safe, beside the key."""

    table: str
    rec: str
    field: str
    parent: str
    parent_key: str
    removed_table: str
    scope: str | None = None


REFERENCES = (
    Reference("policies", "rec_id", "client_id", "clients", "client_id", "clients"),
    Reference("policies", "rec_id", "writing_agent_npn", "agents", "npn", "agents"),
    Reference("statement_lines", "line_id", "carrier_member_id", "policies", "carrier_member_id", "policies", "carrier"),
)


def _scope(c: str | None) -> Column:
    return F.coalesce(F.col(c), F.lit("")) if c else F.lit("")


def key_facts(tables: dict[str, DataFrame], refs: tuple[Reference, ...]) -> DataFrame:
    """One row per known key of each reference: when the parent table first held it, when it was first removed."""
    out = []
    for n, ref in enumerate(refs):
        parent, removed = tables[ref.parent], tables["removed_keys"]
        when = parent.schema["loaded_at"].dataType
        out.append(parent.where(F.col(ref.parent_key).isNotNull()).select(
            F.lit(n).alias("ref"), _scope(ref.scope).alias("scope"), norm_key(F.col(ref.parent_key)).alias("key"),
            F.col("loaded_at").alias("first_loaded"), F.lit(None).cast(when).alias("first_removed"), F.lit(True).alias("is_parent")))
        named = (F.col("table_name") == ref.removed_table) & (F.col("field_name") == ref.parent_key) & F.col("key_value").isNotNull()
        out.append(removed.where(named).select(
            F.lit(n).alias("ref"), _scope(ref.scope).alias("scope"), norm_key(F.col("key_value")).alias("key"),
            F.lit(None).cast(when).alias("first_loaded"), F.col("removed_at").alias("first_removed"), F.lit(False).alias("is_parent")))
    return _united(out).groupBy(*KEYS).agg(
        F.min("first_loaded").alias("first_loaded"), F.min("first_removed").alias("first_removed"),
        F.bool_or("is_parent").alias("has_parent"), F.bool_or(~F.col("is_parent")).alias("was_removed"))


def orphan_kind(at: Column) -> Column:
    """deleted, missing, late or null (a sound reference) from the facts joined to a reference."""
    parent = F.coalesce(F.col("has_parent"), F.lit(False))
    removed = F.coalesce(F.col("was_removed"), F.lit(False))
    return (
        F.when(removed & (~parent | (F.col("first_removed") <= at)), "deleted")
        .when(~parent, "missing")
        .when(F.col("first_loaded") > at, "late")
    )


def _rows_of(tables: dict[str, DataFrame], refs: tuple[Reference, ...]) -> DataFrame:
    """Every reference of every kind, once per row that makes it."""
    return _united([
        tables[r.table].where(F.col(r.field).isNotNull()).select(
            F.lit(n).alias("ref"), F.col(r.rec).alias("rec_id"), _scope(r.scope).alias("scope"), norm_key(F.col(r.field)).alias("key"),
            F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("")).alias("period"), "loaded_at")
        for n, r in enumerate(refs)])


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


KEYS, GROUP = ["ref", "scope", "key"], ["ref", "scope", "key", "period"]


@dataclass(frozen=True)
class Judged:
    """All references, their heavy keys (None, or at most 1 / share a kind) and their suspicious groups, told by hot."""

    rows: DataFrame
    heavy: DataFrame | None
    groups: DataFrame


def heavy_keys(groups: DataFrame, share: float) -> DataFrame | None:
    """Keys that hold more than share of the references of their kind, or None. At most 1 / share a kind can, so the
    driver may hold them."""
    totals = {r["ref"]: r["n"] for r in groups.groupBy("ref").agg(F.sum("n").alias("n")).collect()}  # one row a kind
    over = F.lit(False)
    for n, rows in totals.items():
        over = over | ((F.col("ref") == n) & (F.col("all_n") > max(1.0, share * rows)))
    held = groups.groupBy(*KEYS).agg(F.sum("n").alias("all_n")).where(over).select(*KEYS)
    found = [tuple(r) for r in bounded(held, len(totals) * (int(1 / share) + 1), "heavy keys")]
    return groups.sparkSession.createDataFrame(found, "ref int, scope string, key string") if found else None


def judge(tables: dict[str, DataFrame], refs: tuple[Reference, ...], share: float = HEAVY_SHARE) -> Judged:
    """Groups (ref, scope, key, period) that hold, or may hold, orphans, with n rows, the key's facts and their kind. All
    kinds of reference go through the same few jobs."""
    rows, facts = _rows_of(tables, refs), key_facts(tables, refs)
    groups = durable(rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("lo"), F.max("loaded_at").alias("hi"), F.count("loaded_at").alias("dated")))
    heavy = heavy_keys(groups, share)
    rest = groups if heavy is None else groups.join(F.broadcast(heavy), KEYS, "left_anti")
    sound = facts.where("has_parent and not was_removed").alias("f")
    same = (F.col("g.ref") == F.col("f.ref")) & (F.col("g.scope") == F.col("f.scope")) & (F.col("g.key") == F.col("f.key"))
    # an undated row is never late, so a group without dates is sound as soon as its key is
    in_time = F.col("f.first_loaded").isNull() | F.col("g.lo").isNull() | (F.col("f.first_loaded") <= F.col("g.lo"))
    suspects = rest.alias("g").join(sound.hint("shuffle_hash"), same & in_time, "left_anti").join(facts.hint("shuffle_hash"), KEYS, "left").withColumn("hot", F.lit(False))
    if heavy is not None:
        hot_facts = facts.join(F.broadcast(heavy), KEYS, "left_semi")
        checked = groups.join(F.broadcast(heavy), KEYS, "left_semi").join(F.broadcast(hot_facts), KEYS, "left").withColumn("hot", F.lit(True))
        suspects = suspects.unionByName(checked)
    first, last = orphan_kind(F.col("lo")), orphan_kind(F.col("hi"))
    even = first.eqNullSafe(last) & ((F.col("dated") == F.col("n")) | (F.col("dated") == 0))
    told = suspects.withColumn("even", even).withColumn("kind", F.when(even, first)).where("not even or kind is not null")
    return Judged(rows, heavy, durable(told))


def _single(j: Judged, condition: str) -> DataFrame:
    """The rows of the suspicious groups that meet condition, each with its own kind. Groups of heavy keys, at most 1 / share
    times the periods, are broadcast; no other key has rows enough to weigh on a task."""
    groups = j.groups.where(condition).select(*GROUP, "hot", "has_parent", "was_removed", "first_loaded", "first_removed")
    if j.heavy is None:
        both = j.rows.join(groups, GROUP)
    else:
        both = j.rows.join(F.broadcast(j.heavy), KEYS, "left_anti").join(groups.where("not hot"), GROUP).unionByName(j.rows.join(F.broadcast(groups.where("hot")), GROUP))
    return both.withColumn("orphan_kind", orphan_kind(F.col("loaded_at"))).where("orphan_kind is not null")


def _named(df: DataFrame, refs: tuple[Reference, ...], *more: str) -> DataFrame:
    name = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("ref"))
    return df.select(name([r.table for r in refs]).alias("table_name"), *more[:1], name([r.field for r in refs]).alias("field_name"), "orphan_kind",
                     F.nullif("period", F.lit("")).alias("load_month"), *more[1:])


def find_orphans(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES, share: float = HEAVY_SHARE) -> DataFrame:
    """(table_name, rec_id, field_name, orphan_kind, load_month) of each orphan reference.

    Null keys are no references; repeated rows each count; an empty parent table makes every
    reference missing (or deleted); a null loaded_at is never late and has a null load month.
    """
    return _named(_single(judge(tables, refs, share), "true"), refs, "rec_id")


def orphan_counts(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES, share: float = HEAVY_SHARE) -> DataFrame:
    """Orphans per table, field, kind and load month: groups of one fate add their count, rows of the others are counted."""
    j = judge(tables, refs, share)
    whole = j.groups.where("even").select("ref", "period", F.col("kind").alias("orphan_kind"), "n")
    single = _single(j, "not even").select("ref", "period", "orphan_kind", F.lit(1).cast("bigint").alias("n"))
    counted = whole.unionByName(single).groupBy("ref", "period", "orphan_kind").agg(F.sum("n").cast("bigint").alias("orphan_rows"))
    return _named(counted, refs, "orphan_rows").select("table_name", "field_name", "orphan_kind", "load_month", "orphan_rows")
