"""Schemas that drift between the files of one source.

Each file's columns become a schema tree; the minimum-cost edit script from the file received before
it tells what was added, removed, renamed, moved or retyped. The scripts are compiled into one
projection per file, which puts every raw row into one consistent table.

Files, not sources, are the unit of work: a source that sends a third of all files is spread over
all tasks, since "the file before" is found by a range-partitioned sort with the partitions' edges
handed on, not by a window over the source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.treedist import Node, edit_script
from ledgerloom.functions.dates import parse_date_loose
from ledgerloom.runtime import bounded, durable, lookup_join

# Samples that say nothing, and flag words.
FILLERS = {"", "-", "--", "n/a", "na", "none", "null", "nil", "?", "???", "tbd", "."}
FLAGS = {"y", "n", "yes", "no", "true", "false", "t", "f", "si", "sí"}
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
_DATE = (
    rf"(?i)^(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(?:[T ].*)?|\d{{1,2}}[-/.]\d{{1,2}}[-/.](?:\d{{2}}|\d{{4}})|\d{{1,2}}[- ]{_MONTH}[- ,]+(?:\d{{2}}|\d{{4}})|{_MONTH} \d{{1,2}},? \d{{4}})$"
)
_WHOLE = r"^[(+-]?\$?\s*(?:\d{1,3}(?:,\d{3})+|\d+)\)?-?$"
_DECIMAL = r"^[(+-]?\$?\s*[(+-]?(?:\d{1,3}(?:,\d{3})+|\d*)\.\d+\)?\s*%?-?$"
KINDS = ("whole", "decimal", "date", "flag", "text")

RENAME_FROM = 0.6
#: Canonical fields; a list with more is refused, since each is a column.
FIELDS = 2_000


def norm_header(h: str) -> str:
    return re.sub(r"\s+", " ", h or "").strip().lower()


def _trimmed(v: Column) -> Column:
    return F.regexp_replace(v, r"^\s+|\s+$", "")


def sample_kind(v: Column) -> Column:
    """whole, decimal, date, flag or text; null for fillers and null."""
    s = _trimmed(F.coalesce(v, F.lit("")))
    low = F.lower(s)
    return (
        F.when(low.isin(*sorted(FILLERS)), F.lit(None).cast("string")).when(low.isin(*sorted(FLAGS)), "flag")
        .when(s.rlike(_WHOLE), "whole").when(s.rlike(_DECIMAL), "decimal").when(s.rlike(_DATE), "date").otherwise("text")
    )


def column_kind(samples: Column) -> Column:
    """The kind of more than half of the samples that are no fillers, else null."""
    kinds = F.filter(F.transform(samples, sample_kind), lambda k: k.isNotNull())
    return F.coalesce(*[F.when(2 * (F.size(kinds) - F.size(F.array_remove(kinds, k))) > F.size(kinds), F.lit(k)) for k in KINDS])


def sample_shapes(samples: Column) -> Column:
    """The distinct builds of the samples that are no fillers: runs of letters as a or A, of digits as 9."""
    one = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(_trimmed(v), r"[A-Z](?=[a-z])", ""), r"[a-z]+(?:-[a-z0-9]+)?", "a"), r"[A-Z]+", "A"), r"\d+", "9")
    return F.array_distinct(F.transform(F.filter(samples, lambda v: sample_kind(v).isNotNull()), one))


def _words(h: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", norm_header(h)).strip()


def rename_score(a: dict, b: dict, learned: frozenset = frozenset()) -> float:
    """How far column b of the new file carries on column a of the old one, 0 to 1. learned holds pairs of
    wordings, in order of letters, that replace each other in this kind of source."""
    known_a, known_b = a["concept"], b["concept"]
    wa, wb = _words(a["header"]), _words(b["header"])
    if known_a and known_b and "none" not in (known_a, known_b):
        score = 0.7 if known_a == known_b else 0.0
    else:
        lexical = max(SequenceMatcher(None, wa, wb).ratio(), _jaccard(wa, wb))
        score = 0.6 * lexical if (known_a == known_b or not known_a or not known_b) else 0.2 * lexical
        if (min(wa, wb), max(wa, wb)) in learned:
            score = max(score, 0.55)
    if score == 0.0:
        return 0.0
    if a["proposed"] and a["proposed"] != "none" and a["proposed"] == b["proposed"]:
        score += 0.1
    if a["kind"] and b["kind"]:
        score += 0.1 if a["kind"] == b["kind"] else -0.3
        if a["shapes"] and b["shapes"] and a["kind"] == b["kind"] == "text":
            score += 0.05 if a["shapes"] & b["shapes"] else -0.1
    if a["place"] == b["place"]:
        score += 0.1
    return max(0.0, min(1.0, score))


def _jaccard(x: str, y: str) -> float:
    p, q = set(x.split()), set(y.split())
    return len(p & q) / len(p | q) if p | q else 0.0


def _tree(columns) -> Node:
    kids = []
    for c in sorted(columns, key=lambda c: (c["header_no"] if c["header_no"] is not None else 1 << 30)):
        data = {"header": c["header"] or "", "proposed": c["proposed_field"], "concept": c["concept"], "kind": c["kind"], "shapes": set(c["shapes"]) if c["shapes"] is not None else set(), "no": c["header_no"]}
        kids.append(Node(norm_header(c["header"]), [], c["header_no"] or 0, data))
    return Node("", kids)


def diff_columns(old, new, learned: frozenset = frozenset()) -> list[tuple[str, str, str]]:
    """(change_kind, old_header, new_header) from one file's columns to the next file's."""
    a, b = _tree(old), _tree(new)
    left, right = {x.label for x in a.children}, {y.label for y in b.children}
    for side, other in ((a, right), (b, left)):  # places among the columns that are not on both sides
        kept = 0
        for n in side.children:
            n.data["place"] = kept
            kept += n.label in other

    def relabel(x: Node, y: Node) -> float:
        if x.label == y.label:
            return 0.0
        if x.data is None or y.data is None:
            return 4.0
        score = rename_score(x.data, y.data, learned)
        return 2 * (1 - score) / (1 - RENAME_FROM) if score < RENAME_FROM else 1.99 * (1 - score) / (1 - RENAME_FROM)

    out = []
    for kind, x, y in edit_script(a, b, relabel, together=True)[1]:
        if (x or y) in (a, b):
            continue
        if kind == "delete":
            out.append(("removed", x.data["header"], ""))
        elif kind == "add":
            out.append(("added", "", y.data["header"]))
        elif kind == "rename":
            out.append(("renamed", x.data["header"], y.data["header"]))
        elif x.data["kind"] and y.data["kind"] and x.data["kind"] != y.data["kind"]:
            out.append(("retyped", x.data["header"], y.data["header"]))
    return out


def _norm(c):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def review_items(review: DataFrame) -> DataFrame:
    """The columns of files, each item_id once (items without an id by file, place and header); rows without a file are
    left out."""
    key = F.coalesce(F.col("item_id"), F.concat_ws("|", F.lit("item"), F.col("file_id").cast("string"), F.col("header_no").cast("string"), "header"))
    cols = ["file_id", "source", "received_at", "header_no", "header", "proposed_field"]
    # samples are reduced to their kind and build in the scan, so they are not shuffled
    shown = F.when(~F.coalesce("samples_withheld", F.lit(False)), F.col("samples"))
    kind = F.coalesce(column_kind(shown), F.lit(None).cast("string"))
    read = review.where("file_id is not null").select(key.alias("__item"), *cols, kind.alias("kind"), F.when(kind == "text", sample_shapes(shown)).alias("shapes"))
    return read.dropDuplicates(["__item"]).drop("__item")


def with_concepts(review: DataFrame) -> DataFrame:
    """Items with the field that most files of the same kind of source propose for their header."""
    items = review_items(review)
    items = items.withColumn("norm", F.coalesce(_norm("header"), F.lit(""))).withColumn("family", F.regexp_replace(F.coalesce("source", F.lit("")), r"[_-]?\d+$", ""))
    votes = items.where("proposed_field is not null").groupBy("family", "norm", "proposed_field").agg(F.count(F.lit(1)).alias("n"))
    concept = votes.groupBy("family", "norm").agg(F.max_by("proposed_field", F.struct("n", "proposed_field")).alias("concept"))
    return lookup_join(items, concept, ["family", "norm"])


def file_pairs(review: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per file: its columns and those of the file received before it from the same source (null
    for a source's first file). Equal times are put in order of file_id."""
    spark = review.sparkSession
    items = with_concepts(review)
    files = durable(
        items.groupBy("file_id").agg(
            F.min("source").alias("source"),
            F.min("received_at").alias("received_at"),
            F.array_sort(F.collect_list(F.struct("header_no", "header", "proposed_field", "concept", "kind", "shapes"))).alias("cols"),
        )
    )
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "received_at", "file_id"]
    keys = durable(
        files.select(*order).repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id())
    )
    here = Window.partitionBy("pid").orderBy(*order)
    inner = keys.withColumn("before", F.lag(F.struct("source", "file_id")).over(here)).withColumn("first", F.row_number().over(here) == 1)
    # one row per partition: its last file, handed to the next partition that holds any
    edges = keys.groupBy("pid").agg(F.max(F.struct(*order)).alias("last"))
    handed = edges.select((F.lead("pid").over(Window.orderBy("pid"))).alias("pid"), F.struct(F.col("last.source"), F.col("last.file_id")).alias("handed"))
    prev = (
        inner.join(F.broadcast(handed), "pid", "left")
        .withColumn("before", F.when(F.col("first"), F.col("handed")).otherwise(F.col("before")))
        .withColumn("prev_id", F.when(F.col("before.source").eqNullSafe(F.col("source")), F.col("before.file_id")))
        .select("file_id", "prev_id")
    )
    old = files.select(F.col("file_id").alias("prev_id"), F.col("cols").alias("old_cols"))
    return files.join(prev, "file_id").join(old, "prev_id", "left").select("file_id", "source", "received_at", "prev_id", "old_cols", "cols")


def _family(source: str | None) -> str:
    return re.sub(r"[_-]?\d+$", "", source or "")


def _other_headers(columns) -> dict[str, str]:
    """norm_header and words of a file's columns that no canonical field covers."""
    return {norm_header(c["header"]): _words(c["header"]) for c in columns if c["concept"] in (None, "none") and _words(c["header"])}


def learned_renames(pairs: DataFrame) -> DataFrame:
    """(family, x, y): wordings without a canonical field, x before y, of which one goes where the other comes in
    at least two sources of a family, and which no file of the family has side by side. At most the pairs of
    its vocabulary."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for s, old, new in zip(pdf.source, pdf.old_cols, pdf.cols):
                a, b = _other_headers(old if old is not None else ()), _other_headers(new)
                here = sorted(set(b.values()))
                out |= {(_family(s), x, y, s or "", True) for i, x in enumerate(here) for y in here[i + 1 :]}
                gone, come = [w for h, w in a.items() if h not in b], [w for h, w in b.items() if h not in a]
                out |= {(_family(s), min(x, y), max(x, y), s or "", False) for x in gone for y in come if x != y}
            yield pd.DataFrame(sorted(out), columns=["family", "x", "y", "source", "together"])

    slim = lambda c: F.transform(c, lambda k: F.struct(k["header"].alias("header"), k["concept"].alias("concept"))).alias(c)
    seen = pairs.select("source", slim("old_cols"), slim("cols")).mapInPandas(met, "family string, x string, y string, source string, together boolean")
    return (
        seen.groupBy("family", "x", "y").agg(F.bool_or("together").alias("together"), F.min("source").alias("one"), F.max("source").alias("two"))
        .where("not together and one <> two").select("family", "x", "y")
    )


def changes(review: DataFrame) -> DataFrame:
    """(file_id, source, change_kind, old_header, new_header) of each file against the one before it.

    A source's first file has no changes. Null headers count as ''; null or withheld samples have no
    kind; a header that a file repeats is paired in order of place; repeated items (same item_id) count once.
    """
    pairs = durable(file_pairs(review))
    learned: dict[str, set] = {}
    for r in learned_renames(pairs).collect():
        learned.setdefault(r["family"], set()).add((r["x"], r["y"]))
    learned = {family: frozenset(p) for family, p in learned.items()}

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (f, s, *c)
                for f, s, old, new in zip(pdf.file_id, pdf.source, pdf.old_cols, pdf.cols)
                for c in diff_columns(old, new, learned.get(_family(s), frozenset()))
            ]
            yield pd.DataFrame(rows, columns=["file_id", "source", "change_kind", "old_header", "new_header"])

    later = pairs.where("prev_id is not null").select("file_id", "source", "old_cols", "cols")
    return later.mapInPandas(scripts, "file_id bigint, source string, change_kind string, old_header string, new_header string")


def canonical_columns(review: DataFrame, found: DataFrame) -> DataFrame:
    """(source, norm, column): the consistent column of each header of a source. Headers joined by renames
    share one; its name is the field most of their files propose, else the first header of the chain."""
    items = with_concepts(review)
    votes = items.where("concept is not null and concept <> 'none'").groupBy("source", "norm", "concept").agg(F.count(F.lit(1)).alias("n"))
    heads = items.groupBy("source", "norm").agg(F.min(F.struct("received_at", "header_no")).alias("seen"))
    best = votes.groupBy("source", "norm").agg(F.max(F.struct("n", "concept")).alias("vote"))
    links = (
        found.where("change_kind = 'renamed'").select("source", _norm("old_header").alias("norm"), _norm("new_header").alias("other")).distinct()
        .groupBy("source", "norm").agg(F.collect_set("other").alias("others"))
    )
    per_head = heads.join(best, ["source", "norm"], "left").join(links, ["source", "norm"], "left").select(
        "source", "norm", F.col("seen.received_at").alias("at"), F.col("vote.n").alias("n"), F.col("vote.concept").alias("concept"), "others"
    )

    def chains(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per distinct wording of a source: bounded by its vocabulary, not by its rows
        root = {h: h for h in pdf.norm}

        def find(h):
            while root[h] != h:
                root[h] = root[root[h]]
                h = root[h]
            return h

        first = dict(zip(pdf.norm, pdf["at"]))
        for h, others in zip(pdf.norm, pdf.others):
            for o in others if others is not None else ():
                if o in root:
                    p, q = sorted((find(h), find(o)), key=lambda x: (str(first[x]), x))
                    root[q] = p
        votes: dict[str, Counter] = {}
        for h, n, c in zip(pdf.norm, pdf.n, pdf.concept):
            if c is not None and n == n:
                votes.setdefault(find(h), Counter())[c] += int(n)
        name = {r: min(v.items(), key=lambda x: (-x[1], x[0]))[0] for r, v in votes.items()}
        return pd.DataFrame({"source": pdf.source, "norm": pdf.norm, "column": [name.get(find(h), find(h)) for h in pdf.norm]})

    return per_head.groupBy("source").applyInPandas(chains, "source string, norm string, `column` string")


def consistent_table(review: DataFrame, raw: DataFrame, found: DataFrame) -> DataFrame:
    """All raw rows in one table: a column per canonical field, everything else by name in other_columns.

    A field has the narrowest type that holds what all its files bring: a day where all samples are dates, a decimal number
    where numbers come with decimals in some, else text; whole numbers alone stay text, since they may be codes with
    leading zeros. A cell that its column's type cannot hold is null there and kept in other_columns as "FIELD as written".

    A file that gives one field twice keeps the first by place; the later ones go to other_columns
    under their header. Cells beyond the headers are kept as column_N. Null cells stay null.
    """
    items = review_items(review).where("header_no is not null").dropDuplicates(["file_id", "header_no"]).withColumn("norm", F.coalesce(_norm("header"), F.lit("")))
    named = items.select("source", "file_id", "header_no", "norm").join(canonical_columns(review, found), ["source", "norm"], "left")
    place = Window.partitionBy("file_id", "column").orderBy("header_no")
    named = named.withColumn("column", F.when(F.row_number().over(place) == 1, F.col("column")).otherwise(F.concat("norm", F.lit(" #"), F.col("header_no").cast("string"))))
    projection = named.groupBy("file_id").agg(
        F.min("source").alias("source"), F.map_from_entries(F.collect_list(F.struct(F.col("header_no").cast("int"), F.coalesce("column", F.concat(F.lit("column_"), F.col("header_no").cast("string")))))).alias("names")
    )
    fields = sorted(r[0] for r in bounded(review.select(F.explode("allowed_fields")).distinct(), FIELDS, "fields") if r[0] and r[0] != "none")
    brought = with_concepts(review).where("kind is not null and concept is not null").groupBy("concept").agg(F.collect_set("kind").alias("kinds"))
    kinds = {r["concept"]: set(r["kinds"]) for r in bounded(brought, FIELDS, "fields")}
    rows = lookup_join(raw.select("raw_id", "file_id", "row_number", "cells"), projection, ["file_id"]).withColumn(
        "keys", F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda v, i: F.coalesce(F.col("names")[i + 1], F.concat(F.lit("column_"), (i + 1).cast("string"))))
    ).withColumn(
        "cell_map",  # a name that a file gives twice gets its place added
        F.map_from_entries(F.transform("keys", lambda k, i: F.struct(
            F.when(F.array_position("keys", k) == i + 1, k).otherwise(F.concat(k, F.lit(" at place "), (i + 1).cast("string"))), F.get("cells", i)))),
    )
    typed, kept = {}, []
    for f in fields:
        cell, brings = F.col("cell_map")[f], kinds.get(f, set())
        if brings == {"date"}:
            typed[f] = parse_date_loose(cell)
        elif "decimal" in brings and brings <= {"decimal", "whole"}:
            bare = F.regexp_replace(cell, r"[$,\s]", "")
            typed[f] = F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast("decimal(38,6)")
        else:
            typed[f] = cell
            continue
        kept.append(F.when((_trimmed(cell) != "") & typed[f].isNull(), F.struct(F.lit(f"{f} as written").alias("key"), cell.alias("value"))))
    others = F.map_filter("cell_map", lambda k, v: ~k.isin(fields))
    if kept:
        others = F.map_concat(others, F.map_from_entries(F.filter(F.array(*kept), lambda e: e.isNotNull())))
    return rows.select("raw_id", "file_id", "source", "row_number", *[typed[f].alias(f.replace(".", "__")) for f in fields], others.alias("other_columns"))
