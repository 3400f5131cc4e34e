"""Headers of files mapped to canonical fields; a few hundred strings, decided once per distinct header."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import header_similarity, normalize_header

LEAST_SCORE, BEST = 0.5, 3


def map_headers(headers: Iterable[str], synonyms: dict[str, list[str]], saved: dict[str, str] | None = None, required: Iterable[str] = ()) -> dict:
    """Saved decisions first, then exact synonyms; the second header for a field is refused, the rest get candidates.

    Returns mapped (header -> field), doubles (header -> field already taken), open (header -> best candidates) and missing.
    """
    exact = {normalize_header(w): f for f, words in synonyms.items() for w in (*words, f.split(".")[-1])}
    mapped, doubles, unknown = {}, {}, {}
    for h in headers:
        field = (saved or {}).get(h) or exact.get(normalize_header(h))
        if field is None:
            unknown[h] = candidates(h, synonyms)
        elif field in mapped.values():
            doubles[h] = field
        else:
            mapped[h] = field
    return {"mapped": mapped, "doubles": doubles, "open": unknown, "missing": sorted(set(required) - set(mapped.values()))}


def candidates(header: str, synonyms: dict[str, list[str]], best: int = BEST) -> list[tuple[str, float]]:
    """The fields whose wordings come closest, at LEAST_SCORE or more, best first, ties by name."""
    h = normalize_header(header)
    scored = {f: max((header_similarity(h, normalize_header(w)) for w in (*words, f.split(".")[-1])), default=0.0) for f, words in synonyms.items()}
    return sorted(((f, round(s, 6)) for f, s in scored.items() if s >= LEAST_SCORE), key=lambda x: (-x[1], x[0]))[:best]


def learn_synonyms(review: DataFrame, least: int = 2) -> DataFrame:
    """(field, wording, files) that reviewers or models proposed at least so often."""
    norm = F.lower(F.trim(F.regexp_replace("header", r"\s+", " ")))
    return (review.where("proposed_field is not null and proposed_field <> 'none'").groupBy(F.col("proposed_field").alias("field"), norm.alias("wording"))
            .agg(F.countDistinct("file_id").cast("bigint").alias("files")).where(F.col("files") >= least))


def header_candidates(review: DataFrame, best: int = BEST) -> DataFrame:
    """(header, rank, field, score) for each distinct header against the wordings learnt from all other headers."""
    words: dict[str, list[str]] = {}
    for r in learn_synonyms(review).orderBy("field", "wording").collect():  # wordings of canonical fields: a vocabulary, not rows
        words.setdefault(r["field"], []).append(r["wording"])

    def score(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, k + 1, f, s) for h in pdf.header for k, (f, s) in enumerate(candidates(h, words, best))]
            yield pd.DataFrame(rows, columns=["header", "rank", "field", "score"])

    distinct = review.select(F.lower(F.trim(F.regexp_replace("header", r"\s+", " "))).alias("header")).distinct()
    return distinct.mapInPandas(score, "header string, rank bigint, field string, score double")


def mapping_conflicts(review: DataFrame) -> DataFrame:
    """Files in which two headers or more are proposed for one field."""
    return (review.where("proposed_field is not null and proposed_field <> 'none'").groupBy("file_id", "proposed_field")
            .agg(F.countDistinct("header").cast("bigint").alias("headers")).where("headers > 1"))


def format_changes(review: DataFrame) -> DataFrame:
    """Files whose fingerprint differs from that of the file before from the same source: (file_id, source)."""
    from pyspark.sql import Window

    files = review.groupBy("file_id").agg(F.min("source").alias("source"), F.min("received_at").alias("at"), F.min("format_fingerprint").alias("print"))
    w = Window.partitionBy("source").orderBy("at", "file_id")  # one short row per file of a source
    return files.withColumn("before", F.lag("print").over(w)).where("before is not null and before <> print").select("file_id", "source")


def benchmark(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Accuracy, coverage, wrong and missed of predicted (header, field) against truth (header, field)."""
    j = truth.select("header", F.col("field").alias("want")).join(predicted.select("header", F.col("field").alias("got")), "header", "left")
    same = F.col("got").eqNullSafe(F.col("want"))
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("headers"), F.count_if(same).cast("bigint").alias("right"), F.count("got").cast("bigint").alias("covered"),
                 F.count_if(F.col("got").isNotNull() & ~same).cast("bigint").alias("wrong"), F.count_if(F.col("got").isNull() & F.col("want").isNotNull()).cast("bigint").alias("missed"))
