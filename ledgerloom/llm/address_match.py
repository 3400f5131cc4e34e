"""Which address rows denote the same place.

Every distinct address is read into its parts. The street's name becomes a vector of character n-grams,
weighted by how rare a gram is among all distinct addresses. Candidates come from an inverted index that
holds only each vector's prefix: its rarest grams, up to where the rest is too light to reach the
threshold, so no pair at or above the threshold is lost. An entry's key also holds house number (or
box) and unit, since these must agree anyway; lists stay short however common a street is. Candidates
are verified by cosine, by edit distance of the names, and by the parts that must not differ.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.address_parts import Address, parse
from ledgerloom.runtime import durable

COSINE = 0.2
_PARTS = Address._fields


_PARTS_TYPE = "struct<" + ",".join(f"{f}:string" for f in _PARTS) + ">"


def _parsed(line: pd.Series, city: pd.Series, state: pd.Series, zipcode: pd.Series) -> pd.DataFrame:
    rows = []
    for row in zip(line, city, state, zipcode):
        a = parse(*row)
        if not a.number:  # nothing to tell places apart by: only the same wording is the same place
            a = parse(None, *row[1:])._replace(number="text " + " ".join((row[0] or "").lower().split()))
        rows.append(a)
    return pd.DataFrame(rows, columns=list(_PARTS))


def grams(name: str) -> list[str]:
    """Distinct two-letter grams of a street name with its ends marked; [] for none."""
    padded = f"^{name}$"
    return list(dict.fromkeys(padded[i : i + 2] for i in range(len(padded) - 1))) if name else []


def prefix(gs: list[str], weight: dict[str, float], least: float = COSINE) -> list[str]:
    """The rarest grams, until those left weigh less than `least` of the vector."""
    order = sorted(gs, key=lambda g: (-weight.get(g, 0.0), g))
    total = math.sqrt(sum(weight.get(g, 0.0) ** 2 for g in gs)) or 1.0
    rest, out = sum(weight.get(g, 0.0) ** 2 for g in gs), []
    for g in order:
        if math.sqrt(max(rest, 0.0)) / total < least:
            break
        out.append(g)
        rest -= weight.get(g, 0.0) ** 2
    return out


def read_addresses(rows: DataFrame, key: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """(members, places): each row's address id, and the parts of each distinct address."""
    raw = ["address_line1", "city", "state", "zip"]
    read = durable(
        rows.where("address_line1 is not null").select(F.col(key).alias("row_id"), F.pandas_udf(_parsed, _PARTS_TYPE)(*raw).alias("p"))
        .select("row_id", "p.*").withColumn("place", F.xxhash64(*_PARTS))
    )
    return read.select("row_id", "place"), read.dropDuplicates(["place"]).select("place", *_PARTS)


def gram_weights(places: DataFrame) -> dict[str, float]:
    """log(1 + N / n) of each gram over all distinct addresses. Grams are pairs of the 38 characters that a
    read street may hold (and two marks), so the table has at most 1,600 rows."""
    counts = places.select(F.explode(F.pandas_udf(_grams, "array<string>")("street")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    total = max((r["n"] for r in counts), default=1)
    return {r["g"]: math.log1p(total / r["n"]) for r in counts}


def _grams(s: pd.Series) -> pd.Series:
    return s.map(grams)


def _near(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) <= F.when(F.least(F.length(a), F.length(b)) >= 9, 3).when(F.least(F.length(a), F.length(b)) >= 5, 2).otherwise(1)


def _or_missing(a: Column, b: Column, test: Column) -> Column:
    return (a == "") | (b == "") | test


def same_town(x: str = "a", y: str = "b") -> Column:
    """Both towns alike, with no other state; where a town is lacking the ZIP codes, else the states, must agree.
    A ZIP code may have one digit wrong or two swapped."""
    c = lambda f: (F.col(f"{x}_{f}"), F.col(f"{y}_{f}"))
    (ta, tb), (sa, sb), (za, zb) = c("town"), c("state"), c("zip")
    letters = lambda z: F.array_sort(F.split(z, ""))
    zip_near = (za == zb) | (letters(za) == letters(zb)) | (F.levenshtein(za, zb) <= 1)
    both = (ta != "") & (tb != "")
    zips = (za != "") & (zb != "")
    state_ok = _or_missing(sa, sb, sa == sb)
    named = _near(ta, tb) & (~zips | zip_near | ((sa != "") & (sa == sb)))
    return state_ok & F.when(both, named).when(zips, zip_near).otherwise((sa != "") & (sa == sb))


def place_pairs(places: DataFrame, least: float = COSINE) -> DataFrame:
    """(place_a, place_b, cosine) of different wordings of one place, place_a < place_b."""
    weight = gram_weights(places)

    @F.pandas_udf("struct<gs:array<string>,pre:array<string>,norm:double>")
    def vector(street: pd.Series) -> pd.DataFrame:
        out = []
        for s in street:
            gs = grams(s)
            out.append((gs, prefix(gs, weight, least) or ["-"], math.sqrt(sum(weight.get(g, 0.0) ** 2 for g in gs))))
        return pd.DataFrame(out, columns=["gs", "pre", "norm"])

    @F.pandas_udf("double")
    def dot(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(weight.get(g, 0.0) ** 2 for g in set(x) & set(y)) for x, y in zip(a, b)], dtype=float)

    vectors = durable(places.where("number <> ''").withColumn("v", vector("street")).select("*", "v.*").drop("v"))
    index = vectors.select("place", F.explode("pre").alias("g"), "number", "unit", "state")
    known, free = index.where("state <> ''"), index.where("state = ''").select(F.col("place").alias("x"), "g", "number", "unit")
    other = known.select(F.col("place").alias("place_b"), "g", "number", "unit", "state")
    # states that are given must agree, so they are part of the key; the few addresses without one meet all
    alike = known.withColumnRenamed("place", "place_a").join(other, ["number", "unit", "g", "state"]).where("place_a < place_b").select("place_a", "place_b")
    open_ = free.join(index.select(F.col("place").alias("y"), "g", "number", "unit"), ["number", "unit", "g"]).where("x <> y").select(F.least("x", "y").alias("place_a"), F.greatest("x", "y").alias("place_b"))
    pairs = alike.unionByName(open_).distinct()
    cols = [*(f for f in _PARTS if f not in ("number", "unit")), "gs", "norm"]
    for side in "ab":
        pairs = pairs.join(vectors.select(F.col("place").alias(f"place_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in cols]), f"place_{side}")
    agree = pairs.where(
        _or_missing(F.col("a_direction"), F.col("b_direction"), F.col("a_direction") == F.col("b_direction"))
        & _or_missing(F.col("a_kind"), F.col("b_kind"), F.col("a_kind") == F.col("b_kind"))
        & ((F.col("a_street") == F.col("b_street")) | _near(F.col("a_street"), F.col("b_street")))
        & same_town()
    )
    cosine = F.when(F.col("a_street") == F.col("b_street"), 1.0).otherwise(dot("a_gs", "b_gs") / (F.col("a_norm") * F.col("b_norm")))
    return agree.withColumn("cosine", cosine).where(F.col("cosine") >= least).select("place_a", "place_b", "cosine")


def same_place(rows: DataFrame, key: str = "rec_id", least: float = COSINE) -> DataFrame:
    """(a, b, cosine): all pairs of rows, a < b, whose addresses denote the same place.

    Rows without address_line1 take no part. A missing unit is no unit; a missing direction or street type
    agrees with any, so one that lacks them can pair with two that differ. Repeated rows pair like others. An address with neither town, ZIP code nor state
    pairs with nothing, not even its own wording. Empty tables give an empty result.
    """
    members, places = read_addresses(rows, key)
    places = places.where("town <> '' or zip <> '' or state <> ''")
    pairs = durable(place_pairs(places, least))
    left = members.select(F.col("row_id").alias("x"), F.col("place").alias("place_a"))
    right = members.select(F.col("row_id").alias("y"), F.col("place").alias("place_b"))
    copies = members.join(places.select("place"), "place", "left_semi")
    within = (
        copies.select(F.col("row_id").alias("x"), "place").join(copies.select(F.col("row_id").alias("y"), "place"), "place").where("x < y")
        .select("x", "y", F.lit(1.0).alias("cosine"))
    )
    across = pairs.join(left, "place_a").join(right, "place_b").select("x", "y", "cosine")
    return within.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")
