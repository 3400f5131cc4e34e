"""Several values packed in one field: one row per value, with its place.

The text is split at its quoted spans. What lies inside quotes is a literal; what lies between
them is split on delimiters; an array fold puts literal and plain parts of one value together
again and numbers the values. Everything is a built-in expression, so the operator is a narrow
stage without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quotes open only at the start of a value and need a closing one; a doubled quote inside stands for one.
_EDGE = r"(?:^|(?<=[,;|/&\s])|(?<=[\s,;|/&](?i:and)))"
# Possessive and unrolled: the regex engine walks a span of any length in a loop, without recursion.
QUOTED = _EDGE + r"""(?:"[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+')"""
DELIMITER = r"[,;|/&\n\r\t\x0B\f\u0085  ]|(?i)\band\b"
CODES_ONLY = r"^[A-Za-z]{2}(?:\s++[A-Za-z]{2})++$"
CUT, OPEN = "\x01", "\x02"


def split_values(text: Column) -> Column:
    """array<string> of the values of a packed text, in order, repeats kept.

    Null text gives null; empty text, or delimiters alone, an empty array. Values are trimmed, empty
    values skipped. A space separates only where a plain part holds nothing but two-letter codes.
    A quote that never closes, or stands inside a word, is an ordinary character.
    """
    clean = F.translate(text, CUT + OPEN, "  ")
    literals = F.transform(F.regexp_extract_all(clean, F.lit(f"({QUOTED})"), 1), _unquote)
    plain = F.split(clean, QUOTED, -1)
    marked = F.transform(plain, lambda p: F.regexp_replace(p, DELIMITER, CUT))
    # odd pieces (literals) carry OPEN in front, so that a literal's own commas and spaces stay
    folded = F.array_join(  # a fold in one pass; adding to one growing text would copy it for every piece
        F.transform(marked, lambda p, i: F.concat(p, F.coalesce(F.concat(F.lit(OPEN), F.get(literals, i)), F.lit("")))), ""
    )
    parts = F.split(folded, CUT, -1)
    values = F.flatten(
        F.transform(
            parts,
            lambda v: F.when(v.contains(OPEN), F.array(F.translate(v, OPEN, "")))
            .when(_strip(v).rlike(CODES_ONLY), F.split(_strip(v), r"\s+"))
            .otherwise(F.array(v)),
        )
    )
    return F.filter(F.transform(values, _strip), lambda v: v != "")


def _strip(v: Column) -> Column:
    return F.regexp_replace(v, r"^[\s ]+|[\s ]+$", "")


def _unquote(q: Column) -> Column:
    inner = F.substring(q, F.lit(2), F.length(q) - 2)
    return F.when(F.substring(q, 1, 1) == '"', F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(
        F.replace(inner, F.lit("''"), F.lit("'"))
    )


def explode_values(df: DataFrame, key: str, column: str, pos: str = "pos_no", value: str = "license_value") -> DataFrame:
    """(key, pos, value) for each value packed in column; positions count from 1. Rows whose text is
    null or holds no value give no row; repeated rows and repeated values are kept."""
    src = df.select(F.col(key).alias(key), split_values(F.col(column)).alias("__v"))
    return src.select(key, F.posexplode("__v").alias("__p", value)).select(
        key, (F.col("__p") + 1).cast("bigint").alias(pos), value
    )
