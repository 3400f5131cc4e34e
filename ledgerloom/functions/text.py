"""Names, lists, masks, shapes and fingerprints of rows."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = ("jr", "sr", "ii", "iii")
#: How headers shorten words (fixed values).
SHORT_WORDS = {
    "addr": "address", "amt": "amount", "comm": "commission", "dt": "date", "eff": "effective", "mbr": "member", "nbr": "number", "no": "number",
    "num": "number", "pmt": "payment", "seq": "sequence", "stmt": "statement", "term": "termination", "txn": "transaction", "yr": "year",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def name_key(c: Column) -> Column:
    """Lower-case a to z only."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def normalize_name(c: Column) -> Column:
    """Lower case, apostrophes dropped, punctuation as spaces, suffixes dropped unless nothing would stay."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(c), "['’]", ""), r"[^\p{L}\p{N}_\s]", " ")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*SUFFIXES))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def split_list(c: Column) -> Column:
    """Upper-case parts between bars, commas, semicolons, slashes and white space."""
    return F.filter(F.split(F.upper(c), r"[|,;/\s]+"), lambda p: p != "")


def mask(c: Column) -> Column:
    """The first third, two characters at most, stays; other letters and digits become stars; cut after 32."""
    keep = F.least(F.lit(2), F.floor(F.length(c) / 3)).cast("int")
    starred = F.concat(F.substring(c, F.lit(1), keep), F.regexp_replace(F.substring(c, keep + 1, F.length(c)), r"[\p{L}\p{N}]", "*"))
    return F.when(F.length(starred) > 32, F.concat(F.substring(starred, 1, 32), F.lit("..."))).otherwise(starred)


def shape(c: Column) -> Column:
    """Digits as 9, letters as A, cut after 32."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"\p{N}", "9"), r"\p{L}", "A"), 1, 32)


def row_hash(cells: list[Column]) -> Column:
    """SHA-256 over the cells' texts with unit separators between; null counts as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), "\x1f"), 256)


def short_id(prefix: str, parts: list[Column]) -> Column:
    """prefix and the first 12 hex digits of the hash of the parts, null as empty."""
    joined = F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "|")
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 12))


def formula_guard(c: Column) -> Column:
    """An apostrophe before anything that a spreadsheet would run."""
    risky = F.ltrim(c).rlike(r"^[=+@-]") | c.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


# headers: a few hundred strings, handled on the driver ------------------------------------------------
def normalize_header(h: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", h or "") if not unicodedata.combining(c))
    flat = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", flat).replace("#", " number ")
    return " ".join(SHORT_WORDS.get(w, w) for w in re.findall(r"[a-z0-9]+", flat.casefold()))


def header_similarity(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return max(SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y) if x | y else 0.0)


def format_fingerprint(headers: list[str]) -> str:
    return hashlib.sha256("\x1f".join((h or "").strip().lower() for h in headers).encode()).hexdigest()[:16]
