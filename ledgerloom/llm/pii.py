"""Personal information inside free text: found by a bidirectional LSTM with CRF, checked, replaced."""

from __future__ import annotations

import io
import pkgutil
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bilstm_crf import Tagger
from ledgerloom.llm.pii_corpus import AFTER_PERSON, AFTER_VALUE, BEFORE_PERSON, BEFORE_VALUE, KIN, KINDS, LABELS, WORDS

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
SPANS = "array<struct<span_start:bigint,span_end:bigint,pii_kind:string>>"


def tags_of(length: int, spans) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


@lru_cache(maxsize=1)
def model() -> Tagger:
    raw = pkgutil.get_data("ledgerloom.llm", "pii_weights.npz")
    with np.load(io.BytesIO(raw)) as z:
        return Tagger({k: z[k].astype(np.float32) for k in z.files})


# The exact check. It moves a found span to the edges of the token, number or address that it lies on, and drops
# a span that holds nothing of its kind; it never adds one. A form that the patterns do not list stays as found, at
# token edges, if it holds what its kind needs.
_EMAIL = re.compile(r"[\w.+-]+(?:@|\s*\(at\)\s*|\s*\[at\]\s*|\s+at\s+|\s+arroba\s+)[\w-]+(?:(?:\.|\s+dot\s+|\s+punto\s+|\s*\(dot\)\s*)[\w-]+)+", re.I)
_PHONE = re.compile(r"(?<![\w-])(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s?|\d{3}[-./\s]?)?\d{3}[-.\s]?\d{4}(?:\s?(?:x|ext(?:ension|n)?\.?)\s?\d{1,5})?(?![\w-]*\d)", re.I)
_ABROAD = re.compile(r"(?<![\w-])(?:\+|00|011[ -])\d{1,3}(?:[-. ]?\(?\d{1,5}\)?){2,5}(?:\s?(?:x|ext(?:ension|n)?\.?)\s?\d{1,5})?(?![\w-]*\d)", re.I)
_IDNUM = re.compile(r"(?<![\w-])(?:\d{3}[-. ]?\d{2}[-. ]?\d{4}|\d[a-z]{2}\d-?[a-z][a-z0-9]\d-?[a-z]{2}\d{2}|[a-z]\d{3}-\d{4}-\d{4}|[a-z]\d{8})(?![\w-])", re.I)
_WORD = r"[^\W\d_][\w'’-]*\.?"
_TITLES = re.compile(r"^(?:(?:dr|mrs?|ms|miss|sra?|srta|don|doña)\b\.?\s*)+", re.I)
_STATE_ZIP = r"(?:\s*,)?\s+(?:A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])\b(?:\s+\d{5}(?:-\d{4})?)?"
_TAIL = re.compile(_STATE_ZIP)


#: An email address has at most 254 characters; no number is longer.
REACH = 320


def _overlap(text: str, rx: re.Pattern, a: int, b: int) -> tuple[int, int] | None:
    """The match of rx that shares most characters with text[a:b]. No match begins or ends farther off than REACH."""
    best, size = None, 0
    for m in rx.finditer(text, max(0, a - REACH), min(len(text), b + REACH)):
        common = min(b, m.end()) - max(a, m.start())
        if common > size:
            best, size = (m.start(), m.end()), common
    return best


_LIKE = {
    "email": re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+"),
    "phone": re.compile(r"(?:\+|00)?(?:[-./\s()]*\d){7,15}\)?(?:,?\s*(?:x|ext(?:ension|n)?\.?)\s*\d{1,5})?", re.I),
    "id_number": re.compile(r"(?=(?:[^\d]*\d){5})[a-z\d]+(?:[-. /][a-z\d]+)*", re.I),
}


def _unlisted(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span at token edges if it holds what its kind needs, else None."""
    while a > 0 and a < len(text) and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while 0 < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    while b > a and not text[b - 1].isalnum() and text[b - 1] != ")":
        b -= 1
    while a < b and not text[a].isalnum() and text[a] not in "+(":
        a += 1
    return (a, b) if _LIKE[kind].fullmatch(text, a, b) else None


#: What a number is called that is no mention: it belongs to a policy, a plan, a case or an order.
_OTHER = re.compile(r"\b(?:polic(?:y|ies)|p[oó]liza|plan|contract|case|caso|ref(?:erence)?|conf(?:irmation)?|claim|order|npn|agent|agente|ticket|group|form|batch|invoice|acct|tracking|check|member id|zip|since|room|page)\W{0,3}(?:no|nr|num|number|npn|id)?\W{0,3}(?:[a-z]{1,3}-?)?$", re.I)


_EVERYDAY = {w for x in (*WORDS, *KIN, *AFTER_PERSON, *AFTER_VALUE, *BEFORE_PERSON, *(v for vs in BEFORE_VALUE.values() for v in vs), *LABELS.values()) for w in re.findall(r"[a-z]{3,}", x)}
_SMALL_WORD = re.compile(r"[a-záéíóúñü]+")
_IN_ADDRESS = {"apt", "unit", "ste", "suite", "lot", "rm", "box", "de", "la", "las", "los", "del", "of", "the", "floor", "bldg", "no", "st", "nd", "rd", "th"}
_STREET_ENDS = re.compile(r"\b(?:street|avenue|court|lane|road|drive|place|circle|boulevard|parkway|terrace|highway|trail|[A-Z]{2})(?=\.\s)", re.I)


def _without_everyday(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without small-letter everyday words, and what stands around them, at its ends."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[\w'’.-]+", text[a:b])]
    plain = lambda w: bool(_SMALL_WORD.fullmatch(t := text[a + w[0] : a + w[1]])) and t in _EVERYDAY
    while words and plain(words[-1]):
        words.pop()
    while words and plain(words[0]):
        words.pop(0)
    return (a + words[0][0], a + words[-1][1]) if words else (a, a)


def _address_end(text: str, a: int, b: int) -> int:
    """Where an address ends: before the first word in small letters that belongs to none, or where a sentence does."""
    s = text[a:b]
    if m := _STREET_ENDS.search(s):
        s = s[: m.end()]
    if re.search(r"[A-Z]", s):
        for m in re.finditer(r"[,;]?\s+([a-z]{2,})\b", s):
            if m[1] not in _IN_ADDRESS and re.search(r"[A-Z]", s[: m.start()]):
                return a + m.start()
    return a + len(s)


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span's exact edges, or None if nothing of its kind is there."""
    if kind != "person_name" and kind != "email" and _OTHER.search(text, max(0, a - 40), a):
        return None
    if kind == "email":
        return _overlap(text, _EMAIL, a, b) or _unlisted(text, a, b, kind)
    if kind == "phone":
        here, abroad = _overlap(text, _PHONE, a, b), _overlap(text, _ABROAD, a, b)
        if here and abroad:  # a number from abroad may hold what looks like a local one
            return max(here, abroad, key=lambda e: e[1] - e[0])
        return here or abroad or _unlisted(text, a, b, kind)
    if kind == "id_number":
        return _overlap(text, _IDNUM, a, b) or _unlisted(text, a, b, kind)
    while a > 0 and re.match(r"[\w]", text[a]) and re.match(r"[\w'’]", text[a - 1]):
        a -= 1
    while b < len(text) and re.match(r"\w", text[b - 1]) and re.match(r"[\w]", text[b]):
        b += 1
    s = text[a:b]
    if kind == "person_name":
        m = _TITLES.match(s)
        if m:
            a += m.end()
        while b > a and not re.match(r"\w", text[b - 1]):
            b -= 1
        while a < b and not re.match(r"\w", text[a]):
            a += 1
        a, b = _without_everyday(text, a, b)
        return (a, b) if re.search(r"[^\W\d_]{2}", text[a:b]) else None
    if not re.search(r"\d", s):
        return None
    first = re.search(r"\d|\b(?:p\.?\s?o\.?|post|box)\b", s, re.I)
    a += first.start() if first else 0
    b = _address_end(text, a, b)
    b = a + len(text[a:b].rstrip(" .,;:-/&(!\n\t"))
    if m := _TAIL.match(text, b):  # a state and ZIP code that follow belong to it
        b = m.end()
    return (a, b) if b - a > 4 else None


def spans_of(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The settled mentions of each text, in order; where two touch the same characters the longer stays."""
    out = []
    for text, path in zip(texts, model().best_paths(texts)):
        raw, start, kind = [], None, None
        for i, t in enumerate([*path.tolist(), 0]):
            k = (t - 1) // 2 if t else None
            if start is not None and (k != kind or (t and t % 2)):
                raw.append((start, i, KINDS[kind]))
                start = None
            if start is None and k is not None:
                start, kind = i, k
        found: list[tuple[int, int, str]] = []
        for a, b, name in raw:
            edges = settle(text, a, b, name)
            if edges is None:
                continue
            if found and edges[0] < found[-1][1]:
                if edges[1] - edges[0] > found[-1][1] - found[-1][0]:
                    found[-1] = (*edges, name)
                continue
            found.append((*edges, name))
        out.append(found)
    return out


def redact(text: str, spans) -> str:
    """The text with each mention replaced by [KIND]."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find(rows: DataFrame, key: str = "rec_id", column: str = "notes") -> DataFrame:
    """(key, notes, spans, redacted). Null or empty texts have no mentions; a text of any length is read whole,
    in overlapping windows. Repeated rows each keep their result."""

    def tag(texts: pd.Series) -> pd.DataFrame:
        distinct = list(dict.fromkeys(t for t in texts if t))
        known = dict(zip(distinct, spans_of(distinct)))
        rows = []
        for t in texts:
            sp = known.get(t, [])
            rows.append(([{"span_start": a, "span_end": b, "pii_kind": k} for a, b, k in sp], redact(t, sp) if t else t))
        return pd.DataFrame(rows, columns=["spans", "redacted"])

    # not deterministic to the planner, or it would run the model once more to see whether there are spans
    udf = F.pandas_udf(tag, f"spans {SPANS}, redacted string").asNondeterministic()
    return rows.select(key, column).where(F.col(column).isNotNull()).withColumn("r", udf(column)).select(key, column, "r.*")


def mentions(rows: DataFrame, key: str = "rec_id", column: str = "notes") -> DataFrame:
    return find(rows, key, column).select(key, F.explode("spans").alias("s")).select(key, "s.*")
