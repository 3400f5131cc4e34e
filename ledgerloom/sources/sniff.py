"""Reading the form of a delimited file from its first and last lines: encoding, delimiter, header row, totals."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter

DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES, HEADER_ROWS, WORDS_FROM = 50, 20, 0.6
_TOTAL = re.compile(r"^(?:grand[ -]?|sub[ -]?)?totals?\b", re.I)
_WORD = re.compile(r"[^\W\d_]")


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8 if the bytes are, with or without a mark, else Latin-1."""
    body = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        return body.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return body.decode("latin-1"), "latin-1"


def sniff_delimiter(text: str) -> tuple[str, bool]:
    """(delimiter, sure): the one whose most frequent field count, two at least, holds for most lines, then gives most fields."""
    lines = [line for line in text.splitlines() if line.strip()][:HEAD_LINES]
    best, score = ",", (0.0, 0)
    for d in DELIMITERS:
        counts = Counter(len(r) for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=d))
        fields, n = max(counts.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        if fields >= 2 and (n / sum(counts.values()), fields) > score:
            best, score = d, (n / sum(counts.values()), fields)
    return best, score[0] == 1.0


def header_row(rows: list[list[str]]) -> int:
    """The first of the first rows in which most of the widest row's cells are words; else 0."""
    head = rows[:HEADER_ROWS]
    width = max((sum(bool(c.strip()) for c in r) for r in head), default=0)
    for k, r in enumerate(head):
        words = sum(bool(c.strip()) and bool(_WORD.search(c)) and not re.search(r"\d{3}", c) for c in r)
        if width and words >= WORDS_FROM * width:
            return k
    return 0


def trim_totals(rows: list[list[str]]) -> tuple[list[list[str]], int | None]:
    """Rows without a closing block of totals and footers, and the row count printed there, if any."""
    end, cut, printed = len(rows), len(rows), None
    while end:
        filled = [c for c in rows[end - 1] if c and c.strip()]
        if filled and _TOTAL.match(filled[0].strip()):
            end -= 1
            cut = end
            cells = [c.strip() for c in rows[end]]
            if printed is None and len(cells) > 1 and cells[1].replace(",", "").isdigit():
                printed = int(cells[1].replace(",", ""))
        elif len(filled) <= 1:
            end -= 1
        else:
            break
    while cut and not any(c and c.strip() for c in rows[cut - 1]):  # blank rows at the end go in any case
        cut -= 1
    return rows[:cut], printed


def column_names(header: list[str]) -> list[str]:
    """Names for every column: blank ones by place, repeated ones numbered, none called lineage."""
    out: list[str] = []
    taken: set[str] = set()
    for k, h in enumerate(header, 1):
        base = (h or "").strip() or f"column_{k}"
        base = f"{base}_1" if base.lower() == "lineage" else base
        name, n = base, 2
        while name.lower() in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out
