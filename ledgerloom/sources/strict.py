"""Import of a statement whose layout is stated in full: any departure refuses the whole file."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from dataclasses import dataclass
from decimal import Decimal

from ledgerloom.sources import sniff, spreadsheet

_MONEY = re.compile(r"-?\d{1,10}(?:\.\d{1,2})?")


@dataclass(frozen=True)
class Layout:
    sha256: str
    headers: tuple[str, ...]
    amount: str
    header_row: int = 1
    sheet: str | None = None
    most_rows: int = 1_000_000
    most_chars: int = 4_000


def read_strict(raw: bytes, layout: Layout) -> list[dict]:
    """The rows as header -> text, amounts as exact decimals; ValueError names the first thing that does not fit."""
    if hashlib.sha256(raw).hexdigest() != layout.sha256:
        raise ValueError("the file is not the one that was agreed on")
    if layout.sheet is not None:
        sheets = spreadsheet.read_sheets(raw, [layout.sheet])
        if layout.sheet not in sheets:
            raise ValueError("the sheet is absent")
        rows = [[c or "" for c in r] for r in sheets[layout.sheet]]
    else:
        text, encoding = sniff.decode(raw)
        if encoding != "utf-8":
            raise ValueError("the file is not UTF-8")
        rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    head = rows[layout.header_row - 1] if len(rows) >= layout.header_row else []
    if tuple(head) != layout.headers:
        raise ValueError("the headers are not those of the layout")
    body = rows[layout.header_row :]
    if len(body) > layout.most_rows:
        raise ValueError("too many rows")
    out = []
    for k, r in enumerate(body, layout.header_row + 1):
        if len(r) != len(head):
            raise ValueError(f"row {k} has {len(r)} cells")
        if any(len(c) > layout.most_chars or c.startswith("=") for c in r):
            raise ValueError(f"row {k} has a cell that is too long or a formula")
        row = dict(zip(head, r))
        if not _MONEY.fullmatch(row[layout.amount]):
            raise ValueError(f"row {k} has no exact amount")
        out.append({**row, layout.amount: Decimal(row[layout.amount]).quantize(Decimal("0.01"))})
    return out
