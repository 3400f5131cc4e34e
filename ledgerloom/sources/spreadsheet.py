"""Spreadsheet files read with the standard library alone: cell values as text, sheet by sheet."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that show dates (fixed values).
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MOST_BYTES = 1 << 30


def _place(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    xfs = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(xfs if xfs is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _as_date(number: str) -> str:
    moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(number))
    moment = moment.replace(microsecond=0)
    return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(sep=" ")


def read_sheets(raw: bytes, wanted: list[str] | None = None) -> dict[str, list[list[str | None]]]:
    """Rows of text by sheet; formulas give their stored value; absent sheets are left out, short rows are padded."""
    out: dict[str, list[list[str | None]]] = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError("spreadsheet is too large when unpacked")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(z)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            name = sheet.get("name")
            if wanted is not None and name not in wanted:
                continue
            target = rels[sheet.get(f"{_REL}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                at, cells = int(row.get("r", len(rows) + 1)), {}
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    kind, v = c.get("t"), c.find(f"{_MAIN}v")
                    text = v.text if v is not None else None
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "b" and text is not None:
                        text = "True" if text == "1" else "False"
                    elif text is not None and kind in (None, "n") and int(c.get("s", 0)) in dates:
                        text = _as_date(text)
                    cells[_place(c.get("r")) if c.get("r") else k] = text if text and text.strip() else None
                while len(rows) < at - 1:
                    rows.append([])
                rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            out[name] = [r + [None] * (width - len(r)) for r in rows]
    return out


def write_sheets(sheets: dict[str, list[list]]) -> bytes:
    """A plain workbook of the given rows, the same bytes every time; numbers stay numbers, all else is inline text."""
    from xml.sax.saxutils import escape, quoteattr

    def column(n: int) -> str:
        s = ""
        n += 1
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(65 + r) + s
        return s

    def cell(v, ref: str) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for k, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{i}">' + "".join(cell(v, f"{column(j)}{i}") for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return buffer.getvalue()
