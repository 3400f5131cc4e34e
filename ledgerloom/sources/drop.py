"""A drop folder of exports read into one table of cells with full lineage.

Every file, whatever its form, becomes rows (source, file, sheet, row_number, cells, names, row_hash). Files are read
on the executors through a Python data source, one partition per file and sheet; the driver only lists them.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.sources import sniff, spreadsheet

SCHEMA = (
    "source string, source_file string, sheet string, row_number bigint, names array<string>, cells array<string>, raw_hash string, "
    "encoding string, delimiter string, header_row bigint, dropped_rows bigint, printed_rows bigint, sure boolean")
SUFFIXES = (".csv", ".txt", ".tsv", ".xlsx")


@dataclass(frozen=True)
class Entry:
    source: str
    file: str
    sheet: str | None = None
    rows: int | None = None


def read_manifest(folder: str) -> list[Entry]:
    """The files that manifest.json lists; without one, every delimited file and workbook of the folder, by name.

    Names must be bare and no symbolic links; a key given twice in the manifest is refused.
    """
    root = Path(folder)
    manifest = root / "manifest.json"
    if not manifest.exists():
        return [Entry(p.stem, p.name) for p in sorted(root.iterdir()) if p.suffix.lower() in SUFFIXES and p.is_file() and not p.is_symlink()]
    out = []
    for f in json.loads(manifest.read_text(), object_pairs_hook=unique_keys)["files"]:
        name = f["file_name"]
        if name != Path(name).name or name in (".", "..") or (root / name).is_symlink():
            raise ValueError(f"not a bare file name: {name}")
        out.append(Entry(f["source"], name, f.get("sheet"), f.get("rows")))
    return out


def unique_keys(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is given twice")
    return out


def row_hash(cells: list[str | None]) -> str:
    return hashlib.sha256("\x1f".join(c or "" for c in cells).encode()).hexdigest()


def file_rows(entry: Entry, raw: bytes) -> Iterator[tuple]:
    """The data rows of one file (and sheet) with the facts about its form."""
    encoding = delimiter = None
    sure = True
    if entry.file.lower().endswith(".xlsx"):
        sheets = spreadsheet.read_sheets(raw, [entry.sheet] if entry.sheet else None)
        tables = [(n, [[c or "" for c in r] for r in rows]) for n, rows in sheets.items()]
    else:
        text, encoding = sniff.decode(raw)
        delimiter, sure = sniff.sniff_delimiter(text)
        tables = [(None, [list(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)])]
    for sheet, rows in tables:
        head = sniff.header_row(rows)
        body, printed = sniff.trim_totals(rows[head + 1 :])
        dropped = len(rows) - head - 1 - len(body)
        width = max([len(rows[head]) if rows else 0, *map(len, body)], default=0)
        names = sniff.column_names((rows[head] if rows else []) + [""] * (width - (len(rows[head]) if rows else 0)))
        for k, r in enumerate(body):
            cells = [c if c.strip() else None for c in r] + [None] * (width - len(r))
            yield (entry.source, entry.file, sheet, head + 2 + k, names, cells, row_hash(cells), encoding, delimiter, head, dropped, printed, sure)


class _Part(InputPartition):
    def __init__(self, entry: Entry):
        self.entry = entry


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_Part(e) for e in read_manifest(self.folder) if (Path(self.folder) / e.file).is_file()] or [_Part(Entry("", ""))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.entry.file:
            yield from file_rows(partition.entry, (Path(self.folder) / partition.entry.file).read_bytes())


class DropSource(DataSource):
    """spark.read.format("drop_folder").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "drop_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_drop(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(DropSource)
    return spark.read.format("drop_folder").load(folder)


def missing_files(folder: str) -> list[Entry]:
    return [e for e in read_manifest(folder) if not (Path(folder) / e.file).is_file()]


def reader_notes(rows: DataFrame) -> DataFrame:
    """What reading had to decide, once per file and sheet: (source_file, sheet, rule_id, severity, message)."""
    facts = rows.groupBy("source_file", "sheet").agg(*[F.first(c).alias(c) for c in ("encoding", "delimiter", "header_row", "dropped_rows", "sure")])
    notes = F.array(
        F.when(F.col("encoding") != "utf-8", F.struct(F.lit("ING-001").alias("rule_id"), F.lit("info").alias("severity"), F.concat(F.lit("read as "), F.col("encoding")).alias("message"))),
        F.when(F.col("header_row") > 0, F.struct(F.lit("ING-002").alias("rule_id"), F.lit("info").alias("severity"), F.concat(F.lit("header in row "), (F.col("header_row") + 1).cast("string")).alias("message"))),
        F.when(F.col("dropped_rows") > 0, F.struct(F.lit("ING-003").alias("rule_id"), F.lit("info").alias("severity"), F.concat(F.col("dropped_rows").cast("string"), F.lit(" closing rows left out")).alias("message"))),
        F.when(~F.col("sure"), F.struct(F.lit("ING-004").alias("rule_id"), F.lit("warning").alias("severity"), F.lit("delimiter is uncertain").alias("message"))),
    )
    return facts.select("source_file", "sheet", F.explode(F.filter(notes, lambda n: n.isNotNull())).alias("n")).select("source_file", "sheet", "n.*")


def project(rows: DataFrame, columns: dict[str, str], carried: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns (field -> header) of a file's rows with lineage; an absent header gives nulls. A full_name
    header also fills first_name and last_name where these are null; carried copies a field under another name."""
    cell = lambda h: F.get("cells", (F.array_position("names", h) - 1).cast("int"))
    out = rows.select(
        *[F.when(F.array_position("names", h) > 0, cell(h)).alias(f) for f, h in columns.items()],
        F.struct("source_file", "sheet", "row_number", "raw_hash").alias("lineage"))
    if "full_name" in columns:
        n = F.trim("full_name")
        comma = n.contains(",")
        first = F.when(comma, F.trim(F.regexp_extract(n, r"^[^,]*,(.*)$", 1))).otherwise(F.regexp_extract(n, r"^(\S+)", 1))
        last = F.when(comma, F.trim(F.regexp_extract(n, r"^([^,]*),", 1))).otherwise(F.trim(F.regexp_extract(n, r"^\S+\s+(.*)$", 1)))
        have = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
        out = out.withColumn("first_name", F.coalesce(have("first_name"), first)).withColumn("last_name", F.coalesce(have("last_name"), last)).drop("full_name")
    for new, old in (carried or {}).items():
        out = out.withColumn(new, F.col(old))
    return out
