"""Writing results: load-ready tables, run directories, reports, archives, journals. All are the same bytes each time."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import html
import json
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import formula_guard


def write_table(df: DataFrame, folder: str, name: str, order: list[str]) -> None:
    """folder/name.parquet and folder/name.csv, sorted; lists joined by bars in the CSV. Parts stay parts: one file per
    range of the order, not one for all."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    flat = out.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in out.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_review_csv(df: DataFrame, path: str) -> None:
    """A CSV for people, with cells that a spreadsheet would run made harmless."""
    df.select(*[formula_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    raise TypeError(type(v))


def dump_json(value, path: Path) -> None:
    path.write_text(json.dumps(value, indent=2, sort_keys=True, default=_plain, ensure_ascii=False) + "\n", encoding="utf-8")


def publish(build, target: str, overwrite: bool = False) -> None:
    """Run build(folder) beside target and move the folder into place at once; an older target is kept until then. A
    build that fails leaves the target as it was."""
    to = Path(target)
    if to.exists() and not overwrite:
        raise FileExistsError(target)
    to.parent.mkdir(parents=True, exist_ok=True)
    work = Path(tempfile.mkdtemp(prefix=f".{to.name}-", dir=to.parent))
    try:
        build(str(work))
        if to.exists():
            old = to.with_name(f".{to.name}-old")
            os.replace(to, old)
            os.replace(work, to)
            shutil.rmtree(old)
        else:
            os.replace(work, to)
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise


def write_run(findings: DataFrame, folder: str, manifest: dict, tables: dict[str, DataFrame]) -> None:
    """manifest.json, scorecard.json, findings (JSON lines, by Spark) and the tables. Only counts by rule come to the driver."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    findings.repartitionByRange("finding_id").sortWithinPartitions("finding_id").write.mode("overwrite").json(f"{folder}/findings")
    counts = {f"{r['severity']}/{r['rule_id']}": r["n"] for r in findings.groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    dump_json({"findings": counts, "total": sum(counts.values())}, root / "scorecard.json")
    for name, df in tables.items():
        write_table(df, folder, name, df.columns[:1])
    dump_json({**manifest, "tables": sorted(tables)}, root / "manifest.json")


def check_run(spark: SparkSession, folder: str) -> list[str]:
    """What in a run directory does not agree with itself."""
    root, wrong = Path(folder), []
    card, manifest = json.loads((root / "scorecard.json").read_text()), json.loads((root / "manifest.json").read_text())
    found = spark.read.schema("finding_id string, severity string, rule_id string").json(f"{folder}/findings")
    n, distinct = found.agg(F.count(F.lit(1)), F.countDistinct("finding_id")).first()
    if n != card["total"]:
        wrong.append(f"{n} findings, scorecard says {card['total']}")
    if distinct != n:
        wrong.append("finding ids repeat")
    wrong += [f"table {t} is absent" for t in manifest["tables"] if not (root / f"{t}.parquet").exists()]
    return wrong


def report_html(findings: DataFrame, title: str, top: int = 50) -> str:
    """A page with the counts by rule and the first findings; the limit is the page's feature."""
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").collect()
    first = findings.orderBy("severity", "rule_id", "finding_id").limit(top).collect()
    row = lambda cells: "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>"
    more = sum(r["n"] for r in counts) - len(first)
    return (
        f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>" + "".join(row((r["rule_id"], r["n"])) for r in counts)
        + "</table><table>" + "".join(row((r["severity"], r["rule_id"], r["field"], r["shown"], r["message"])) for r in first) + f"</table><p>{max(0, more)} more</p>")


def archive(files: dict[str, bytes], path: str) -> None:
    """A ZIP with fixed times and ordered entries; never over an existing file."""
    with open(path, "xb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name])


def pin(path: str, root: str) -> dict:
    """Name, size and hash of a file inside root; links and paths that lead out are refused."""
    p, base = Path(path), Path(root).resolve()
    if p.is_symlink() or base not in p.resolve().parents:
        raise ValueError(f"outside {root}: {path}")
    raw = p.read_bytes()
    return {"path": str(p.resolve().relative_to(base)), "size": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}


def verify_pin(pinned: dict, root: str) -> None:
    if pin(str(Path(root) / pinned["path"]), root) != pinned:
        raise ValueError(f"stale artifact: {pinned['path']}")


class Journal:
    """Append-only records, each chained to the hash of the one before; an operation id is appended once."""

    def __init__(self, path: str):
        self.path = Path(path)

    def read(self) -> list[dict]:
        out, last = [], ""
        for k, line in enumerate(self.path.read_text().splitlines() if self.path.exists() else []):
            r = json.loads(line)
            if r["before"] != last or r["hash"] != self._hash(r["before"], r["operation"], r["body"]):
                raise ValueError(f"journal is broken at record {k}")
            last = r["hash"]
            out.append(r)
        return out

    def append(self, operation: str, body: dict) -> bool:
        """True if appended, False if the operation is there with the same body; another body is refused."""
        records = self.read()
        for r in records:
            if r["operation"] == operation:
                if r["body"] != body:
                    raise ValueError(f"operation {operation} was recorded with other content")
                return False
        before = records[-1]["hash"] if records else ""
        with self.path.open("a") as f:
            f.write(json.dumps({"operation": operation, "body": body, "before": before, "hash": self._hash(before, operation, body)}, sort_keys=True) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return True

    @staticmethod
    def _hash(before: str, operation: str, body: dict) -> str:
        return hashlib.sha256(json.dumps([before, operation, body], sort_keys=True).encode()).hexdigest()
