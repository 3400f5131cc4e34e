"""Reading drop folders and writing results."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import findings
from ledgerloom.sources import drop, sinks, sniff, spreadsheet


def make_drop(tmp_path):
    (tmp_path / "crm.csv").write_bytes("﻿Report;;\nName;Zip;Note\n\"Lee; Ann\";12345;\"two\nlines\"\nJosé;;x\n\nTotal;2;\nprinted by us;;\n".encode("latin-1", "replace").replace(b"?", b"", 1))
    (tmp_path / "tab.txt").write_text("a\tb\ta\n1\t2\t3\n4\t5\n")
    (tmp_path / "book.xlsx").write_bytes(spreadsheet.write_sheets({"One": [["Name", "Paid"], ["Ann", 1.5], ["Bob", None]], "Two": [["x", "y"], ["p", "q"]]}))
    (tmp_path / "manifest.json").write_text(json.dumps({"seed": 1, "files": [
        {"source": "crm", "file_name": "crm.csv", "rows": 2}, {"source": "tab", "file_name": "tab.txt"}, {"source": "one", "file_name": "book.xlsx", "sheet": "One"}, {"source": "gone", "file_name": "gone.csv"}]}))


def test_drop_folder(spark, tmp_path):
    make_drop(tmp_path)
    df = drop.read_drop(spark, str(tmp_path))
    got = {(r["source"], r["row_number"]): r for r in df.collect()}
    assert set(got) == {("crm", 3), ("crm", 4), ("tab", 2), ("tab", 3), ("one", 2), ("one", 3)}
    crm = got["crm", 3]
    assert crm["cells"] == ["Lee; Ann", "12345", "two\nlines"] and crm["encoding"] == "latin-1" and crm["printed_rows"] == 2
    assert got["tab", 2]["names"] == ["a", "b", "a_2"] and got["tab", 3]["cells"] == ["4", "5", None]
    assert got["one", 2]["cells"] == ["Ann", "1.5"] and got["one", 2]["sheet"] == "One"
    assert [e.source for e in drop.missing_files(str(tmp_path))] == ["gone"]
    assert {(r["source_file"], r["rule_id"]) for r in drop.reader_notes(df).collect()} >= {("crm.csv", "ING-001"), ("crm.csv", "ING-002"), ("crm.csv", "ING-003")}
    p = drop.project(df.where("source = 'crm'"), {"full_name": "Name", "zip": "Zip", "absent": "Nope"}).collect()
    assert {(r["first_name"], r["last_name"], r["zip"], r["absent"]) for r in p} == {("Lee;", "Ann", "12345", None), ("José", "", None, None)}


def test_manifest_refusals(tmp_path):
    (tmp_path / "manifest.json").write_text('{"files": [{"source": "a", "file_name": "../x.csv"}]}')
    with pytest.raises(ValueError):
        drop.read_manifest(str(tmp_path))
    (tmp_path / "manifest.json").write_text('{"files": [], "files": []}')
    with pytest.raises(ValueError):
        drop.read_manifest(str(tmp_path))


def test_sniffing():
    assert sniff.sniff_delimiter("a,b\n1,2\n") == (",", True) and sniff.sniff_delimiter("a|b;c\n1|2;3\n4|5\n")[0] == "|"
    assert sniff.decode(b"\xef\xbb\xbfa\xe9")[1] == "latin-1" and sniff.decode("é".encode())[1] == "utf-8"
    assert sniff.column_names(["", "A", "a", "lineage"]) == ["column_1", "A", "a_2", "lineage_1"]
    assert sniff.trim_totals([["a", "1"], ["", ""], ["Grand total", "1,234"], ["foot", ""]]) == ([["a", "1"]], 1234)
    assert sniff.trim_totals([["a", "1"], ["", ""]]) == ([["a", "1"]], None)


def test_empty_folder(spark, tmp_path):
    assert drop.read_drop(spark, str(tmp_path)).count() == 0


def test_run_directory(spark, tmp_path):
    df = spark.createDataFrame([(1, "bad", "12345"), (2, "1EG4TE5MK73", "9")], "rec_id long, mbi string, zip string")
    checks = [findings.Check("MBI-001", "error", "mbi", F.col("mbi") == "bad", "m"), findings.Check("ADR-001", "error", "zip", F.col("zip") == "9", "m")]
    found = findings.run_checks(df, "rec_id", checks, "clients")
    to = tmp_path / "run"
    sinks.publish(lambda folder: sinks.write_run(found, folder, {"run_id": "r1"}, {"clients": df}), str(to))
    assert sinks.check_run(spark, str(to)) == [] and spark.read.parquet(f"{to}/clients.parquet").count() == 2
    with pytest.raises(FileExistsError):
        sinks.publish(lambda f: None, str(to))

    def fails(folder):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.publish(fails, str(to), overwrite=True)
    assert sinks.check_run(spark, str(to)) == []
    page = sinks.report_html(found, "<run>", top=1)
    assert "&lt;run&gt;" in page and "1 more" in page


def test_archive_pin_journal(tmp_path):
    sinks.archive({"b": b"2", "a": b"1"}, str(tmp_path / "x.zip"))
    sinks.archive({"a": b"1", "b": b"2"}, str(tmp_path / "y.zip"))
    assert (tmp_path / "x.zip").read_bytes() == (tmp_path / "y.zip").read_bytes()
    with pytest.raises(FileExistsError):
        sinks.archive({}, str(tmp_path / "x.zip"))
    p = sinks.pin(str(tmp_path / "x.zip"), str(tmp_path))
    (tmp_path / "x.zip").write_bytes(b"changed")
    with pytest.raises(ValueError):
        sinks.verify_pin(p, str(tmp_path))
    j = sinks.Journal(str(tmp_path / "j"))
    assert j.append("o1", {"x": 1}) and not j.append("o1", {"x": 1}) and j.append("o2", {})
    with pytest.raises(ValueError):
        j.append("o1", {"x": 2})
    text = (tmp_path / "j").read_text().replace('"x": 1', '"x": 3')
    (tmp_path / "j").write_text(text)
    with pytest.raises(ValueError):
        j.read()


def test_strict_import():
    import hashlib
    from decimal import Decimal

    from ledgerloom.sources.strict import Layout, read_strict

    def layout(raw, **more):
        return Layout(hashlib.sha256(raw).hexdigest(), ("Label", "Paid"), "Paid", **more)

    good = b"Label,Paid\nx,1.5\ny,-2\n"
    assert read_strict(good, layout(good)) == [{"Label": "x", "Paid": Decimal("1.50")}, {"Label": "y", "Paid": Decimal("-2.00")}]
    book = spreadsheet.write_sheets({"S": [["note"], ["Label", "Paid"], ["x", "3"]]})
    with pytest.raises(ValueError):
        read_strict(book, layout(book, sheet="S", header_row=1))
    assert read_strict(spreadsheet.write_sheets({"S": [["Label", "Paid"], ["x", "3"]]}), layout(spreadsheet.write_sheets({"S": [["Label", "Paid"], ["x", "3"]]}), sheet="S"))[0]["Paid"] == 3
    for bad in (b"Label,Paid\nx,1.555\n", b"Label,Paid\nx\n", b"Paid,Label\n1,x\n", b"Label,Paid\n=x,1\n", b"Label,Paid\n\xe9,1\n"):
        with pytest.raises(ValueError):
            read_strict(bad, layout(bad))
    with pytest.raises(ValueError):
        read_strict(good + b" ", layout(good))
