"""Sources, sinks and streams on files made here."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.sources import files, sinks, tables
from foliant.streaming import logs
from tests.helpers import rows, ts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, content in parts.items():
            z.writestr({"core": "docProps/core.xml", "comments": "word/comments.xml", "media": "word/media/a.png"}[name], content)
    return out.getvalue()


def xlsx(rows_):
    out = io.BytesIO()
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows_, 1))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_inventory(spark, tmp_path):
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.docx").write_bytes(
        docx(p.format("Title") + f"<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:ins><w:r><w:t>er</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>" + "<w:p/>",
             core='<c xmlns:dc="d"><dc:creator>desk</dc:creator></c>', comments=f"<w:comments {W}><w:comment/></w:comments>", media="x")
    )
    (tmp_path / "in/bad.docx").write_bytes(b"no package")
    (tmp_path / "in/B.JPG").write_bytes(b"img")
    (tmp_path / "c.msg").write_bytes(b"")
    got = {r["file_name"]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    a = got["A.docx"]
    assert set(got) == {"A.docx", "bad.docx", "B.JPG", "c.msg"} and (a["readable"], a["n_units"], a["tracked_changes"], a["comments"], a["has_images"], a["author"], a["title_guess"]) == (True, 2, 3, 1, True, "desk", "Title")
    assert got["bad.docx"]["readable"] is False and "BadZipFile" in got["bad.docx"]["note"]
    assert got["B.JPG"]["file_type"] == "image" and got["B.JPG"]["scanned_pages"] == 1 and got["c.msg"]["file_type"] == "other" and got["c.msg"]["readable"] is False
    text = {r[0].rpartition("/")[2]: r[1] for r in files.marked_text(files.extract(files.walk(spark, str(tmp_path), "*.docx"))).collect()}
    assert text["A.docx"] == "[¶ 1] Title\n[¶ 2] {+newer+}{-old-}"


def test_control_tables(spark, tmp_path):
    (tmp_path / "erp.csv").write_bytes("Customer account;Account number;Country\nCaf\xe9 Ltd;1; UK \n;;\nShort\n".encode("cp1252"))
    assert rows(tables.read_accounts(spark, str(tmp_path / "erp.csv"))) == [("Café Ltd", "1", "UK"), ("Short", "", "")]
    (tmp_path / "erp.xlsx").write_bytes(xlsx([["Customer account", "Account number", "Country", ""], ["Beta", "2", "DE"], ["Gamma", "", "FR"]]))
    assert rows(tables.read_accounts(spark, str(tmp_path / "erp.xlsx"))) == [("Beta", "2", "DE"), ("Gamma", "", "FR")]
    (tmp_path / "t.csv").write_text('1. Name (as printed),Signed,Name\n"a, ""b""",yes,z\nq,no,z,extra\n')
    t = tables.read_table(spark, str(tmp_path / "t.csv"), required=("file_name",), aliases={"name": "file_name"})
    assert rows(t.select("file_name", "signed")) == [('a, "b"', "yes"), ("q", "no")]
    with pytest.raises(tables.BadTable, match="missing"):
        tables.read_table(spark, str(tmp_path / "t.csv"), required=("nope",))
    with pytest.raises(tables.BadTable, match="repeated"):
        tables.read_table(spark, str(tmp_path / "t.csv"), strict=True)
    (tmp_path / "empty.csv").write_text("")
    assert tables.read_table(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "log.xlsx").write_bytes(xlsx([["h"], ["x", "PARSE_ERROR", "in/a.pdf"], ["READ_FAILED", "b/a.pdf"], ["none"]]))
    assert rows(tables.error_codes(spark, str(tmp_path / "log.xlsx"))) == [("a.pdf", "READ_FAILED")]


def test_records(spark, tmp_path):
    d = tmp_path / "cards"
    d.mkdir()
    (d / "1.json").write_text(json.dumps({"doc_id": 1, "q1": ["a", "b"], "extra": 2}))
    (d / "2.json").write_text("{not json")
    (d / "3.json").write_text('{"doc_id": "3", "doc_id": "4"}')
    assert ("1.json", "1", "a | b", "not found") in rows(tables.read_records(spark, str(d), ["doc_id", "q1", "q2"]))
    assert [r[:2] for r in rows(tables.strict_records(spark, str(d)))] == [("1.json", True), ("2.json", False), ("3.json", False)]
    (tmp_path / "n.md").write_text("# t\n\n## One\nbody\n\n## Two\n\nx | y\n| master | a\\|b | c |\n| other | 1 | 2 |\n")
    assert rows(tables.sections(spark, str(tmp_path / "n.md")))[0] == ("n.md", "One", "body")
    assert rows(tables.pipe_table(spark, str(tmp_path / "n.md"), 3, ("master",))) == [(["master", "a|b", "c"],)]
    (tmp_path / "p.json").write_text(json.dumps({"account": "A", "trees": [{"tree": "T1", "family": "f", "doc_ids": ["1", "2"]}]}))
    assert rows(tables.proposals(spark, str(tmp_path / "p.json"))) == [("A", "T1", "f", None, ["1", "2"], None)]
    (tmp_path / "r.csv").write_text("id,x\n1,a\n1,b\n")
    with pytest.raises(tables.BadTable):
        tables.read_registry(spark, str(tmp_path / "r.csv"), "id")
    assert tables.read_state(spark, str(tmp_path / "no.json"), {}) == {}
    (tmp_path / "state.json").write_text('{"a": [1]}')
    assert tables.read_state(spark, str(tmp_path / "state.json")) == {"a": [1]}
    with pytest.raises(FileNotFoundError):
        tables.read_state(spark, str(tmp_path / "no.json"))
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": "one", "b": "y"}\n{"a": 2\n[1]\n{"b": null, "z": 3}\n')
    good, bad = tables.read_events(spark, str(tmp_path / "log.jsonl"), "a int, b string")
    assert rows(good) == [(1, "x"), (None, None)]
    assert sorted(r[1:] for r in rows(bad)) == [("[1]", "json"), ('{"a": "one", "b": "y"}', "schema"), ('{"a": 2', "json")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "1", "x|y", None), ("B", "2", "z", 3)], "account string, folder string, d string, n int")
    sinks.write_csv(df, str(tmp_path / "o"), ["d", "n", "none"])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "o"))) == [("x|y", None, None), ("z", "3", None)]
    lists = str(tmp_path / "lists")
    sinks.write_lists(df, lists, ["account"], ["d"])
    sinks.write_lists(df.where("account = 'B'").withColumn("d", F.lit("new")), lists, ["account"], ["d"])
    assert rows(spark.read.option("header", True).csv(lists).select("account", "d")) == [("A", "x|y"), ("B", "new")]
    assert sinks.drop_stale(spark, lists, "account", ["B"]) == ["A"]
    odd = ["O'Neil Ltd", "Alba: North", "a/b=c", "100% \"x\"", "Plain", ""]
    sinks.write_lists(spark.createDataFrame([(a, a) for a in odd], "account string, d string"), str(tmp_path / "odd"), ["account"], ["d"])
    assert sinks.drop_stale(spark, str(tmp_path / "odd"), "account", [*odd[:5], None]) == []
    assert sinks.drop_stale(spark, str(tmp_path / "odd"), "account", ["Alba: North", "a/b=c"]) == sorted(["O'Neil Ltd", '100% "x"', "Plain", sinks.NO_VALUE])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "odd")).select("d")) == [("Alba: North",), ("a/b=c",)]
    assert sinks.drop_stale(spark, str(tmp_path / "nowhere"), "account", []) == []
    (tmp_path / "s/source_hash=h1").mkdir(parents=True)  # left by a write that failed
    sinks.write_snapshot(df, str(tmp_path / "s"), "h1", str(tmp_path / "p"), "2024-01-01")
    sinks.write_snapshot(df.limit(0), str(tmp_path / "s"), "h2", str(tmp_path / "p"), "2024-01-02")
    assert sinks.read_active(spark, str(tmp_path / "s"), str(tmp_path / "p")).count() == 0
    sinks.write_snapshot(df.limit(0), str(tmp_path / "s"), "h1", str(tmp_path / "p"), "2024-01-03")
    assert sinks.read_active(spark, str(tmp_path / "s"), str(tmp_path / "p")).count() == 2  # written once
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_graph(spark.createDataFrame([("b", "L"), ("a", "L")], "id string, label string"), spark.createDataFrame([("a", "b", "t")], "src string, dst string, type string"), str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g/nodes")).columns == ["id:ID", ":LABEL"]
    assert sinks.write_version(df, str(tmp_path / "v"), "1").endswith("version=1")
    assert sinks.markdown_table(df.select("d")).splitlines()[2] == "| x\\|y |"


def drain(q):
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    led = spark.createDataFrame([("sort", "filer", "1", "10"), ("sort", "filer", "2", "unknown")], "stage string, role string, attempt string, tokens string")
    led.write.mode("append").json(src)
    s = logs.ledger_totals(logs.log_stream(spark, src, "stage string, role string, attempt string, tokens string"))
    q = s.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    led.write.mode("append").json(src)
    drain(q)
    assert rows(spark.table("totals")) == [("sort", "filer", 4, 2, 20)]

    ev = str(tmp_path / "ev")
    spark.createDataFrame(
        [("1", "requested", ts("2024-01-01T10:00:00")), ("1", "requested", ts("2024-01-01T10:00:00")), ("1", "completed", ts("2024-01-01T11:00:00")), ("2", "completed", ts("2024-01-01T11:00:00"))], "check_id string, event string, recorded_at timestamp"
    ).write.parquet(ev)
    q = logs.paired_requests(logs.log_stream(spark, ev, "check_id string, event string, recorded_at timestamp", "parquet")).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c2")).start()
    drain(q)
    assert [r["check_id"] for r in spark.table("pairs").collect()] == ["1"]


def test_interval_stream(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, 5), ("a", 10, logs.OPEN), (None, 1, 2)], "key string, s int, e int").write.mode("append").parquet(src)
    q = logs.interval_stream(logs.log_stream(spark, src, "key string, s int, e int", "parquet")).writeStream.outputMode("update").format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 6, 9)], "key string, s int, e int").write.mode("append").parquet(src)
    drain(q)
    got = [tuple(r) for r in spark.table("spans").collect()]
    assert sorted(got[:3]) == [("a", "gap", 6, 9), ("a", "period", 1, 5), ("a", "period", 10, logs.OPEN)] and got[3:] == [("a", "period", 1, logs.OPEN)]
    assert dt.date.min
