"""Control tables from CSV and XLSX files, and records from JSON and Markdown."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from foliant.functions.text import is_blank

ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(content: bytes) -> str:
    """The first encoding that reads it all."""
    for e in ENCODINGS:
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads everything")


def sniff(header: str, candidates: str = ",;\t") -> str:
    """The separator that the header line has most of; the first named wins ties."""
    return max(candidates, key=lambda c: (header.count(c), -candidates.index(c)))


def csv_rows(content: bytes) -> list[list[str]]:
    """Trimmed cells; blank rows dropped, short rows padded to the header."""
    text = decode(content)
    if not text.strip():
        return []
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text.splitlines()[0]))]
    rows = [r for r in rows if any(r)]
    return [r + [""] * (len(rows[0]) - len(r)) for r in rows]


def xlsx_sheets(content: bytes) -> dict[str, list[list[str]]]:
    """Cells of every sheet as text, in sheet order; trailing blank headers cut off."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = rels[sheet.get(f"{_R}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row.iter(f"{_S}c")):
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    at = i
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    v = c.find(f"{_S}v")
                    value = "".join(x.text or "" for x in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[at] = (shared[int(value)] if c.get("t") == "s" and value else value).strip()
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            rows = [r for r in rows if any(r)]
            if rows:
                while rows[0] and not rows[0][-1]:
                    rows[0].pop()
                rows = [rows[0], *([*r, *[""] * (len(rows[0]) - len(r))] for r in rows[1:])]
            out[sheet.get("name") or ""] = rows
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sheets = xlsx_sheets(content) if path.lower().endswith(".xlsx") else {"": csv_rows(content)}
            out += [(path, s, i, r) for s, rows in sheets.items() for i, r in enumerate(rows)]
        types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=["path", "sheet", "row_no", "cells"])


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells) of CSV or XLSX files; row 0 is the header. Each file is read in one task, as control files are small."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_rows, "path string, sheet string, row_no int, cells array<string>")


def header_key(header: str, aliases: dict[str, str] | None = None) -> str:
    """cut at the first bracket, leading number off, anything but letters and digits to _, lower case, alias."""
    key = re.sub(r"^\s*\d+[.)]\s*", "", header.split("(")[0])
    key = re.sub(r"\W+", "_", key).strip("_").lower()
    return (aliases or {}).get(key, key)


class BadTable(ValueError):
    """A control table that does not have the columns or the shape it must have."""


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = (), aliases: dict[str, str] | None = None, sheet: str | None = None, strict: bool = False) -> DataFrame:
    """A control table as string columns named by their header keys, with ``row_no``.

    The first sheet with rows is taken, or the one named. Missing required columns raise, and with ``strict`` also blank and
    repeated headers and rows longer than the header; without it a repeated header keeps its first column and overlong rows are cut."""
    raw = cells(spark, path)
    heads = raw.where("row_no = 0").select("path", "sheet", "cells").collect()
    heads = [h for h in heads if sheet is None or h["sheet"] == sheet]
    if not heads:
        if required:
            raise BadTable(f"{path}: no rows; needs {', '.join(required)}")
        return spark.createDataFrame([], "row_no int")
    if strict and len(heads) > 1:
        raise BadTable(f"{path}: several sheets have rows")
    keys = [header_key(h, aliases) for h in heads[0]["cells"]]
    lost = [c for c in required if c not in keys]
    if lost:
        raise BadTable(f"{path}: missing columns: {', '.join(lost)}")
    body = raw.where((F.col("row_no") > 0) & (F.col("sheet") == heads[0]["sheet"]) & (F.col("path") == heads[0]["path"]))
    if strict:
        if "" in keys or len(set(keys)) < len(keys):
            raise BadTable(f"{path}: blank or repeated headers")
        if body.where(F.size("cells") > len(keys)).limit(1).count():
            raise BadTable(f"{path}: a row is longer than the header")
    first = {k: i for i, k in reversed(list(enumerate(keys))) if k}
    return body.select("row_no", *[F.get("cells", F.lit(first[k])).alias(k) for k in dict.fromkeys(keys) if k])


def control_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The one file of a folder whose name fits the pattern, or None; several raise."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = sorted(f.getPath().toString() for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root) or [])
    if len(found) > 1:
        raise BadTable(f"{folder}: several files fit {pattern}")
    return found[0] if found else None


def as_at_in_headers(headers: list[str]) -> str | None:
    """The ISO date that stands within 40 characters of "as at" in a header."""
    for h in headers:
        if m := re.search(r"\bas at\b.{0,40}?(\d{4}-\d{2}-\d{2})", h, re.I | re.S):
            return m[1]
    return None


#: Names that an account column may have, best first.
ACCOUNT_COLUMNS = ("customer_account", "supplier_account", "account", "account_name", "customer", "supplier", "name", "company")


def account_column(columns: list[str]) -> str | None:
    """The column that names the account: the best known name, else the first that does not look like a number column (1.4, F18)."""
    plain = [c for c in columns if not re.search(r"(^|_)(id|no|number|code|num)($|_)", c) and c != "row_no"]
    return next((c for c in ACCOUNT_COLUMNS if c in plain), plain[0] if plain else None)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(account, account_number, country) of an account list, blank names left out."""
    df = read_table(spark, path)
    name = account_column(df.columns)
    if name is None:
        raise BadTable(f"{path}: no account column")
    pick = lambda *words: next((F.col(c) for c in df.columns if any(w in c.split("_") for w in words) and c not in (name, "row_no")), F.lit(None).cast("string"))
    return df.where(~is_blank(F.col(name))).select(F.col(name).alias("account"), pick("number", "no", "id", "code").alias("account_number"), pick("country").alias("country"))


def error_codes(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, code) from any sheet with an UPPER_SNAKE code and a file name in a row; the last row wins."""
    c = cells(spark, path).select("sheet", "row_no", F.get(F.filter("cells", lambda x: x.rlike(r"^[A-Z]+(_[A-Z]+)+$")), F.lit(0)).alias("code"), F.get(F.filter("cells", lambda x: x.rlike(r"\.[A-Za-z0-9]{2,5}$")), F.lit(0)).alias("f"))
    c = c.where("code is not null and f is not null")
    return c.groupBy(F.regexp_extract("f", r"([^/\\]+)$", 1).alias("file_name")).agg(F.max_by("code", F.struct("sheet", "row_no")).alias("code"))


def read_records(spark: SparkSession, path: str, fields: list[str], missing: str = "not found") -> DataFrame:
    """One JSON object a file as string columns: missing fields get the sentinel, lists are joined, other keys ignored, and files that
    are no object give no row (S14, N06)."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.try_parse_json("value").alias("v"), "value").where("v is not null and schema_of_variant(v) like 'OBJECT%'")

    def field(f: str) -> F.Column:
        listed = F.from_json(F.get_json_object("value", f"$.{f}"), t.ArrayType(t.StringType()))
        scalar = F.get_json_object("value", f"$.{f}")
        return F.coalesce(F.nullif(F.trim(F.when(F.startswith(F.trim(scalar), F.lit("[")), F.array_join(listed, " | ")).otherwise(scalar)), F.lit("")), F.lit(missing)).alias(f)

    return texts.select("file_name", *map(field, fields))


def strict_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, ok, value): JSON texts; repeated keys and bad JSON are not ok."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return texts.select("file_name", F.try_parse_json("value").isNotNull().alias("ok"), "value")


def read_events(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """An append-only JSON-lines log (S16): the events, and (file_name, line, reason) of the lines that are none.

    ``reason`` is ``json`` where a line is no JSON object and ``schema`` where a value does not fit its column; blank lines are neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line")).where("trim(line) <> ''")
    read = lines.withColumn("e", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = read.where("e is not null and e._bad is null").select("e.*").drop("_bad")
    shape = F.try_parse_json("line").isNull() | ~F.trim("line").startswith("{")
    bad = read.where("e is null or e._bad is not null").select("file_name", "line", F.when(shape, "json").otherwise("schema").alias("reason"))
    return good, bad


def pipe_table(spark: SparkSession, path: str, n_cells: int, types: tuple[str, ...]) -> DataFrame:
    """Rows of Markdown tables with ``n_cells`` cells whose first is one of ``types``, as an array."""
    line = F.trim("value")
    row = spark.read.text(path).where(line.startswith("|") & line.endswith("|"))
    c = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
    return row.select(c.alias("cells")).where((F.size("cells") == n_cells) & F.get("cells", F.lit(0)).isin(*types))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, heading, body): Markdown split at its ``##`` headings."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    heads = F.regexp_extract_all("value", F.lit(r"(?m)^##[ \t]+(.+?)[ \t]*$"), F.lit(1))
    bodies = F.slice(F.split("value", r"(?m)^##[ \t]+.+$"), F.lit(2), F.greatest(F.size(heads), F.lit(0)))
    return texts.select("file_name", F.explode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("s")).select("file_name", F.col("s.h").alias("heading"), F.trim(F.regexp_replace("s.b", r"^\s+|\s+$", "")).alias("body"))


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """(account, tree, family, confidence, doc_ids, overlays): proposal files with a list of trees, one row a tree."""
    tree = "struct<tree:string,family:string,confidence:string,doc_ids:array<string>,overlays:array<string>>"
    raw = spark.read.schema(f"account string, trees array<{tree}>").option("multiLine", "true").json(path)
    return raw.select("account", F.explode("trees").alias("t")).select("account", "t.*")


def read_registry(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A registry CSV with a header; repeated keys raise."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise BadTable(f"{path}: repeated {key}")
    return df


def read_state(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """A singleton JSON state file on any store the session reaches, or the default where there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    if default is None:
        raise FileNotFoundError(path)
    return default
