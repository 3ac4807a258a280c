"""Folders of documents as tables: the walk, hashes, types, and text by page or paragraph."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime
from fnmatch import fnmatch
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import pypdf
except ImportError:  # PDF text stays empty then, and the files show as unreadable
    pypdf = None

#: File types by ending.
FILE_TYPES = {".pdf": "pdf", ".docx": "docx", ".jpg": "image", ".jpeg": "image", ".png": "image", ".tif": "image", ".tiff": "image", ".csv": "csv", ".xlsx": "xlsx"}
#: A page with fewer characters than this is a scan.
SCAN_CHARS = 25
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    """By ending; ``other`` for the rest."""
    types = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(types, extension(path)), F.lit("other"))


def walk(spark: SparkSession, folder: str, glob: str | None = None, empty: bool = True) -> DataFrame:
    """(path, size_bytes, modified_at, content) of every file below a folder (S01); links are not followed.

    Spark's reader passes over files of no bytes. With ``empty`` they are listed by the file system and added with empty content; that
    is one driver call a file, so leave it off for folders of millions of files."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    found = r.load(folder).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    if not empty:
        return found
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    bare = []
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0 and (glob is None or fnmatch(f.getPath().getName(), glob)):
            bare.append((f.getPath().toString(), 0, datetime.fromtimestamp(f.getModificationTime() / 1000), b""))
    return found.unionByName(spark.createDataFrame(bare, found.schema)) if bare else found


def docx_paragraphs(content: bytes) -> tuple[list[str], dict[str, str | int]]:
    """Paragraph texts with tracked insertions as {+ +} and deletions as {- -}, and what the package says about itself.

    Raises on anything that is not a readable package."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        body = ElementTree.fromstring(z.read("word/document.xml"))
        about: dict[str, str | int] = {"author": "", "created": "", "modified": "", "tracked_changes": 0, "comments": 0, "images": 0}
        if "docProps/core.xml" in names:
            for e in ElementTree.fromstring(z.read("docProps/core.xml")):
                key = {"creator": "author", "created": "created", "modified": "modified"}.get(e.tag.rpartition("}")[2])
                if key:
                    about[key] = (e.text or "").strip()
        if "word/comments.xml" in names:
            about["comments"] = sum(1 for _ in ElementTree.fromstring(z.read("word/comments.xml")).iter(f"{_W}comment"))
        about["images"] = sum(1 for n in names if n.startswith("word/media/"))
    about["tracked_changes"] = sum(1 for e in body.iter() if e.tag in (f"{_W}ins", f"{_W}del"))

    def text(e: ElementTree.Element) -> str:
        if e.tag in (f"{_W}t", f"{_W}delText"):
            return e.text or ""
        if e.tag in (f"{_W}tab", f"{_W}br"):
            return " "
        inner = "".join(text(c) for c in e if c.tag != f"{_W}p")
        return {f"{_W}ins": f"{{+{inner}+}}", f"{_W}del": f"{{-{inner}-}}"}.get(e.tag, inner) if inner else ""

    joined = (text(p).replace("+}{+", "").replace("-}{-", "") for p in body.iter(f"{_W}p"))
    return [p.strip() for p in joined if p.strip()], about


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page (S11). Raises where there is no PDF library or the file cannot be read."""
    if pypdf is None:
        raise RuntimeError("no PDF library")
    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise ValueError("encrypted")
    return [(p.extract_text() or "").strip() for p in reader.pages]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "readable", "note", "unit_kind", "units", "author", "created", "modified", "tracked_changes", "comments", "has_images"]
    types = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in batches:
        rows = []
        for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row: list = [path, True, None, None, [], None, None, None, None, None, False]
            try:
                if kind == "docx":
                    row[4], about = docx_paragraphs(content)
                    row[3] = "paragraph"
                    row[5:11] = [about["author"], about["created"], about["modified"], about["tracked_changes"], about["comments"], about["images"] > 0]
                elif kind == "pdf":
                    row[3], row[4] = "page", pdf_pages(content)
                elif kind == "image":
                    row[3], row[4], row[10] = "page", [""], True
                else:
                    row[1], row[2] = False, "not readable"
            except Exception as e:  # one bad file is a row with its reason, never a failed job
                row[1], row[2], row[4] = False, f"{type(e).__name__}: {e}"[:200], []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_SCHEMA = "path string, readable boolean, note string, unit_kind string, units array<string>, author string, created string, modified string, tracked_changes int, comments int, has_images boolean"


def extract(files: DataFrame) -> DataFrame:
    """Text units and properties of each file: files are read where they are, one task many files."""
    return files.select("path", file_type(F.col("path")).alias("kind"), "content").mapInArrow(_extract, _SCHEMA)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file: identity, type, hash, size, units, scans, properties (A11, H21, H22). ``operators.matching.numbered`` gives them numbers in path order."""
    files = walk(spark, folder)
    units = extract(files).select(
        F.col("path").alias("_p"), "readable", "note", F.size("units").alias("n_units"), F.when(F.col("unit_kind") == "page", F.size(F.filter("units", lambda u: F.length(F.trim(u)) < SCAN_CHARS))).alias("scanned_pages"),
        F.when(F.col("unit_kind") == "page", F.array_join(F.transform("units", lambda u: F.when(F.length(F.trim(u)) < SCAN_CHARS, "s").otherwise("t")), "")).alias("page_kinds"),
        F.get(F.filter("units", lambda u: F.trim(u) != ""), F.lit(0)).alias("title_guess"), "author", "created", "modified", "tracked_changes", "comments", "has_images",
    )
    base = files.select(F.col("path").alias("original_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), extension(F.col("path")).alias("ext"), file_type(F.col("path")).alias("file_type"), F.sha2("content", 256).alias("sha256"), "size_bytes")
    return base.join(units, F.col("original_path") == F.col("_p")).drop("_p")


def marked_text(extracted: DataFrame) -> DataFrame:
    """(path, text): units under their numbered markers, as downstream operators read them."""
    line = lambda u, i: F.when(F.col("unit_kind") == "page", F.concat(F.lit("=== page "), i + 1, F.lit(" ===\n"), u)).otherwise(F.concat(F.lit("[¶ "), i + 1, F.lit("] "), u))
    return extracted.where("readable").select("path", F.array_join(F.transform("units", line), "\n").alias("text"))

