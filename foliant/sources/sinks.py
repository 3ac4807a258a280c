"""Writers: fixed columns, partitioned lists, versions, snapshots and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order as text; extra ones dropped, missing ones and nulls blank."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """K01"""
    fixed(df, columns).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """K02"""
    df.write.mode("overwrite").json(path)


def write_lists(df: DataFrame, path: str, by: list[str], columns: list[str]) -> None:
    """One list for each value of ``by``; lists of values that this run has are replaced, others stay.

    Rows of a list are brought together first, so a list is a few files and not one for each task; a hot list is split by size."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        kept = fixed(df, [*by, *[c for c in columns if c not in by]])
        kept.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).option("header", "true").csv(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


#: The folder that stands for null and the empty string.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def drop_stale(spark: SparkSession, path: str, by: str, current: list[str | None]) -> list[str]:
    """Removes lists of values that no run produces any more; gives their names.

    Folder names are read back as they were written, with quotes, colons and slashes escaped. Null and '' in ``current`` both mean the list without a value."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    keep, gone = {v or NO_VALUE for v in current}, []
    for s in fs.listStatus(root) if fs.exists(root) else ():
        column, _, value = s.getPath().getName().partition("=")
        if s.isDirectory() and unescape(column) == by and (name := unescape(value)) not in keep:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def write_version(df: DataFrame, path: str, version: str) -> str:
    """A run's output under its own version; earlier ones stay as history."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_snapshot(df: DataFrame, path: str, source_hash: str, pointer: str, as_at: str) -> None:
    """Content-addressed: rows under the hash of their source, written once, and a pointer row to the active one.

    Rows are written aside and renamed when complete; a folder without the mark of a finished write is one that failed, and is written anew."""
    spark = df.sparkSession
    target = f"{path.rstrip('/')}/source_hash={source_hash}"
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path_of(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path_of(f"{target}/_SUCCESS")):
        aside = f"{path.rstrip('/')}/_writing-{source_hash}-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        fs.delete(path_of(target), True)
        if not fs.rename(path_of(aside), path_of(target)):
            raise OSError(f"{aside} cannot be renamed to {target}")
    df.sparkSession.createDataFrame([(source_hash, as_at)], "source_hash string, as_at string").coalesce(1).write.mode("overwrite").json(pointer)


def read_active(spark: SparkSession, path: str, pointer: str) -> DataFrame:
    active = spark.read.schema("source_hash string, as_at string").json(pointer).first()
    return spark.read.parquet(f"{path.rstrip('/')}/source_hash={active['source_hash']}")


def append_log(df: DataFrame, path: str) -> None:
    """K08"""
    df.write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge files with import headers, sorted by key."""
    n = nodes.select(F.col("id").alias("id:ID"), F.col("label").alias(":LABEL"), *[c for c in nodes.columns if c not in ("id", "label")])
    e = edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE"), *[c for c in edges.columns if c not in ("src", "dst", "type")])
    n.orderBy("id:ID").write.mode("overwrite").option("header", "true").csv(f"{path}/nodes")
    e.orderBy(":START_ID", ":END_ID", ":TYPE").write.mode("overwrite").option("header", "true").csv(f"{path}/edges")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A rollup of up to ``limit`` rows as a pipe table; more raise, as a page is no place for them."""
    from foliant.functions.text import md_cell
    from foliant.session import bounded_rows

    rows = bounded_rows(df.select(*[md_cell(F.col(c).cast("string")).alias(c) for c in df.columns]), limit, "the table")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows)])
