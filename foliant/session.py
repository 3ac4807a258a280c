"""Session helpers: table loading, the shared folder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local session may fall back to its own."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="foliant-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    This cuts lineage, is read back column by column, and does not depend on any executor staying alive. The
    folder goes when the JVM ends, or before by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete written tables that no result still to be computed reads."""
    for df in staged:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a side that is to be broadcast, refusing more than ``limit`` rows instead of trusting its size."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a Spark application, by way of the shared folder; they need no path to this repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    target = f"{shared_dir(spark).rstrip('/')}/{root.name}-{uuid.uuid4().hex}.zip"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(body.getvalue())
    out.close()
    fs.deleteOnExit(path)
    spark.sparkContext.addPyFile(fs.makeQualified(path).toString())
    _shipped.add(app)
