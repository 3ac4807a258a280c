"""The append-only logs as streams: ledger rollup, request pairing, orphan counts and interval maps in keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions.text import tolerant_int
from foliant.operators.intervals import OPEN, IntervalMap


def log_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    """A growing folder of log files as a stream, or one file, as Spark's source takes only folders."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).load(target.getParent().toString())
    return reader.load(path)


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Running totals for each stage and role, for update or complete mode (A03 without its distinct counts)."""
    return ledger.groupBy("stage", "role").agg(
        F.count("*").alias("agents"), F.count_if(tolerant_int(F.col("attempt")) > 1).alias("retries"), F.coalesce(F.sum(tolerant_int(F.col("tokens"))), F.lit(0)).alias("tokens")
    )


def paired_requests(events: DataFrame, at: str = "recorded_at", late: str = "1 day") -> DataFrame:
    """Completions joined to their request by check_id; both sides forget after ``late``."""
    once = events.withWatermark(at, late).dropDuplicatesWithinWatermark(["check_id", "event"])
    r = once.where("event = 'requested'").select("check_id", F.col(at).alias("requested_at"))
    c = once.where("event = 'completed'").select(F.col("check_id").alias("c_id"), F.col(at).alias("completed_at"))
    return r.join(c, F.expr(f"check_id = c_id and completed_at >= requested_at and completed_at <= requested_at + interval {late}")).select("check_id", "requested_at", "completed_at")


def reference_counts(deltas: DataFrame) -> DataFrame:
    """Signed counts for each key from a stream of deltas (key, kind reference or existence, delta), for update mode; orphans are the keys
    with references and no record (P2)."""
    n = lambda k: F.sum(F.when(F.col("kind") == k, F.col("delta")).otherwise(0))
    return deltas.groupBy("key").agg(n("reference").alias("n_references"), n("existence").alias("n_existing"))


def _insert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap()
    if state.exists:
        m.starts, m.ends = pickle.loads(state.get[0])
    for f in frames:
        for s, e in zip(f["s"].tolist(), f["e"].tolist(), strict=True):
            if s == s and e == e:
                m.insert(int(s), int(e))
    state.update((pickle.dumps((m.starts, m.ends)),))
    rows = [(key[0], k, s, e) for k, s, e in m.spans()]
    yield pd.DataFrame(rows, columns=["key", "span_kind", "s", "e"])


def interval_stream(terms: DataFrame) -> DataFrame:
    """(key, span_kind, s, e) of every entity that a batch touches, from terms (key, s, e) in day numbers; OPEN is an open end.

    The map of an entity is its keyed state: it grows with the entity's disjoint intervals, not with its rows."""
    return terms.where("key is not null").groupBy("key").applyInPandasWithState(
        _insert, "key string, span_kind string, s int, e int", "m binary", "update", GroupStateTimeout.NoTimeout
    )


__all__ = ["OPEN", "interval_stream", "ledger_totals", "log_stream", "paired_requests", "reference_counts"]
