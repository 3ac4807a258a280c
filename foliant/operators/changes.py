"""Set operations between versions of a table: changes, replays, overlays, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import row_hash


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows, by one full join of row hashes (T02, G13). Null keys are left out."""
    a = before.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), row_hash(*columns).alias("old"))
    b = after.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), row_hash(*columns).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "key", "full").select(F.col("key").alias(key), kind.alias("change")).where("change is not null")


def replay(kept: DataFrame, scope: DataFrame, key: str, produced: DataFrame) -> DataFrame:
    """Old rows outside the scope and the rows produced anew for it."""
    return kept.join(scope.select(key).distinct(), key, "left_anti").unionByName(produced)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows, each as often."""
    tag = lambda df, s: df.select(F.xxhash64(*sorted(df.columns)).alias("h"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("t"), F.lit(s).alias("n"))
    diff = tag(a, 1).unionByName(tag(b, -1)).groupBy("h", "t").agg(F.sum("n").alias("n")).where("n <> 0")
    return diff.agg((F.count("*") == 0).alias("same"))


def overlay(rows: DataFrame, key: str, corrections: DataFrame, field: str, value: str, order: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with corrected values (P11): per key and known field the last correction wins; unknown fields are ignored.

    Corrections become one map a key before the join, so a key with many corrections stays one row."""
    last = (
        corrections.where(F.col(field).isin(fields) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.col(field).alias("_field")).agg(F.max_by(value, F.struct(*order)).alias("_value"))
        .groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_field", "_value"))).alias("_fix"))
    )
    fixed = [F.coalesce(F.try_element_at("_fix", F.lit(c)), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return rows.join(last, F.col(key) == F.col("_key"), "left").select(*fixed)


def missing_and_strays(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, problem): required but missing, present but not required."""
    r, p = required.select(key).where(F.col(key).isNotNull()).distinct(), present.select(key).where(F.col(key).isNotNull()).distinct()
    return r.join(p, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(p.join(r, key, "left_anti").withColumn("problem", F.lit("stray")))


def upsert(rows: DataFrame, key: list[str], new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same key (H17); null keys replace nothing."""
    return rows.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def same_coverage(produced: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """One row: whether both have the same different keys."""
    return missing_and_strays(selected, produced, key).agg((F.count("*") == 0).alias("same"))
