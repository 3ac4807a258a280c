"""Rollups of the token ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import tolerant_int

#: Roles that run once a document, and once an account.
DOCUMENT_ROLES = ("filer", "reader", "table-reader", "extractor")
ACCOUNT_ROLES = ("judge", "mapper")


def role_basis(role: Column) -> Column:
    """H16"""
    r = F.lower(F.trim(role))
    return F.when(r.isin(*DOCUMENT_ROLES), "per document").when(r.isin(*ACCOUNT_ROLES), "per account").otherwise("not classified")


def measured(ledger: DataFrame) -> DataFrame:
    """Ledger rows with numbers where the text is one; rows with nothing in them are left out."""
    columns = [c for c in ("stage", "role", "model", "target", "attempt", "outcome", "tokens", "duration_ms", "units_read") if c in ledger.columns]
    some = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns]).isNotNull()
    num = lambda c: tolerant_int(F.col(c))
    return ledger.where(some).select(
        "ledger_no", "stage", "role", F.nullif(F.trim("model"), F.lit("")).alias("model"), F.nullif(F.trim("target"), F.lit("")).alias("target"),
        (num("attempt") > 1).alias("retry"), (F.coalesce(F.lower(F.trim("outcome")), F.lit("")) != "ok").alias("failed"),
        num("tokens").alias("tokens"), num("duration_ms").alias("duration_ms"), num("units_read").alias("units"),
    )


def totals() -> list[Column]:
    """Counts and sums; unknown tokens count as 0 and are counted; tokens a unit only where both are known."""
    both = (F.col("units") > 0) & F.col("tokens").isNotNull()
    zero = F.lit(0).cast("long")
    return [
        F.count("*").alias("agents"), F.count_if("retry").alias("retries"), F.count_if("failed").alias("failures"), F.coalesce(F.sum("tokens"), zero).alias("tokens"),
        F.count_if(F.col("tokens").isNull()).alias("unknown_tokens"), F.countDistinct("target").alias("targets"), F.coalesce(F.sum("duration_ms"), zero).alias("duration_ms"),
        F.coalesce(F.sum(F.when(both, F.col("tokens"))), zero).alias("unit_tokens"), F.coalesce(F.sum(F.when(both, F.col("units"))), zero).alias("units"),
    ]


def rollup_by_role(ledger: DataFrame) -> DataFrame:
    """One row for each stage and role and one for each stage, distinct targets exact on both levels. Models in order of first use."""
    m = measured(ledger)
    first = m.where("model is not null").groupBy("stage", "role", "model").agg(F.min("ledger_no").alias("at"))
    ordered = lambda g: g.agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "model"))), lambda x: x["model"])), ", ").alias("models"))
    parts = m.groupingSets([["stage", "role"], ["stage"]], "stage", "role").agg(*totals(), F.grouping("role").alias("is_total"))
    by_role = ordered(first.groupBy("stage", "role")).withColumn("is_total", F.lit(0))
    by_stage = ordered(first.groupBy("stage")).select("stage", F.lit(None).cast("string").alias("role"), "models", F.lit(1).alias("is_total"))
    models = by_role.unionByName(by_stage).select(F.col("stage").alias("_s"), F.col("role").alias("_r"), F.col("is_total").alias("_t"), "models")
    j = F.col("stage").eqNullSafe(F.col("_s")) & F.col("role").eqNullSafe(F.col("_r")) & (F.col("is_total") == F.col("_t"))
    return parts.join(models, j, "left").drop("_s", "_r", "_t").withColumn("is_total", F.col("is_total").cast("int"))


def extrapolate(ledger: DataFrame, n_documents: int) -> DataFrame:
    """Tokens a target of each document role, times the documents; account roles are not scaled. Rounded half up."""
    m = measured(ledger).withColumn("basis", role_basis(F.col("role"))).groupBy("role", "basis").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.countDistinct("target").alias("targets"))
    each = F.col("tokens") / F.nullif(F.col("targets"), F.lit(0))
    return m.select("role", "basis", F.floor(each + 0.5).cast("long").alias("tokens_per_target"), F.when(F.col("basis") == "per document", F.floor(each * n_documents + 0.5).cast("long")).alias("projected"))
