"""Rows of an outside list routed to records, and states handed down a chain of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.hierarchy import resolve
from foliant.operators.matching import unique_index


def route_rows(rows: DataFrame, row_no: str, key: str, answers: list[str], records: DataFrame, record_key: str, record: str) -> DataFrame:
    """(row_no, record, route, differing): where each row of a list goes.

    ``ignored`` without a key; ``unknown`` where the records do not have exactly one of that key; ``kept`` for the first row of a record;
    ``repeat`` for a later one with the same answers and ``conflict`` for one with others, named in ``differing``. Null and '' are the same
    answer. Only the first row of a record is ever joined, so a record with many rows stays one row on that side; the answers are
    compared as they come."""
    index = unique_index(records, F.col(record_key), record).select("key", F.col("value").alias("record"))
    said = F.struct(*[F.coalesce(F.col(a).cast("string"), F.lit("")).alias(a) for a in answers])
    r = rows.select(F.col(row_no).alias("row_no"), F.coalesce(F.col(key), F.lit("")).alias("key"), said.alias("said"))
    found = r.where("key <> ''").join(index, "key", "left")
    first = found.where("record is not null").groupBy("record").agg(F.min("row_no").alias("first_no"), F.min_by("said", "row_no").alias("first_said"))
    both = found.join(first, "record", "left")
    differing = F.array_join(F.array_compact(F.array(*[F.when(F.col("said")[a] != F.col("first_said")[a], F.lit(a)) for a in answers])), ", ")
    route = F.when(F.col("record").isNull(), "unknown").when(F.col("row_no") == F.col("first_no"), "kept").when(F.col("said") == F.col("first_said"), "repeat").otherwise("conflict")
    known = both.select("row_no", "record", route.alias("route"), F.when(F.col("record").isNotNull(), differing).otherwise("").alias("differing"))
    return known.unionByName(r.where("key = ''").select("row_no", F.lit(None).cast(dict(known.dtypes)["record"]).alias("record"), F.lit("ignored").alias("route"), F.lit("").alias("differing")))


def inherited(nodes: DataFrame, node: str, parent: str, state: str, unsettled: str) -> DataFrame:
    """(node, state, source): every node with its own state, or that of its nearest ancestor that has one.

    A null state waits for the parent's. Only waiting nodes are links, so the chains end at the first node that has a state, whatever lies
    above it, and pointer doubling settles chains of any length in rounds of their logarithm. A chain that ends in a circle, at a node without
    a row or without a parent stays ``unsettled``. One row a node is asked of ``nodes``; null nodes are left out."""
    own = nodes.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"), F.col(state).alias("state")).where("node is not null")
    waiting = own.where("state is null and parent is not null").select("node", "parent")
    ends = resolve(waiting, with_path=False).select("node", F.col("root").alias("source"))
    known = own.where("state is not null").select(F.col("node").alias("source"), F.col("state").alias("found"))
    handed = ends.join(known, "source", "left").select("node", F.coalesce("found", F.lit(unsettled)).alias("state"), F.when(F.col("found").isNotNull(), F.col("source")).alias("source"))
    alone = own.where("state is null and parent is null").select("node", F.lit(unsettled).alias("state"), F.lit(None).cast("string").alias("source"))
    return own.where("state is not null").select("node", "state", F.col("node").alias("source")).unionByName(handed).unionByName(alone)
