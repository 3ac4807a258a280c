"""References to records that do not exist, from signed counts over change deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.docrefs import doc_numbers

_ALWAYS = "timestamp_ntz'0001-01-01 00:00:00'"


def reference_deltas(cards: DataFrame, fields: tuple[str, ...], row_id: str, at: str) -> DataFrame:
    """One +1 row for each distinct document number that a row's field refers to: row_id, field_name, key, at."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.array_distinct(doc_numbers(F.col(f))).alias("keys")) for f in fields])
    return (
        cards.select(F.col(row_id).alias("row_id"), F.col(at).cast("timestamp_ntz").alias("at"), F.explode(cells).alias("c"))
        .select("row_id", "at", F.col("c.field_name").alias("field_name"), F.explode("c.keys").alias("key"))
    )


def existence_deltas(records: DataFrame, key: str, added: str, removed: str) -> DataFrame:
    """+1 when a record comes, -1 when it goes: key, at, delta. A null ``added`` means it was always there."""
    moves = F.array(
        F.struct(F.coalesce(F.col(added).cast("timestamp_ntz"), F.expr(_ALWAYS)).alias("at"), F.lit(1).alias("delta")),
        F.struct(F.col(removed).cast("timestamp_ntz").alias("at"), F.lit(-1).alias("delta")),
    )
    return (
        records.where(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), F.explode(moves).alias("m"))
        .where("m.at is not null")
        .select("key", "m.at", "m.delta")
    )


#: The span number of references without an instant, and of references to keys that no delta names.
EVER, NEVER = 0, -1


def timelines(deltas: DataFrame) -> DataFrame:
    """(key, span, span_from, span_until, n_existing): the whole time of every key, cut where its signed count changes; open ends are null.

    Span EVER has no ends and the highest count the key ever had. Deltas of one key and instant are summed first, so the window sees one
    row per change."""
    w = Window.partitionBy("key").orderBy("at")
    steps = deltas.groupBy("key", "at").agg(F.sum("delta").alias("delta"))
    steps = steps.select("key", "at", F.sum("delta").over(w).alias("n"), F.lead("at").over(w).alias("until"), (F.row_number().over(w) + 1).alias("i"))
    steps = steps.withColumn("most", F.max("n").over(Window.partitionBy("key")))
    none = F.lit(None).cast("timestamp_ntz")
    span = lambda i, a, b, n: F.struct(F.lit(i).cast("int").alias("span") if isinstance(i, int) else i.alias("span"), a.alias("span_from"), b.alias("span_until"), n.cast("long").alias("n_existing"))
    here = span(F.col("i"), F.col("at"), F.col("until"), F.col("n"))
    first = F.array(span(EVER, none, none, F.col("most")), span(1, none, F.col("at"), F.lit(0)), here)
    return steps.select("key", F.explode(F.when(F.col("i") == 2, first).otherwise(F.array(here))).alias("s")).select("key", "s.*")


def placed(references: DataFrame, spans: DataFrame) -> DataFrame:
    """``references`` with the span of their key that they fall into. A change at the very instant of the reference counts."""
    r, s = references.alias("r"), spans.alias("s")
    inside = (F.col("r.at") >= F.coalesce("s.span_from", F.col("r.at"))) & F.coalesce(F.col("r.at") < F.col("s.span_until"), F.lit(True))
    there = (F.col("r.key") == F.col("s.key")) & F.when(F.col("s.span") == EVER, F.col("r.at").isNull()).otherwise(F.coalesce(inside, F.lit(False)))
    return r.join(s, there, "left").select("r.*", F.coalesce("s.span", F.lit(NEVER)).alias("span"))


def orphan_references(references: DataFrame, deltas: DataFrame) -> DataFrame:
    """References whose key, at their instant, has references and no record: positive reference count, existence count not above zero.

    Both counts are kept for each key and each span of time between changes of its records (``apply_deltas``), and the report is taken
    from them (``current_orphans``). A removal at the very instant of the reference counts, and so does an addition. A reference without an
    instant is an orphan only if its key never existed. The counts of references combine map-side, and where references are joined, they
    meet few rows a key, so that adaptive skew handling splits a key that holds a third of them."""
    spans = timelines(deltas)
    tagged = placed(references, spans)
    state = apply_deltas(None, tagged.select("key", "span"), spans.select("key", "span", F.col("n_existing").alias("delta")), ("key", "span"))
    return tagged.join(current_orphans(state, ("key", "span")).select("key", "span"), ["key", "span"], "left_semi").select("row_id", "field_name", "key", "at")


def apply_deltas(state: DataFrame | None, references: DataFrame | None, existence: DataFrame | None, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The next state (*by, n_references, n_existing) from the last one and a batch of deltas of either kind.

    ``references`` has the columns ``by`` and optionally delta (+1 where absent), ``existence`` has them and delta. Keys whose counts both
    return to zero leave the state. Any argument may be None."""
    parts = []
    if state is not None:
        parts.append(state.select(*by, "n_references", "n_existing"))
    if references is not None:
        d = F.col("delta") if "delta" in references.columns else F.lit(1)
        parts.append(references.select(*by, d.cast("long").alias("n_references"), F.lit(0).cast("long").alias("n_existing")))
    if existence is not None:
        parts.append(existence.select(*by, F.lit(0).cast("long").alias("n_references"), F.col("delta").cast("long").alias("n_existing")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*by).agg(F.sum("n_references").alias("n_references"), F.sum("n_existing").alias("n_existing")).where("n_references <> 0 or n_existing <> 0")


def current_orphans(state: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Keys with references and no record."""
    return state.where("n_references > 0 and n_existing <= 0").select(*by, "n_references")
