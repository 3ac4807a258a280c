"""Loading rows that conform, and the reason for each one that does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed lists of a card's answers.
SIGNED = ("both", "us only", "them only", "nobody", "can't tell")
KINDS = (
    "master or framework", "amendment or side letter", "pricing or rebate letter", "NDA", "project or programme agreement",
    "statement of work", "purchase order or quote", "guarantee", "data terms", "standard terms", "termination letter",
    "adoption agreement", "schedule or annex", "internal playbook or guidance", "other",
)
RAW_FIELDS = ("doc_id", "q1_title", "q1_kind", "q2_our_entity", "q3_signed", "q4_start_date", "q4_status", "q10_oddities")
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'


def in_closed_list(value: Column, members: tuple[str, ...]) -> Column:
    """Whether the answer is in the list, outer white space and case aside; false for null."""
    bare = F.lower(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.coalesce(bare.isin(*[m.lower() for m in members]), F.lit(False))


def well_quoted(line: Column) -> Column:
    """Whether a line is a list of fields each free of double quotes or wholly enclosed in them with inner ones doubled."""
    return F.coalesce(line.rlike(rf"(?s)\A{_FIELD}(?:,{_FIELD})*+\z"), F.lit(False))


def line_fields(line: Column) -> Column:
    """The fields of a well-quoted line, quotes taken off and doubled ones made single."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf"(?s),({_FIELD})"), F.lit(1))
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def load_lines(raw: DataFrame, offset: str, line: str, fields: tuple[str, ...], closed: dict[str, tuple[str, ...]]) -> DataFrame:
    """The strict load: only rows that parse into exactly ``fields`` with every closed answer in its list, offset kept."""
    parsed = raw.select(F.col(offset).alias("row_no"), F.col(line).alias("line")).where(well_quoted(F.col("line")))
    parsed = parsed.select("row_no", "line", line_fields(F.col("line")).alias("f")).where(F.size("f") == len(fields))
    good = [in_closed_list(F.col("f")[fields.index(k)], v) for k, v in closed.items()]
    for g in good:
        parsed = parsed.where(g)
    return parsed.select("row_no", "line", *[F.col("f")[i].alias(x) for i, x in enumerate(fields)])


def _subtract(raw: DataFrame, loaded: DataFrame, *content: str) -> DataFrame:
    """Raw rows whose offset and content were not loaded. The content hash keeps a bad row apart from a good one with its offset."""
    mark = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in content])
    r = raw.withColumn("mark", mark).alias("r")
    g = loaded.select(F.col("row_no"), mark.alias("mark")).alias("g")
    return r.join(g, F.col("r.row_no").eqNullSafe(F.col("g.row_no")) & (F.col("r.mark") == F.col("g.mark")), "left_anti")


def rejected_lines(raw: DataFrame, offset: str, line: str, fields: tuple[str, ...], closed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(row_no, reason) of every line that the strict load left behind: quoting, else columns, else each failing closed field.

    A null line is ``quoting``, an empty one ``columns``. Lines are compared by offset and content, so repeated lines with their own
    offsets are each reported and a repeated row comes out once for each copy."""
    rest = _subtract(raw.select(F.col(offset).alias("row_no"), F.col(line).alias("line")), load_lines(raw, offset, line, fields, closed), "line")
    ok = well_quoted(F.col("line"))
    f = F.when(ok, line_fields(F.col("line")))
    bad = F.array_compact(F.array(*[F.when(~in_closed_list(F.get(F.col("f"), F.lit(fields.index(k))), v), F.lit(k)) for k, v in closed.items()]))
    return (
        rest.select("row_no", ok.alias("ok"), f.alias("f"))
        .select("row_no", F.explode(F.when(~F.col("ok"), F.array(F.lit("quoting"))).when(F.size("f") != len(fields), F.array(F.lit("columns"))).otherwise(bad)).alias("reason"))
    )


def rejected_answers(rows: DataFrame, offset: str, closed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(row_no, reason) of every row with an answer outside its closed list; null is outside."""
    raw = rows.select(F.col(offset).alias("row_no"), *closed)
    loaded = raw
    for k, v in closed.items():
        loaded = loaded.where(in_closed_list(F.col(k), v))
    bad = F.array_compact(F.array(*[F.when(~in_closed_list(F.col(k), v), F.lit(k)) for k, v in closed.items()]))
    return _subtract(raw, loaded, *closed).select("row_no", F.explode(bad).alias("reason"))
