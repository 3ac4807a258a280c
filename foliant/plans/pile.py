"""Problem queries 2 to 6 over the card tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.dates import leading_date, whole_date
from foliant.functions.docrefs import first_doc_number
from foliant.operators import hierarchy as H
from foliant.operators import orphans as O
from foliant.operators import packed_cells as P
from foliant.operators import strict_load as S
from foliant.operators.intervals import continuous_periods
from foliant.session import table

LINK_FIELDS = ("q6_attaches_to", "q6_referred_to_not_in_pile")


def _references(spark: SparkSession, d: str) -> DataFrame:
    return O.reference_deltas(table(spark, d, "cards"), LINK_FIELDS, "card_no", "read_at")


def _existence(spark: SparkSession, d: str) -> DataFrame:
    return O.existence_deltas(table(spark, d, "inventory"), "doc_id", "added_at", "removed_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = O.orphan_references(_references(spark, d), _existence(spark, d))
    return found.select(F.col("row_id").alias("card_no"), "field_name", F.col("key").alias("ref_doc_id"))


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    found = O.orphan_references(_references(spark, d), _existence(spark, d))
    return found.groupBy("field_name", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_orphans"))


def p2_current(spark: SparkSession, d: str) -> DataFrame:
    state = O.apply_deltas(None, _references(spark, d), _existence(spark, d))
    return O.current_orphans(state).select(F.col("key").alias("ref_doc_id"), "n_references")


def card_terms(cards: DataFrame) -> DataFrame:
    """(pile_folder, start, end, is_open) of every card, as read; unusable parts are null."""
    end = F.lower(F.trim("q4_end"))
    live = F.lower(F.trim("q4_status")) == "live"
    fixed = F.regexp_extract(end, r"^fixed\s*:?\s*(.*)$", 1)
    return cards.select(
        F.when(F.trim("pile_folder") != "", F.col("pile_folder")).alias("pile_folder"),
        whole_date(F.col("q4_start_date")).alias("start"),
        leading_date(fixed).alias("end"),
        F.coalesce(end.rlike(r"^(rolling until notice|until project ends)") & live, F.lit(False)).alias("is_open"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return continuous_periods(card_terms(table(spark, d, "cards")), "pile_folder", "start", "end", "is_open")


CLOSED = {"q1_kind": S.KINDS, "q3_signed": S.SIGNED}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = S.rejected_lines(table(spark, d, "cards_raw"), "line_no", "raw_line", S.RAW_FIELDS, CLOSED)
    answers = S.rejected_answers(table(spark, d, "cards"), "card_no", CLOSED)
    tag = lambda df, name: df.select(F.lit(name).alias("src_table"), "row_no", "reason")
    return tag(lines, "cards_raw").unionByName(tag(answers, "cards"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = S.load_lines(table(spark, d, "cards_raw"), "line_no", "raw_line", S.RAW_FIELDS, CLOSED)
    return loaded.select(F.col("row_no").alias("line_no"), *S.RAW_FIELDS)


PACKED = ["q2_their_group_companies", "q6_attaches_to"]
#: Fixed values, for the SQL only, which has no description lengths: what a complete entry of each field ends in.
ROLE_END = r"\((?:parent listed|affiliate listed|guarantor|other)\)"
TARGET_END = r"(?:→|->|=>)\s*(?:not in pile|doc\b[\s.:#]*\d+)"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return P.split_packed(table(spark, d, "cards"), "card_no", PACKED, least=2).withColumnRenamed("row_id", "card_no")


def card_parents(cards: DataFrame) -> DataFrame:
    parent = F.coalesce(first_doc_number(F.col("q6_attaches_to")), first_doc_number(F.col("q6_replaces")))
    return H.parent_links(cards.select("doc_id", parent.alias("parent")), "doc_id", "parent")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    r = H.resolve(card_parents(table(spark, d, "cards")), with_path=False)
    return r.select(F.col("node").alias("doc_id"), F.col("root").alias("root_doc_id"), "depth")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    r = H.resolve(card_parents(table(spark, d, "cards")))
    return H.paths(r).select(F.col("node").alias("doc_id"), "path")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hang below each one that no circle is above; those of all others are in ``p6_descendant_list``."""
    n = H.count_descendants(card_parents(table(spark, d, "cards")))
    return n.select(F.col("node").alias("doc_id"), "n_descendants")


def p6_descendant_list(spark: SparkSession, d: str) -> DataFrame:
    """Each document and every other one below it; in a circle each is below each."""
    pairs = H.all_descendants(card_parents(table(spark, d, "cards")))
    return pairs.select(F.col("ancestor").alias("doc_id"), F.col("node").alias("descendant_doc_id"))


QUERIES = {f.__name__: f for f in (p2_found, p2_by_month, p2_current, p3_found, p4_found, p4_loaded, p5_found, p6_found, p6_paths, p6_descendants, p6_descendant_list)}

_REFS = """refs as (
  select distinct card_no, field_name, read_at,
         case when length(n) < 8 then lpad(n, 8, '0') else n end as ref_doc_id
  from (select card_no, read_at, 'q6_attaches_to' as field_name, unnest(regexp_extract_all(q6_attaches_to, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1)) as n from cards
        union all
        select card_no, read_at, 'q6_referred_to_not_in_pile', unnest(regexp_extract_all(q6_referred_to_not_in_pile, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1)) from cards)),
found as (
  select card_no, field_name, ref_doc_id, read_at from refs r
  where not exists (select 1 from inventory i where i.doc_id = r.ref_doc_id and coalesce(i.added_at <= r.read_at, true)
                    and coalesce(i.removed_at > r.read_at, true)))"""

_MON = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def _sql_date(x: str, tail: str) -> str:
    """DuckDB text of a date at the start of ``x`` (lower case, trimmed); ``tail`` is what may follow."""
    month = "lpad(cast(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], {}) as varchar), 2, '0')"

    def shape(p: str, y: int, m: int, d: int, named: bool) -> str:
        g = lambda i: f"regexp_extract({x}, '{p}', {i})"
        mm = month.format(g(m)) if named else f"lpad({g(m)}, 2, '0')"
        return f"case when regexp_matches({x}, '{p}{tail}') then try_cast({g(y)} || '-' || {mm} || '-' || lpad({g(d)}, 2, '0') as date) end"

    parts = (
        shape("^(\\d{4})-(\\d{1,2})-(\\d{1,2})", 1, 2, 3, False), shape("^(\\d{1,2})[./](\\d{1,2})[./](\\d{4})", 3, 2, 1, False),
        shape(f"^(\\d{{1,2}})(?:st|nd|rd|th)?\\.?\\s+{_MON}\\.?,?\\s+(\\d{{4}})", 3, 2, 1, True), shape(f"^{_MON}\\.?\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})", 3, 1, 2, True),
    )
    return "coalesce(" + ", ".join(parts) + ")"


_CLOSED_SQL = {k: "(" + ", ".join("'" + x.lower().replace("'", "''") + "'" for x in v) + ")" for k, v in CLOSED.items()}
_LINE_OK = '^(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*$'
_RAW_SQL = f"""parsed as (
  select line_no, raw_line, coalesce(regexp_matches(raw_line, '(?s){_LINE_OK}'), false) as ok,
         list_transform(regexp_extract_all(',' || raw_line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
           lambda f: case when starts_with(f, '"') then replace(f[2:-2], '""', '"') else f end) as f from cards_raw),
checked as (
  select *, ok and len(f) = 8 as shaped, coalesce(lower(trim(f[3])) in {_CLOSED_SQL["q1_kind"]}, false) as kind_ok,
         coalesce(lower(trim(f[5])) in {_CLOSED_SQL["q3_signed"]}, false) as signed_ok from parsed)"""


def _packed_sql(field: str, end: str) -> str:
    """Marks each joint of complete entries and splits there: an independent reading of the same cells."""
    joint = f"((?i:{end})\"?)\\s*[|;,/+\\n](?:[ \\t]*[|;,/+\\n])*"
    return f"""select card_no, '{field}' as field_name, list_filter(list_transform(
        string_split(regexp_replace(regexp_replace({field}, '^[\\s|;,/+]+', ''), '{joint}', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: case when regexp_matches(trim(x, e' \\n\\t'), '^"(?s:.*)"$') then trim(replace(trim(x, e' \\n\\t')[2:-2], '""', '"'), e' \\n\\t') else trim(x, e' \\n\\t') end),
        lambda x: x <> '' and lower(x) not in ('none', 'not found')) as e
      from cards where {field} is not null"""


_LINKS = """links as (
  select doc_id as node, min(parent) as parent from (
    select doc_id, case when length(n) < 8 then lpad(n, 8, '0') else n end as parent from (
      select doc_id, coalesce(nullif(regexp_extract(q6_attaches_to, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1), ''),
                              nullif(regexp_extract(q6_replaces, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1), '')) as n from cards))
  where parent is not null and doc_id is not null group by doc_id),
down as (
  select node, parent as root, 1 as depth, parent || '/' || node as path from links where parent not in (select node from links)
  union all
  select l.node, d.root, d.depth + 1, d.path || '/' || l.node from links l join down d on l.parent = d.node)"""

SQL = {
    "p2_found": f"with {_REFS} select card_no, field_name, ref_doc_id from found",
    "p2_by_month": f"with {_REFS} select field_name, strftime(read_at, '%Y-%m') as month, count(*) as n_orphans from found group by all",
    "p2_current": f"""with {_REFS}
select ref_doc_id, count(*) as n_references from refs
where ref_doc_id not in (select doc_id from inventory where removed_at is null) group by all""",
    "p3_found": f"""with t as (
  select card_no, pile_folder, lower(trim(q4_start_date)) as s, lower(trim(q4_end)) as e, lower(trim(q4_status)) = 'live' as live from cards where trim(pile_folder) <> ''),
u as (select *, regexp_extract(e, '^fixed\\s*:?\\s*(.*)$', 1) as fx from t),
v as (select card_no, pile_folder, {_sql_date("s", "\\s*$")} as s,
        case when regexp_matches(e, '^(rolling until notice|until project ends)') and live then date '9999-12-31' else {_sql_date("fx", "(?:$|\\D)")} end as e from u),
w as (select *, max(e) over (partition by pile_folder order by s, e, card_no rows between unbounded preceding and 1 preceding) as reach from v where s is not null and e is not null and e >= s),
x as (select *, sum(case when reach is null or (reach < date '9999-12-31' and s > reach + 1) then 1 else 0 end) over (partition by pile_folder order by s, e, card_no rows unbounded preceding) as island from w),
y as (select pile_folder, min(s) as f, max(e) as t from x group by pile_folder, island),
z as (select *, lead(f) over (partition by pile_folder order by f) as nxt from y)
select pile_folder, 'period' as span_kind, strftime(f, '%Y-%m-%d') as span_from, case when t = date '9999-12-31' then 'open' else strftime(t, '%Y-%m-%d') end as span_to from z
union all
select pile_folder, 'gap', strftime(t + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') from z where nxt is not null""",
    "p4_found": f"""with {_RAW_SQL}
select 'cards_raw' as src_table, line_no as row_no, 'quoting' as reason from checked where not ok
union all select 'cards_raw', line_no, 'columns' from checked where ok and not shaped
union all select 'cards_raw', line_no, 'q1_kind' from checked where shaped and not kind_ok
union all select 'cards_raw', line_no, 'q3_signed' from checked where shaped and not signed_ok
union all select 'cards', card_no, 'q1_kind' from cards where not coalesce(lower(trim(q1_kind)) in {_CLOSED_SQL["q1_kind"]}, false)
union all select 'cards', card_no, 'q3_signed' from cards where not coalesce(lower(trim(q3_signed)) in {_CLOSED_SQL["q3_signed"]}, false)""",
    "p4_loaded": f"with {_RAW_SQL} select line_no, " + ", ".join(f"f[{i + 1}] as {x}" for i, x in enumerate(S.RAW_FIELDS)) + " from checked where shaped and kind_ok and signed_ok",
    "p5_found": f"""with cells as ({_packed_sql("q2_their_group_companies", ROLE_END)} union all {_packed_sql("q6_attaches_to", TARGET_END)})
select card_no, field_name, cast(unnest(range(1, len(e) + 1)) as integer) as entry_no, unnest(e) as entry_text from cells where len(e) >= 2""",
    "p6_found": f"""with recursive {_LINKS}
select l.node as doc_id, coalesce(d.root, 'cycle') as root_doc_id, cast(coalesce(d.depth, -1) as integer) as depth from links l left join down d on l.node = d.node""",
    "p6_paths": f"with recursive {_LINKS} select l.node as doc_id, d.path from links l left join down d on l.node = d.node",
    "p6_descendants": f"""with recursive {_LINKS}, a as (
  select node, unnest(string_split(path, '/')) as anc from down)
select anc as doc_id, count(*) as n_descendants from a where anc <> node group by anc""",
    "p6_descendant_list": f"""with recursive {_LINKS}, reach as (
  select node, parent as anc from links
  union
  select r.node, l.parent from reach r join links l on r.anc = l.node)
select anc as doc_id, node as descendant_doc_id from reach where anc <> node""",
}
