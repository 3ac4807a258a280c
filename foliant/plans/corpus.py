"""The joined corpus, export rows, placements, inherited states, and the rules across a card's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import dates as D
from foliant.functions import text as T
from foliant.functions.docrefs import doc_numbers, first_doc_number
from foliant.operators import ledger as L
from foliant.operators import strict_load as S
from foliant.operators.hierarchy import CYCLE, parent_links, resolve
from foliant.operators.routing import inherited, route_rows
from foliant.plans.matching import _DOC, _EMPTY, _MATCH, _START, accounts, unique_key_match
from foliant.plans.pile import _RAW_SQL, CLOSED
from foliant.plans.scalars import _lit, _q_date, q_norm, q_titles
from foliant.session import table

ANSWERS = [f for f in S.RAW_FIELDS if f != "doc_id"]
#: Kinds of paper whose state is that of the paper they hang on.
CHILD_KINDS = ("amendment or side letter", "schedule or annex", "statement of work", "pricing or rebate letter")
#: Folders that a placement may name.
FOLDERS = ("4-not-live", "unsure")
#: Stages in the order of a run.
STAGES = ("prepare", "sort", "extract", "analyse", "report")


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The export's rows that load, and where each row goes; lines that do not load have no key."""
    raw = table(spark, d, "cards_raw").select("line_no", "raw_line")
    rows = S.load_lines(raw, "line_no", "raw_line", S.RAW_FIELDS, CLOSED).drop("line")
    asked = raw.select("line_no").join(rows, F.col("line_no") == F.col("row_no"), "left")
    return rows, route_rows(asked, "line_no", "doc_id", ANSWERS, table(spark, d, "inventory"), "doc_id", "doc_id")


def export_routing(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the export with its route and document: kept, repeat, conflict (and in which answers), unknown, ignored."""
    return _routes(spark, d)[1].select(F.col("row_no").alias("line_no"), F.col("record").alias("doc_id"), "route", "differing")


def _placements(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, folder, reason, n): of several placements of a document the greatest stands, as the table has no order."""
    p = table(spark, d, "corrections").where("field = 'folder' and doc_id is not null")
    best = F.max(F.struct(F.coalesce("value", F.lit("")).alias("value"), F.coalesce("reason", F.lit("")).alias("reason")))
    return p.groupBy("doc_id").agg(best.alias("b"), F.count("*").alias("n")).select("doc_id", F.col("b.value").alias("folder"), F.col("b.reason").alias("reason"), "n")


def settled_placements(spark: SparkSession, d: str) -> DataFrame:
    """The folder of every readable document: a placement with a known folder and a reason stands, everything else is unsure, with the why."""
    i = table(spark, d, "inventory").where("readable = 'yes'").select("doc_id")
    p = i.join(_placements(spark, d), "doc_id", "left")
    why = F.when(F.col("folder").isNull(), "no placement").when(~F.col("folder").isin(*FOLDERS), "unknown folder").when(F.col("reason") == "", "no reason")
    return p.select("doc_id", F.when(why.isNull(), F.col("folder")).otherwise("unsure").alias("folder"), F.coalesce(why, F.when(F.col("n") > 1, "one row of several"), F.lit("")).alias("why"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """(account_number, source_checks): what the ledger says of each account, by stage, role and outcome."""
    m = L.measured(table(spark, d, "cost_ledger")).where("target is not null").join(accounts(spark, d).select("account", "account_number"), F.col("target") == F.col("account"))
    g = m.groupBy("account_number", F.concat_ws("/", "stage", "role").alias("at"), "failed").agg(F.count("*").alias("n"))
    said = F.concat("at", F.when(F.col("failed"), ": failed ").otherwise(": ok "), F.col("n").cast("string"))
    return g.groupBy("account_number").agg(F.array_join(F.sort_array(F.collect_list(said)), " | ").alias("source_checks"))


def corpus_joined(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the inventory with each of its cards, its placement, its export row, the checks of its account and
    its text's kind; what is not there says so, and the stage tells how far the document has come."""
    i = table(spark, d, "inventory").select("doc_id", "readable")
    c = table(spark, d, "cards").select("doc_id", "card_no", "q1_title", "q1_kind")
    account = unique_key_match(spark, d).where("account_number is not null").groupBy("card_no").agg(F.min("account_number").alias("account_number"))
    rows, routes = _routes(spark, d)
    review = routes.where("route = 'kept'").join(rows.drop("doc_id"), "row_no").select(F.col("record").alias("doc_id"), F.col("q1_title").alias("review_title"), F.col("q4_status").alias("review_status"))
    form = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("doc_id"), F.col("kind").alias("form_kind"))
    j = i.join(c, "doc_id", "left").join(account, "card_no", "left").join(_placements(spark, d).select("doc_id", "folder"), "doc_id", "left").join(review, "doc_id", "left")
    j = j.join(_checks(spark, d), "account_number", "left").join(form, "doc_id", "left")
    card, placed, seen, dead = F.col("card_no").isNotNull(), F.col("folder").isNotNull(), F.col("review_title").isNotNull(), F.coalesce(F.col("readable") == "no", F.lit(False))
    stage = (
        F.when(dead, "unreadable").when(seen & placed, "judged from the export").when(seen, "export; awaiting judgment").when(card & placed, "judged").when(card, "read; awaiting judgment").otherwise("filing only")
    )
    say = lambda x, none: F.when(dead, "not readable by the kit").otherwise(F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(none)))
    return j.select(
        "doc_id", "card_no", "account_number", say("q1_title", "no card").alias("title"), say("q1_kind", "no card").alias("kind"), say("folder", "not judged").alias("folder"),
        say("review_title", "").alias("review_title"), say("review_status", "").alias("review_status"), say("source_checks", "none").alias("source_checks"), say("form_kind", "not found").alias("form_kind"), stage.alias("analysis_stage"),
    )


def inherited_status(spark: SparkSession, d: str) -> DataFrame:
    """The state of every document with a card: its own, or for papers that hang on another that of the first above them with one of its own."""
    c = table(spark, d, "cards").where("doc_id is not null")
    parent = F.coalesce(first_doc_number(F.col("q6_attaches_to")), first_doc_number(F.col("q6_replaces")))
    one = c.groupBy("doc_id").agg(F.min(parent).alias("parent"), F.min_by(F.struct(F.lower(F.trim("q1_kind")).alias("k"), F.lower(F.trim("q4_status")).alias("s")), "card_no").alias("x"))
    own = F.when(F.coalesce(F.col("x.k").isin(*CHILD_KINDS), F.lit(False)), None).otherwise(F.coalesce("x.s", F.lit("unsure")))
    out = inherited(one.select("doc_id", "parent", own.alias("state")), "doc_id", "parent", "state", "unsure")
    return out.select(F.col("node").alias("doc_id"), "state", "source")


def family_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Of every tree the kinds that the cards of its root document give it; more than one is a conflict. Circles have no root."""
    c = table(spark, d, "cards")
    parent = F.coalesce(first_doc_number(F.col("q6_attaches_to")), first_doc_number(F.col("q6_replaces")))
    r = resolve(parent_links(c.select("doc_id", parent.alias("parent")), "doc_id", "parent"), with_path=False).where(F.col("root") != CYCLE)
    trees = r.groupBy(F.col("root").alias("doc_id")).agg((F.count("*") + 1).alias("n_docs"))
    said = c.select("doc_id", F.lower(F.trim("q1_kind")).alias("family")).where("family <> ''").groupBy("doc_id").agg(F.countDistinct("family").alias("n_families"), F.min("family").alias("family"))
    j = trees.join(said, "doc_id", "left")
    return j.select(F.col("doc_id").alias("root_doc_id"), "n_docs", F.coalesce("n_families", F.lit(0)).cast("long").alias("n_families"), F.when(F.col("n_families") == 1, F.col("family")).when(F.col("n_families") > 1, "conflict").otherwise("not found").alias("family"))


def parents_by_dated_title(spark: SparkSession, d: str) -> DataFrame:
    """For each date quoted in the parent words the document of the folder that starts on it; of several the one whose title is most like
    the words, if that is above nothing and above the next; else the date is ambiguous and links nothing.

    Titles are compared once for each folder, date and words, so copies of a paper do not multiply."""
    c = table(spark, d, "cards").where("pile_folder is not null").withColumn("start", D.whole_date(F.col("q4_start_date")))
    child = c.where("doc_id is not null").select("card_no", "doc_id", "pile_folder", F.col("q6_attaches_to").alias("words"), F.posexplode(D.dates_in(F.col("q6_attaches_to"))).alias("pos", "start"))
    docs = c.where("start is not null and doc_id is not null").groupBy("pile_folder", "start", "doc_id").agg(F.min_by(F.struct("q1_title"), "card_no")["q1_title"].alias("title"))
    titles = docs.groupBy("pile_folder", "start", F.coalesce("title", F.lit("")).alias("title")).agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other"), F.count("*").alias("n"))
    met = child.join(titles, ["pile_folder", "start"]).where("n > 1 or one <> doc_id")
    # the child itself is no candidate: beside one twin of its own title the twin is left, beside more the title is shared
    twin = F.when(F.col("one") == F.col("doc_id"), F.col("other")).otherwise(F.col("one"))
    own = (F.col("one") == F.col("doc_id")) | (F.col("other") == F.col("doc_id"))
    left = F.when(own, F.col("n") - 1).otherwise(F.col("n"))
    score = T.title_similarity(F.col("title"), F.col("words"))
    scored = met.select("card_no", "pos", score.alias("score"), left.alias("left"), twin.alias("doc"))
    g = scored.groupBy("card_no", "pos").agg(F.sum("left").alias("n"), F.max("score").alias("top"), F.max_by("doc", "score").alias("best"))
    ties = scored.join(g.select("card_no", "pos", "top"), ["card_no", "pos"]).where("score = top").groupBy("card_no", "pos").agg(F.sum("left").alias("ties"))
    g = g.join(ties, ["card_no", "pos"])
    sure = (F.col("n") == 1) | ((F.col("top") > 0) & (F.col("ties") == 1))
    found = g.where(sure).groupBy("card_no").agg(F.min_by(F.struct(F.col("best").alias("parent_doc"), F.when(F.col("n") == 1, "parent date").otherwise("parent date and title").alias("how")), "pos").alias("x"))
    return found.select("card_no", "x.parent_doc", "x.how")


def card_rules(spark: SparkSession, d: str) -> DataFrame:
    """Q02: one row for each rule across answers that a card breaks."""
    c = table(spark, d, "cards")
    start, end = D.whole_date(F.col("q4_start_date")), D.leading_date(F.regexp_extract(F.lower(F.trim("q4_end")), r"^fixed\s*:?\s*(.*)$", 1))
    gone = D.leading_date(F.regexp_extract(F.lower(F.trim("q4_ended_sign")), r"^expired\s+(.*)$", 1))
    layered, detail = F.lower(F.trim("q5_parts")), ~T.is_empty_answer(F.col("q5_parts_detail"))
    copy = ~T.is_empty_answer(F.col("q9_copy_or_draft_of"))
    broken = {
        "end before start": end < start, "expired on another day": gone != end, "parts without detail": (layered == "yes") & ~detail, "detail without parts": (layered == "no") & detail,
        "precedence without parts": (layered == "no") & ~T.is_empty_answer(F.col("q5_precedence")), "copy of itself": F.array_contains(doc_numbers(F.col("q9_copy_or_draft_of")), F.col("doc_id")),
        "best copy of nothing": (F.lower(F.trim("q9_better_copy")) == "this one") & ~copy, "attached to what it replaces": F.arrays_overlap(doc_numbers(F.col("q6_attaches_to")), doc_numbers(F.col("q6_replaces"))),
    }
    return c.select("card_no", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(rule)) for rule, b in broken.items()]))).alias("rule"))


def stages_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The stages of the ledger, known ones first and in their order, others as they first appear."""
    g = table(spark, d, "cost_ledger").where("trim(stage) <> ''").groupBy("stage").agg(F.min("ledger_no").alias("first_no"), F.count("*").alias("n_rows"))
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.lower(F.trim("stage")))
    known = F.when(place > 0, place).otherwise(F.lit(len(STAGES) + 1)).cast("int")
    return g.select("stage", known.alias("place"), "first_no", "n_rows").orderBy("place", "first_no")


def signers(spark: SparkSession, d: str) -> DataFrame:
    """Of each folder the companies that signed, as first printed, with how many papers they signed."""
    c = table(spark, d, "cards").where("pile_folder is not null and lower(trim(q3_signed)) in ('both', 'them only')")
    e = c.where(~T.is_empty_answer(F.col("q2_their_signing_entities"))).select("pile_folder", "doc_id", "card_no", F.posexplode(F.split("q2_their_signing_entities", r" \| ")).alias("i", "e"))
    e = e.select("pile_folder", "doc_id", "card_no", "i", T.strip_role(F.col("e")).alias("name")).withColumn("key", T.norm_name(F.col("name")))
    return e.where("key <> ''").groupBy("pile_folder", "key").agg(F.min_by("name", F.struct("card_no", "i")).alias("name"), F.countDistinct("doc_id").alias("n_docs")).select("pile_folder", "name", "n_docs")


QUERIES = {f.__name__: f for f in (export_routing, settled_placements, corpus_joined, inherited_status, family_conflicts, parents_by_dated_title, card_rules, stages_in_order, signers)}

_PLACED = "placed as (select doc_id, arg_max(folder, (folder, reason)) as folder, arg_max(reason, (folder, reason)) as reason, count(*) as n from (select doc_id, coalesce(value, '') as folder, coalesce(reason, '') as reason from corrections where field = 'folder' and doc_id is not null) group by doc_id)"
_ROUTED = f"""{_RAW_SQL},
loaded as (select line_no, f[1] as doc_id, {", ".join(f"f[{i + 1}] as {x}" for i, x in enumerate(S.RAW_FIELDS) if x != "doc_id")} from checked where shaped and kind_ok and signed_ok),
listed as (select r.line_no, coalesce(l.doc_id, '') as key, {", ".join(f"coalesce(l.{a}, '') as {a}" for a in ANSWERS)} from cards_raw r left join loaded l using (line_no)),
known as (select listed.*, row_number() over w as k, {", ".join(f"first_value({a}) over w as first_{a}" for a in ANSWERS)} from listed where key in (select doc_id from inventory) window w as (partition by key order by line_no)),
routed as (select line_no, key as doc_id, case when k = 1 then 'kept' when {" and ".join(f"{a} = first_{a}" for a in ANSWERS)} then 'repeat' else 'conflict' end as route,
  array_to_string(list_filter([{", ".join(f"case when {a} <> first_{a} then '{a}' end" for a in ANSWERS)}], lambda x: x is not null), ', ') as differing from known
  union all select line_no, null, case when key = '' then 'ignored' else 'unknown' end, '' from listed where key not in (select doc_id from inventory where doc_id is not null))"""
_PARENT = f"coalesce({_DOC.format('q6_attaches_to')}, {_DOC.format('q6_replaces')})"
_LINKS = f"links as (select doc_id, min(p) as parent from (select doc_id, {_PARENT} as p from cards) where doc_id is not null and p is not null group by doc_id)"
_FIX_END = _q_date("regexp_extract(lower(trim(q4_end)), '^fixed\\s*:?\\s*(.*)$', 1)", "(?:$|\\D)")
_GONE = _q_date("regexp_extract(lower(trim(q4_ended_sign)), '^expired\\s+(.*)$', 1)", "(?:$|\\D)")
_DOCS = "list_transform(regexp_extract_all({0}, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1), lambda n: case when length(n) < 8 then lpad(n, 8, '0') else n end)"
_DASHED = lambda x, none: f"case when coalesce(readable = 'no', false) then 'not readable by the kit' else coalesce(nullif(trim({x}), ''), '{none}') end"


def _rule(name: str, test: str) -> str:
    return f"select card_no, '{name}' as rule from c where {test}"


SQL = {
    "export_routing": f"with {_ROUTED} select line_no, doc_id, route, differing from routed",
    "settled_placements": f"""with {_PLACED} select i.doc_id, case when folder in ({_lit(FOLDERS)[1:-1]}) and reason <> '' then folder else 'unsure' end as folder,
  case when folder is null then 'no placement' when folder not in ({_lit(FOLDERS)[1:-1]}) then 'unknown folder' when reason = '' then 'no reason' when n > 1 then 'one row of several' else '' end as why
from inventory i left join placed p on p.doc_id = i.doc_id where i.readable = 'yes'""",
    "corpus_joined": f"""with {_MATCH}, {_ROUTED}, {_PLACED},
a as (select card_no, min(account_number) as account_number from matched where account_number is not null group by card_no),
g as (select account_number, stage || '/' || role as at_role, coalesce(lower(trim(outcome)), '') <> 'ok' as failed, count(*) as n from (select nullif(trim(target), '') as target, stage, role, outcome from cost_ledger) l join erp on l.target = erp.account group by all),
k as (select account_number, string_agg(s, ' | ' order by s) as source_checks from (select account_number, at_role || case when failed then ': failed ' else ': ok ' end || n as s from g) group by account_number),
v as (select r.doc_id, l.q1_title as review_title, l.q4_status as review_status from routed r join loaded l using (line_no) where route = 'kept'),
j as (select i.doc_id, i.readable, c.card_no, a.account_number, c.q1_title, c.q1_kind, p.folder, review_title, review_status, source_checks, t.kind as form_kind from inventory i left join cards c on c.doc_id = i.doc_id left join a on a.card_no = c.card_no
  left join placed p on p.doc_id = i.doc_id left join v on v.doc_id = i.doc_id left join k on k.account_number = a.account_number left join documents t on lpad(cast(t.doc_id as varchar), 8, '0') = i.doc_id)
select doc_id, card_no, account_number, {_DASHED('q1_title', 'no card')} as title, {_DASHED('q1_kind', 'no card')} as kind, {_DASHED('folder', 'not judged')} as folder, {_DASHED('review_title', '')} as review_title,
  {_DASHED('review_status', '')} as review_status, {_DASHED('source_checks', 'none')} as source_checks, {_DASHED('form_kind', 'not found')} as form_kind,
  case when readable = 'no' then 'unreadable' when review_title is not null then case when folder is not null then 'judged from the export' else 'export; awaiting judgment' end
       when card_no is not null then case when folder is not null then 'judged' else 'read; awaiting judgment' end else 'filing only' end as analysis_stage from j""",
    "inherited_status": f"""with recursive {_LINKS}, f as (select doc_id, arg_min(struct_pack(k := lower(trim(q1_kind)), s := lower(trim(q4_status))), card_no) as x from cards where doc_id is not null group by doc_id),
o as (select f.doc_id, parent, case when coalesce(x.k in ({_lit(CHILD_KINDS)[1:-1]}), false) then null else coalesce(x.s, 'unsure') end as state from f left join links using (doc_id)),
up as (select doc_id, parent as at_doc, 1 as n from o where state is null and parent is not null
  union all select up.doc_id, o.parent, n + 1 from up join o on o.doc_id = up.at_doc where o.state is null and o.parent is not null and n < 200),
e as (select up.doc_id, o.state, o.doc_id as source from up join o on o.doc_id = up.at_doc where o.state is not null)
select o.doc_id, coalesce(o.state, e.state, 'unsure') as state, case when o.state is not null then o.doc_id else e.source end as source from o left join e using (doc_id)""",
    "family_conflicts": f"""with recursive {_LINKS}, down as (select doc_id, parent as root from links where parent not in (select doc_id from links) union all select l.doc_id, d.root from links l join down d on l.parent = d.doc_id),
t as (select root, count(*) + 1 as n_docs from down group by root), s as (select doc_id, count(distinct lower(trim(q1_kind))) as n, min(lower(trim(q1_kind))) as f from cards where lower(trim(q1_kind)) <> '' group by doc_id)
select root as root_doc_id, n_docs, coalesce(n, 0) as n_families, case when n = 1 then f when n > 1 then 'conflict' else 'not found' end as family from t left join s on s.doc_id = t.root""",
    "parents_by_dated_title": f"""with c as (select card_no, doc_id, pile_folder, q1_title, q6_attaches_to as words, {_START} as s,
  list_filter(list_transform(regexp_extract_all(lower(coalesce(q6_attaches_to, '')), '({D.ANYWHERE})', 1), lambda x: {_q_date('x', '(?:$|\\D)')}), lambda x: x is not null) as dates from cards where pile_folder is not null and doc_id is not null),
b as (select pile_folder, s, doc_id as parent, first_title.t as title from (select pile_folder, s, doc_id, arg_min(struct_pack(t := q1_title), card_no) as first_title from c where s is not null group by all)),
q as (select card_no, doc_id, pile_folder, words, unnest(dates) as s, unnest(range(0, len(dates))) as pos from c),
m as (select card_no, pos, parent, {q_titles('words')} as w, {q_titles('title')} as t from q join b using (pile_folder, s) where parent <> doc_id),
z as (select card_no, pos, parent, case when len(w) = 0 or len(t) = 0 then 0 else len(list_intersect(w, t)) / len(list_distinct(list_concat(w, t))) end as score from m),
r as (select *, count(*) over (partition by card_no, pos) as n, max(score) over (partition by card_no, pos) as top from z),
u as (select card_no, pos, min(parent) filter (score = top) as parent, any_value(n) as n, any_value(top) as top, count(*) filter (score = top) as ties from r group by card_no, pos)
select card_no, arg_min(parent, pos) as parent_doc, arg_min(case when n = 1 then 'parent date' else 'parent date and title' end, pos) as how from u where n = 1 or (top > 0 and ties = 1) group by card_no""",
    "card_rules": f"with c as (select *, {_START} as s, {_FIX_END} as e, {_GONE} as g, lower(trim(q5_parts)) as l from cards) "
    + " union all ".join((
        _rule("end before start", "e < s"), _rule("expired on another day", "g <> e"), _rule("parts without detail", f"l = 'yes' and {q_norm('q5_parts_detail')} in ({_EMPTY})"),
        _rule("detail without parts", f"l = 'no' and {q_norm('q5_parts_detail')} not in ({_EMPTY})"), _rule("precedence without parts", f"l = 'no' and {q_norm('q5_precedence')} not in ({_EMPTY})"),
        _rule("copy of itself", f"list_contains({_DOCS.format('q9_copy_or_draft_of')}, doc_id)"), _rule("best copy of nothing", f"lower(trim(q9_better_copy)) = 'this one' and {q_norm('q9_copy_or_draft_of')} in ({_EMPTY})"),
        _rule("attached to what it replaces", f"list_has_any({_DOCS.format('q6_attaches_to')}, {_DOCS.format('q6_replaces')})"),
    )),
    "stages_in_order": "select stage, coalesce(nullif(list_position(" + _lit(STAGES) + f", lower(trim(stage))), 0), {len(STAGES) + 1})::integer as place, min(ledger_no) as first_no, count(*) as n_rows from cost_ledger where trim(stage) <> '' group by stage",
    "signers": f"""with e as (select pile_folder, doc_id, card_no, unnest(string_split(q2_their_signing_entities, ' | ')) as e, unnest(range(0, len(string_split(q2_their_signing_entities, ' | ')))) as i from cards
  where pile_folder is not null and lower(trim(q3_signed)) in ('both', 'them only') and {q_norm('q2_their_signing_entities')} not in ({_EMPTY})),
n as (select *, trim(regexp_replace(trim(e), '\\s*\\([^()]*\\)\\s*$', '')) as name from e)
select pile_folder, arg_min(name, (card_no, i)) as name, count(distinct doc_id) as n_docs from n where {q_norm('name')} <> '' group by pile_folder, {q_norm('name')}""",
}
