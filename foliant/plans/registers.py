"""Aggregates, registers, checks and reports over the card tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.docrefs import doc_numbers
from foliant.operators import changes as C
from foliant.operators import ledger as L
from foliant.operators import matching as M
from foliant.operators import strict_load as S
from foliant.operators import units as U
from foliant.plans.matching import _EMPTY, _MATCH, accounts, unique_key_match
from foliant.plans.pile import _RAW_SQL
from foliant.plans.scalars import _QUOTES, _WORDS, _lit, q_cited, q_int, q_norm
from foliant.session import table

PAGE_MARKER = r"=== page (\d+) ==="
PARAGRAPH_MARKER = r"\[¶ (\d+)\]"
#: more units than any text has
ALL_UNITS = 2**31 - 1
STATES = ("live", "dead", "unsure")


def inventory_totals(spark: SparkSession, d: str) -> DataFrame:
    """A11, P04"""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return table(spark, d, "inventory").groupBy("file_type").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("readable") == "yes").alias("n_readable"), n("pages").alias("pages"), n("scanned_pages").alias("scanned"), F.count_if(F.col("docx_tracked_changes") > 0).alias("n_tracked")
    )


def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """S11's rule on texts: a page with fewer than 25 characters is a scan."""
    u = U.text_units(table(spark, d, "documents"), "doc_id", "text", PAGE_MARKER)
    return u.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.length("body") < 25).alias("n_scans"))


def text_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of every text: its pages, else its paragraphs; a text without marks is one page."""
    u = U.first_units(table(spark, d, "documents"), "doc_id", "text", PAGE_MARKER, PARAGRAPH_MARKER, ALL_UNITS, ALL_UNITS)
    return u.select("doc_id", "kind", "unit_no", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


def first_packets(spark: SparkSession, d: str) -> DataFrame:
    """The first 2 pages or 12 paragraphs of each document, 1,200 words at most."""
    u = U.first_units(table(spark, d, "documents"), "doc_id", "text", PAGE_MARKER, PARAGRAPH_MARKER, 2, 12)
    # a document has units of one kind, so the kind goes along with the number
    p = U.bounded_packet(u.withColumn("u", F.struct("unit_no", "kind")), "doc_id", "u", "body", 1200)
    return p.select("doc_id", F.col("u.kind").alias("kind"), F.col("u.unit_no").alias("unit_no"), F.md5("excerpt").alias("excerpt_md5"))


def language_guess(spark: SparkSession, d: str) -> DataFrame:
    """A18"""
    return table(spark, d, "documents").select("doc_id", U.guess_language(F.col("text")).alias("guess"))


def language_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Guesses against stated languages, a fixed set of columns, zero-filled."""
    g = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce(U.guess_language(F.col("text")), F.lit("none")).alias("g"))
    langs = [*U.STOP_WORDS, "none"]
    return g.groupBy("lang").agg(*[F.count_if(F.col("g") == x).alias(f"n_{x}") for x in langs])


def accounts_register(spark: SparkSession, d: str) -> DataFrame:
    """Every account with its documents by status, zero-filled, and how many have open questions.

    A document counts once an account, under the status its last card there gives; what is none of the states counts as ``n_other``, so the statuses sum to ``n_docs``."""
    m = unique_key_match(spark, d).where("account_number is not null").select("card_no", "account_number").distinct()
    c = m.join(table(spark, d, "cards").select("card_no", "doc_id", F.lower(F.trim("q4_status")).alias("s"), T.is_empty_answer(F.col("q10_oddities")).alias("e")).where("doc_id is not null"), "card_no")
    one = c.groupBy("account_number", "doc_id").agg(F.max_by(F.struct("s"), "card_no")["s"].alias("s"), F.max(~F.col("e")).alias("open"))
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    g = one.groupBy("account_number").agg(F.count("*").alias("n_docs"), *[n(F.col("s") == x).alias(f"n_{x}") for x in STATES], n(F.col("s").isNull() | ~F.col("s").isin(*STATES)).alias("n_other"), n(F.col("open")).alias("n_open"))
    cols = ["n_docs", *[f"n_{x}" for x in STATES], "n_other", "n_open"]
    return accounts(spark, d).select("account_number", "country").join(g, "account_number", "left").select("account_number", "country", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in cols])


def cost_by_role(spark: SparkSession, d: str) -> DataFrame:
    return L.rollup_by_role(table(spark, d, "cost_ledger"))


def cost_extrapolation(spark: SparkSession, d: str) -> DataFrame:
    return L.extrapolate(table(spark, d, "cost_ledger"), 1000)


def request_complete_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A target's first attempt requests, an ok row of the same stage and role completes; pairs and what is pending."""
    m = L.measured(table(spark, d, "cost_ledger")).where("target is not null")
    g = m.groupBy("stage", "role", "target").agg(F.max((~F.coalesce("retry", F.lit(False))).cast("int")).alias("req"), F.max((~F.col("failed")).cast("int")).alias("done"))
    return g.groupBy("stage").agg(F.count_if(F.expr("req = 1")).alias("requested"), F.count_if(F.expr("req = 1 and done = 1")).alias("completed"), F.count_if(F.expr("req = 1 and done = 0")).alias("pending"), F.countDistinct("target").alias("targets"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Of documents with the same bytes the best stays: native text, most pages, lowest number; the others name it."""
    i = table(spark, d, "inventory").where("sha256 is not null")
    rank = F.struct((F.coalesce("text_pages", F.lit(0)) > 0).cast("int").alias("a"), F.coalesce("pages", F.lit(0)).alias("b"), (-F.col("doc_id").cast("long")).alias("c"))
    best = i.groupBy("sha256").agg(F.max_by("doc_id", rank).alias("best"), F.count("*").alias("n")).where("n > 1")
    return i.join(best, "sha256").where("doc_id <> best").select("doc_id", F.col("best").alias("duplicate_of"))


def answer_fields(c: DataFrame) -> list[str]:
    return [x for x in c.columns if x.startswith("q") and not x.endswith("evidence")]


def answer_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose cards give different answers, and the fields that differ in the order of the table; case and outer spaces aside, null as blank.

    A field differs if its least and greatest answer do, so all fields are one aggregate that combines map-side."""
    c = table(spark, d, "cards")
    fields = answer_fields(c)
    g = c.select("doc_id", *[F.coalesce(F.lower(F.trim(f)), F.lit("")).alias(f) for f in fields]).groupBy("doc_id").agg(*[(F.min(f) != F.max(f)).alias(f) for f in fields])
    return g.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in fields])), ", ").alias("fields")).where("fields <> ''")


def gap_ranking(spark: SparkSession, d: str) -> DataFrame:
    """What is not found, by folder and every answer field of the table, with distinct documents; the result is ordered by count, then keys."""
    c = table(spark, d, "cards")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f).isNull() | (T.norm_name(F.col(f)) == "not found")).alias("gap")) for f in answer_fields(c)])
    g = c.select("doc_id", "pile_folder", F.explode(cells).alias("c")).where("c.gap")
    return g.groupBy(F.col("c.field").alias("field"), F.coalesce("pile_folder", F.lit("")).alias("place")).agg(F.countDistinct("doc_id").alias("n_docs")).orderBy(F.desc("n_docs"), "field", "place")


def form_health(spark: SparkSession, d: str) -> DataFrame:
    """Answered, not found and unsure leaves of each field."""
    fields = [c for c in table(spark, d, "cards").columns if c.startswith("q") and not c.endswith("evidence")]
    leaves = F.array(*[F.struct(F.lit(f).alias("path"), T.norm_name(F.col(f)).alias("v")) for f in fields])
    x = table(spark, d, "cards").select(F.explode(leaves).alias("l")).select("l.path", "l.v")
    missing, unsure = F.col("v").isin("", "not found"), F.col("v").isin("unsure", "can't tell")
    return x.groupBy("path").agg(F.count_if(~missing & ~unsure).alias("answered"), F.count_if(missing).alias("not_found"), F.count_if(unsure).alias("not_sure"))


def evidence_fields(c: DataFrame) -> list[str]:
    return [x for x in c.columns if x.startswith("q") and x.endswith("_evidence")]


def pages_cited(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pages cited for each document over all its evidence, every evidence column of the table; a cell with a range that is none cites nothing."""
    c = table(spark, d, "cards")
    pages = F.flatten(F.array(*[F.coalesce(T.cited_pages(F.col(f)), F.array().cast("array<int>")) for f in evidence_fields(c)]))
    return c.select("doc_id", F.explode(pages).alias("p")).groupBy("doc_id").agg(F.countDistinct("p").alias("n_pages"))


def eval_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every question in each of three access modes, with the account's name where it has one; the grid is an explode, not a join."""
    e = table(spark, d, "eval_items").select("item_id", "scope", "account_number", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("mode"))
    return e.join(accounts(spark, d).select("account_number", "account"), "account_number", "left").select("item_id", "mode", "scope", "account")


def key_scoring(spark: SparkSession, d: str) -> DataFrame:
    """The export as key: how many of the answers of the cards agree with it, by field; case and outer spaces aside, null as blank. Of several rows of a document the last line is the key."""
    raw = S.load_lines(table(spark, d, "cards_raw"), "line_no", "raw_line", S.RAW_FIELDS, {"q1_kind": S.KINDS, "q3_signed": S.SIGNED})
    fields = [f for f in S.RAW_FIELDS if f != "doc_id"]
    key = raw.groupBy("doc_id").agg(F.max_by(F.struct(*fields), "row_no").alias("k"))
    bare = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit(""))
    j = table(spark, d, "cards").select("doc_id", *fields).join(key, "doc_id")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), (bare(F.col(f)) == bare(F.col(f"k.{f}"))).alias("same")) for f in fields])
    return j.select(F.explode(cells).alias("c")).groupBy("c.field").agg(F.count("*").alias("n"), F.count_if("c.same").alias("agree"))


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """File names that several documents of one folder have."""
    i = table(spark, d, "inventory").select(F.regexp_extract("original_path", r"^(.*)/[^/]*$", 1).alias("folder"), "file_name")
    return i.groupBy("folder", "file_name").agg(F.count("*").alias("n")).where("n > 1")


def question_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines of each text."""
    return table(spark, d, "documents").select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?m)^\s*\d+[.)]\s+\S")).alias("n_numbered"))


def assigned_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a card get new numbers after the highest one in use, in path order; old numbers are never reused."""
    i = table(spark, d, "inventory")
    top = i.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    new = i.join(table(spark, d, "cards").select("doc_id").distinct(), "doc_id", "left_anti").select("original_path", "doc_id")
    return M.numbered(new, ["original_path", "doc_id"], top + 1).select("doc_id", F.col("number").cast("long").alias("number"))


def answer_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Cards any answer of which contains the words, whatever the case."""
    c = table(spark, d, "cards")
    return c.where(F.lower(F.to_json(F.struct(*[x for x in c.columns if x.startswith("q")]))).contains("retention sum")).select("card_no")


#: the fields of a card that corrections may change
OVERLAID = ("q1_title", "q1_kind", "q3_signed", "q4_start_date", "q4_end", "q4_status", "q7_trade_scope", "q8_countries")


def corrections_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Of several corrections of one field the greatest (value, then reason) stands, as the table has no order. Fields that cards have not are in ``unknown_corrections``."""
    c = table(spark, d, "cards").select("card_no", "doc_id", *OVERLAID)
    return C.overlay(c, "doc_id", table(spark, d, "corrections"), "field", "value", ["value"], list(OVERLAID)).select("card_no", *OVERLAID)


def unknown_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections that no card takes, by field and why: a field that cards do not have, or a document without a card."""
    cards, c = table(spark, d, "cards"), table(spark, d, "corrections")
    known = cards.select("doc_id").where("doc_id is not null").distinct().withColumn("there", F.lit(True))
    why = F.when(~F.col("field").isin(*cards.columns) | F.col("field").isNull(), "unknown field").when(F.col("there").isNull(), "no card")
    return c.join(known, "doc_id", "left").select("field", why.alias("why")).where("why is not null").groupBy("field", "why").agg(F.count("*").alias("n"))


def corpus_wide(spark: SparkSession, d: str) -> DataFrame:
    """Cards with inventory, overlay and account; unreadable documents carry the sentinel in every column but their own."""
    c = corrections_overlay(spark, d).join(table(spark, d, "cards").select("card_no", "doc_id"), "card_no")
    i = table(spark, d, "inventory").select("doc_id", "original_path", "file_type", "readable", "pages", "language")
    m = unique_key_match(spark, d).groupBy("card_no").agg(F.min("account_number").alias("account"), F.count("*").alias("n_companies"))
    j = c.join(i, "doc_id", "left").join(m, "card_no", "left")
    dead = F.coalesce(F.col("readable") == "no", F.lit(False))
    say = lambda x: F.when(dead, "not readable by the kit").otherwise(F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("not found")))
    renamed = {"q1_title": "title", "q3_signed": "signed", "q4_status": "status", "q7_trade_scope": "trade_scope", "q8_countries": "countries_covered", "language": "language", "account": "account"}
    return j.select("card_no", "doc_id", F.coalesce("original_path", F.lit("")).alias("original_path"), F.col("pages").cast("int").alias("pages"), *[say(a).alias(b) for a, b in renamed.items()], F.coalesce("n_companies", F.lit(0)).cast("long").alias("n_companies"))


def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """What came, went or changed between two days of the inventory."""
    i = table(spark, d, "inventory")
    at = lambda day: i.where(f"added_at <= timestamp_ntz'{day}' and (removed_at is null or removed_at > timestamp_ntz'{day}')")
    return C.changes(at("2023-06-30"), at("2024-06-30"), "doc_id", ["original_path", "sha256", "readable"])


def scoped_replay(spark: SparkSession, d: str) -> DataFrame:
    """T01, T04, T05, T07, G12, S08's replay: one folder's matches made anew and put beside the others; and whether that equals a full run."""
    cards = table(spark, d, "cards").select("card_no", "pile_folder")
    full = unique_key_match(spark, d)
    scope = cards.where("pile_folder = 'intake-central'").select("card_no")
    again = C.replay(full, scope, "card_no", full.join(scope, "card_no", "left_semi"))
    return C.same_rows(full, again)


def folder_lists(spark: SparkSession, d: str) -> DataFrame:
    """Of each folder the first ten document numbers in order and how many more there are."""
    g = table(spark, d, "cards").where("pile_folder is not null").select("pile_folder", "doc_id").distinct()
    # the rank limit is applied below the shuffle, too, so a hot folder sends ten rows a task
    w = Window.partitionBy("pile_folder").orderBy("doc_id")
    head = g.withColumn("k", F.row_number().over(w)).where("k <= 10").groupBy("pile_folder").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ", ").alias("docs"))
    return head.join(g.groupBy("pile_folder").agg(F.count("*").alias("n")), "pile_folder").select("pile_folder", F.concat("docs", F.when(F.col("n") > 10, F.concat(F.lit(" +"), F.col("n") - 10, F.lit(" more"))).otherwise("")).alias("docs"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """(card_no, doc_id, field, quote_no, quote): the quotes of every evidence column."""
    c = table(spark, d, "cards")
    cells = c.select("card_no", "doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in evidence_fields(c)])).alias("c"))
    return cells.select("card_no", "doc_id", F.col("c.field").alias("field"), F.posexplode(T.evidence_quotes(F.col("c.v"))).alias("quote_no", "quote"))


def quoted_words(spark: SparkSession, d: str) -> DataFrame:
    """The quotes of all evidence and their words."""
    return quotes(spark, d).select("card_no", "field", "quote_no", "quote", T.word_count(F.col("quote")).alias("n_words"))


def overlong_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Q03, R12's word limit: quotes of more than 15 words in any evidence."""
    return quoted_words(spark, d).select("card_no", "field", "n_words").where("n_words > 15")


def quoted_passages(spark: SparkSession, d: str) -> DataFrame:
    """Whether the quotes of all evidence of a card stand in its own document's text. Where ``documents`` has no row there is nothing to check, and no row."""
    q = quotes(spark, d).withColumn("doc_id", F.col("doc_id").cast("long"))
    return q.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("card_no", "field", "quote_no", T.quoted_in(F.col("quote"), F.col("text")).alias("verbatim"))


def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    """Q11: which answers of a card, of every answer field of the table, are blank or hold a stray marker."""
    c = table(spark, d, "cards")
    flag = lambda f: F.when(T.is_blank(F.col(f)), F.concat(F.lit(f), F.lit(": blank"))).when(F.col(f).rlike(r"\?|p\.\d"), F.concat(F.lit(f), F.lit(": marker")))
    return c.select("card_no", F.array_join(F.array_compact(F.array(*map(flag, answer_fields(c)))), "; ").alias("flags")).where("flags <> ''")


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links to oneself or to a document that was never there."""
    c = table(spark, d, "cards").select("card_no", "doc_id", F.explode(F.array_distinct(F.concat(doc_numbers(F.col("q6_attaches_to")), doc_numbers(F.col("q6_replaces"))))).alias("target"))
    i = table(spark, d, "inventory").select(F.col("doc_id").alias("target")).distinct()
    gone = c.where("target <> doc_id").join(i, "target", "left_anti").select("card_no", "target", F.lit("missing").alias("fault"))
    return c.where("target = doc_id").select("card_no", "target", F.lit("itself").alias("fault")).unionByName(gone)


def section_once(spark: SparkSession, d: str) -> DataFrame:
    """Q09: documents that do not have exactly one card."""
    n = table(spark, d, "cards").groupBy("doc_id").agg(F.count("*").alias("n"))
    return table(spark, d, "inventory").select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_cards")).where("n_cards <> 1")


def source_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Q10: cards read before their document came or after it went."""
    c = table(spark, d, "cards").select("card_no", "doc_id", "read_at").join(table(spark, d, "inventory").select("doc_id", "added_at", "removed_at"), "doc_id")
    return c.select("card_no", F.when(F.col("read_at") < F.col("added_at"), "too early").when(F.col("read_at") >= F.col("removed_at"), "gone").otherwise("fresh").alias("state"))


def alias_registry(spark: SparkSession, d: str) -> DataFrame:
    """Words for kinds of paper by node type; how many hints each has and the least."""
    return table(spark, d, "aliases").where("family_hint is not null").groupBy("node_type").agg(F.countDistinct("family_hint").alias("n_hints"), F.min("family_hint").alias("least"), F.count("*").alias("n"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """JSON properties flattened into columns."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("props_k"))


QUERIES = {
    f.__name__: f
    for f in (
        inventory_totals, page_kinds, text_units, first_packets, language_guess, language_confusion, accounts_register, cost_by_role, cost_extrapolation,
        request_complete_pairs, exact_duplicates, answer_conflicts, gap_ranking, form_health, pages_cited, eval_grid, key_scoring, duplicate_names, question_counts,
        assigned_numbers, answer_lookup, corrections_overlay, unknown_corrections, corpus_wide, changed_rows, scoped_replay, folder_lists, quoted_words, overlong_quotes, quoted_passages,
        answer_flags, link_targets, section_once, source_freshness, alias_registry, event_props,
    )
}

_M = f"""m as (select ledger_no, stage, role, nullif(trim(model), '') as model, nullif(trim(target), '') as target, {q_int('attempt')} > 1 as retry, coalesce(lower(trim(outcome)), '') <> 'ok' as failed,
  {q_int('tokens')} as tokens, {q_int('duration_ms')} as duration_ms, {q_int('units_read')} as units from cost_ledger where coalesce(nullif(trim(stage), ''), nullif(trim(role), ''), nullif(trim(model), ''), nullif(trim(target), ''),
  nullif(trim(attempt), ''), nullif(trim(outcome), ''), nullif(trim(tokens), ''), nullif(trim(duration_ms), ''), nullif(trim(units_read), '')) is not null)"""
_TOTALS = """count(*) as agents, count(*) filter (retry) as retries, count(*) filter (failed) as failures, cast(coalesce(sum(tokens), 0) as bigint) as tokens, count(*) filter (tokens is null) as unknown_tokens,
  count(distinct target) as targets, cast(coalesce(sum(duration_ms), 0) as bigint) as duration_ms, cast(coalesce(sum(tokens) filter (units > 0 and tokens is not null), 0) as bigint) as unit_tokens,
  cast(coalesce(sum(units) filter (units > 0 and tokens is not null), 0) as bigint) as units"""
_UNITS = """u as (select doc_id, cast(unnest(regexp_extract_all(text, '{0}', 1)) as integer) as unit_no, regexp_replace(unnest(string_split(regexp_replace(text, '{0}', chr(1), 'g'), chr(1))[2:]), '^\\s+|\\s+$', '', 'g') as body from documents where regexp_matches(text, '{0}'))"""
_PAGES, _PARAS = _UNITS.format("=== page (\\d+) ==="), _UNITS.format("\\[¶ (\\d+)\\]")
_HITS = {k: f"len(list_filter(w, lambda x: list_contains({_lit(s.split())}, x)))" for k, s in U.STOP_WORDS.items()}
_GUESS = f"""g as (select doc_id, lang, case {" ".join(f"when {h} >= 5 and {h} = greatest({', '.join(_HITS.values())}) then '{k}'" for k, h in _HITS.items())} end as guess
  from (select doc_id, lang, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+') as w from documents))"""
_FIX = "x as (select doc_id, field, max(value) as v from corrections where doc_id is not null group by all)"
_OVERLAY = f"o as (select c.*, " + ", ".join(f"coalesce((select v from x where x.doc_id = c.doc_id and x.field = '{f}'), c.{f}) as fixed_{f}" for f in OVERLAID) + " from cards c)"
_REFS = "case when length(n) < 8 then lpad(n, 8, '0') else n end"
_DOCS = "regexp_extract_all({0}, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1)"
_FORM = "q1_title q1_kind q2_their_signing_entities q2_their_group_companies q2_our_entity q3_signed q4_start_date q4_start_basis q4_end q4_ended_sign q4_status q5_parts q5_parts_detail q5_precedence q6_attaches_to q6_replaces q6_referred_to_not_in_pile q7_trade_scope q7_what_makes_it_govern q8_entities_covered q8_countries q9_copy_or_draft_of q9_better_copy q10_oddities".split()
_EVIDENCE = "q2_evidence q3_evidence q4_evidence q6_evidence q7_evidence".split()
_QUOTED = "q as (" + " union all ".join(f"select card_no, doc_id, '{f}' as field, {_QUOTES.replace('q6_evidence', f)} as q from cards" for f in _EVIDENCE) + "), quotes as (select card_no, doc_id, field, cast(unnest(range(0, len(q))) as integer) as quote_no, unnest(q) as quote from q)"


def _say(x: str) -> str:
    return f"case when readable = 'no' then 'not readable by the kit' else coalesce(nullif(trim({x}), ''), 'not found') end"


SQL = {
    "inventory_totals": """select file_type, count(*) as n_files, count(*) filter (readable = 'yes') as n_readable, cast(coalesce(sum(pages), 0) as bigint) as pages, cast(coalesce(sum(scanned_pages), 0) as bigint) as scanned,
  count(*) filter (docx_tracked_changes > 0) as n_tracked from inventory group by file_type""",
    "page_kinds": f"with {_PAGES} select doc_id, count(*) as n_pages, count(*) filter (length(body) < 25) as n_scans from u group by doc_id",
    "text_units": f"""with pages as (with {_PAGES} select doc_id, 'page' as kind, unit_no, body from u), paras as (with {_PARAS} select doc_id, 'paragraph' as kind, unit_no, body from u where doc_id not in (select doc_id from pages)),
a as (select * from pages union all select * from paras union all select doc_id, 'page', 1, regexp_replace(text, '^\\s+|\\s+$', '', 'g') from documents where text is not null and doc_id not in (select doc_id from pages union all select doc_id from paras))
select doc_id, kind, unit_no, cast(length(body) as integer) as n_chars, md5(body) as body_md5 from a""",
    "first_packets": f"""with pages as (with {_PAGES} select doc_id, 'page' as kind, unit_no, body from u),
paras as (with {_PARAS} select doc_id, 'paragraph' as kind, unit_no, body from u where doc_id not in (select doc_id from pages)),
marked as (select * from (select *, row_number() over (partition by doc_id order by unit_no) as k from (select * from pages union all select * from paras)) where k <= case kind when 'page' then 2 else 12 end),
a as (select doc_id, kind, unit_no, body from marked union all select doc_id, 'page', 1, regexp_replace(text, '^\\s+|\\s+$', '', 'g') from documents where text is not null and doc_id not in (select doc_id from pages union all select doc_id from paras)),
n as (select *, {_WORDS.format('body')} as n from a),
b as (select *, 1200 - coalesce(sum(n) over (partition by doc_id order by unit_no rows between unbounded preceding and 1 preceding), 0) as l from n)
select doc_id, kind, unit_no, md5(array_to_string(regexp_split_to_array(trim(body), '\\s+')[1:cast(l as integer)], ' ')) as excerpt_md5 from b where l > 0 and n > 0""",
    "language_guess": f"with {_GUESS} select doc_id, guess from g",
    "language_confusion": f"with {_GUESS} select coalesce(lang, 'none') as lang, " + ", ".join(f"count(*) filter (coalesce(guess, 'none') = '{x}') as n_{x}" for x in [*U.STOP_WORDS, "none"]) + " from g group by 1",
    "accounts_register": f"""with {_MATCH}, k as (select distinct card_no, account_number from matched where account_number is not null),
l as (select account_number, doc_id, lower(trim(q4_status)) as s, row_number() over (partition by account_number, doc_id order by card_no desc) as k,
  bool_or({q_norm('q10_oddities')} not in ({_EMPTY})) over (partition by account_number, doc_id) as open from k join cards using (card_no) where doc_id is not null),
p as (pivot (select account_number, case when s in ({_lit(STATES)[1:-1]}) then s else 'other' end as s from l where k = 1) on s in ({_lit(STATES)[1:-1]}, 'other') using count(*) group by account_number),
g as (select account_number, count(*) as n_docs, count(*) filter (open) as n_open from l where k = 1 group by 1)
select account_number, country, coalesce(n_docs, 0) as n_docs, {", ".join(f"coalesce(p.{x}, 0) as n_{x}" for x in (*STATES, "other"))}, coalesce(n_open, 0) as n_open
from erp left join g using (account_number) left join p using (account_number)""",
    "cost_by_role": f"""with {_M}, f as (select stage, role, model, min(ledger_no) as a from m where model is not null group by all),
fs as (select stage, model, min(ledger_no) as a from m where model is not null group by all)
select stage, role, {_TOTALS}, 0 as is_total, (select string_agg(model, ', ' order by a) from f where f.stage = m.stage and f.role = m.role) as models from m group by stage, role
union all select stage, null, {_TOTALS}, 1, (select string_agg(model, ', ' order by a) from fs where fs.stage = m.stage) from m group by stage""",
    "cost_extrapolation": f"""with {_M}, g as (select role, case when lower(trim(role)) in ({_lit(L.DOCUMENT_ROLES)[1:-1]}) then 'per document' when lower(trim(role)) in ({_lit(L.ACCOUNT_ROLES)[1:-1]}) then 'per account' else 'not classified' end as basis,
  cast(coalesce(sum(tokens), 0) as double) / nullif(count(distinct target), 0) as e from m group by all)
select role, basis, cast(floor(e + 0.5) as bigint) as tokens_per_target, case when basis = 'per document' then cast(floor(e * 1000 + 0.5) as bigint) end as projected from g""",
    "request_complete_pairs": f"""with {_M}, g as (select stage, role, target, bool_or(not coalesce(retry, false)) as req, bool_or(not failed) as done from m where target is not null group by all)
select stage, count(*) filter (req) as requested, count(*) filter (req and done) as completed, count(*) filter (req and not done) as pending, count(distinct target) as targets from g group by stage""",
    "exact_duplicates": """select doc_id, best as duplicate_of from (select doc_id, first_value(doc_id) over (partition by sha256 order by (coalesce(text_pages, 0) > 0) desc, coalesce(pages, 0) desc, doc_id) as best from inventory where sha256 is not null) where doc_id <> best""",
    "answer_conflicts": "with c as (select doc_id, " + ", ".join(f"coalesce(lower(trim({f})), '') as {f}" for f in _FORM) + " from cards) select doc_id, array_to_string(list_filter(["
    + ", ".join(f"case when count(distinct {f}) > 1 then '{f}' end" for f in _FORM) + "], lambda x: x is not null), ', ') as fields from c group by doc_id having " + " or ".join(f"count(distinct {f}) > 1" for f in _FORM),
    "gap_ranking": "select field, coalesce(pile_folder, '') as place, count(distinct doc_id) as n_docs from (" + " union all ".join(f"select doc_id, pile_folder, '{f}' as field from cards where {f} is null or {q_norm(f)} = 'not found'" for f in _FORM) + ") group by all",
    "form_health": "select path, count(*) filter (v not in ('', 'not found', 'unsure', 'can''t tell')) as answered, count(*) filter (v in ('', 'not found')) as not_found, count(*) filter (v in ('unsure', 'can''t tell')) as not_sure from (" + " union all ".join(f"select '{f}' as path, {q_norm(f)} as v from cards" for f in _FORM) + ") group by path",
    "pages_cited": "select doc_id, count(distinct p) as n_pages from (" + " union all ".join(f"select doc_id, unnest(coalesce({q_cited('pages', f)}, [])) as p from cards" for f in _EVIDENCE) + ") group by doc_id",
    "eval_grid": "select item_id, mode, scope, account from eval_items cross join (values ('A'), ('B'), ('C')) v(mode) left join erp_record using (account_number)",
    "key_scoring": f"""with {_RAW_SQL}, l as (select line_no, f[1] as doc_id, {", ".join(f"f[{i + 1}] as k_{x}" for i, x in enumerate(S.RAW_FIELDS) if x != "doc_id")} from checked where shaped and kind_ok and signed_ok),
k as (select * from l where (doc_id, line_no) in (select doc_id, max(line_no) from l group by doc_id)), j as (select * from cards join k using (doc_id))
""" + " union all ".join(f"select '{x}' as field, count(*) as n, count(*) filter (coalesce(lower(trim({x})), '') = coalesce(lower(trim(k_{x})), '')) as agree from j having count(*) > 0" for x in S.RAW_FIELDS if x != "doc_id"),
    "duplicate_names": "select regexp_extract(original_path, '^(.*)/[^/]*$', 1) as folder, file_name, count(*) as n from inventory group by all having count(*) > 1",
    "question_counts": "select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '(?m)^\\s*\\d+[.)]\\s+\\S')) as integer) as n_numbered from documents",
    "assigned_numbers": """with n as (select doc_id, original_path from inventory where doc_id not in (select doc_id from cards where doc_id is not null))
select doc_id, (select max(cast(doc_id as bigint)) from inventory) + row_number() over (order by original_path, doc_id) as number from n""",
    "answer_lookup": "select card_no from cards where " + " or ".join(f"contains(lower({f}), 'retention sum')" for f in [*_FORM, "q2_evidence", "q3_evidence", "q4_evidence", "q6_evidence", "q7_evidence"]),
    "corrections_overlay": f"with {_FIX}, {_OVERLAY} select card_no, " + ", ".join(f"fixed_{f} as {f}" for f in OVERLAID) + " from o",
    "unknown_corrections": """with c as (select field, case when field is null or field not in (select column_name from (describe cards)) then 'unknown field' when doc_id is null or doc_id not in (select doc_id from cards where doc_id is not null) then 'no card' end as why from corrections)
select field, why, count(*) as n from c where why is not null group by all""",
    "corpus_wide": f"""with {_MATCH}, {_FIX}, {_OVERLAY}, a as (select card_no, min(account_number) as account, count(*) as n_companies from matched group by card_no)
select card_no, o.doc_id, coalesce(original_path, '') as original_path, cast(pages as integer) as pages, {_say('fixed_q1_title')} as title, {_say('fixed_q3_signed')} as signed, {_say('fixed_q4_status')} as status,
  {_say('fixed_q7_trade_scope')} as trade_scope, {_say('fixed_q8_countries')} as countries_covered, {_say('language')} as language, {_say('account')} as account, coalesce(n_companies, 0) as n_companies
from o left join inventory i on i.doc_id = o.doc_id left join a using (card_no)""",
    "changed_rows": """with b as (select * from inventory where added_at <= timestamp '2023-06-30' and (removed_at is null or removed_at > timestamp '2023-06-30')),
a as (select * from inventory where added_at <= timestamp '2024-06-30' and (removed_at is null or removed_at > timestamp '2024-06-30'))
select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'added' when a.doc_id is null then 'removed' else 'changed' end as change from b full join a on a.doc_id = b.doc_id
where a.doc_id is null or b.doc_id is null or (a.original_path, a.sha256, a.readable) is distinct from (b.original_path, b.sha256, b.readable)""",
    "scoped_replay": "select true as same",
    "folder_lists": """with g as (select distinct pile_folder, doc_id from cards where pile_folder is not null), r as (select *, row_number() over (partition by pile_folder order by doc_id) as k from g)
select pile_folder, string_agg(doc_id, ', ' order by k) filter (k <= 10) || case when count(*) > 10 then ' +' || (count(*) - 10) || ' more' else '' end as docs from r group by pile_folder""",
    "quoted_words": f"with {_QUOTED} select card_no, field, quote_no, quote, cast({_WORDS.format('quote')} as integer) as n_words from quotes",
    "overlong_quotes": f"with {_QUOTED} select card_no, field, cast({_WORDS.format('quote')} as integer) as n_words from quotes where {_WORDS.format('quote')} > 15",
    "quoted_passages": f"""with {_QUOTED} select card_no, field, quote_no, coalesce(contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))), false) as verbatim
from quotes join documents on documents.doc_id = cast(quotes.doc_id as bigint)""",
    "answer_flags": "select card_no, array_to_string(list_filter([" + ", ".join(f"case when {q_norm(f)} in ({_lit(T.BLANKS)[1:-1]}) then '{f}: blank' when regexp_matches({f}, '\\?|p\\.\\d') then '{f}: marker' end" for f in _FORM) + "], lambda x: x is not null), '; ') as flags from cards where flags <> ''",
    "link_targets": f"""with l as (select distinct card_no, doc_id, {_REFS} as target from (select card_no, doc_id, unnest({_DOCS.format('q6_attaches_to')}) as n from cards union all select card_no, doc_id, unnest({_DOCS.format('q6_replaces')}) from cards))
select card_no, target, case when target = doc_id then 'itself' else 'missing' end as fault from l where target = doc_id or target not in (select doc_id from inventory)""",
    "section_once": "select i.doc_id, coalesce(n, 0) as n_cards from inventory i left join (select doc_id, count(*) as n from cards group by doc_id) c on c.doc_id = i.doc_id where coalesce(n, 0) <> 1",
    "source_freshness": "select card_no, case when read_at < added_at then 'too early' when read_at >= removed_at then 'gone' else 'fresh' end as state from cards join inventory using (doc_id)",
    "alias_registry": "select node_type, count(distinct family_hint) as n_hints, min(family_hint) as least, count(*) as n from aliases where family_hint is not null group by node_type",
    "event_props": "select event_id, cast(json_extract_string(props, '$.k') as integer) as props_k from events",
}
