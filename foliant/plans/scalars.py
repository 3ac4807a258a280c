"""Scalar functions over the card tables: names, titles, references, quotes, dates, slugs and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import dates as D
from foliant.functions import text as T
from foliant.session import table

AS_AT = "2024-06-30"


def joined(a: Column) -> Column:
    return F.array_join(a, " ")


def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("alias")
    return table(spark, d, "aliases").where(a.isNotNull()).select(
        "alias_id", T.norm_name(a).alias("norm"), T.group_key(a).alias("group_key"), T.core_name(a).alias("core"), joined(F.sort_array(T.distinctive_tokens(a))).alias("tokens")
    )


def ref_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cards")
    return c.select("card_no", T.ref_key(F.col("q1_title")).alias("ref_key"), T.portable(F.concat(F.lit("\\"), F.col("pile_folder"))).alias("folder"), T.strip_role(F.col("q9_copy_or_draft_of")).alias("copy_of"))


def title_agreement(spark: SparkSession, d: str) -> DataFrame:
    c, i = table(spark, d, "cards").select("card_no", "doc_id", "q1_title"), table(spark, d, "inventory").select("doc_id", "title_guess")
    return c.join(i, "doc_id").select("card_no", F.floor(T.title_similarity(F.col("q1_title"), F.col("title_guess")) * 100 + 0.5).cast("int").alias("percent"))


def parsed_entities(spark: SparkSession, d: str) -> DataFrame:
    e = F.explode(T.entity_lines(F.regexp_replace(F.col("q2_their_signing_entities"), r" \| ", "\n")))
    return table(spark, d, "cards").select("card_no", e.alias("e")).select("card_no", "e.name", "e.number")


def kind_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("card_no", T.kind_slug(F.col("q1_kind")).alias("slug"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cards")
    return c.select("card_no", T.name_slug(F.col("q1_title")).alias("slug"), T.safe_name(F.col("q5_parts_detail")).alias("safe"), T.truncated(F.col("q10_oddities"), 40).alias("short"), T.md_cell(F.col("q2_their_group_companies")).alias("cell"))


def filed_names(spark: SparkSession, d: str) -> DataFrame:
    """Number, kind, party, date and status of each card's document, fitted to the cap of a file name."""
    c = table(spark, d, "cards").select("card_no", "doc_id", "q1_kind", "q2_our_entity", "q4_start_date", "q3_signed", "q9_copy_or_draft_of")
    i = table(spark, d, "inventory").select("doc_id", "ext")
    date = F.coalesce(D.whole_date(F.col("q4_start_date")).cast("string"), F.lit(""))
    draft = (F.lower(F.trim("q3_signed")) == "nobody") & F.lower("q9_copy_or_draft_of").contains("draft")
    status = F.when(draft, "draft").otherwise("")
    return c.join(i, "doc_id").select("card_no", T.filed_name(F.col("doc_id"), F.col("ext"), F.col("q1_kind"), F.col("q2_our_entity"), date, status).alias("filed_as"))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.first_line(t).alias("first_line"), T.word_count(t).alias("n_words"))


def cited_units(spark: SparkSession, d: str) -> DataFrame:
    """pages, paragraphs and clauses that the parts and every evidence column of a card cite; a range that is none is ``invalid``."""
    c = table(spark, d, "cards")
    fields = ["q5_parts_detail", *[x for x in c.columns if x.startswith("q") and x.endswith("_evidence")]]
    cells = c.select("card_no", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("c")).select("card_no", "c.field", "c.v").where("v is not null")
    said = lambda x: F.coalesce(F.array_join(x, " "), F.lit("invalid"))
    return cells.select("card_no", "field", said(T.cited_pages(F.col("v"))).alias("pages"), said(T.cited_paragraphs(F.col("v"))).alias("paragraphs"), joined(T.cited_clauses(F.col("v"))).alias("clauses"))


def tracked_changes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.contains("{+") | t.contains("{-")).select("doc_id", F.md5(T.plain_tracked(T.merge_tracked(t))).alias("plain_md5"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aliases").select("alias_id", T.stable_id("node", F.col("node_type"), F.col("alias")).alias("stable_id"))


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    found = D.dates_in(F.col("q4_evidence"))
    return table(spark, d, "cards").select("card_no", joined(F.transform(found, lambda x: x.cast("string"))).alias("dates"), F.size(found).alias("n_dates"))


def date_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cards").select("card_no", D.whole_date(F.col("q4_start_date")).cast("string").alias("start_date"))


def term_states(spark: SparkSession, d: str) -> DataFrame:
    end = D.leading_date(F.regexp_extract(F.lower(F.col("q4_end")), r"^fixed\s*:?\s*(.*)$", 1))
    return table(spark, d, "cards").select("card_no", D.term_state(D.whole_date(F.col("q4_start_date")), end, AS_AT).alias("state"))


def clocks(spark: SparkSession, d: str) -> DataFrame:
    n = T.tolerant_int(F.col("duration_ms"))
    return table(spark, d, "cost_ledger").select("ledger_no", T.tolerant_int(F.col("tokens")).alias("tokens"), T.clock(n).alias("clock"))


STATUS = ("live", "dead", "unsure")
COUNTRIES = ("France", "Germany", "Ireland", "Italy", "Netherlands", "Poland", "Spain", "United Kingdom")


def closed_answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cards")
    return c.select("card_no", F.array_join(T.closed_labels(F.col("q4_status"), STATUS), "; ").alias("status"), F.array_join(T.closed_labels(F.col("q8_countries"), COUNTRIES, multi=True), "; ").alias("countries"))


def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """N05, as the number of different contents and of rows: hash texts are engine-specific."""
    c = table(spark, d, "corrections")
    return c.select(T.row_hash(*c.columns).alias("h")).agg(F.count("*").alias("n_rows"), F.countDistinct("h").alias("n_contents"))


QUERIES = {
    f.__name__: f
    for f in (
        normalized_names, ref_keys, title_agreement, parsed_entities, kind_slugs, safe_names, filed_names, first_lines, cited_units,
        tracked_changes, stable_ids, parsed_dates, date_slugs, term_states, clocks, closed_answers, row_hashes,
    )
}

# ---------------------------------------------------------------- the same in DuckDB
_Q = "'"


def _lit(values: object) -> str:
    return "[" + ", ".join(_Q + str(v).replace(_Q, _Q * 2) + _Q for v in values) + "]"


def q_norm(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"


_EDGE = "[.,;:!?''\"“”‘’()\\[\\]]+"


def q_group(x: str) -> str:
    words = f"map({_lit(T.COMPANY_WORDS)}, {_lit(T.COMPANY_WORDS.values())})"
    bare = f"list_transform(string_split(regexp_replace({q_norm(x)}, '^the\\s+', ''), ' '), lambda t: regexp_replace(t, '^{_EDGE}|{_EDGE}$', '', 'g'))"
    return f"array_to_string(list_filter(list_transform({bare}, lambda t: coalesce({words}[t], t)), lambda t: t <> ''), ' ')"


def q_blank(x: str) -> str:
    return f"{q_norm(x)} in ({_lit(T.BLANKS)[1:-1]})"


_NUMBER = T.COMPANY_NUMBER.replace("'", "''")
_BRACKETS = T.ROLE_BRACKETS.replace("'", "''")


def q_entity(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(coalesce({x}, ''), '{_NUMBER}', '', 'g'), '{_BRACKETS}', ' ', 'g')"
    return f"case when {q_blank(x)} or {q_norm(x)} = 'not found' then '' else regexp_replace(trim(regexp_replace({bare}, '\\s+', ' ', 'g')), '^[ ,;.]+|[ ,;.]+$', '', 'g') end"


def q_core(x: str) -> str:
    forms = "|".join(sorted(T.LEGAL_FORMS, key=len, reverse=True))
    return f"trim(regexp_replace({q_group(f'({q_entity(x)})')}, '(?:(?:^|\\s)(?:{forms}))+$', ''))"


def q_distinctive(x: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+')), lambda t: length(t) >= 4 and not list_contains({_lit(T.COMMON_WORDS)}, t))"


def q_titles(x: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+')), lambda t: length(t) > 2)"


def q_similarity(x: str, y: str) -> str:
    a, b = q_titles(x), q_titles(y)
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / cast(len(list_distinct(list_concat({a}, {b}))) as double) end"


def q_ascii(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in T.TWO_LETTERS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace(translate({out}, '{T.ACCENTED}', '{T.PLAIN}'), '[^\\x00-\\x7f]', '', 'g')"


def q_slug(x: str) -> str:
    out = f"regexp_replace(regexp_replace(trim({q_ascii(x)}), '\\s+', '-', 'g'), '[^A-Za-z0-9.\\-]', '', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '-{{2,}}', '-', 'g'), '\\.{{2,}}', '.', 'g'), '^[\\-. ]+|[\\-. ]+$', '', 'g')"


def q_kind(x: str) -> str:
    t = f"lower(trim({q_ascii(x)}))"
    whens = " ".join(f"when regexp_matches({t}, '{p}') then '{s}'" for p, s in T.KIND_SLUGS)
    words = f"lower({q_slug(f'''array_to_string(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')[1:3], ' ')''')})"
    rest = f"regexp_replace(left({words}, 24), '[\\-.]+$', '')"
    return f"case when {q_norm(t)} in ({_lit(T.EMPTY_ANSWERS)[1:-1]}) or {t} in ('not assessed', 'unknown', 'unclear', 'can''t tell', 'cant tell') then '' {whens} when {rest} = '' then 'other' else {rest} end"


def _q_date(x: str, tail: str) -> str:
    from foliant.plans.pile import _sql_date

    return _sql_date(f"lower(trim({x}))", tail)




def q_cited(kind: str, x: str) -> str:
    """The numbers cited, ranges expanded, first mentions only; null if a range is none."""
    ref = T.PAGE_REF if kind == "pages" else T.PARAGRAPH_REF
    found = f"regexp_extract_all(coalesce({x}, ''), '(?i){ref}', 0)"
    if kind == "pages":
        named = f"list_filter({found}, lambda m: not regexp_matches(m, '^P[0-9]'))"
        found = f"case when regexp_matches(trim({x}), '^[0-9]+$') then [trim({x})] when len({named}) > 0 then {named} else {found} end"
    ends = f"list_transform({found}, lambda m: list_transform(regexp_extract_all(m, '[0-9]+'), lambda n: cast(n as bigint)))"
    numbers = f"flatten(list_transform({ends}, lambda e: range(e[1], e[-1] + 1)))"
    ok = f"len(list_filter({ends}, lambda e: e[1] < 1 or e[-1] < e[1] or e[-1] - e[1] > {T.LONGEST_RANGE})) = 0"
    return f"case when {ok} then list_filter({numbers}, lambda n, i: list_position({numbers}, n) = i) end"


_WORDS = "len(list_filter(regexp_split_to_array(trim(coalesce({0}, '')), '\\s+'), lambda w: w <> ''))"
_ANY = D.ANYWHERE
_QUOTES = f"""list_filter(list_transform(flatten(list_transform(string_split(coalesce(q6_evidence, ''), ' | '), lambda s:
  case when {q_norm("s")} in ({_lit(T.EMPTY_ANSWERS)[1:-1]}) then [] when len(regexp_extract_all(s, '["“]([^"”]+)["”]', 1)) > 0 then regexp_extract_all(s, '["“]([^"”]+)["”]', 1)
       else [regexp_replace(trim(s), '^[^:]{{1,40}}:\\s*', '')] end)), lambda q: trim(q)), lambda q: q <> '')"""


def q_int(x: str) -> str:
    return f"case when try_cast(regexp_replace(trim({x}), '[,_]', '', 'g') as double) >= 0 then cast(floor(try_cast(regexp_replace(trim({x}), '[,_]', '', 'g') as double)) as bigint) end"


def q_closed(x: str, labels: tuple[str, ...], multi: bool) -> str:
    t = f"trim(string_split(coalesce({x}, ''), '|')[1])"
    by = f"map({_lit(v.lower() for v in labels)}, {_lit(labels)})"
    whole = f"list_filter([{by}[{q_norm(t)}]], lambda v: v is not null)"
    parts = f"list_filter(list_transform(regexp_split_to_array({t}, '\\s*[,;/]\\s*|\\n'), lambda p: {by}[{q_norm('p')}]), lambda v: v is not null)" if multi else "[]"
    starts = "coalesce(" + ", ".join(f"case when starts_with({q_norm(t)}, '{v.lower()}') then '{v}' end" for v in sorted(labels, key=lambda v: (-len(v), v))) + ", '')"
    found = f"list_concat({whole}, list_filter({parts}, lambda v: not list_contains({whole}, v)))"
    return f"case when {q_blank(x)} then '' when len({found}) > 0 then array_to_string({found}, '; ') else {starts} end"


SQL = {
    "normalized_names": f"select alias_id, {q_norm('alias')} as norm, {q_group('alias')} as group_key, {q_core('alias')} as core, array_to_string(list_sort({q_distinctive('alias')}), ' ') as tokens from aliases where alias is not null",
    "ref_keys": f"""select card_no, case when {q_blank('q1_title')} then '' else regexp_replace(lower(q1_title), '[^a-z0-9]+', '', 'g') end as ref_key,
  lower('/' || pile_folder) as folder, trim(regexp_replace(trim(q9_copy_or_draft_of), '\\s*\\([^()]*\\)\\s*$', '')) as copy_of from cards""",
    "title_agreement": f"select card_no, cast(floor({q_similarity('q1_title', 'title_guess')} * 100 + 0.5) as integer) as percent from cards join inventory using (doc_id)",
    "parsed_entities": f"""select card_no, {q_entity('l')} as name, upper(regexp_extract(l, '{_NUMBER}', 1)) as number
from (select card_no, unnest(regexp_split_to_array(regexp_replace(replace(q2_their_signing_entities, ' | ', chr(10)), '\\s{{2,}}([A-Z])', e'\\n\\\\1', 'g'), '\\n|;')) as l from cards)
where {q_entity('l')} <> '' and lower({q_entity('l')}) <> 'none'""",
    "kind_slugs": f"select card_no, {q_kind('q1_kind')} as slug from cards",
    "safe_names": f"""select card_no, {q_slug('q1_title')} as slug, regexp_replace(regexp_replace(trim(q5_parts_detail), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[. ]+$', '') as safe,
  case when length(trim(coalesce(q10_oddities, ''))) <= 40 then trim(coalesce(q10_oddities, '')) else rtrim(left(trim(q10_oddities), 39)) || '…' end as short,
  replace(regexp_replace(coalesce(q2_their_group_companies, ''), '\\s*\\n\\s*', ' ', 'g'), '|', '\\|') as cell from cards""",
    "filed_names": f"""with n as (select card_no, doc_id, ext, {q_kind('q1_kind')} as k, {q_slug('q2_our_entity')} as party, coalesce(cast({_q_date('q4_start_date', '\\s*$')} as varchar), '') as day,
  coalesce(lower(trim(q3_signed)) = 'nobody' and contains(lower(q9_copy_or_draft_of), 'draft'), false) as draft from cards join inventory using (doc_id))
select card_no, array_to_string(list_filter([doc_id, case when draft and k in ('master-agreement', 'draft-master') then 'draft-master' else k end, party, day,
  case when draft and k not in ('master-agreement', 'draft-master') then 'draft' else '' end], lambda x: x <> ''), ' ') || '.' || ltrim(lower(ext), '.') as filed_as from n""",
    "first_lines": f"select doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]), 80) as first_line, cast({_WORDS.format('text')} as integer) as n_words from documents",
    "cited_units": "select card_no, field, coalesce(array_to_string(p, ' '), 'invalid') as pages, coalesce(array_to_string(g, ' '), 'invalid') as paragraphs, array_to_string(c, ' ') as clauses from ("
    + " union all ".join(f"select card_no, '{f}' as field, {q_cited('pages', f)} as p, {q_cited('paragraphs', f)} as g, regexp_extract_all({f}, '(?i){T.CLAUSE_REF}', 1) as c from cards where {f} is not null"
                         for f in "q5_parts_detail q2_evidence q3_evidence q4_evidence q6_evidence q7_evidence".split()) + ")",
    "tracked_changes": "select doc_id, md5(regexp_replace(replace(replace(text, '+}{+', ''), '-}{-', ''), '\\{[+\\-]|[+\\-]\\}', '', 'g')) as plain_md5 from documents where contains(text, '{+') or contains(text, '{-')",
    "stable_ids": f"""select alias_id, 'node-' || left(sha256('["' || replace(replace({q_norm('node_type')}, '\\', '\\\\'), '"', '\\"') || '", "' || replace(replace({q_norm('alias')}, '\\', '\\\\'), '"', '\\"') || '"]'), 20) as stable_id from aliases""",
    "parsed_dates": f"""with f as (select card_no, list_filter(list_transform(regexp_extract_all(lower(coalesce(q4_evidence, '')), '({_ANY})', 1), lambda x: {_q_date('x', '(?:$|\\D)')}), lambda x: x is not null) as d from cards)
select card_no, array_to_string(list_transform(d, lambda x: strftime(x, '%Y-%m-%d')), ' ') as dates, cast(len(d) as integer) as n_dates from f""",
    "date_slugs": f"select card_no, cast({_q_date('q4_start_date', '\\s*$')} as varchar) as start_date from cards",
    "term_states": f"""with t as (select card_no, {_q_date('q4_start_date', '\\s*$')} as s, {_q_date("regexp_extract(lower(q4_end), '^fixed\\s*:?\\s*(.*)$', 1)", '(?:$|\\D)')} as e from cards)
select card_no, case when e < date '{AS_AT}' then 'ended' when s > date '{AS_AT}' then 'future' when s is not null or e is not null then 'live' else 'unknown' end as state from t""",
    "clocks": f"""with t as (select ledger_no, {q_int('tokens')} as tokens, {q_int('duration_ms')} as n from cost_ledger), u as (select *, cast(floor(n / 1000.0 + 0.5) as bigint) as s from t)
select ledger_no, tokens, case when n <= 0 then '0s' when n < 60000 then format('{{:.1f}}s', n / 1000.0) when s >= 3600 then format('{{}}h {{:02d}}m', s // 3600, (s // 60) % 60)
  when n is not null then format('{{}}m {{:02d}}s', s // 60, s % 60) end as clock from u""",
    "closed_answers": f"select card_no, {q_closed('q4_status', STATUS, False)} as status, {q_closed('q8_countries', COUNTRIES, True)} as countries from cards",
    "row_hashes": "select count(*) as n_rows, (select count(*) from (select distinct * from corrections)) as n_contents from corrections",
}
