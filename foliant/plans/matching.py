"""Name resolution and linking over the card tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import dates as D
from foliant.functions import text as T
from foliant.functions.docrefs import first_doc_number
from foliant.operators import changes as C
from foliant.operators import matching as M
from foliant.plans.scalars import AS_AT, _lit, _q_date, q_core, q_distinctive, q_group, q_norm, q_similarity, q_titles
from foliant.session import table


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(card_no, entry_no, name): signing entities as printed, without roles."""
    cell = F.col("q2_their_signing_entities")
    e = F.posexplode(F.split(cell, r" \| ")).alias("i", "e")
    return table(spark, d, "cards").where(~T.is_empty_answer(cell)).select("card_no", e).select("card_no", (F.col("i") + 1).cast("int").alias("entry_no"), T.strip_role(F.col("e")).alias("name"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "erp_record").where("account is not null")


def exact_name_match(spark: SparkSession, d: str) -> DataFrame:
    """J06"""
    m = M.match_by_keys(entries(spark, d), accounts(spark, d), "account_number", [("same name", T.norm_name(F.col("name")), T.norm_name(F.col("account")))])
    return m.where("account_number is not null").select("card_no", "entry_no", "account_number")


def _keys() -> list:
    n, a = F.col("name"), F.col("account")
    return [("same name", T.norm_name(n), T.norm_name(a)), ("group key", T.group_key(n), T.group_key(a)), ("core name", T.core_name(n), T.core_name(a))]


def unique_key_match(spark: SparkSession, d: str) -> DataFrame:
    """J07, J08, R02's name steps: exact name, else a group key or core name that only one account has."""
    return M.match_by_keys(entries(spark, d), accounts(spark, d), "account_number", _keys()).select("card_no", "entry_no", "account_number", "basis")


def conflicting_map_rows(spark: SparkSession, d: str) -> DataFrame:
    """Core names that several aliases with different family hints share."""
    return M.conflicting_keys(table(spark, d, "aliases"), T.group_key(F.col("alias")), "family_hint")


def token_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For each alias the five accounts with most telling words in common."""
    al = table(spark, d, "aliases").where(F.col("node_type").isin("legal_entity", "group"))
    pairs = M.shared_tokens(al, "alias_id", T.distinctive_tokens(F.col("alias")), accounts(spark, d), "account_number", T.distinctive_tokens(F.col("account")))
    top = pairs.groupBy("alias_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n_shared")).alias("k"), "account_number"))), 1, 5).alias("t"))
    return top.select("alias_id", F.array_join(F.transform("t", lambda x: x["account_number"]), " ").alias("nearest"))


def prefix_streams(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that begin with another alias and a space."""
    al = table(spark, d, "aliases").where("alias is not null")
    found = M.longest_prefix(al, "alias_id", T.norm_name(F.col("alias")))
    return found.select(F.col("row_id").alias("alias_id"), F.col("prefix_of").alias("stream_of"))


def same_stem_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different accounts that share their first telling word."""
    a = accounts(spark, d).select("account_number", F.get(T.distinctive_tokens(F.col("account")), F.lit(0)).alias("stem")).where("stem is not null")
    b = a.select(F.col("account_number").alias("other"), "stem")
    return a.join(b, "stem").where("account_number < other").select("account_number", "other")


def number_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A document without a matched account takes that of the first matched document with the same bytes."""
    inv = table(spark, d, "inventory").select("doc_id", "sha256")
    got = unique_key_match(spark, d).where("account_number is not null").join(table(spark, d, "cards").select("card_no", "doc_id"), "card_no").groupBy("doc_id").agg(F.min("account_number").alias("account_number"))
    docs = inv.join(got, "doc_id", "left")
    out = M.learned(docs.where("account_number is not null"), "sha256", "account_number", "doc_id", docs.where("account_number is null").select("doc_id", "sha256"), "sha256")
    return out.where("learned_account_number is not null").select("doc_id", F.col("learned_account_number").alias("account_number"))


def priority_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One alias for each name; rows with a note win, then the later row."""
    al = table(spark, d, "aliases").where("alias is not null").withColumn("key", T.norm_name(F.col("alias")))
    return M.first_of(al, ["key"], [F.col("notes").isNotNull().desc(), F.col("alias_id").desc()]).select("key", "alias_id")


def dominant_party(spark: SparkSession, d: str) -> DataFrame:
    """A folder's most frequent own entity; the first seen wins ties. Two aggregates, no window over a folder's rows."""
    c = table(spark, d, "cards").where("pile_folder is not null and q2_our_entity is not null")
    n = c.groupBy("pile_folder", "q2_our_entity").agg(F.count("*").alias("n"), F.min("card_no").alias("first"))
    return n.groupBy("pile_folder").agg(F.max_by("q2_our_entity", F.struct("n", (-F.col("first")).alias("f"))).alias("our_entity"))


def holding_groups(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched names by group key, with the longest and the first spelling, how many cards they have and the first. Their documents are in ``undecided_names``."""
    g = _unmatched(spark, d).groupBy("key").agg(
        F.max_by("name", F.struct(F.length("name"), "name")).alias("longest"), F.min_by("name", F.struct("card_no", "entry_no")).alias("first"), F.countDistinct("card_no").alias("n_cards"), F.min("card_no").alias("first_card")
    )
    return g


def undecided_names(spark: SparkSession, d: str) -> DataFrame:
    """The documents that wait under each unmatched name, one row for each group key and document, so no hot name is one long list."""
    return _unmatched(spark, d).join(table(spark, d, "cards").select("card_no", "doc_id"), "card_no").where("doc_id is not null").select("key", "doc_id").distinct()


def _unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unique_key_match_named(spark, d).where("account_number is null").withColumn("key", T.group_key(F.col("name"))).where("key <> ''")


def unique_key_match_named(spark: SparkSession, d: str) -> DataFrame:
    return M.match_by_keys(entries(spark, d), accounts(spark, d), "account_number", _keys())


def best_match_first(spark: SparkSession, d: str) -> DataFrame:
    """W03, R01's precedence: of each card the best match first (exact before key, then entry order), the others listed."""
    m = unique_key_match(spark, d)
    rank = F.when(F.col("basis") == "same name", 0).when(F.col("basis").isNotNull(), 1).otherwise(2)
    g = m.groupBy("card_no").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "entry_no", F.coalesce("account_number", F.lit("")).alias("a")))).alias("s"))
    names = F.transform("s", lambda x: x["a"])
    return g.select("card_no", F.get(names, F.lit(0)).alias("best"), F.array_join(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), " ").alias("others"))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """A file name resolves if only one document has it, else by the tail of its folder, else it is ambiguous."""
    inv = table(spark, d, "inventory").select("doc_id", F.lower("file_name").alias("f"), F.lower(F.regexp_extract("original_path", r"([^/]*)/[^/]*$", 1)).alias("tail"))
    by_name = inv.groupBy("f").agg(F.count("*").alias("n_name"))
    by_tail = inv.groupBy("f", "tail").agg(F.count("*").alias("n_tail"))
    route = F.when(F.col("n_name") == 1, "name").when(F.col("n_tail") == 1, "folder").otherwise("ambiguous")
    return inv.join(by_name, "f").join(by_tail, ["f", "tail"]).select("doc_id", route.alias("route"))


def review_rows_match(spark: SparkSession, d: str) -> DataFrame:
    """An exact link by title and hash, kept only where it is one to one both ways."""
    c = table(spark, d, "cards").select("card_no", "doc_id", F.lower("q1_title").alias("t"))
    i = table(spark, d, "inventory").select(F.col("doc_id").alias("i_doc"), F.lower("title_guess").alias("it"))
    m = c.join(i, (c.doc_id == i.i_doc) & c.t.eqNullSafe(i.it)).groupBy("i_doc").agg(F.count("*").alias("n"), F.min("card_no").alias("card_no"))
    return m.where("n = 1").select(F.col("i_doc").alias("doc_id"), "card_no")


def missing_and_strays(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a card, cards without a document."""
    return C.missing_and_strays(table(spark, d, "inventory"), table(spark, d, "cards"), "doc_id")


def empty_accounts(spark: SparkSession, d: str) -> DataFrame:
    """J26"""
    return accounts(spark, d).join(unique_key_match(spark, d).where("account_number is not null"), "account_number", "left_anti").select("account_number")


def top_scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the accounts in scope, and readable documents that no account has."""
    scope = accounts(spark, d).where("country = 'Italy'").select("account_number")
    filed = unique_key_match(spark, d).where("account_number is not null").join(table(spark, d, "cards").select("card_no", "doc_id"), "card_no")
    inside = filed.join(scope, "account_number", "left_semi").select("doc_id").distinct().withColumn("part", F.lit("in scope"))
    readable = table(spark, d, "inventory").where("readable = 'yes'").select("doc_id")
    return inside.unionByName(readable.join(filed, "doc_id", "left_anti").withColumn("part", F.lit("unfiled")))


def parents_by_reference(spark: SparkSession, d: str) -> DataFrame:
    """The title of one other document of the folder that stands, word by word, in the parent words: the longest, if all others quoted
    stand in it; else the words quote several and nothing is linked. Titles under four characters, or of several documents, are no reference.

    Containment becomes an equi-join: the parent words are exploded into their word runs, as long as the longest title."""
    c = table(spark, d, "cards").where("pile_folder is not null")
    words = F.split(T.norm_name(F.regexp_replace("q6_attaches_to", r"[^A-Za-z0-9]+", " ")), " ")
    c = c.withColumn("w", words)
    title = T.norm_name(F.regexp_replace("q1_title", r"[^A-Za-z0-9]+", " "))
    longest = c.agg(F.max(F.size(F.split(title, " ")))).first()[0] or 1
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    child = c.where(~T.is_empty_answer(F.col("q6_attaches_to"))).select("card_no", "doc_id", "pile_folder", F.explode(F.array_distinct(runs)).alias("run"))
    titles = c.select("pile_folder", title.alias("run"), F.col("doc_id").alias("parent")).where(F.length("run") >= 4).groupBy("pile_folder", "run").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"))
    hit = child.join(titles, ["pile_folder", "run"]).where("parent = other and parent <> doc_id")
    g = hit.groupBy("card_no").agg(F.max_by(F.struct("run", "parent"), F.struct(F.length("run"), "run")).alias("top"), F.collect_set("run").alias("runs"))
    within = F.forall("runs", lambda r: F.contains(F.concat(F.lit(" "), F.col("top.run"), F.lit(" ")), F.concat(F.lit(" "), r, F.lit(" "))))
    return g.where(within).select("card_no", F.col("top.parent").alias("parent_doc"))


def parents_by_date(spark: SparkSession, d: str) -> DataFrame:
    """The first quoted date on which exactly one document of the folder starts."""
    c = table(spark, d, "cards").where("pile_folder is not null").withColumn("start", D.whole_date(F.col("q4_start_date")))
    child = c.select("card_no", "doc_id", "pile_folder", F.posexplode(D.dates_in(F.col("q6_attaches_to"))).alias("pos", "start"))
    starts = c.where("start is not null").groupBy("pile_folder", "start").agg(F.min("doc_id").alias("parent"), F.max("doc_id").alias("other"))
    hit = child.join(starts, ["pile_folder", "start"]).where("parent = other and parent <> doc_id")
    return hit.groupBy("card_no").agg(F.min_by("parent", "pos").alias("parent_doc"))


def parents_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cards of one folder whose titles are at least 0.8 alike, as the number of partners of each card. The parents of J17 are in ``parents_by_words``.

    A folder's equal titles are one representative, so a hot folder does not square its copies."""
    c = table(spark, d, "cards").where("pile_folder is not null").withColumn("key", F.array_join(F.sort_array(T.title_tokens(F.col("q1_title"))), " ")).where("key <> ''")
    reps = c.select("pile_folder", "key").distinct().withColumn("id", F.concat_ws("\x1f", "pile_folder", "key"))
    near = M.similar_sets(reps, "id", "pile_folder", F.split("key", " "), 0.8)
    both = near.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(near.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    n = c.groupBy(F.concat_ws("\x1f", "pile_folder", "key").alias("id")).agg(F.count("*").alias("n"))
    extra = both.join(n.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("n").alias("extra"))
    return c.withColumn("id", F.concat_ws("\x1f", "pile_folder", "key")).join(n, "id").join(extra, "id", "left").select("card_no", (F.col("n") - 1 + F.coalesce("extra", F.lit(0))).alias("n_alike"))


#: an arrow and its target end an entry of a link cell; what stands before them are the parent words
LINK_TARGET = r"(?i)\s*(?:→|->|=>)\s*(?:not in pile|doc\b[\s.:#]*\d+)"


def parents_by_words(spark: SparkSession, d: str) -> DataFrame:
    """For each entry of the parent words the one other document of the folder with a title at least 0.6 alike; none if several have one.

    Words and titles are compared once for each folder. Three documents a title are enough to tell one from several when the card's own is left out."""
    key = lambda t: F.array_join(F.sort_array(t), " ")
    c = table(spark, d, "cards").where("pile_folder is not null")
    entries_of = F.filter(F.transform(F.split("q6_attaches_to", LINK_TARGET), lambda e: key(T.title_tokens(e))), lambda k: k != "")
    child = c.where(~T.is_empty_answer(F.col("q6_attaches_to"))).select("card_no", "doc_id", "pile_folder", F.posexplode(entries_of).alias("i", "key"))
    titles = c.select("pile_folder", key(T.title_tokens(F.col("q1_title"))).alias("key"), F.col("doc_id").alias("parent")).where("key <> '' and parent is not null").distinct()
    three = titles.withColumn("k", F.row_number().over(Window.partitionBy("pile_folder", "key").orderBy("parent"))).where("k <= 3").groupBy("pile_folder", "key").agg(F.collect_list("parent").alias("docs"))
    near = M.similar_between(child, titles, "pile_folder", "key", 0.6)
    found = near.join(three.withColumnRenamed("key", "key_b"), ["pile_folder", "key_b"]).groupBy("pile_folder", F.col("key_a").alias("key")).agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
    others = child.join(found, ["pile_folder", "key"]).withColumn("others", F.array_except("docs", F.array("doc_id")))
    return others.where(F.size("others") == 1).select("card_no", (F.col("i") + 1).cast("int").alias("entry_no"), F.get("others", F.lit(0)).alias("parent_doc"))


def copy_instruments(spark: SparkSession, d: str) -> DataFrame:
    """Whether a copy or draft and the document it names are one instrument. Cards have no reference of their own, so titles decide; a document's first card stands."""
    c = table(spark, d, "cards").withColumn("best", first_doc_number(F.col("q9_copy_or_draft_of")))
    body = c.groupBy(F.col("doc_id").alias("best")).agg(F.min_by(F.struct("q1_title"), "card_no").alias("b"))
    none = F.lit(None).cast("string")
    return c.where("best is not null").join(body, "best").select("card_no", "best", T.same_instrument(none, F.col("q1_title"), none, F.col("b.q1_title")).alias("same"))


def drafts_to_best(spark: SparkSession, d: str) -> DataFrame:
    """A copy or draft beside the document it names: draft on or before it, fragment within 45 days after it, else unrelated."""
    c = table(spark, d, "cards").withColumn("start", D.whole_date(F.col("q4_start_date"))).withColumn("best", first_doc_number(F.col("q9_copy_or_draft_of")))
    body = c.groupBy(F.col("doc_id").alias("best")).agg(F.min("start").alias("best_start"))
    days = F.datediff("start", "best_start")
    kind = F.when(days.isNull(), "undated").when(days <= 0, "on or before").when(days <= 45, "within 45 days").otherwise("later")
    return c.where("best is not null").join(body, "best").select("card_no", "best", kind.alias("relation"))


def ending_effects(spark: SparkSession, d: str) -> DataFrame:
    """A parent's latest ending or extending child, and whether that takes effect by the as-at date."""
    c = table(spark, d, "cards").withColumn("start", D.whole_date(F.col("q4_start_date"))).withColumn("parent", first_doc_number(F.col("q6_attaches_to")))
    kind = F.lower(F.trim("q1_kind"))
    ends = c.where(kind.isin("termination letter", "amendment or side letter") & F.col("parent").isNotNull() & F.col("start").isNotNull())
    e = ends.groupBy("parent", kind.alias("kind")).agg(F.max("start").alias("effective"))
    return e.select(F.col("parent").alias("doc_id"), "kind", F.when(F.col("effective") <= F.lit(AS_AT).cast("date"), "in effect").otherwise("not yet").alias("effect"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_name_match, unique_key_match, conflicting_map_rows, token_candidates, prefix_streams, same_stem_accounts, number_backfill, priority_dedupe,
        dominant_party, holding_groups, undecided_names, best_match_first, export_rows, review_rows_match, missing_and_strays, empty_accounts, top_scope,
        parents_by_reference, parents_by_date, parents_by_title, parents_by_words, copy_instruments, drafts_to_best, ending_effects,
    )
}

_EMPTY = _lit(T.EMPTY_ANSWERS)[1:-1]
_ENTRIES = f"""entries as (select card_no, entry_no, trim(regexp_replace(trim(e), '\\s*\\([^()]*\\)\\s*$', '')) as name from (
  select card_no, unnest(string_split(q2_their_signing_entities, ' | ')) as e, cast(unnest(range(1, len(string_split(q2_their_signing_entities, ' | ')) + 1)) as integer) as entry_no
  from cards where {q_norm('q2_their_signing_entities')} not in ({_EMPTY}))),
erp as (select * from erp_record where account is not null)"""


def _index(name: str, key: str) -> str:
    return f"{name} as (select key, min(account_number) as v from (select {key} as key, account_number from erp) where key <> '' group by key having count(distinct account_number) = 1)"


_MATCH = f"""{_ENTRIES},
{_index("i1", q_norm("account"))},
{_index("i2", q_group("account"))},
{_index("i3", q_core("account"))},
matched as (select card_no, entry_no, name, coalesce(i1.v, i2.v, i3.v) as account_number,
  case when i1.v is not null then 'same name' when i2.v is not null then 'group key' when i3.v is not null then 'core name' end as basis
  from entries left join i1 on i1.key = {q_norm("name")} left join i2 on i2.key = {q_group("name")} left join i3 on i3.key = {q_core("name")})"""
_CLEAN = "trim(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]+', ' ', 'g')), '\\s+', ' ', 'g'))"
_TARGET = LINK_TARGET
_START = _q_date("q4_start_date", "\\s*$")
_DOC = "case when length(regexp_extract({0}, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1)) < 8 then nullif(lpad(regexp_extract({0}, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1), 8, '0'), '00000000') else regexp_extract({0}, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1) end"

SQL = {
    "exact_name_match": f"with {_ENTRIES}, {_index('i1', q_norm('account'))} select card_no, entry_no, v as account_number from entries join i1 on i1.key = {q_norm('name')}",
    "unique_key_match": f"with {_MATCH} select card_no, entry_no, account_number, basis from matched",
    "conflicting_map_rows": f"select {q_group('alias')} as key, count(distinct family_hint) as n_values from aliases where {q_group('alias')} <> '' group by 1 having count(distinct family_hint) > 1",
    "token_candidates": f"""with a as (select alias_id, unnest({q_distinctive('alias')}) as t from aliases where node_type in ('legal_entity', 'group')),
b as (select account_number, unnest({q_distinctive('account')}) as t from erp_record where account is not null),
p as (select alias_id, account_number, count(*) as n from a join b using (t) group by all),
r as (select *, row_number() over (partition by alias_id order by n desc, account_number) as k from p)
select alias_id, string_agg(account_number, ' ' order by k) as nearest from r where k <= 5 group by alias_id""",
    "prefix_streams": f"""with n as (select alias_id, {q_norm('alias')} as x from aliases where alias is not null),
u as (select x, min(alias_id) as o from n where x <> '' group by x)
select alias_id, arg_max(o, length(u.x)) as stream_of from n join u on starts_with(n.x, u.x || ' ') group by alias_id""",
    "same_stem_accounts": f"with a as (select account_number, (list_filter(regexp_split_to_array(lower(account), '[^a-z0-9]+'), lambda t: length(t) >= 4 and not list_contains({_lit(T.COMMON_WORDS)}, t)))[1] as s from erp_record where account is not null) select a.account_number, b.account_number as other from a join a b using (s) where a.account_number < b.account_number",
    "number_backfill": f"""with {_MATCH}, got as (select doc_id, min(account_number) as a from matched join cards using (card_no) where account_number is not null group by doc_id),
k as (select sha256, arg_min(a, doc_id) as a from inventory join got using (doc_id) where sha256 is not null group by sha256)
select doc_id, k.a as account_number from inventory i join k using (sha256) where doc_id not in (select doc_id from got)""",
    "priority_dedupe": f"""select key, alias_id from (select {q_norm('alias')} as key, alias_id, row_number() over (partition by {q_norm('alias')} order by (notes is not null) desc, alias_id desc) as n
  from aliases where alias is not null) where n = 1""",
    "dominant_party": """with n as (select pile_folder, q2_our_entity, count(*) as n, min(card_no) as f from cards where pile_folder is not null and q2_our_entity is not null group by all)
select pile_folder, q2_our_entity as our_entity from (select *, row_number() over (partition by pile_folder order by n desc, f) as k from n) where k = 1""",
    "holding_groups": f"""with {_MATCH}, u as (select *, {q_group('name')} as key from matched where account_number is null)
select key, (list(name order by length(name) desc, name desc))[1] as longest, (list(name order by card_no, entry_no))[1] as first, count(distinct card_no) as n_cards, min(card_no) as first_card from u where key <> '' group by key""",
    "undecided_names": f"with {_MATCH} select distinct {q_group('name')} as key, doc_id from matched join cards using (card_no) where account_number is null and {q_group('name')} <> '' and doc_id is not null",
    "best_match_first": f"""with {_MATCH}, r as (select card_no, coalesce(account_number, '') as a, row_number() over (partition by card_no order by case when basis = 'same name' then 0 when basis is not null then 1 else 2 end, entry_no) as k from matched)
select card_no, max(case when k = 1 then a end) as best, coalesce(string_agg(case when k > 1 then a end, ' ' order by k), '') as others from r group by card_no""",
    "export_rows": """with i as (select doc_id, lower(file_name) as f, lower(regexp_extract(original_path, '([^/]*)/[^/]*$', 1)) as t from inventory)
select doc_id, case when count(*) over (partition by f) = 1 then 'name' when count(*) over (partition by f, t) = 1 then 'folder' else 'ambiguous' end as route from i where f is not null and t is not null""",
    "review_rows_match": """select i.doc_id, min(card_no) as card_no from cards c join inventory i on c.doc_id = i.doc_id and lower(c.q1_title) is not distinct from lower(i.title_guess) group by i.doc_id having count(*) = 1""",
    "missing_and_strays": """select distinct doc_id, 'missing' as problem from inventory where doc_id not in (select doc_id from cards where doc_id is not null)
union all select distinct doc_id, 'stray' from cards where doc_id not in (select doc_id from inventory)""",
    "empty_accounts": f"with {_MATCH} select account_number from erp where account_number not in (select account_number from matched where account_number is not null)",
    "top_scope": f"""with {_MATCH}, filed as (select distinct doc_id, account_number from matched join cards using (card_no) where account_number is not null)
select distinct doc_id, 'in scope' as part from filed where account_number in (select account_number from erp where country = 'Italy')
union all select doc_id, 'unfiled' from inventory where readable = 'yes' and doc_id not in (select doc_id from filed)""",
    "parents_by_reference": f"""with c as (select card_no, doc_id, pile_folder, {_CLEAN.format('q6_attaches_to')} as p, {_CLEAN.format('q1_title')} as t, q6_attaches_to from cards where pile_folder is not null),
t as (select pile_folder, t, min(doc_id) as parent from c where length(t) >= 4 group by all having count(distinct doc_id) = 1),
h as (select c.card_no, parent, t.t as t, first_value(t.t) over (partition by c.card_no order by length(t.t) desc, t.t desc) as top from c join t using (pile_folder)
  where contains(' ' || c.p || ' ', ' ' || t.t || ' ') and parent <> doc_id and {q_norm('q6_attaches_to')} not in ({_EMPTY}))
select card_no, min(parent) filter (t = top) as parent_doc from h group by card_no having bool_and(contains(' ' || top || ' ', ' ' || t || ' '))""",
    "parents_by_date": f"""with c as (select card_no, doc_id, pile_folder, {_START} as s,
  list_filter(list_transform(regexp_extract_all(lower(coalesce(q6_attaches_to, '')), '({D.ANYWHERE})', 1), lambda x: {_q_date('x', '(?:$|\\D)')}), lambda x: x is not null) as d from cards where pile_folder is not null),
k as (select card_no, doc_id, pile_folder, unnest(d) as s, unnest(range(0, len(d))) as pos from c),
b as (select pile_folder, s, min(doc_id) as parent from c where s is not null group by all having count(distinct doc_id) = 1)
select card_no, arg_min(parent, pos) as parent_doc from k join b using (pile_folder, s) where parent <> doc_id group by card_no""",
    "parents_by_title": f"""with c as (select card_no, pile_folder, list_sort({q_titles('q1_title')}) as t from cards where pile_folder is not null),
u as (select pile_folder, t, count(*) as n from c where len(t) > 0 group by all),
p as (select a.pile_folder, a.t, sum(b.n) as n from u a join u b using (pile_folder) where len(list_intersect(a.t, b.t)) >= 0.8 * len(list_distinct(list_concat(a.t, b.t))) group by all)
select card_no, cast(n - 1 as bigint) as n_alike from c join p using (pile_folder, t)""",
    "parents_by_words": f"""with c as (select card_no, doc_id, pile_folder, q1_title, q6_attaches_to from cards where pile_folder is not null),
t as (select distinct pile_folder, doc_id as parent, {q_titles('q1_title')} as t from c where doc_id is not null),
l as (select card_no, doc_id, pile_folder, list_filter(list_transform(regexp_split_to_array(q6_attaches_to, '{_TARGET}'), lambda e: {q_titles('e')}), lambda x: len(x) > 0) as w
  from c where {q_norm('q6_attaches_to')} not in ({_EMPTY})),
e as (select card_no, doc_id, pile_folder, unnest(w) as w, cast(unnest(range(1, len(w) + 1)) as integer) as entry_no from l)
select card_no, entry_no, min(parent) as parent_doc from e join t using (pile_folder)
where parent is distinct from doc_id and len(t) > 0 and 10 * len(list_intersect(w, t)) >= 6 * len(list_distinct(list_concat(w, t))) group by all having count(distinct parent) = 1""",
    "copy_instruments": f"""with c as (select card_no, doc_id, q1_title as t, {_DOC.format('q9_copy_or_draft_of')} as best from cards), b as (select doc_id as best, first_value(t) over (partition by doc_id order by card_no) as bt, row_number() over (partition by doc_id order by card_no) as k from c)
select card_no, best, coalesce(t, '') = '' or coalesce(bt, '') = '' or {q_norm('t')} = {q_norm('bt')} or {q_similarity('t', 'bt')} >= 0.6 as same from c join b using (best) where k = 1""",
    "drafts_to_best": f"""with c as (select card_no, doc_id, {_START} as s, {_DOC.format('q9_copy_or_draft_of')} as best from cards), b as (select doc_id as best, min(s) as bs from c group by all)
select card_no, best, case when s is null or bs is null then 'undated' when s <= bs then 'on or before' when s <= bs + 45 then 'within 45 days' else 'later' end as relation from c join b using (best)""",
    "ending_effects": f"""with c as (select {_START} as s, {_DOC.format('q6_attaches_to')} as doc_id, lower(trim(q1_kind)) as kind from cards)
select doc_id, kind, case when max(s) <= date '{AS_AT}' then 'in effect' else 'not yet' end as effect from c where doc_id is not null and s is not null and kind in ('termination letter', 'amendment or side letter') group by doc_id, kind""",
}
