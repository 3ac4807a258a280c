"""Lists and checks that reports are made of."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.cascade import first_match
from foliant.functions.docrefs import doc_numbers
from foliant.operators import changes as C
from foliant.operators import strict_load as S
from foliant.plans.matching import _MATCH, accounts, entries, unique_key_match_named
from foliant.plans.pile import _RAW_SQL, CLOSED
from foliant.plans.scalars import q_group, q_int, q_norm
from foliant.session import shared_dir, table
from foliant.streaming import logs as L


def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    """Readable documents without a card."""
    return table(spark, d, "inventory").where("readable = 'yes'").join(table(spark, d, "cards"), "doc_id", "left_anti").select("doc_id")


def folder_parties(spark: SparkSession, d: str) -> DataFrame:
    """Of each folder our entities in order of first sight, each in its first spelling."""
    c = table(spark, d, "cards").where("pile_folder is not null and q2_our_entity is not null")
    first = c.groupBy("pile_folder", T.norm_name(F.col("q2_our_entity")).alias("key")).agg(F.min("card_no").alias("at"), F.min_by("q2_our_entity", "card_no").alias("name"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    return first.groupBy("pile_folder").agg(F.array_join(ordered, " | ").alias("ours"), F.count("*").alias("n_ours"))


def couldnt_tell(spark: SparkSession, d: str) -> DataFrame:
    """What a card leaves open, one row a reason: missing references, no start, rolling though unsure."""
    c = table(spark, d, "cards")
    why = [
        F.when(~T.is_empty_answer(F.col("q6_referred_to_not_in_pile")) & (F.size(doc_numbers(F.col("q6_referred_to_not_in_pile"))) == 0), "reference without a number"),
        F.when(T.is_empty_answer(F.col("q4_start_date")), "no start date"),
        F.when(F.lower("q4_end").startswith("rolling") & (F.lower(F.trim("q4_status")) == "unsure"), "rolling, state unsure"),
    ]
    return c.select("card_no", F.explode(F.array_compact(F.array(*why))).alias("why"))


def reversed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Cards with one of our own entities in the other side's slot; ours are the names that stand in our slot anywhere."""
    ours = table(spark, d, "cards").select(T.group_key(F.col("q2_our_entity")).alias("key")).where("key <> ''").distinct()
    e = entries(spark, d).select("card_no", T.group_key(F.col("name")).alias("key"))
    return e.join(ours, "key", "left_semi").select("card_no").distinct()


def name_targets(spark: SparkSession, d: str) -> DataFrame:
    """R01, R02's precedence, H11, H20: where each name goes: its account's folder, or a holding folder with its label."""
    m = unique_key_match_named(spark, d).withColumn("key", T.group_key(F.col("name")))
    label = m.where("account_number is null and key <> ''").groupBy("key").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("label"))
    j = m.join(label, "key", "left").join(accounts(spark, d).select("account_number", "account"), "account_number", "left")
    target = first_match([(F.col("account_number").isNotNull(), F.concat(F.lit("accounts/"), F.col("account_number"))), (F.col("key") == "", F.lit("_no-name-found"))], F.concat(F.lit("_not-on-the-list/"), F.col("label")))
    return j.select("card_no", "entry_no", target.alias("target"))


def our_entities(spark: SparkSession, d: str) -> DataFrame:
    """Our entities as first printed on the cards; those that the export names replace the row of their key."""
    first = lambda df, no, status: df.where(T.group_key(F.col("q2_our_entity")) != "").groupBy(T.group_key(F.col("q2_our_entity")).alias("key")).agg(F.min_by("q2_our_entity", no).alias("name"), F.lit(status).alias("status"))
    new = S.load_lines(table(spark, d, "cards_raw"), "line_no", "raw_line", S.RAW_FIELDS, CLOSED)
    return C.upsert(first(table(spark, d, "cards"), "card_no", "current"), ["key"], first(new, "row_no", "export"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether two lists of documents are the same: cards and inventory, texts and inventory, the export and the cards."""
    doc = lambda df: df.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("doc_id"))
    cards, inv, texts = (table(spark, d, x).select("doc_id") for x in ("cards", "inventory", "documents"))
    export = S.load_lines(table(spark, d, "cards_raw"), "line_no", "raw_line", S.RAW_FIELDS, CLOSED).select("doc_id")
    pairs = {"cards and inventory": (cards, inv), "texts and inventory": (doc(texts), inv), "export and cards": (export, cards)}
    return reduce(DataFrame.unionByName, [C.same_coverage(a, b, "doc_id").select(F.lit(k).alias("pair"), "same") for k, (a, b) in pairs.items()])


def streamed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A03 as a stream over the ledger (K08, S23): all that is there now, then it stops. The state is a row for each stage and role."""
    path = f"{d}/cost_ledger.parquet"
    name = f"streamed_ledger_{uuid.uuid4().hex}"
    stream = L.ledger_totals(L.log_stream(spark, path, spark.read.parquet(path).schema.simpleString()[7:-1].replace(":", " "), "parquet"))
    root = f"{shared_dir(spark).rstrip('/')}/{name}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/totals")  # the whole result of each batch replaces the one before, from the executors

    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/totals")


QUERIES = {f.__name__: f for f in (pending_documents, folder_parties, couldnt_tell, reversed_questions, name_targets, our_entities, coverage, streamed_ledger)}

_EMPTY = "('', 'none', 'not found', 'n/a', 'na', '-', '—')"
SQL = {
    "pending_documents": "select doc_id from inventory where readable = 'yes' and doc_id not in (select doc_id from cards where doc_id is not null)",
    "folder_parties": f"""with f as (select pile_folder, {q_norm('q2_our_entity')} as key, min(card_no) as first_at, arg_min(q2_our_entity, card_no) as name from cards where pile_folder is not null and q2_our_entity is not null group by all)
select pile_folder, string_agg(name, ' | ' order by first_at) as ours, count(*) as n_ours from f group by pile_folder""",
    "couldnt_tell": f"""select card_no, 'reference without a number' as why from cards where {q_norm('q6_referred_to_not_in_pile')} not in {_EMPTY} and not regexp_matches(q6_referred_to_not_in_pile, '(?i)\\bdoc\\b[\\s.:#]*\\d+')
union all select card_no, 'no start date' from cards where {q_norm('q4_start_date')} in {_EMPTY}
union all select card_no, 'rolling, state unsure' from cards where starts_with(lower(q4_end), 'rolling') and lower(trim(q4_status)) = 'unsure'""",
    "reversed_questions": f"with {_MATCH} select distinct card_no from matched where {q_group('name')} in (select {q_group('q2_our_entity')} from cards where {q_group('q2_our_entity')} <> '')",
    "name_targets": f"""with {_MATCH}, k as (select *, {q_group('name')} as key from matched), l as (select key, (list(name order by length(name) desc, name desc))[1] as label from k where account_number is null and key <> '' group by key)
select card_no, entry_no, case when account_number is not null then 'accounts/' || account_number when key = '' then '_no-name-found' else '_not-on-the-list/' || label end as target from k left join l using (key)""",
    "our_entities": f"""with {_RAW_SQL}, n as (select {q_group('o')} as key, arg_min(o, line_no) as name from (select line_no, f[4] as o from checked where shaped and kind_ok and signed_ok) where {q_group('o')} <> '' group by 1),
c as (select {q_group('q2_our_entity')} as key, arg_min(q2_our_entity, card_no) as name from cards where {q_group('q2_our_entity')} <> '' group by 1)
select coalesce(n.key, c.key) as key, coalesce(n.name, c.name) as name, case when n.key is null then 'current' else 'export' end as status from c full join n on n.key = c.key""",
    "streamed_ledger": f"""select stage, role, count(*) as agents, count(*) filter ({q_int('attempt')} > 1) as retries, cast(coalesce(sum({q_int('tokens')}), 0) as bigint) as tokens from cost_ledger group by stage, role""",
    "coverage": f"""with {_RAW_SQL}, x as (select f[1] as d from checked where shaped and kind_ok and signed_ok), c as (select doc_id as d from cards where doc_id is not null), i as (select doc_id as d from inventory where doc_id is not null),
t as (select lpad(cast(doc_id as varchar), 8, '0') as d from documents)
select 'cards and inventory' as pair, not exists (from i except from c) and not exists (from c except from i) as same union all
select 'texts and inventory', not exists (from i except from t) and not exists (from t except from i) union all select 'export and cards', not exists (from x except from c) and not exists (from c except from x)""",
}
