"""Problem queries 1 and 7 to 10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.canonical import NAMES, map_to_canonical
from foliant.llm.leakage import find_leaks, near_leaks
from foliant.llm.packing import pack
from foliant.llm.splitting import split_oversized
from foliant.llm.tokens import token_count
from foliant.llm.variants import link_names, variant_pairs
from foliant.operators import packed_cells as P
from foliant.session import table

NAMED_NODES = ("legal_entity", "group", "person")


def without_role(entry: Column) -> Column:
    """Without the role in the last parentheses, trimmed, runs of white space made one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(entry, r"\s*\([^()]*\)\s*$", ""), r"\s+", " "))


def signing_entries(cards: DataFrame) -> DataFrame:
    """(card_no, entry_no, name) of every entry of the signing entities."""
    cell = F.col("q2_their_signing_entities")
    return (
        cards.where(cell.isNotNull() & ~F.lower(F.trim(cell)).isin("not found", ""))
        .select("card_no", F.posexplode(F.split(cell, r" \| ")).alias("i", "entry"))
        .select("card_no", (F.col("i") + 1).cast("int").alias("entry_no"), without_role(F.col("entry")).alias("name"))
    )


def all_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name in the three fields, once for each task that meets it."""
    cards = table(spark, d, "cards")
    group = P.split_packed(cards.select("card_no", "q2_their_group_companies"), "card_no", ["q2_their_group_companies"])
    alias = table(spark, d, "aliases").where(F.col("node_type").isin(*NAMED_NODES))
    names = signing_entries(cards).select("name").unionByName(group.select(without_role(F.col("entry_text")).alias("name")))
    return names.unionByName(alias.select(F.trim(F.regexp_replace("alias", r"\s+", " ")).alias("name")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(link_names(all_names(spark, d)))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return link_names(all_names(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    erp = table(spark, d, "erp_record")
    found = map_to_canonical(signing_entries(table(spark, d, "cards")), "name", erp, "account_number", "account", reading=NAMES)
    return found.select("card_no", "entry_no", F.col("ref_id").alias("account_number"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Names that mean no account, with the number of entries."""
    erp = table(spark, d, "erp_record")
    found = map_to_canonical(signing_entries(table(spark, d, "cards")), "name", erp, "account_number", "account", reading=NAMES)
    return found.where("ref_id = 'unmatched'").groupBy("name").agg(F.count("*").alias("n_entries"))


CAPACITY, LIMIT, OVERLAP, LEAST_WORDS = 2048, 512, 64, 12


def containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return pack(docs, "doc_id", "n_tokens", CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return containers(spark, d).where("piece_no = 2").select(F.col("item").alias("doc_id"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(spark, d).withColumnRenamed("item", "doc_id")


def leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", LEAST_WORDS)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with its number of documents and its longest run."""
    return leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which four fifths of a passage's words stand in about their places."""
    return near_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "documents"), "doc_id", "text", LIMIT, OVERLAP, with_text=False)
    return pieces.where("piece_no = 2").select(F.col("item").alias("doc_id"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"), "doc_id", "text", LIMIT, OVERLAP).withColumnRenamed("item", "doc_id")


def p10_sums(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the tokens of all its pieces, repeated ones counted once, the text that their new parts make, whether all keep the
    limit, and whether each repeats the last tokens before it and begins with a whole word."""
    p = p10_pieces(spark, d).withColumn("new", F.expr("substring(piece, char_new - char_from + 1)")).withColumn("n_new", token_count(F.col("new")))
    repeats = (F.col("piece_no") == 1) | (F.col("n_tokens") - F.col("n_new") == OVERLAP)
    whole = ~(F.regexp_like(F.expr("left(piece, char_new - char_from)"), F.lit(r"[\p{L}\p{N}]\z")) & F.regexp_like("new", F.lit(r"^[\p{L}\p{N}]")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"]), "")
    return p.groupBy("doc_id").agg(
        F.sum("n_new").cast("long").alias("n_tokens"), F.md5(text).alias("text_md5"), (F.max("n_tokens") <= LIMIT).alias("within"), F.bool_and(repeats & whole).alias("repeats")
    )


def p8_sums(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the tokens of its pieces, whether it is cut, and whether all its pieces are in containers that hold no more than their capacity."""
    c = p8_containers(spark, d)
    fill = c.groupBy("container").agg(F.sum("size").alias("fill"))
    return c.join(fill, "container", "left").groupBy("doc_id").agg(F.sum("size").cast("long").alias("n_tokens"), (F.count("*") > 1).alias("cut"), F.bool_and(F.coalesce(F.col("fill") <= CAPACITY, F.lit(True))).alias("fits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: tokens packed, containers over their capacity, and whether the containers are at most a fiftieth more than the tokens fill."""
    fill = p8_containers(spark, d).where("container is not null").groupBy("container").agg(F.sum("size").alias("fill"))
    total = F.coalesce(F.sum("fill"), F.lit(0))
    return fill.agg(total.cast("long").alias("n_tokens"), F.count_if(F.col("fill") > CAPACITY).alias("n_over"), (F.count("*") <= F.ceil(total / CAPACITY * 1.02) + 1).alias("tight"))


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p7_found, p7_unmatched, p8_found, p8_containers, p8_sums, p8_fill, p9_found, p9_items, p9_near, p10_found, p10_pieces, p10_sums)}

_TOKENS = "len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]'))"
_GRAMS = """d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
e as (select distinct item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') as w from eval_items)"""
SQL = {
    "p8_sums": f"select doc_id, coalesce({_TOKENS}, 0) as n_tokens, coalesce({_TOKENS}, 0) > {CAPACITY} as cut, true as fits from documents",
    "p8_fill": f"select cast(coalesce(sum({_TOKENS}), 0) as bigint) as n_tokens, 0 as n_over, true as tight from documents",
    "p10_sums": f"select doc_id, {_TOKENS} as n_tokens, md5(text) as text_md5, true as within, true as repeats from documents where {_TOKENS} > 0",
    "p9_items": f"""with {_GRAMS},
eg as (select item_id, i, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e)),
dg as (select doc_id, i, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
m as (select distinct doc_id, item_id, dg.i - eg.i as shift, eg.i as pos from dg join eg using (g)),
r as (select doc_id, item_id, shift, count(*) + 11 as n from (select *, pos - row_number() over (partition by doc_id, item_id, shift order by pos) as island from m) group by doc_id, item_id, shift, island)
select item_id, count(distinct doc_id) as n_docs, cast(max(n) as integer) as longest from r group by item_id""",
    "p9_near": f"""with {_GRAMS},
ew as (select item_id, len(w) as n, unnest(w) as v, unnest(range(0, len(w))) as b from e), dw as (select doc_id, unnest(w) as v, unnest(range(0, len(w))) as a from d),
h as (select doc_id, item_id, n, b, cast(floor((a - b) / 16.0) as integer) as k from dw join ew using (v)),
s as (select doc_id, item_id, n, b, k from h union all select doc_id, item_id, n, b, k - 1 from h),
c as (select doc_id, item_id, n, k, count(distinct b) as c from s group by all having count(*) >= ceil(0.8 * n - 1e-9))
select doc_id, item_id, max(c) as n_shared from c group by doc_id, item_id, n having max(c) >= ceil(0.8 * n - 1e-9)""",
    "p8_found": f"select doc_id from documents where {_TOKENS} > {CAPACITY}",
    "p10_found": f"select doc_id from documents where {_TOKENS} > {LIMIT}",
    "p9_found": """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
e as (select item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') as w from eval_items),
eg as (select item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e)),
dg as (select doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d))
select distinct doc_id, item_id from dg join eg using (g)""",
}
