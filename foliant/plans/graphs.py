"""The property graph of the pile: accounts, folders and documents, and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import dates as D
from foliant.functions import text as T
from foliant.functions.docrefs import doc_numbers, first_doc_number
from foliant.operators import graph as G
from foliant.operators.components import connected_components
from foliant.plans.matching import _DOC, _MATCH, accounts, unique_key_match
from foliant.plans.pile import card_parents
from foliant.plans.scalars import AS_AT, _q_date
from foliant.session import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    i, a, c = table(spark, d, "inventory"), accounts(spark, d), table(spark, d, "cards")
    docs = G.node_rows(i, F.concat(F.lit("doc-"), F.col("doc_id")), "document", F.col("title_guess"), language=F.col("language"), pages=F.col("pages"), file_type=F.col("file_type"))
    accs = G.node_rows(a, F.concat(F.lit("acc-"), F.col("account_number")), "account", F.col("account"), country=F.col("country"), site=F.col("site"))
    folders = G.node_rows(c.select("pile_folder").distinct(), F.concat(F.lit("folder-"), F.col("pile_folder")), "folder", F.col("pile_folder"))
    cards = G.node_rows(c.select("doc_id", F.lower(F.trim("q4_status")).alias("status")).distinct(), F.concat(F.lit("doc-"), F.col("doc_id")), "document", F.lit(None).cast("string"), status=F.col("status"))
    return docs.unionByName(accs).unionByName(folders).unionByName(cards)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cards")
    doc = F.concat(F.lit("doc-"), F.col("doc_id"))
    to = lambda f: F.concat(F.lit("doc-"), f)
    filed = c.where("pile_folder is not null").select(doc.alias("src"), F.concat(F.lit("folder-"), F.col("pile_folder")).alias("dst"), F.lit("filed_in").alias("type"))
    part = c.select(doc.alias("src"), F.explode(F.transform(doc_numbers(F.col("q6_attaches_to")), to)).alias("dst"), F.lit("forms_part_of").alias("type"))
    over = c.select(doc.alias("src"), F.explode(F.transform(doc_numbers(F.col("q6_replaces")), to)).alias("dst"), F.lit("supersedes").alias("type"))
    acc = unique_key_match(spark, d).where("account_number is not null").join(c.select("card_no", "doc_id"), "card_no").select(doc.alias("src"), F.concat(F.lit("acc-"), F.col("account_number")).alias("dst"), F.lit("party_to").alias("type"))
    return filed.unionByName(part).unionByName(over).unionByName(acc).distinct()


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Merged nodes with their properties as sorted text."""
    n = G.merge_nodes(_nodes(spark, d))
    props = F.array_join(F.transform(F.sort_array(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return n.select("id", "label", F.coalesce("name", F.lit("")).alias("name"), "n_labels", props.alias("props"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


#: the registry of edge types that the checks use
EDGE_TYPES = (("filed_in", "document", "folder"), ("forms_part_of", "document", "same type"), ("supersedes", "document", "same type"), ("party_to", "document", "account|folder"))


def edge_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Edges that the registry or the nodes do not bear, counted by type and fault."""
    nodes = G.merge_nodes(_nodes(spark, d)).select("id", "label")
    types = spark.createDataFrame(EDGE_TYPES, "type string, from_types string, to_types string")
    return G.check_edges(_edges(spark, d), nodes, types).where("fault is not null").groupBy("type", "fault").agg(F.count("*").alias("n"))


def dangling_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """G09"""
    p = G.placeholders(_edges(spark, d), _nodes(spark, d).select("id").distinct(), "provisional")
    return p.select("id", "label", T.stable_id("node", F.col("label"), F.col("id")).alias("hashed_id"))


def structural_parents(spark: SparkSession, d: str) -> DataFrame:
    """G06"""
    return G.several_parents(_edges(spark, d), "forms_part_of")


def cycle_members(spark: SparkSession, d: str) -> DataFrame:
    """R05's circles: along one parent a document, as in ``p6_found``; those over all links are in ``relation_circles``."""
    links = card_parents(table(spark, d, "cards")).select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    return G.cyclic_nodes(links).select(F.col("id").alias("doc_id"))


def relation_circles(spark: SparkSession, d: str) -> DataFrame:
    """Documents in or leading into a circle of forms_part_of or of supersedes, over all their links."""
    c = table(spark, d, "cards")
    links = lambda f, kind: c.select(F.col("doc_id").alias("src"), F.explode(doc_numbers(F.col(f))).alias("dst"), F.lit(kind).alias("type"))
    found = G.circle_nodes(links("q6_attaches_to", "forms_part_of").unionByName(links("q6_replaces", "supersedes")))
    return found.select(F.col("type").alias("relation"), F.col("id").alias("doc_id"))


def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    """G08, G10"""
    c = table(spark, d, "cards")
    m = c.where("pile_folder is not null").groupBy("pile_folder", "doc_id").agg(F.min(first_doc_number(F.col("q6_attaches_to"))).alias("parent"))
    return G.tree_roots(m, "pile_folder", "doc_id", "parent")


def settled_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What superseding papers, effective on their own start date, and dead parents do to a document's state."""
    c = table(spark, d, "cards").withColumn("start", D.whole_date(F.col("q4_start_date")))
    live = F.max((F.lower(F.trim("q4_status")) == "live").cast("int"))
    status = c.groupBy(F.col("doc_id").alias("id")).agg(F.when(live == 1, "active").otherwise("provisional").alias("status"))
    endings = c.select(F.explode(doc_numbers(F.col("q6_replaces"))).alias("dst"), F.col("start").alias("effective"), F.lit("superseded").alias("status"))
    parts = c.select(F.col("doc_id").alias("src"), F.explode(doc_numbers(F.col("q6_attaches_to"))).alias("dst")).distinct()
    return G.settle(status, endings, parts, AS_AT)


def version_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents tied by equal bytes, by a named copy or by an equal file name in one folder, transitively; groups of two or more.

    Shared keys become a star around the key's least document, so a hot key costs one edge a row."""
    i = table(spark, d, "inventory")
    folder = F.regexp_extract("original_path", r"^(.*)/[^/]*$", 1)
    keys = i.select("doc_id", F.explode(F.array(F.concat(F.lit("h:"), F.col("sha256")), F.concat(F.lit("f:"), folder, F.lit("/"), F.lower("title_guess")))).alias("key")).where("key is not null")
    star = keys.join(keys.groupBy("key").agg(F.min("doc_id").alias("hub")), "key").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    named = table(spark, d, "cards").select(F.col("doc_id").alias("a"), first_doc_number(F.col("q9_copy_or_draft_of")).alias("b"))
    comp = connected_components(star.unionByName(named).where("a <> b"))
    return comp.select(F.col("node").alias("doc_id"), F.col("component").alias("version_group"))


def scope_members(spark: SparkSession, d: str) -> DataFrame:
    """Accounts folded into the shortest account name they begin with, as member lists."""
    a = accounts(spark, d).select("account_number", F.regexp_replace(T.norm_name(F.col("account")), r"\s*\(.*$", "").alias("base"))
    return a.groupBy("base").agg(F.min("account_number").alias("main"), F.array_join(F.sort_array(F.collect_list("account_number")), " ").alias("members"))


def mermaid_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a position diagram of each folder, dashed where the status is unsure."""
    c = table(spark, d, "cards").where("pile_folder is not null").withColumn("p", first_doc_number(F.col("q6_attaches_to"))).where("p is not null")
    arrow = F.when(F.lower(F.trim("q4_status")) == "unsure", " -.-> ").otherwise(" --> ")
    return c.select("pile_folder", F.concat(F.lit("d"), F.col("doc_id"), arrow, F.lit("d"), F.col("p")).alias("line")).distinct()


QUERIES = {
    f.__name__: f
    for f in (graph_nodes, graph_edges, edge_gaps, dangling_placeholders, structural_parents, cycle_members, relation_circles, tree_roots, settled_lifecycle, version_groups, scope_members, mermaid_lines)
}

_PAD = "case when length(n) < 8 then lpad(n, 8, '0') else n end"


def _links(field: str) -> str:
    return f"(select doc_id, {_PAD} as to_id from (select doc_id, unnest(regexp_extract_all({field}, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1)) as n from cards))"


_GRAPH = f"""{_MATCH},
nodes as (select 'doc-' || doc_id as id, 'document' as label, title_guess as name, doc_id, language, pages, file_type from inventory),
statuses as (select distinct doc_id, lower(trim(q4_status)) as status from cards),
edges as (select distinct 'doc-' || doc_id as src, 'folder-' || pile_folder as dst, 'filed_in' as type from cards where pile_folder is not null
  union select 'doc-' || doc_id, 'doc-' || to_id, 'forms_part_of' from {_links('q6_attaches_to')}
  union select 'doc-' || doc_id, 'doc-' || to_id, 'supersedes' from {_links('q6_replaces')}
  union select 'doc-' || doc_id, 'acc-' || account_number, 'party_to' from matched join cards using (card_no) where account_number is not null),
ids as (select id, 'document' as label from nodes union select 'doc-' || doc_id, 'document' from cards union select 'acc-' || account_number, 'account' from erp union select 'folder-' || pile_folder, 'folder' from cards where pile_folder is not null)"""
_BAD = "lower(trim({0})) in ('', 'not_found', 'not found')"


def _prop(key: str, x: str) -> str:
    return f"case when {x} is not null and not {_BAD.format(f'cast({x} as varchar)')} then '{key}=' || {x} end"


_START = _q_date("q4_start_date", "\\s*$")
SQL = {
    "graph_nodes": f"""with {_GRAPH}, s as (select doc_id, max(status) as status from statuses where not {_BAD.format('status')} group by doc_id),
docs as (select 'doc-' || coalesce(i.doc_id, c.doc_id) as id, 'document' as label, coalesce(title_guess, '') as name,
  array_to_string(list_filter([{_prop('file_type', 'file_type')}, {_prop('language', 'language')}, {_prop('pages', 'pages')}, case when s.status is not null then 'status=' || s.status end], lambda x: x is not null), ';') as props
  from inventory i full join (select distinct doc_id from cards where doc_id is not null) c on c.doc_id = i.doc_id left join s on s.doc_id = coalesce(i.doc_id, c.doc_id))
select id, label, name, cast(1 as bigint) as n_labels, props from docs
union all select 'acc-' || account_number, 'account', account, 1, array_to_string(list_filter([{_prop('country', 'country')}, {_prop('site', 'site')}], lambda x: x is not null), ';') from erp
union all select distinct 'folder-' || pile_folder, 'folder', pile_folder, 1, '' from cards where pile_folder is not null""",
    "graph_edges": f"with {_GRAPH} select src, dst, type from edges",
    "edge_gaps": f"""with {_GRAPH}, f as (select e.type, case when s.id is null then 'missing source' when t.id is null then 'missing target' end as fault
  from edges e left join ids s on s.id = e.src left join ids t on t.id = e.dst) select type, fault, count(*) as n from f where fault is not null group by all""",
    "dangling_placeholders": f"""with {_GRAPH} select dst as id, 'provisional' as label, 'node-' || left(sha256('["provisional", "' || lower(dst) || '"]'), 20) as hashed_id from (select distinct dst from edges where dst not in (select id from ids))""",
    "structural_parents": f"with {_GRAPH} select src, count(distinct dst) as n_parents from edges where type = 'forms_part_of' group by src having count(distinct dst) > 1",
    "cycle_members": "",
    "tree_roots": f"""with m as (select pile_folder, doc_id, min({_DOC.format('q6_attaches_to')}) as parent from cards where pile_folder is not null group by all),
r as (select pile_folder, doc_id from m where not exists (select 1 from m x where x.pile_folder = m.pile_folder and x.doc_id = m.parent))
select * from r union all select pile_folder, min(doc_id) from m where pile_folder not in (select pile_folder from r) group by pile_folder""",
    "settled_lifecycle": f"""with s as (select doc_id as id, case when bool_or(lower(trim(q4_status)) = 'live') then 'active' else 'provisional' end as status from cards group by doc_id),
e as (select distinct {_PAD} as id from (select {_START} as s, unnest(regexp_extract_all(q6_replaces, '(?i)\\bdoc\\b[\\s.:#]*(\\d+)', 1)) as n from cards) where s <= date '{AS_AT}'),
o as (select id, case when id in (select id from e) then 'superseded' else status end as status from s),
p as (select doc_id from {_links('q6_attaches_to')} where to_id in (select id from o where status = 'superseded'))
select id, case when status in ('active', 'provisional') and id in (select doc_id from p) then 'parent ended' else status end as status from o""",
    "version_groups": f"""with recursive k as (select doc_id, unnest(['h:' || sha256, 'f:' || regexp_extract(original_path, '^(.*)/[^/]*$', 1) || '/' || lower(title_guess)]) as key from inventory),
e0 as (select doc_id as a, min(doc_id) over (partition by key) as b from k where key is not null union all select doc_id, {_DOC.format('q9_copy_or_draft_of')} from cards),
e as (select a, b from e0 where a <> b union select b, a from e0 where a <> b),
r as (select a as node, a as other from e union select r.node, e.b from r join e on e.a = r.other)
select node as doc_id, min(other) as version_group from r group by node""",
    "scope_members": """select regexp_replace(lower(trim(regexp_replace(account, '\\s+', ' ', 'g'))), '\\s*\\(.*$', '') as base, min(account_number) as main, string_agg(account_number, ' ' order by account_number) as members
from erp_record where account is not null group by 1""",
    "mermaid_lines": f"""select distinct pile_folder, 'd' || doc_id || case when lower(trim(q4_status)) = 'unsure' then ' -.-> ' else ' --> ' end || 'd' || {_DOC.format('q6_attaches_to')} as line
from cards where pile_folder is not null and {_DOC.format('q6_attaches_to')} is not null and {_DOC.format('q6_attaches_to')} <> ''""",
}
from foliant.plans.pile import SQL as _PILE  # noqa: E402

SQL["cycle_members"] = f"select doc_id from ({_PILE['p6_found']}) where root_doc_id = 'cycle'"
SQL["relation_circles"] = f"""with recursive e as (select 'forms_part_of' as relation, doc_id, to_id from {_links('q6_attaches_to')} where doc_id is not null union select 'supersedes', doc_id, to_id from {_links('q6_replaces')} where doc_id is not null),
r as (select relation, doc_id, to_id from e union select r.relation, r.doc_id, e.to_id from r join e on e.relation = r.relation and e.doc_id = r.to_id)
select distinct relation, doc_id from r where (relation, to_id) in (select (relation, doc_id) from r where doc_id = to_id)"""
