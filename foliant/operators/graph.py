"""A property graph from tables: nodes, edges, what does not fit, and checks on its structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.hierarchy import CYCLE, parent_links, resolve
from foliant.session import discard, stage


def node_rows(df: DataFrame, node_id: Column, label: str, name: Column, **properties: Column) -> DataFrame:
    """(id, label, name, properties): one row a write; null and blank properties and ``not_found`` are never written."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(properties.items())]) if properties else F.array().cast("array<struct<key:string,value:string>>")
    kept = F.filter(pairs, lambda p: p["value"].isNotNull() & ~F.lower(F.trim(p["value"])).isin("", "not_found", "not found"))
    return df.select(node_id.alias("id"), F.lit(label).alias("label"), name.alias("name"), F.map_from_entries(kept).alias("properties")).where("id is not null")


def merge_nodes(writes: DataFrame, order: str | None = None) -> DataFrame:
    """(id, label, name, n_labels, properties): one row an id (G04). Later writes win property by property; ids written under several
    labels show it in ``n_labels`` and carry the least. Without an order the greatest value wins."""
    o = F.col(order) if order else F.lit(0)
    props = (
        writes.select("id", o.alias("o"), F.explode("properties").alias("key", "value")).groupBy("id", "key").agg(F.max_by("value", F.struct("o", "value")).alias("value"))
        .groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))
    )
    base = writes.groupBy("id").agg(F.min("label").alias("label"), F.max_by("name", F.struct(o, "name")).alias("name"), F.countDistinct("label").alias("n_labels"))
    return base.join(props, "id", "left")


def check_edges(edges: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """``edges`` (src, dst, type) with ``fault``: null, or missing source, missing target, unknown type, or labels the type does not allow.

    ``types`` has type, from_types and to_types as pipe-separated labels; ``same type`` asks for equal labels, ``any`` takes all."""
    s, t = nodes.select(F.col("id").alias("src"), F.col("label").alias("_s")), nodes.select(F.col("id").alias("dst"), F.col("label").alias("_t"))
    allowed = lambda label, col: F.col(col).contains("any") | F.array_contains(F.split(col, r"\|"), F.col(label))
    same = F.col("to_types") == "same type"
    ok = allowed("_s", "from_types") & F.when(same, F.col("_s") == F.col("_t")).otherwise(allowed("_t", "to_types"))
    j = edges.join(s, "src", "left").join(t, "dst", "left").join(types, "type", "left")
    fault = F.when(F.col("_s").isNull(), "missing source").when(F.col("_t").isNull(), "missing target").when(F.col("from_types").isNull(), "unknown type").when(~ok, "labels")
    return j.select("src", "dst", "type", fault.alias("fault"))


def placeholders(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """(id, label): provisional nodes for targets that no node is."""
    return edges.select(F.col("dst").alias("id")).where("id is not null").distinct().join(nodes.select("id"), "id", "left_anti").withColumn("label", F.lit(label))


def several_parents(edges: DataFrame, kind: str) -> DataFrame:
    """(src, n_parents): sources with more than one structural parent."""
    return edges.where(F.col("type") == kind).groupBy("src").agg(F.countDistinct("dst").alias("n_parents")).where("n_parents > 1")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Sources in or leading into a circle when each follows its least target."""
    return resolve(parent_links(edges, "src", "dst"), with_path=False).where(F.col("root") == CYCLE).select(F.col("node").alias("id"))


def circle_nodes(edges: DataFrame, levels: int = 4) -> DataFrame:
    """(type, id): nodes in or leading into a circle of edges of one type, over all edges (src, dst, type) and not one a node.

    Nodes without outgoing edges are stripped, with the edges into them, until none goes; a written table takes off ``levels`` layers.
    Edges with a null end are none; an edge to oneself is a circle."""
    left = stage(edges.select("type", "src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    n = left.count()
    while n:
        kept = left
        for _ in range(levels):
            kept = kept.join(kept.select("type", F.col("src").alias("dst")).distinct(), ["type", "dst"], "left_semi")
        kept = stage(kept.select("type", "src", "dst"), "edges")
        discard(left)
        left, before, n = kept, n, kept.count()
        if n == before:
            break
    return left.select("type", F.col("src").alias("id")).distinct()


def tree_roots(members: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, node): members whose parent is not in their tree; where all have one, the least member."""
    m = members.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent")).where("tree is not null and node is not null")
    inside = m.select("tree", F.col("node").alias("parent")).distinct()
    roots = m.join(inside, ["tree", "parent"], "left_anti").select("tree", "node").distinct()
    rest = m.join(roots.select("tree").distinct(), "tree", "left_anti").groupBy("tree").agg(F.min("node").alias("node"))
    return roots.unionByName(rest).select(F.col("tree").alias(tree), F.col("node").alias(node))


def settle(status: DataFrame, endings: DataFrame, parts: DataFrame, as_of: str) -> DataFrame:
    """(id, status) after endings (dst, effective, status) up to ``as_of`` and, one level down, dead parents of parts (src, dst).

    Of several endings the latest effective one counts, the greater status where dates tie."""
    e = endings.where(F.col("effective") <= F.lit(as_of).cast("date")).groupBy(F.col("dst").alias("id")).agg(F.max_by("status", F.struct("effective", "status")).alias("ended"))
    own = status.select("id", "status").join(e, "id", "left").select("id", F.coalesce("ended", "status").alias("status"))
    dead = own.where(~F.col("status").isin("active", "provisional")).select(F.col("id").alias("dst"))
    hit = parts.join(dead, "dst", "left_semi").select(F.col("src").alias("id"), F.lit(True).alias("_dead")).distinct()
    return own.join(hit, "id", "left").select("id", F.when(F.col("_dead") & F.col("status").isin("active", "provisional"), "parent ended").otherwise(F.col("status")).alias("status"))
