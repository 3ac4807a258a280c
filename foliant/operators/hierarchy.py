"""Parent-child rows of unknown depth to full hierarchies, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import discard, stage

CYCLE = "cycle"


def parent_links(links: DataFrame, node: str, parent: str) -> DataFrame:
    """One (node, parent) row for each node with a parent: the least parent where rows disagree; null ends are dropped."""
    return (
        links.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
        .where("node is not null and parent is not null")
        .groupBy("node").agg(F.min("parent").alias("parent"))
    )


def resolve(links: DataFrame, with_path: bool = True) -> DataFrame:
    """(node, root, depth[, up]) for every node with a parent; ``links`` has one (node, parent) row a node.

    ``depth`` is the number of steps to the root and ``up`` the ancestors from the parent to the root. Nodes in or leading into a
    circle get root ``cycle``, depth -1 and a null ``up``. A parent without a row of its own is a root.

    Every round joins each open pointer to the pointer of its ancestor, so jumps double in length. After round r all nodes of depth
    up to 2^(r-1) are closed. A node deeper than that has one of each smaller depth above it, so a round that closes no node proves that
    all open ones are cyclic: the number of rounds is logarithmic in the depth, whatever the circles. Closed pointers are never
    rewritten. Each round is a written table, which no lost executor takes along. Roots are no nodes, so an ancestor that a third of
    the nodes share finds no partner at all; one below a root is split by adaptive skew handling, as the pointer side has one row a node."""
    up = ["up"] if with_path else []
    first = links.select("node", F.col("parent").alias("anc"), F.lit(1).alias("dist"), F.lit(False).alias("done"), *([F.array("parent").alias("up")] if with_path else []))
    open_ = start = stage(first, "pointers")
    closed: list[DataFrame] = []
    n_open = open_.count()
    while n_open:
        every = open_
        for c in closed:
            every = every.unionByName(c)
        q = every.select(F.col("node").alias("q_node"), F.col("anc").alias("q_anc"), F.col("dist").alias("q_dist"), F.col("done").alias("q_done"), *[F.col("up").alias("q_up") for _ in up])
        hit = F.col("q_node").isNotNull()
        jumped = open_.join(q, F.col("anc") == F.col("q_node"), "left").select(
            "node", F.coalesce("q_anc", "anc").alias("anc"), (F.col("dist") + F.coalesce("q_dist", F.lit(0))).alias("dist"), F.when(hit, F.col("q_done")).otherwise(F.lit(True)).alias("done"),
            *[F.when(hit, F.concat("up", "q_up")).otherwise(F.col("up")).alias("up") for _ in up],
        )
        moved = stage(jumped, "pointers")
        if not closed:
            discard(start)
        n_left = moved.where("not done").count()
        closed.append(moved.where("done"))
        open_ = moved.where("not done")
        if n_left == n_open:
            break
        n_open = n_left
    cyclic = open_.select("node", F.lit(CYCLE).alias("root"), F.lit(-1).alias("depth"), *[F.lit(None).cast(dict(open_.dtypes)["up"]).alias("up") for _ in up])
    out = cyclic
    for c in closed:
        out = out.unionByName(c.select("node", F.col("anc").cast("string").alias("root"), F.col("dist").alias("depth"), *up))
    return out


def paths(resolved: DataFrame, separator: str = "/") -> DataFrame:
    """(node, path): from the root down to the node; null for cyclic nodes."""
    return resolved.select("node", F.array_join(F.concat(F.reverse("up"), F.array("node")), separator).alias("path"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, steps): every pair of a node and one of its ancestors; cyclic nodes have none."""
    return resolved.select("node", F.posexplode("up").alias("i", "ancestor")).select("ancestor", "node", (F.col("i") + 1).alias("steps"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """(node, n_descendants) for every node with descendants, from rows with their ``up``."""
    return count_descendants(resolved.where("up is not null").select("node", F.col("up")[0].alias("parent")))


def count_descendants(links: DataFrame) -> DataFrame:
    """(node, n_descendants) for every node with descendants that is not in or leading into a circle; ``links`` has one (node, parent) row a node.

    Pairs are never made: in round r every node holds how many nodes stand less than 2^r steps below it, itself among them, and adds that to
    its ancestor 2^r steps above, if there is one. So work is linear in the nodes and rounds are logarithmic in the depth. A round that ends with as
    many nodes as it began has cyclic ones only, as in ``resolve``, and cyclic nodes only add to cyclic ones."""
    open_ = stage(links.select("node", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")), "sizes")
    sums: DataFrame | None = None
    n_open, n_left = open_.count(), -1
    while n_left:
        part = stage(open_.groupBy("anc").agg(F.sum("size").alias("n")), "sizes")
        sums = part if sums is None else sums.unionByName(part)
        above, below = open_.select(F.col("node").alias("q_node"), F.col("anc").alias("q_anc")), part.withColumnRenamed("anc", "p_node")
        moved = stage(
            open_.join(above, F.col("anc") == F.col("q_node")).join(below, F.col("node") == F.col("p_node"), "left")
            .select("node", F.col("q_anc").alias("anc"), (F.col("size") + F.coalesce("n", F.lit(0))).alias("size")), "sizes",
        )
        discard(open_)
        open_, n_left = moved, moved.count()
        if n_left == n_open:
            break
        n_open = n_left
    total = sums.groupBy(F.col("anc").alias("node")).agg(F.sum("n").alias("n_descendants"))
    return total.join(open_.select("node"), "node", "left_anti")


def all_descendants(links: DataFrame) -> DataFrame:
    """(ancestor, node): every pair of a node and another one that its parents lead to, in circles too; ``links`` has one (node, parent) row a node.

    Outside circles these are the pairs of ``resolve``. Cyclic nodes double their sets of ancestors until a round adds none to any: what lies up to
    2^(r+1) steps above is then what lies up to 2^r. The result is as long as there are pairs, the square of the length of a chain or circle."""
    resolved = resolve(links)
    sets = stage(
        resolved.where(F.col("root") == CYCLE).select("node").join(links, "node").select("node", F.col("parent").alias("anc"), F.array("parent").alias("up"), F.lit(True).alias("grew")), "sets"
    )
    while sets.where("grew").limit(1).count():
        q = sets.select(F.col("node").alias("q_node"), F.col("anc").alias("q_anc"), F.col("up").alias("q_up"))
        more = F.array_distinct(F.concat("up", "q_up"))
        moved = stage(sets.join(q, F.col("anc") == F.col("q_node")).select("node", F.col("q_anc").alias("anc"), more.alias("up"), (F.size(more) > F.size("up")).alias("grew")), "sets")
        discard(sets)
        sets = moved
    cyclic = sets.select("node", F.explode("up").alias("ancestor")).where("ancestor <> node").select("ancestor", "node")
    return descendants(resolved).select("ancestor", "node").unionByName(cyclic)
