"""Variant spellings of one entity, linked by metric-space partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.edit import probes, segments, within
from foliant.llm.names import RADIUS, read_name
from foliant.operators.components import connected_components
from foliant.session import discard, stage

#: A block of more keys is divided by what its keys have in common before pivots are set.
SPLIT_ABOVE = 4_000
#: One key in so many, chosen by its hash, is a pivot; every part has at least one, and about MOST_PIVOTS at most.
KEYS_PER_PIVOT = 64
MOST_PIVOTS = 256
#: Distances beyond this are all alike. A metric cut off so is still a metric, and long keys are then measured in proportion to their length.
FURTHEST = 40
#: Keys that one task joins, about.
KEYS_PER_TASK = 2_000


def _columns(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _columns([(n, *read_name(n)) for n in batch.column(0).to_pylist()], dict.fromkeys(("name", "block", "key", "first", "middle"), pa.string()))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each point in every part in which a key near it may be at home, and at home in one part for each of its segments."""
    for batch in batches:
        rows = []
        for block, key, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = set(segments(form, RADIUS)) if form == key else set()
            rows += [(block, f"{n}:{i}:{s if len(s) <= 32 else blake2b(s.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}", key, form, (n, i, s) in own) for n, i, s in probes(form, RADIUS) | own]
        yield _columns(rows, {"block": pa.string(), "part": pa.string(), "key": pa.string(), "form": pa.string(), "settled": pa.bool_()})


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact radius join of each cell: its home keys against all that were sent there, under the edit metric. Rows come sorted by cell,
    home keys first. A cell holds the segments of its home keys only; the others pass by and look theirs up."""
    cell, index = None, {}
    for batch in batches:
        out = []
        for block, part, pivot, home, key, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cell != (block, part, pivot):
                cell, index = (block, part, pivot), {}
            if home:
                for s in segments(form, RADIUS):
                    index.setdefault(s, []).append(key)
                continue
            near = {k for s in probes(form, RADIUS) for k in index.get(s, ()) if k != key}
            out += [(block, k, key) for k in near if within(k, form, RADIUS)]
        yield _columns(out, dict.fromkeys(("block", "key_a", "key_b"), pa.string()))


def in_parts(points: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(block, part, key, form, settled): the points of every block, large blocks in parts.

    Of two keys within RADIUS, one has an untouched piece in common with the other (``probes``). So a key of a large block settles in a part
    for each of its RADIUS + 1 pieces and length, and visits those where a key near it may have settled: 19 parts a key, whatever the block."""
    sizes = points.groupBy("block").agg(F.countDistinct("key").alias("n_keys"))
    sized = points.join(sizes, "block")
    small = sized.where(F.col("n_keys") <= split_above).select("block", F.lit("").alias("part"), "key", "form", (F.col("form") == F.col("key")).alias("settled"))
    large = sized.where(F.col("n_keys") > split_above).select("block", "key", "form").mapInArrow(_signed, "block string, part string, key string, form string, settled boolean")
    return small.unionByName(large)


def cells(parts: DataFrame) -> DataFrame:
    """(block, part, pivot, home, key, form): every settled key at home with the nearest pivot of its part, every point also sent to each
    pivot at most 2 * RADIUS further away than its nearest, since by the triangle inequality no key within the radius is at home elsewhere."""
    where = ["block", "part"]
    n = parts.where("settled").groupBy(*where).agg(F.count("*").alias("n"), F.min("form").alias("least"))
    every = F.greatest(F.lit(KEYS_PER_PIVOT), F.ceil(F.col("n") / MOST_PIVOTS))
    chosen = parts.where("settled").join(n, where).where((F.col("form") == F.col("least")) | (F.pmod(F.xxhash64("form"), every) == 0))
    pivots = chosen.groupBy(*where).agg(F.sort_array(F.collect_set("form")).alias("pivots"))
    away = F.transform("pivots", lambda p: F.coalesce(F.nullif(F.levenshtein(F.col("form"), p, FURTHEST), F.lit(-1)), F.lit(FURTHEST + 1)))
    measured = parts.join(pivots, where).withColumn("d", away).withColumn("reach", F.array_min("d"))
    sent = F.filter(F.transform("pivots", lambda p, i: F.struct(p.alias("pivot"), F.get("d", i).alias("d"), i.alias("i"))), lambda x: x["d"] <= F.col("reach") + 2 * RADIUS)
    at = F.array_position("d", F.col("reach")) - 1
    homes = F.when(F.col("settled"), F.array(F.struct(F.get("pivots", at.cast("int")).alias("pivot"), F.lit(True).alias("home"))))
    visits = F.transform(sent, lambda x: F.struct(x["pivot"].alias("pivot"), F.lit(False).alias("home")))
    return measured.select(*where, "key", "form", F.explode(F.concat(F.coalesce(homes, F.array().cast("array<struct<pivot:string,home:boolean>>")), visits)).alias("c")).select(*where, "c.pivot", "c.home", "key", "form")


def near_keys(keys: DataFrame) -> DataFrame:
    """(block, key_a, key_b): the pairs of different keys of a block within RADIUS under the edit metric, for two stems in either order of the second."""
    points = keys.select("block", "key", F.explode(_forms()).alias("form"))
    parts = stage(in_parts(points), "parts")  # read for sizes, pivots and cells
    placed = cells(parts)
    # cells are small in bytes but dear in time, so their number of tasks follows the keys and not the size
    cores = keys.sparkSession.sparkContext.defaultParallelism
    tasks = min(max(keys.count() // KEYS_PER_TASK + 1, cores), 10_000)
    cell = ["block", "part", "pivot"]
    joined = placed.repartition(tasks, *cell).sortWithinPartitions(*cell, F.desc("home")).mapInArrow(_join_cells, "block string, key_a string, key_b string").distinct()
    near = stage(joined, "near")
    discard(parts)
    return near


def _forms() -> Column:
    """The strings under which a key is compared: both orders of two stems, each a point of its own."""
    stems = F.split("key", " ")
    two = F.col("block").startswith("c:") & (F.size(stems) == 2)
    return F.array_distinct(F.when(two, F.array("key", F.concat_ws(" ", F.get(stems, F.lit(1)), F.get(stems, F.lit(0))))).otherwise(F.array("key")))


def _people(near: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What met whom (a written table), and (block, key_a, sub_a, key_b, sub_b): links between people. Those with a first name must agree in it; a bare initial goes to the one first
    name that the keys near it have, a middle initial deciding between several, and to none if that leaves more than one."""
    alone = nodes.select("block", F.col("key").alias("key_a"), F.col("key").alias("key_b")).distinct()
    around = near.unionByName(alone)
    a = nodes.select("block", F.col("key").alias("key_a"), F.col("first").alias("first_a"), F.col("middle").alias("middle_a"))
    b = nodes.select("block", F.col("key").alias("key_b"), F.col("first").alias("first_b"), F.col("middle").alias("middle_b"))
    met = stage(a.join(around, ["block", "key_a"]).join(b, ["block", "key_b"]), "met")
    named = met.where("first_a <> '' and first_a = first_b and key_a <> key_b").select("block", "key_a", F.col("first_a").alias("sub_a"), "key_b", F.col("first_b").alias("sub_b"))
    bare = ["block", "key_a", "middle_a"]
    fits = F.max((F.col("middle_a") != "") & (F.col("middle_a") == F.col("middle_b")))
    who = met.where("first_a = '' and first_b <> ''").groupBy(*bare, "first_b").agg(fits.alias("fits"), F.min_by("key_b", F.struct(F.col("key_b") != F.col("key_a"), "key_b")).alias("key_b"))
    found = F.struct("first_b", "key_b")
    who = who.groupBy(*bare).agg(F.count("*").alias("n"), F.count_if("fits").alias("n_fit"), F.min(found).alias("only"), F.min(F.when(F.col("fits"), found)).alias("fit"))
    who = who.select(*bare, F.when(F.col("n") == 1, F.col("only")).when(F.col("n_fit") == 1, F.col("fit")).alias("who")).where("who is not null")
    initial = F.concat(F.lit("."), "middle_a")
    settled = who.select("block", "key_a", initial.alias("sub_a"), F.col("who.key_b").alias("key_b"), F.col("who.first_b").alias("sub_b"))
    alike = met.where("first_a = '' and first_b = '' and middle_a = middle_b and key_a <> key_b").join(who, bare, "left_anti")
    return met, named.unionByName(settled).unionByName(alike.select("block", "key_a", initial.alias("sub_a"), "key_b", initial.alias("sub_b"))).distinct()


def link_names(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, entity, n_links): every different name with the id of its entity and the number of other names of that entity.

    Null and blank names have no entity. Repeated names count once. A key that two names share needs no measuring; different keys are
    compared only within their block, which is what the metric sets apart furthest: D(x, y) is the edit distance of the keys plus, for
    unequal blocks, more than any key is long, so no pair across blocks can be within the radius. Within a block every key goes home to
    its nearest pivot and is sent to each pivot at most 2 * RADIUS further away (``cells``); each cell is joined exactly. Edit distances of
    random words hardly differ, so pivots alone would send most keys of a large block everywhere: a large block is first divided by
    what near keys must have in common (``in_parts``), so that copies a key do not grow with it."""
    # distinct names are small in bytes but dear to read: they are spread over all cores, not packed by size
    cores = names.sparkSession.sparkContext.defaultParallelism
    read = (
        names.select(F.col(name).alias("name")).where(F.trim("name") != "").distinct().repartition(cores, "name").mapInArrow(_read, "name string, block string, key string, first string, middle string")
    )
    plain = stage(read, "names")
    # a person whose first name is only an initial is a node of its own until the initial is settled
    sub = F.when(F.col("block").startswith("c:"), F.lit("")).when(F.col("first") == "", F.concat(F.lit("."), "middle")).otherwise(F.col("first"))
    read = plain.withColumn("node", F.concat_ws("\x1f", "block", "key", sub))
    keys = stage(read.where("key <> ''").select("block", "key").distinct(), "keys")
    near = near_keys(keys)
    person = F.col("block").startswith("p:")
    nodes = read.where(person & (F.col("key") != "")).select("block", "key", "first", "middle").distinct()
    met, people = _people(near.where(person), nodes)
    links = near.where(~person).select("block", "key_a", F.lit("").alias("sub_a"), "key_b", F.lit("").alias("sub_b")).unionByName(people)
    node = lambda x: F.concat_ws("\x1f", "block", f"key_{x}", f"sub_{x}")
    entity = connected_components(links.select(node("a").alias("a"), node("b").alias("b")).where("a <> b"))
    labelled = read.select("name", "node").join(entity, "node", "left").select("name", F.coalesce("component", "node").alias("entity"))
    labelled = stage(labelled, "entities")
    discard(plain, keys, near, met)
    sizes = labelled.groupBy("entity").agg((F.count("*") - 1).alias("n_links"))
    return labelled.join(sizes, "entity").select("name", F.left(F.sha2("entity", 256), F.lit(20)).alias("entity"), "n_links")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair of different names of one entity, ``name_a`` first by code point."""
    a = linked.where("n_links > 0").select("entity", F.col("name").alias("name_a"))
    return a.join(a.withColumnRenamed("name_a", "name_b"), "entity").where("name_a < name_b").select("name_a", "name_b")
