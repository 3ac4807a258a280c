"""Mapping free-entered values to a canonical list, by BK-trees over the list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.edit import BKTree, levenshtein
from foliant.llm.names import RADIUS, Name, fold, is_name, read_name, read_text
from foliant.session import bounded_rows, discard, stage

#: A list of at most this many entries is sent to every worker as one index; a longer one is sharded.
BROADCAST_ROWS = 50_000
#: Entries of one block and length that a shard holds at most, about.
SHARD_ROWS = 5_000
UNMATCHED = "unmatched"
NAMES, TEXT = "names", "text"


class CanonicalIndex:
    """The reference list under one metric: the edit distance of the keys, plus more than any radius where blocks differ (lines of
    business and place, or first initial; texts are all in one block). Since nothing is near across blocks, the tree is kept as one tree a block."""

    def __init__(self, entries: list[tuple[str, str]], reading: str) -> None:
        self.reading, self.trees, self.memo = reading, {}, {}
        for ref_id, name in sorted(entries):
            n = self.read(name)
            if n.key:
                self.trees.setdefault(n.block, BKTree()).add(n.key, (ref_id, fold(name), n.first))

    def read(self, name: str) -> Name:
        return read_name(name) if self.reading == NAMES else read_text(name)

    def find(self, name: str) -> tuple[int, int, str] | None:
        """(distance, distance as printed, id) of the winner within RADIUS: the nearest, then the most alike as printed, then the least id.

        A text may have one edit for each three of its characters, so that short ones do not all mean each other."""
        if name in self.memo:
            return self.memo[name]
        n, best = self.read(name), None
        tree = self.trees.get(n.block) if n.key else None
        radius = RADIUS if self.reading == NAMES else min(RADIUS, len(n.key) // 3)
        stems = n.key.split(" ")
        forms = {n.key, " ".join(reversed(stems))} if n.block.startswith("c:") and len(stems) == 2 else {n.key}
        for form in forms if tree else ():
            for d, _, values in tree.search(form, radius):
                for ref_id, printed, first in values:
                    if first and n.first and first != n.first:
                        continue
                    hit = (d, levenshtein(printed, fold(name)), ref_id)
                    best = hit if best is None or hit < best else best
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[name] = best
        return best


def _match(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = index.value.find  # read once for each worker process
        for batch in batches:
            found = [find(n) if n is not None else None for n in batch.column("name").to_pylist()]
            out = pa.array([f[2] if f else UNMATCHED for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "ref_id"])

    return run


def _read(reading: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = read_name if reading == NAMES else read_text
        for batch in batches:
            got = [read(x) for x in batch.column("name").to_pylist()]
            columns = [*batch.columns, pa.array([n.block for n in got], pa.string()), pa.array([len(n.key) for n in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "block", "size"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([is_name(x) for x in batch.column(0).to_pylist()], pa.bool_())], names=["named"])


def _match_shard(reading: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and side: the shard's references come first, then the names that look for them."""
        shard, entries, index = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for *s, ref_id, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, entries, index = s, [], None
                if ref_id is not None:
                    entries.append((ref_id, name))
                    continue
                index = index or CanonicalIndex(entries, reading)
                if hit := index.find(name):
                    out.append((name, *hit))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["name", "d", "printed", "ref_id"])

    return run


def _sharded(rows: DataFrame, ref: DataFrame, n_ref: int, reading: str) -> DataFrame:
    """(name, ref_id): the winner for each different name that has one. A shard is a part of the entries of one block and key length; a
    name asks only the shards of its block whose lengths differ by RADIUS at most, and the shards' winners merge by the same order."""
    refs = stage(ref.mapInArrow(_read(reading), "ref_id string, name string, block string, size int").where("size > 0"), "references")
    asked = rows.select("name").where("name is not null").distinct().mapInArrow(_read(reading), "name string, block string, size int").where("size > 0")
    parts = refs.groupBy("block", "size").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"))
    stored = refs.join(parts, ["block", "size"]).select("block", "size", F.pmod(F.xxhash64("ref_id"), "parts").cast("int").alias("part"), "ref_id", "name")
    near = F.explode(F.sequence(F.greatest(F.lit(1), F.col("size") - RADIUS), F.col("size") + RADIUS))
    looking = asked.select("name", "block", near.alias("size")).join(parts, ["block", "size"]).select("block", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("ref_id"), "name")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n_ref // SHARD_ROWS + 1)
    winners = (
        stored.unionByName(looking).repartition(tasks, "block", "size", "part").sortWithinPartitions("block", "size", "part", F.col("ref_id").isNull())
        .mapInArrow(_match_shard(reading), "name string, d int, printed int, ref_id string")
        .groupBy("name").agg(F.min_by("ref_id", F.struct("d", "printed", "ref_id")).alias("ref_id"))
    )
    winners = stage(winners, "winners")
    discard(refs)
    return winners


def map_to_canonical(entries: DataFrame, name: str, reference: DataFrame, ref_id: str, ref_name: str, broadcast_rows: int = BROADCAST_ROWS, reading: str | None = None) -> DataFrame:
    """``entries`` with a column ``ref_id``: the id of the reference entry that means the same, or ``unmatched``.

    ``reading`` is ``names`` for companies and people, whose lines of business, places and first names must agree, or ``text`` for anything
    else (cities, brands, job titles), compared as a whole. Where it is not given, the list decides: names if most of its entries read as such.
    Every row stays, repeated ones too; null and blank values are unmatched. A reference list of up to ``broadcast_rows`` (counted, not
    assumed) is made into one index, sent to every worker process once, and the rows are mapped where they lie, without a shuffle. A longer
    list is sharded (``_sharded``) and the result joined back. Null ids and names of the list are left out; of entries alike the one most
    alike as printed wins, then the least id."""
    ref = reference.select(F.col(ref_id).cast("string").alias("ref_id"), F.col(ref_name).alias("name")).where("ref_id is not null and trim(name) <> ''")
    rest = [c for c in entries.columns if c not in (name, "name", "ref_id")]
    rows = entries.select(*rest, F.col(name).alias("name"))
    n_ref = ref.count()
    if reading is None:
        named = ref.select("name").mapInArrow(_named, "named boolean").agg(F.count_if("named")).first()[0]
        reading = NAMES if 2 * named > n_ref else TEXT
    if n_ref <= broadcast_rows:
        listed = [(r["ref_id"], r["name"]) for r in bounded_rows(ref, broadcast_rows, "the reference list")]
        index = rows.sparkSession.sparkContext.broadcast(CanonicalIndex(listed, reading))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ref_id string"
        return rows.mapInArrow(_match(index), schema)
    winners = _sharded(rows, ref, n_ref, reading)
    return rows.join(winners, "name", "left").select(*rest, "name", F.coalesce("ref_id", F.lit(UNMATCHED)).alias("ref_id"))
