"""Continuous periods and gaps from overlapping terms, by an ordered disjoint-interval map per entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The end of an open interval, as a day number beyond any date.
OPEN = 2**31 - 1


class IntervalMap:
    """Disjoint intervals of day numbers in order, both ends inclusive; neighbours are at least two days apart."""

    __slots__ = ("starts", "ends")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, start: int, end: int) -> None:
        """Merge with all that overlap or touch: those from the first whose end reaches start-1 to the last that starts by end+1."""
        if end < start:
            return
        lo = bisect_left(self.ends, start - 1)
        hi = bisect_right(self.starts, min(end, OPEN - 1) + 1)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def spans(self) -> Iterator[tuple[str, int, int]]:
        for i, (s, e) in enumerate(zip(self.starts, self.ends, strict=True)):
            if i:
                yield "gap", self.ends[i - 1] + 1, s - 1
            yield "period", s, e


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side maps, one for each entity seen in the batch; a hot entity shrinks to its disjoint intervals before any shuffle."""
    for batch in batches:
        maps: dict = {}
        for key, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is None or s is None or e is None or e < s:
                continue
            m = maps.get(key)
            if m is None:
                m = maps[key] = IntervalMap()
            m.insert(s, e)
        rows = [(k, s, e) for k, m in maps.items() for s, e in zip(m.starts, m.ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.types[0], pa.int32(), pa.int32()))], names=["key", "s", "e"])


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by entity; the state holds the map of one entity at a time."""
    now, m, out = None, IntervalMap(), []
    kind = pa.string()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        types = (kind, pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "span_kind", "s", "e"])

    for batch in batches:
        kind = batch.schema.types[0]
        for key, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                out += [(now, *x) for x in m.spans()]
                now, m = key, IntervalMap()
            m.insert(s, e)
        if len(out) > 10_000:
            yield flush()
            out = []
    out += [(now, *x) for x in m.spans()]
    if out:
        yield flush()


def continuous_periods(terms: DataFrame, entity: str, start: str, end: str, open_ended: str) -> DataFrame:
    """(entity, span_kind, span_from, span_to): merged periods and the gaps between them.

    ``start`` and ``end`` are dates, both inclusive; where ``open_ended`` is true the end is ignored and the period is ``open``.
    Terms without entity or start, without an end though not open, or ending before they start have no effect; repeated terms
    change nothing. Each insertion finds its overlaps by binary search in the entity's map. Maps are built before the shuffle, too, so
    what travels for a hot entity is its disjoint intervals, not its rows."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    clean = terms.select(
        F.col(entity).alias("key"), day(F.col(start)).alias("s"), F.when(F.col(open_ended), F.lit(OPEN)).otherwise(day(F.col(end))).alias("e")
    )
    kind = dict(clean.dtypes)["key"]
    partial = clean.mapInArrow(_partial, f"key {kind}, s int, e int")
    merged = partial.repartition("key").sortWithinPartitions("key").mapInArrow(_final, f"key {kind}, span_kind string, s int, e int")
    text = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), c), "yyyy-MM-dd")
    return merged.select(
        F.col("key").alias(entity), "span_kind", text(F.col("s")).alias("span_from"),
        F.when(F.col("e") == OPEN, F.lit("open")).otherwise(text(F.when(F.col("e") != OPEN, F.col("e")))).alias("span_to"),
    )
