"""Filling containers of fixed capacity by best-two-fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unpacked items a task holds at once; containers are filled while more than half of it waits.
POOL = 60_000


class BestTwoFit:
    """A pool of unpacked items by size, and containers filled from it.

    Sizes in stock are the bits of one integer, so the largest that fits and the tightest pair are found by shifts and masks."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list] = [[] for _ in range(capacity + 1)]
        self.mask = self.mirror = 0  # bit s; bit capacity - s
        self.n = 0

    def put(self, size: int, item: tuple) -> None:
        if not self.items[size]:
            self.mask |= 1 << size
            self.mirror |= 1 << (self.capacity - size)
        self.items[size].append(item)
        self.n += 1

    def take(self, size: int) -> tuple:
        item = self.items[size].pop()
        if not self.items[size]:
            self.mask ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)
        self.n -= 1
        return item

    def largest(self, room: int) -> int:
        """The largest size in stock that fits; 0 if none does."""
        return max(0, (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1)

    def tightest_pair(self, room: int, above: int) -> tuple[int, int] | None:
        """Two items in stock whose sizes together fill ``room`` best, more than ``above``."""
        for total in range(room, max(above, 1), -1):
            both = self.mask & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1)
            while both:
                a = both.bit_length() - 1
                if 2 * a != total:
                    return a, total - a
                if len(self.items[a]) > 1:
                    return a, a
                both ^= 1 << a
        return None

    def fill(self) -> list[tuple[int, tuple]]:
        """One container: largest first until nothing fits, then its smallest item gives way to two that fit the widened gap more
        tightly, as often as that helps."""
        room, out = self.capacity, []
        while room and (s := self.largest(room)):
            out.append((s, self.take(s)))
            room -= s
        while room and out:
            smallest, item = out[-1]
            pair = self.tightest_pair(room + smallest, smallest)
            if pair is None:
                break
            out.pop()
            out += [(s, self.take(s)) for s in pair]
            self.put(smallest, item)
            room += smallest - sum(pair)
            out.sort(key=lambda x: -x[0])
        return out


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, n, pool = context.partitionId() if context else 0, 0, BestTwoFit(capacity)
        kind = pa.int64()

        def emit(least: int) -> pa.RecordBatch:
            nonlocal n
            rows: list[tuple] = ready[:]
            ready.clear()
            while pool.n > least:
                n += 1
                rows += [(f"{part}-{n}", *item, size) for size, item in pool.fill()]
            types = (pa.string(), kind, pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["container", "item", "piece_no", "piece_from", "size"])

        ready: list[tuple] = []
        for batch in batches:
            kind = batch.schema.types[0]
            for item, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = max(size or 0, 0)
                whole = (size - 1) // capacity if size else 0
                for k in range(whole):
                    n += 1
                    ready.append((f"{part}-{n}", item, k + 1, k * capacity, capacity))
                if size:
                    pool.put(size - whole * capacity, (item, whole + 1, whole * capacity))
                else:
                    ready.append((None, item, 1, 0, 0))
            if pool.n > POOL or len(ready) > POOL:
                yield emit(POOL // 2)
        yield emit(0)

    return run


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(container, item, piece_no, piece_from, size): which container each item, or each piece of an oversized one, goes to.

    Only items above the capacity are cut: into full containers and one rest, which is packed like an item; ``piece_from`` is where in
    the item the piece starts. Items of size null, 0 or less take no room and get a null container. Repeated ids are items of their own.

    Every task packs the items it reads, without a shuffle: with thousands of containers a task, the at most one badly filled
    container at its end is the whole price of not packing globally. A task holds POOL items at most, however many it reads, and a
    lost task packs the same rows the same way again."""
    rows = items.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size"))
    return rows.mapInArrow(_pack(capacity), f"container string, item {dict(rows.dtypes)['item']}, piece_no int, piece_from long, size int")
