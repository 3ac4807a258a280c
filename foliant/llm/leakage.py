"""Evaluation passages in training text, by a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import WORD
from foliant.session import discard, stage

#: Test items handled at once; more are taken in blocks, each against the whole corpus.
ITEMS_PER_BLOCK = 20_000
#: A side counted to have at most so many rows of a few numbers each may be sent to every worker.
BROADCAST_ROWS = 500_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _index(vocabulary: dict[str, int], least: int):
    """Postings of a document: term and positions, sorted. Only words that stand in a run of ``least`` or more test words are kept,
    since no other can take part in a match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            terms: list[np.ndarray] = []
            docs: list[np.ndarray] = []
            places: list[np.ndarray] = []
            offsets: list[np.ndarray] = [np.zeros(1, np.int64)]
            done = 0
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                codes = np.fromiter((get(w, -1) for w in words_of(text)), np.int32)
                if len(codes) < least:
                    continue
                known = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
                a, b = known[::2], known[1::2]
                long = b - a >= least
                if not long.any():
                    continue
                at = np.concatenate([np.arange(x, y) for x, y in zip(a[long], b[long], strict=True)])
                order = np.argsort(codes[at], kind="stable")
                at = at[order]
                found, first = np.unique(codes[at], return_index=True)
                terms.append(found)
                docs.append(np.full(len(found), i))
                places.append(at)
                offsets.append(done + np.append(first[1:], len(at)))
                done += len(at)
            cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
            positions = pa.ListArray.from_arrays(pa.array(cat(offsets, np.int32)), pa.array(cat(places, np.int32)))
            rows = cat(docs, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(terms, np.int32)), batch.column(0).take(pa.array(rows)), positions], names=["term", "doc_id", "positions"]
            )

    return run


def _anchors(items: list[tuple], vocabulary: dict[str, int], counts: dict[int, int], least: int) -> set[tuple[int, int, int]]:
    """(term, item number, offset): of each window of ``least`` words the rarest term. Windows with a term that the index lacks cannot match."""
    out = set()
    for number, (_, words) in enumerate(items):
        codes = [vocabulary[w] for w in words]
        rarity = [counts.get(c, 0) for c in codes]
        for k in range(len(codes) - least + 1):
            best = min(range(k, k + least), key=lambda j: (rarity[j], j))
            if rarity[best]:
                out.add((codes[best], number, best))
    return out


def _blocks(items: DataFrame, item_id: str, passage: str, least: int) -> Iterator[list[tuple]]:
    """The different test items with at least ``least`` words as (id, words), a block at a time: only one block is ever on the driver."""
    words = F.regexp_count(F.lower("passage"), F.lit(r"[\p{L}\p{N}]+"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).where(words >= least).distinct()
    n = ceil(asked.count() / ITEMS_PER_BLOCK)
    for k in range(n):
        block = asked.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(n)) == k)
        listed = [(r["item_id"], words_of(r["passage"])) for r in block.collect()]
        yield sorted((x for x in listed if len(x[1]) >= least), key=repr)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, known by counting, for a join with a table that grows: sent to the workers if few, else both sides are sorted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


class _Block:
    """A block of test items and the written postings of its words."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, items: list[tuple], kind: str, least: int) -> None:
        spark = docs.sparkSession
        self.items = items
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        self.postings = stage(rows.mapInArrow(_index(self.vocabulary, least), f"term int, doc_id {dict(rows.dtypes)['doc_id']}, positions array<int>"), "postings")
        self.counts = {r["term"]: r["n"] for r in self.postings.groupBy("term").agg(F.sum(F.size("positions")).alias("n")).collect()}
        test = [(n, self.vocabulary[w], i) for n, (_, words) in enumerate(items) for i, w in enumerate(words)]
        self.test = _bounded(spark.createDataFrame(test, "number int, term int, offset int"), len(test))
        self.names = _bounded(spark.createDataFrame([(n, i, len(words)) for n, (i, words) in enumerate(items)], f"number int, item_id {kind}, n int"), len(items))

    def shifts(self, anchors: set[tuple[int, int, int]]) -> DataFrame:
        """(doc_id, number, shift) at which an anchor (term, item number, offset) stands: its postings, moved by its offset."""
        a = _bounded(self.postings.sparkSession.createDataFrame(sorted(anchors), "term int, number int, offset int"), len(anchors))
        hits = self.postings.join(a, "term").select("doc_id", "number", F.explode("positions").alias("p"), "offset")
        return hits.select("doc_id", "number", (F.col("p") - F.col("offset")).alias("shift"))

    def lists(self, wanted: DataFrame) -> DataFrame:
        """The postings of all terms of the passages wanted in a document. Both sides grow with the corpus, so neither is ever broadcast."""
        return self.postings.hint("merge").join(wanted.join(self.test, "number"), ["doc_id", "term"])


def _union(found: list[DataFrame], docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, numbers: dict[str, str]) -> DataFrame:
    if found:
        return reduce(DataFrame.unionByName, found)
    ends = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}"
    return docs.sparkSession.createDataFrame([], ", ".join([ends, *(f"{k} {t}" for k, t in numbers.items())]))


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least: int = 12) -> DataFrame:
    """(doc_id, item_id, doc_position, n_words): every place where ``least`` or more consecutive words of a passage stand
    consecutively in a text, with the word number in the text at which the passage's first word would stand and the length of the longest such run.

    Null and empty texts and passages match nothing, nor do passages under ``least`` words. Repeated documents and items are matched
    each for themselves; equal rows of the result come out once. The test items are a stated query set, taken in blocks of ITEMS_PER_BLOCK
    against all documents.

    The postings of test words are written once to the shared folder. Their counts give each window of ``least`` words its rarest
    term; the anchors' postings, shifted by their offsets, propose alignments; the lists of all other terms of the passage are then
    intersected under the same shift for the proposed documents. What reaches the driver is a block of the test side and a count for each of its
    terms; alignments and postings are never broadcast, and the written tables of a block go when its leaks are written."""
    kind, out = dict(items.dtypes)[item_id], []
    for listed in _blocks(items, item_id, passage, least):
        block = _Block(docs, doc_id, text, listed, kind, least)
        alignments = stage(block.shifts(_anchors(listed, block.vocabulary, block.counts, least)).distinct(), "alignments")
        hits = (
            block.lists(alignments).where(F.array_contains("positions", F.col("shift") + F.col("offset")))
            .groupBy("doc_id", "number", "shift").agg(F.sort_array(F.collect_set("offset")).alias("o"))
        )
        # the longest run of consecutive offsets: the largest set of equal offset minus rank
        rank = F.transform("o", lambda x, i: x - i)
        run = F.array_max(F.transform(F.array_distinct(rank), lambda r: F.size(F.filter(rank, lambda x: x == r))))
        found = (
            hits.where(F.size("o") >= least).select("doc_id", "number", "shift", run.alias("n_words")).where(F.col("n_words") >= least)
            .join(block.names, "number").select("doc_id", "item_id", F.col("shift").alias("doc_position"), "n_words")
        )
        out.append(stage(found, "leaks"))
        discard(block.postings, alignments)
    return _union(out, docs, doc_id, items, item_id, {"doc_position": "int", "n_words": "int"})


def near_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, share: float = 0.8, slop: int = 16) -> DataFrame:
    """(doc_id, item_id, n_shared): proximity matches: passages of which at least ``share`` of the words stand in a text with shifts
    (place in the text minus place in the passage) inside one window [k * slop, (k + 2) * slop). ``n_shared`` is the number of such words in the best window.

    Words put in, left out or changed move the shift of what follows or lose a word each, so a retouched passage is still found. If
    ``share`` of n words match, at least one of the n - ceil(share * n) + 1 rarest does: only their postings propose windows, and
    nothing is lost. Nulls, blanks and repeated rows as in ``find_leaks``."""
    kind, out = dict(items.dtypes)[item_id], []
    for listed in _blocks(items, item_id, passage, 1):
        block = _Block(docs, doc_id, text, listed, kind, 1)
        anchors = set()
        for number, (_, words) in enumerate(listed):
            codes = [block.vocabulary[w] for w in words]
            rare = sorted(range(len(codes)), key=lambda j: (block.counts.get(codes[j], 0), j))[: len(codes) - ceil(share * len(codes) - 1e-9) + 1]
            anchors |= {(codes[j], number, j) for j in rare}
        window = F.explode(F.array(F.floor(F.col("shift") / slop), F.floor(F.col("shift") / slop) - 1))
        windows = stage(block.shifts(anchors).select("doc_id", "number", window.alias("k")).distinct(), "windows")
        inside = F.exists("positions", lambda p: (p - F.col("offset") >= F.col("k") * slop) & (p - F.col("offset") < (F.col("k") + 2) * slop))
        shared = (
            block.lists(windows).where(inside)
            .groupBy("doc_id", "number", "k").agg(F.countDistinct("offset").alias("n_shared"))
        )
        found = (
            shared.groupBy("doc_id", "number").agg(F.max("n_shared").alias("n_shared")).join(block.names, "number")
            .where(F.col("n_shared") >= F.ceil(F.col("n") * share - 1e-9)).select("doc_id", "item_id", "n_shared")
        )
        out.append(stage(found, "leaks"))
        discard(block.postings, windows)
    return _union(out, docs, doc_id, items, item_id, {"n_shared": "bigint"})
