"""Cutting oversized texts at natural boundaries, by packing their structure tree."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import TOKEN

#: Ranks of the nodes, from the top of the tree down: pages; headings by depth; numbered clauses by depth; paragraphs; list items by
#: indent; lines. Below the lines stand sentences, clauses of a sentence, words and tokens.
PAGE, HEADING, NUMBERED, PARAGRAPH, ITEM, LINE, SENTENCE, CLAUSE, WORD, SINGLE = 0, 1, 7, 10, 11, 15, 16, 17, 18, 19
#: What a line begins with that opens a node.
_PAGE = re.compile(r"=== page \d+ ===")
_MARK = re.compile(r"\[¶ \d+\][^\S\n]?")
_HASHES = re.compile(r"(#{1,6})[^\S\n]")
_TAG = re.compile(r"<(?:h([1-6])|(section|article|table|ul|ol|p|div|blockquote|pre)|(li|tr|dt|dd))\b", re.I)
_NUMBER = re.compile(r"(?:(?:clause|section|article|§)[^\S\n]?)?(\d{1,3}(?:\.\d{1,3}){0,4})[.)]?[^\S\n]", re.I)
_BULLET = re.compile(r"(?:[-*+•–]|\(?(?:[a-z]|[ivx]{1,5}|\d{1,3})\))[^\S\n]", re.I)
_CLOSERS = frozenset("\"'”’)]")
#: Texts made into Python strings at a time.
TEXTS_AT_ONCE = 256


def line_rank(line: str, indent: int, after_blank: bool) -> int:
    """The rank of the node that opens with this line, whose leading white space was ``indent`` long."""
    if _PAGE.match(line):
        return PAGE
    if m := _HASHES.match(line):
        return HEADING + len(m[1]) - 1
    if m := _TAG.match(line):
        return HEADING + int(m[1]) - 1 if m[1] else PARAGRAPH if m[2] else ITEM + min(indent // 2, 3)
    mark = _MARK.match(line)
    body = line[mark.end() :] if mark else line
    if (m := _NUMBER.match(body)) and (m[0].rstrip()[-1] in ".)" or "." in m[1] or not m[0][0].isdigit()):
        return NUMBERED + min(m[1].count("."), 2)
    if mark or after_blank:
        return PARAGRAPH
    return ITEM + min(indent // 2, 3) if _BULLET.match(line) else LINE


class Outline:
    """The structure tree of a text: tokens at which a node opens, with ranks. Lines are read once; what is below them only within a node taken apart there."""

    def __init__(self, text: str, starts: list[int]) -> None:
        self.text, self.starts = text, starts
        self.at: list[int] = []
        self.ranks: list[int] = []
        pos, blank, token = 0, False, 0
        for line in text.split("\n"):
            body = line.lstrip()
            if body:
                indent = len(line) - len(body)
                token = bisect_left(starts, pos + indent, token)
                if token:
                    self.at.append(token)
                    self.ranks.append(line_rank(body, indent, blank))
                blank = False
            else:
                blank = True
            pos += len(line) + 1

    def opens(self, token: int, rank: int) -> bool:
        """Whether a sentence, clause or word opens with the token. Looks back over closing quotes and brackets only."""
        text, i = self.text, self.starts[token] - 1
        if not text[i].isspace():
            return rank == CLAUSE and text[i] in ";|"
        if rank == WORD:
            return True
        i = self.starts[token - 1]
        if text[i].isalnum():
            return False
        if rank == CLAUSE:
            return text[i] in ";:,"
        back = token - 1
        while back > 0 and text[self.starts[back]] in _CLOSERS and self.starts[back] == self.starts[back - 1] + 1:
            back -= 1
        return text[self.starts[back]] in ".!?"

    def children(self, a: int, b: int, rank: int) -> tuple[list[int], int]:
        """Starts of the children of the node [a, b) but the first, of the highest rank from ``rank`` on that opens inside it, and that rank."""
        if rank <= LINE:
            lo, hi = bisect_left(self.at, a + 1), bisect_left(self.at, b)
            inside = [r for r in self.ranks[lo:hi] if r >= rank]
            if inside:
                top = min(inside)
                return [self.at[i] for i in range(lo, hi) if self.ranks[i] == top], top
        for below in range(max(rank, SENTENCE), SINGLE):
            if found := [i for i in range(a + 1, b) if self.opens(i, below)]:
                return found, below
        return [], SINGLE


def tree_pieces(n: int, outline: Outline, limit: int, first: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens, none longer than ``limit``, the first not longer than ``first``.

    A node within the limit stays whole. Only an oversized one is taken apart into its children, each handled likewise; then siblings, with
    all below them, are merged from left to right as long as they fit. Nodes without children that are still too long are cut between tokens."""
    room = lambda a: limit if a else first
    out: list[tuple[int, int]] = []

    def merge(pieces: list[tuple[int, int]], u: int, v: int) -> None:
        if pieces and v - pieces[-1][0] <= room(pieces[-1][0]):
            pieces[-1] = (pieces[-1][0], v)
        else:
            pieces.append((u, v))

    def units(a: int, b: int, rank: int) -> list[tuple[int, int]]:
        if b - a <= room(a):
            return [(a, b)]
        inner, at = outline.children(a, b, rank)
        if not inner:
            cuts = [a, *range(a + room(a), b, limit), b]
            return list(zip(cuts, cuts[1:], strict=False))
        edges, pieces = [a, *inner, b], []
        for x, y in zip(edges, edges[1:], strict=False):
            for u, v in units(x, y, at + 1):
                merge(pieces, u, v)
        return pieces

    for u, v in units(0, n, PAGE) if n else ():
        merge(out, u, v)
    return [a for a, _ in out]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(char_from, char_new, char_to, n_tokens) of each piece; from ``char_new`` on it is new, before it repeats the piece before.

    The new parts of all pieces, one after the other, are the whole text, white space included."""
    starts = [m.start() for m in TOKEN.finditer(text)]
    n = len(starts)
    if n <= limit:
        return [(0, 0, len(text), n)] if n else []
    cuts = tree_pieces(n, Outline(text, starts), limit - overlap, limit)
    out = []
    for i, a in enumerate(cuts):
        b = cuts[i + 1] if i + 1 < len(cuts) else n
        before = max(0, a - overlap)
        out.append((starts[before] if before else 0, starts[a] if a else 0, starts[b] if b < n else len(text), b - before))
    return out


def _split(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                ids = batch.column(0).to_pylist()
                rows: list[tuple] = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if text:
                        rows += [(ids[i], k, *p, text[p[0] : p[2]] if with_text else None) for k, p in enumerate(split_text(text, limit, overlap), 1)]
                types = [batch.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                names = ["item", "piece_no", "char_from", "char_new", "char_to", "n_tokens"]
                if with_text:
                    types, names = [*types, pa.string()], [*names, "piece"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def split_oversized(docs: DataFrame, item: str, text: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """(item, piece_no, char_from, char_new, char_to, n_tokens[, piece]): pieces of at most ``limit`` tokens.

    A text within the limit is one piece; null texts and those without a token have none. Every piece after the first begins with the
    last ``overlap`` tokens before its new part (all of them, where there are fewer). Characters count from 0. Repeated ids are split
    each for itself. One pass over the texts, no shuffle, time in proportion to their length whatever they hold."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    rows = docs.select(F.col(item).alias("item"), F.col(text).alias("text"))
    schema = f"item {dict(rows.dtypes)['item']}, piece_no int, char_from int, char_new int, char_to int, n_tokens int" + ", piece string" * with_text
    return rows.mapInArrow(_split(limit, overlap, with_text), schema)
