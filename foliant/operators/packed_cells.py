"""Several values packed in one field: the dialect of each cell by minimum description length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import bounded_rows, discard, stage

#: What joins entries, and the words for no entry.
DELIMITERS = "|;,/+\n"
NO_ENTRY = ("none", "not found")
#: A word, an end or a value has a code of its own if it is at least this share of all of its kind, so there are at most as many codes as its reciprocal, whatever the data.
CODED_SHARE = 1 / 20_000
#: An end must have been seen so often before its own figures count; below, the last word alone is asked, then all ends together.
SEEN = 20
#: Bits of a spelled-out character, of the choice of a delimiter and of a flag.
CHAR_BITS, DELIMITER_BITS, FLAG_BITS = 5.0, log2(len(DELIMITERS)), 1.0
#: What closes cells at least so often, against what always ends an entry, is taken for an end wherever it stands before a delimiter.
MOSTLY = 0.5
#: No boundary is more certain than this, nor less likely than its complement.
SUREST = 1 - 2**-20
#: Values are counted in whole parts of a cell, so that sums do not depend on their order; fine enough for the 256 parses that a cell may have.
WHOLE = 720_720
#: Stands before the first word.
START = "\x02"
#: Counts of a task are handed on when there are so many.
FLUSH = 200_000
#: Different cells that a task gathers before it counts in them.
CELLS_AT_ONCE = 20_000

#: How far before a place its words are looked for first, and four times as far each time that they are not all there.
LOOK_BACK = 64

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_AT = re.compile("[" + re.escape(DELIMITERS) + "]")
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')


def _value_key(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _key(words: list[str]) -> tuple[str, str] | None:
    words = ["#" if t[0].isdigit() else t.lower() for t in words]
    return (words[0] if len(words) > 1 else "", words[-1]) if words else None


def _end(text: str, at: int) -> tuple[str, str] | None:
    """The last two words before a place, in lower case and with # for numbers; a quote is none."""
    reach = LOOK_BACK
    while True:
        start = max(0, at - reach)
        words = [t for t in _TOKEN.findall(text, start, at) if t != '"']
        if not start or len(words) > 2:  # the first word may be cut, those behind it are whole
            return _key(words[-2:])
        reach *= 4


def _ends(text: str) -> Iterator[tuple[int, str, tuple[str, str] | None]]:
    """(place, delimiter, ``_end`` there) of every delimiter, reading the text once: no word reaches across a delimiter."""
    words, before = [], 0
    for m in _AT.finditer(text):
        at = m.start()
        words = (words + [t for t in _TOKEN.findall(text, before, at) if t != '"'])[-2:]
        before = at
        yield at, m.group(), _key(words)


def _places(text: str) -> list[tuple[int, str, tuple[str, str] | None, int]]:
    """Where a cell might be split: (place, delimiter, last two words before it, last character before it that is no space)."""
    out, before, last = [], 0, -1
    for at, d, end in _ends(text):
        if width := len(text[before:at].rstrip()):
            last = before + width - 1
        out.append((at, d, end, last))
        before = at + 1
        last = last if d.isspace() else at
    return out


class Model:
    """Code lengths of one field: words, ends of entries, values. Without ``end`` the ends are learned from the ends of cells."""

    def __init__(self, end: str | None, counts: dict[str, dict], values: dict[int, int] | None = None, n_values: int = 0) -> None:
        self.complete = re.compile(rf'(?i:{end})"?\s*$') if end else None
        self.given = (end, counts, values or {}, n_values)
        self.words, self.n_words, self.pairs = counts["word"], max(counts["words"], 1), counts["pair"]
        self.ends, self.tails = counts["end"], counts["tail"]
        # entries a cell, as the ends of cells tell it: how often such an end stands before a delimiter for each time it ends the cell
        ratios = sorted((n / c, c) for n, c in self.ends.values() if c and n >= SEEN)
        half, self.per_cell = sum(c for _, c in ratios) / 2, 1.0
        for r, c in ratios:
            self.per_cell = r
            half -= c
            if half <= 0:
                break
        # ends too rare to be known are judged by all of their like
        known = [x for x in self.tails.values() if x[0] >= SEEN]
        n, c = (max(t - sum(x[i] for x in known), 0) for i, t in enumerate(counts["ends"]))
        self.any_end = min(max(self.per_cell * c / n if n else 0.5, 1 - SUREST), SUREST)
        self.values, self.n_values = values or {}, max(n_values, 1)
        self.spelled = lru_cache(maxsize=100_000)(self._spelled)

    def ends_here(self, text: str, at: int, end: tuple[str, str] | None) -> float:
        """The probability that an entry ends before the place ``at``."""
        if self.complete:
            near = max(0, at - LOOK_BACK)
            return SUREST if self.complete.search(text, near, at) or (near and self.complete.search(text, 0, at)) else 1 - SUREST
        for known, key in ((self.ends, end), (self.tails, end[1] if end else None)):
            if key in known and known[key][0] >= SEEN:
                n, c = known[key]
                share = self.per_cell * c / n
                return SUREST if share >= MOSTLY else max(share, 1 - SUREST)
        return self.any_end

    def _spelled(self, value: str) -> float:
        """Each word letter by letter, by its frequency, or by how often it follows the word before it."""
        bits, before = 0.0, START
        for t in _TOKEN.findall(value):
            code = CHAR_BITS * len(t)
            if t != '"' and (n := self.words.get(t)):  # a quote that binds nothing is never expected
                code = min(code, log2(self.n_words / n))
                if (follows := self.pairs.get((before, t))) and before in self.words:
                    code = min(code, log2(self.words[before] / follows))
            bits, before = bits + code, t
        return bits

    def bits(self, value: str) -> float:
        """A value's code length: spelled out word by word, or a pointer into the dictionary, whose spelling all its occurrences share."""
        spelled = self.spelled(value)
        n = self.values.get(_value_key(value), 0) / WHOLE if self.values else 0
        return FLAG_BITS + (min(spelled, log2(self.n_values / n) + spelled / n) if n else spelled)

    def parses(self, text: str) -> list[tuple[float, tuple[str, ...]]]:
        """Every different parse of the cell with the bits of its dialect and of where it splits.

        A dialect is a set of delimiters, whether quotes bind, and whether a delimiter splits everywhere or only where an entry is likely to
        end. Empty slots and the words for no entry are left out."""
        places = _places(text)
        likely = [self.ends_here(text, at, end) for at, _, end, _ in places]
        seen = sorted({d for _, d, _, _ in places}, key=DELIMITERS.index)
        found: dict[tuple[str, ...], float] = {}
        same: dict[str, str] = {}  # parses share their entries
        for mask in (set(c) for k in range(len(seen) + 1) for c in combinations(seen, k)):
            sure = {p >= MOSTLY for (_, d, _, _), p in zip(places, likely, strict=True) if d in mask}
            for guarded in (False, True) if len(sure) > 1 else (False,):
                for quoting in (False, True) if '"' in text else (False,):
                    entries, bits = self._parse(text, places, likely, mask, guarded, quoting)
                    entries = tuple([same.setdefault(e, e) for e in entries])
                    bits += DELIMITER_BITS * len(mask) + FLAG_BITS * (guarded + quoting)
                    if entries not in found or bits < found[entries]:
                        found[entries] = bits
        return [(b, e) for e, b in found.items()]

    def _parse(self, text: str, places: list[tuple], likely: list[float], mask: set[str], guarded: bool, quoting: bool) -> tuple[tuple[str, ...], float]:
        n = len(text)
        out: list[str] = []
        bits, start, i, bound, entry = 0.0, 0, 0, 0, None

        def take(value: str) -> None:
            if value and value.lower() not in NO_ENTRY:
                out.append(value)

        while True:
            if quoting and start >= bound:  # at the start of a slot
                while start < n and text[start].isspace() and text[start] not in mask:
                    start += 1
                bound = n + 1
                if start < n and text[start] == '"' and (m := _QUOTED.match(text, start)):
                    at = m.end()
                    while at < n and text[at].isspace() and text[at] not in mask:
                        at += 1
                    if at >= n or text[at] in mask:
                        entry, bits = m[1].replace('""', '"').strip(), bits + FLAG_BITS
                        while i < len(places) and places[i][0] < at:
                            i += 1
            if i >= len(places):
                take(text[start:].strip() if entry is None else entry)
                return tuple(out), bits
            at, d, _, last = places[i]
            p = likely[i]
            if entry is not None:
                take(entry)
                entry, start, bound = None, at + 1, at + 1
            elif last < start or (at - start < 20 and text[start:at].strip().lower() in NO_ENTRY):
                if d in mask:
                    start = bound = at + 1
            elif d in mask and (not guarded or p >= MOSTLY):
                take(text[start:at].strip())
                bits -= log2(p)
                start = bound = at + 1
            else:
                bits -= log2(1 - p)
            i += 1

    def cheapest(self, text: str) -> tuple[str, ...]:
        """The entries of the parse with the fewest bits; of parses that cost the same the one with fewer entries, then the lesser."""
        parses = self.parses(text)
        if len(parses) == 1:
            return parses[0][1]
        return min((b + sum(map(self.bits, e)), len(e), e) for b, e in parses)[2]


def _counted(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """Partial sums of (field, kind, key) over the cells of a task, handed on before they grow too many."""
    sums: dict[tuple[str, str], Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(f, kind, "\x1f".join(k) if isinstance(k, tuple) else str(_value_key(k)) if kind == "value" else k, n) for (f, kind), c in sums.items() for k, n in c.items() if n]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 3 else pa.string()) for i in range(4)], names=["field_name", "kind", "key", "n"])

    def settle() -> Iterator[pa.RecordBatch]:
        for (field, cell), times in cells.items():
            if field not in of:
                of[field] = {k: sums.setdefault((field, k), Counter()) for k in KINDS}
            count(of[field], field, cell, times)
            if sum(map(len, sums.values())) > FLUSH:
                of.clear()
                yield flush()
        cells.clear()

    cells: Counter = Counter()  # equal cells are looked at once
    of: dict[str, dict[str, Counter]] = {}
    for batch in batches:
        cells.update(zip(batch.column("field_name").to_pylist(), batch.column("cell").to_pylist(), strict=True))
        if len(cells) > CELLS_AT_ONCE:
            yield from settle()
    yield from settle()
    yield flush()


KINDS = ("word", "pair", "end", "tail", "last end", "last tail", "value")


def _count_words_and_ends(sums: dict[str, Counter], field: str, text: str, times: int) -> None:
    tokens = [START, *_TOKEN.findall(text)]
    word, pair = sums["word"], sums["pair"]
    for t in tokens:
        word[t] += times
    for t in zip(tokens, tokens[1:], strict=False):
        pair[t] += times
    for _, _, end in _ends(text):
        if end:
            sums["end"][end] += times
            sums["tail"][end[1]] += times
    # what ends the cell certainly ends an entry; delimiters behind it have counted it above
    if end := _end(text, len(text.rstrip(DELIMITERS + " \t\r\f\v\""))):
        closed = text.rstrip(" \t\r\f\v\"")[-1:] in DELIMITERS
        for kind, key in (("end", end), ("tail", end[1])):
            sums[f"last {kind}"][key] += times
            sums[kind][key] += 0 if closed else times


def _value_counter(ends: dict[str, str | None], counts: dict[str, dict]):
    models = {f: Model(e, counts[f]) for f, e in ends.items()}

    def count(sums: dict[str, Counter], field: str, text: str, times: int) -> None:
        parses, value = models[field].parses(text), sums["value"]
        for _, entries in parses:
            for e in entries:
                value[e] += times * (WHOLE // len(parses))

    return count


_SUMS = "field_name string, kind string, key string, n long"


def _coded(sums: DataFrame, least: dict[str, float] | None = None) -> list:
    """(field_name, kind, key, n, total) of the keys that are common enough for a code, at most 1 / CODED_SHARE of each kind and field. ``least`` says for each field how often that is."""
    totals = sums.groupBy("field_name", "kind").agg(F.sum("n").alias("total"))
    kinds = totals.count()
    enough = F.col("total") * CODED_SHARE
    for field, n in (least or {}).items():
        enough = F.when(F.col("field_name") == field, F.greatest(F.lit(n), enough)).otherwise(enough)
    common = sums.join(F.broadcast(totals), ["field_name", "kind"]).where(F.col("n") >= enough).select("field_name", "kind", "key", "n", "total")
    return bounded_rows(common, int(kinds / CODED_SHARE) + 1, "the list of common words")


def learn(flat: DataFrame, ends: dict[str, str | None]) -> dict[str, Model]:
    """The code lengths of each field, from all cells of (field_name, cell): two passes of partial sums, added up by key; what is sent back is bounded by CODED_SHARE."""
    first = stage(flat.mapInArrow(lambda b: _counted(b, _count_words_and_ends), _SUMS).groupBy("field_name", "kind", "key").agg(F.sum("n").alias("n")), "words")
    counts = {f: {"word": {}, "words": 0, "pair": {}, "end": {}, "tail": {}, "ends": (0, 0)} for f in ends}
    last: dict[tuple, int] = {}
    rows = _coded(first)
    for r in rows:
        of = counts[r["field_name"]]
        if r["kind"] == "word":
            of["word"][r["key"]], of["words"] = r["n"], r["total"]
        elif r["kind"] == "pair":
            of["pair"][tuple(r["key"].split("\x1f"))] = r["n"]
        elif r["kind"].startswith("last "):
            last[r["field_name"], r["kind"][5:], r["key"]] = r["n"]
            of["ends"] = (of["ends"][0], r["total"])
    for r in rows:
        if r["kind"] in ("end", "tail"):
            of = counts[r["field_name"]]
            key = tuple(r["key"].split("\x1f")) if r["kind"] == "end" else r["key"]
            of[r["kind"]][key] = (r["n"], last.get((r["field_name"], r["kind"], r["key"]), 0))
            of["ends"] = (r["total"], of["ends"][1])
    discard(first)
    second = stage(flat.mapInArrow(lambda b: _counted(b, _value_counter(ends, counts)), _SUMS).groupBy("field_name", "kind", "key").agg(F.sum("n").alias("n")), "values")
    values: dict[str, tuple[dict[int, int], int]] = {}
    # a value is coded only if each of its words is, so that no value is cheap for want of their codes
    for r in _coded(second, {f: c["words"] * CODED_SHARE * WHOLE for f, c in counts.items()}):
        values.setdefault(r["field_name"], ({}, r["total"]))[0][int(r["key"])] = r["n"]
    discard(second)
    return {f: Model(e, counts[f], values.get(f, ({}, 0))[0], values.get(f, ({}, 0))[1] / WHOLE) for f, e in ends.items()}


def _entries(models: dict[str, tuple], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {f: Model(*args) for f, args in models.items()}
        read = {f: lru_cache(maxsize=50_000)(m.cheapest) for f, m in made.items()}
        for batch in batches:
            rows: list[tuple] = []
            for i, (field, cell) in enumerate(zip(batch.column("field_name").to_pylist(), batch.column("cell").to_pylist(), strict=True)):
                entries = read[field](cell)
                if len(entries) >= least:
                    rows += [(i, field, k, e) for k, e in enumerate(entries, 1)]
            columns = [batch.column("row_id").take(pa.array([r[0] for r in rows], pa.int64()))]
            columns += [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.string()), (2, pa.int32()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "field_name", "entry_no", "entry_text"])

    return run


def split_packed(rows: DataFrame, row_id: str, fields: list[str] | dict[str, str | None], least: int = 1) -> DataFrame:
    """(row_id, field_name, entry_no, entry_text) of all cells of ``fields`` with ``least`` or more entries.

    Every cell is parsed under each dialect that can differ on it (a set of delimiters, splitting everywhere or only where entries are
    likely to end, quotes binding or not), and the parse with the fewest bits wins, the one with fewer entries where lengths tie. The bits are
    those of the dialect, of each value (spelled out in words by their frequency, or a pointer into a dictionary of values) and of each
    boundary: how likely an entry ends with the words before it, learned from the ends of cells, which no dialect can move. A field may
    come with a regular expression that complete entries end in, which then stands for the learned ends. Null, blank and ``none`` or ``not
    found`` cells have no entries. Repeated rows come out once.

    Counts of words, ends and values are summed in each task, added up by key and cut to those common enough for a code, a bounded
    number whatever the data. The cells themselves are parsed where they lie; what is shuffled is the sums, and the entries for repeated rows."""
    ends = dict(fields) if isinstance(fields, dict) else dict.fromkeys(fields)
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("cell")) for f in ends])
    flat = (
        rows.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("c"))
        .select("row_id", "c.field_name", "c.cell")
        .where(F.col("cell").isNotNull() & ~F.lower(F.trim("cell")).isin("", *NO_ENTRY))
    )
    models = learn(flat.select("field_name", "cell"), ends)
    return flat.mapInArrow(_entries({f: m.given for f, m in models.items()}, least), f"row_id {dict(flat.dtypes)['row_id']}, field_name string, entry_no int, entry_text string").distinct()
