"""The core problem operators against brute force and on the awkward cases."""

import datetime as dt
import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions.docrefs import doc_numbers
from foliant.operators import hierarchy as H
from foliant.operators import orphans as O
from foliant.operators import packed_cells as P
from foliant.operators import strict_load as S
from foliant.operators.components import connected_components
from foliant.operators.intervals import OPEN, IntervalMap, continuous_periods
from foliant.plans.pile import ROLE_END, TARGET_END
from tests.helpers import rows, ts

CARDS = "card_no long, read_at timestamp_ntz, a string, b string, key string, at string"
RECORDS = "doc_id string, added_at timestamp_ntz, removed_at timestamp_ntz, key string"


def refs_of(df):
    return O.reference_deltas(df, ("a", "b"), "card_no", "read_at")


def test_orphans(spark):
    cards = spark.createDataFrame(
        [
            (1, ts("2024-01-02"), "X → doc 7 | Y -> DOC. 8", None, "k", "t"),
            (2, ts("2024-01-05"), "doc 00000007; doc 7", "document 9, doc #10", None, None),
            (3, None, "doc 7", "doc 99", "", ""),
            (4, ts("2024-01-01"), "none", "", None, None),
            (5, ts("2024-01-04"), "doc 7", None, None, None),
            (5, ts("2024-01-04"), "doc 7", None, None, None),
        ],
        CARDS,
    )
    records = spark.createDataFrame(
        [("00000007", ts("2024-01-02"), ts("2024-01-04"), "z"), ("00000010", None, None, "z"), ("00000008", ts("2024-01-03"), None, "z"), (None, ts("2024-01-01"), None, "z")], RECORDS
    )
    deltas = O.existence_deltas(records, "doc_id", "added_at", "removed_at")
    found = O.orphan_references(refs_of(cards), deltas).select("row_id", "field_name", "key")
    # 7 comes at the instant of card 1 and is gone at that of card 5, whose row is repeated; card 3 has no instant and 7 did exist
    assert rows(found.distinct()) == [(1, "a", "00000008"), (2, "a", "00000007"), (3, "b", "00000099"), (5, "a", "00000007")]
    state = O.apply_deltas(None, refs_of(cards), deltas)
    assert {r[0] for r in rows(O.current_orphans(state))} == {"00000007", "00000099"}
    later = O.apply_deltas(state, None, spark.createDataFrame([("00000099", 1)], "key string, delta int"))
    assert {r[0] for r in rows(O.current_orphans(later))} == {"00000007"}


def test_orphans_empty(spark):
    cards, records = spark.createDataFrame([], CARDS), spark.createDataFrame([], RECORDS)
    assert rows(O.orphan_references(refs_of(cards), O.existence_deltas(records, "doc_id", "added_at", "removed_at"))) == []
    one = spark.createDataFrame([(1, ts("2024-01-02"), "doc 123456789", "x" * 200_000 + " doc 5", None, None)], CARDS)
    assert rows(O.orphan_references(refs_of(one), O.existence_deltas(records, "doc_id", "added_at", "removed_at")).select("key")) == [("00000005",), ("123456789",)]


def test_orphans_against_brute_force(spark):
    rnd = random.Random(4)
    day = lambda: ts("2024-01-01") + dt.timedelta(days=rnd.randrange(12))
    recs = [(f"{k:08d}", day(), rnd.choice([None, day()]), "") for k in range(20)]
    cards = [(n, day(), f"doc {rnd.choice([rnd.randrange(25), 3])}", None, None, None) for n in range(300)]
    want = {(n, "a", k) for n, at, a, *_ in cards for k in [f"{int(a[4:]):08d}"] if not any(r[0] == k and r[1] <= at and (r[2] is None or r[2] > at) for r in recs)}
    got = O.orphan_references(refs_of(spark.createDataFrame(cards, CARDS)), O.existence_deltas(spark.createDataFrame(recs, RECORDS), "doc_id", "added_at", "removed_at"))
    assert {tuple(r)[:3] for r in got.collect()} == want


def brute_periods(terms):
    days = sorted({d for s, e in terms for d in range(s, min(e, 400) + 1)})
    out = []
    for d in days:
        if out and d == out[-1][1] + 1:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), max_size=25))
def test_interval_map(terms):
    terms = [(s, s + n) for s, n in terms]
    m = IntervalMap()
    for s, e in terms:
        m.insert(s, e)
    assert list(zip(m.starts, m.ends, strict=True)) == brute_periods(terms)


def test_periods(spark):
    d = dt.date
    terms = [
        ("f", d(2024, 1, 1), d(2024, 1, 10), False), ("f", d(2024, 1, 11), d(2024, 1, 12), False), ("f", d(2024, 1, 3), d(2024, 1, 4), False),
        ("f", d(2024, 2, 1), None, True), ("f", d(2024, 3, 1), d(2024, 3, 2), False), ("g", d(2024, 1, 1), d(2023, 1, 1), False),
        ("g", None, d(2024, 1, 1), False), (None, d(2024, 1, 1), d(2024, 1, 1), False), ("h", d(2024, 5, 5), d(2024, 5, 5), None), ("h", d(2024, 5, 5), d(2024, 5, 5), None),
    ]
    df = spark.createDataFrame([(*t, "x", 1) for t in terms], "who string, a date, z date, o boolean, key string, s int")
    assert rows(continuous_periods(df, "who", "a", "z", "o")) == [
        ("f", "gap", "2024-01-13", "2024-01-31"), ("f", "period", "2024-01-01", "2024-01-12"), ("f", "period", "2024-02-01", "open"), ("h", "period", "2024-05-05", "2024-05-05")
    ]
    assert rows(continuous_periods(df.where("false"), "who", "a", "z", "o")) == []
    assert OPEN > 3_000_000


def test_strict_load(spark):
    closed = {"k": ("yes", "no")}
    lines = ['1,a,yes', '2,"a, ""b""",No ', '3,a"b,yes', '4,"a"b,yes', '5,a', '6,a,maybe', '7,,', None, "", '8,"x\ny",YES', '9,"open,yes', "10,a,b,c,yes", '11,"' + "z" * 100_000 + '",yes']
    raw = spark.createDataFrame([(i, x, "c") for i, x in enumerate(lines)], "n long, raw string, line string")
    bad = S.rejected_lines(raw, "n", "raw", ("i", "t", "k"), closed)
    assert rows(bad) == sorted(
        [(2, "quoting"), (3, "quoting"), (4, "columns"), (5, "k"), (6, "k"), (7, "quoting"), (8, "columns"), (10, "quoting"), (11, "columns")], key=repr
    )
    good = {r["row_no"]: r for r in S.load_lines(raw, "n", "raw", ("i", "t", "k"), closed).collect()}
    assert set(good) == {0, 1, 9, 12} and good[1]["t"] == 'a, "b"' and good[9]["t"] == "x\ny" and len(good[12]["t"]) == 100_000
    assert rows(S.rejected_lines(raw.where("false"), "n", "raw", ("i", "t", "k"), closed)) == []
    # one offset twice, one row good and one bad; an offset that is null
    two = spark.createDataFrame([(1, "1,a,yes", ""), (1, "1,a,never", ""), (None, "x", ""), (None, "1,a,no", "")], "n long, raw string, line string")
    assert rows(S.rejected_lines(two, "n", "raw", ("i", "t", "k"), closed)) == [(1, "k"), (None, "columns")]
    answers = spark.createDataFrame([(1, "yes", "q"), (2, None, "q"), (3, " NO\t", "q"), (4, "", "q"), (4, "", "q")], "n long, k string, row_no string")
    assert rows(S.rejected_answers(answers, "n", closed)) == [(2, "k"), (4, "k"), (4, "k")]


ENDS = {"a": ROLE_END, "b": TARGET_END}


def split(spark, cells, least=1):
    df = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(cells)], "id long, a string, b string, cell string")
    out = {}
    for i, f, n, t in rows(P.split_packed(df, "id", ENDS, least)):
        out.setdefault((i, f), {})[n] = t
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_packed_cells(spark):
    a, b, c = "A & Sons, Ltd (guarantor)", "B / C; D plc (other)", 'The "E" (parent listed)'
    cells = [
        (f"{a} | {b}", None), (f"{a}, {b}, {a}", None), (f'"{a}"; {b};', None), (f"{a}\n\n{b}", None), (f"{a}|{b};{a}", None), (a, "none"), ("not found", ""),
        ('"The ""E"" (parent listed)" | ' + a, "X; Annex 2 -> doc 5; Y → not in pile"), (f" | {a} | | {b} ", 'Z "q" => doc  7 + "W ""v"" → Doc. 8"'), (None, None), (f"{c}", " "),
    ]
    got = split(spark, cells * 2)
    assert got[0, "a"] == [a, b] and got[1, "a"] == [a, b, a] and got[2, "a"] == [a, b] and got[3, "a"] == [a, b] and got[4, "a"] == [a, b, a]
    assert got[5, "a"] == [a] and (5, "b") not in got and (6, "a") not in got and (10, "b") not in got
    assert got[7, "a"] == ['The "E" (parent listed)', a] and got[7, "b"] == ["X; Annex 2 -> doc 5", "Y → not in pile"]
    assert got[8, "a"] == [a, b] and got[8, "b"] == ['Z "q" => doc  7', 'W "v" → Doc. 8'] and got[10, "a"] == [c]
    assert (5, "a") not in split(spark, cells, least=2)
    assert split(spark, []) == {}


def test_packed_cells_long_and_repeated(spark):
    many = " | ".join(f"Firm{i} Ltd (other)" for i in range(3000))
    df = spark.createDataFrame([(1, many, None), (1, many, None), (1, "Q (other); R (other)", None)], "id long, a string, b string")
    got = rows(P.split_packed(df, "id", ENDS))
    assert len(got) == 3002 and (1, "a", 2, "R (other)") in got


NAMES = ["Halden, Weir & Co", "Marlow Ltd", "Orrin/Pike LLP", "Tessel + Brandt", "Quill Group", "Varga Holdings", "Nettle & Sons", "Osprey Shipping Inc"]


def test_packed_cells_without_known_ends(spark):
    """Nothing is known of what entries end in, and some hold delimiters themselves: the description length decides."""
    rnd = random.Random(7)
    want = {i: [rnd.choices(NAMES, range(8, 0, -1))[0] for _ in range(rnd.choice([1, 2, 2, 3, 4]))] for i in range(2000)}
    df = spark.createDataFrame([(i, rnd.choice(["; ", " | "]).join(e)) for i, e in want.items()], "id long, f string")
    got = {}
    for r in sorted(P.split_packed(df, "id", ["f"]).collect(), key=lambda r: (r["row_id"], r["entry_no"])):
        got.setdefault(r["row_id"], []).append(r["entry_text"])
    assert sum(got[i] == e for i, e in want.items()) >= 0.99 * len(want)


def test_packed_cells_of_many_delimiters(spark):
    """Some of five or six different delimiters split a cell, the others belong to names, and the words before them tell little: every set is a dialect."""
    rnd = random.Random(7)
    twin = "Old Hall, Old Hall/Old Hall + Old Hall"
    names = ["Quill Group", "Varga Holdings", "Osprey Works", "Marlow Ltd", twin]
    cells = [rnd.choice(["; ", " | ", "\n"]).join(rnd.choices(names, k=rnd.choice([1, 2, 2, 3, 4]))) for _ in range(2000)]
    cells += [f"{twin} | {twin}; Quill Group", f"{twin} | Marlow Ltd; {twin}; Quill Group"]
    got = {}
    for r in sorted(P.split_packed(spark.createDataFrame(list(enumerate(cells)), "id long, f string"), "id", ["f"]).collect(), key=lambda r: (r["row_id"], r["entry_no"])):
        got.setdefault(r["row_id"], []).append(r["entry_text"])
    assert got[2000] == [twin, twin, "Quill Group"] and got[2001] == [twin, "Marlow Ltd", twin, "Quill Group"]
    m = P.Model(None, {"word": {}, "words": 0, "pair": {}, "end": {}, "tail": {}, "ends": (0, 0)})
    cell = "a|b;c,d/e+f\ng"
    sets = [set(x) for k in range(7) for x in itertools.combinations(P.DELIMITERS, k)]
    assert {e for _, e in m.parses(cell)} == {tuple("".join(" " * 9 if x in s else x for x in cell).split(" " * 9)) for s in sets}


def test_packed_cells_far_ends():
    """Words are seen however far before a place or however long they are."""
    long = "a" * 500
    assert P._end("x Ltd" + " " * 300, 305) == ("x", "ltd") and P._end(f"{long} {long}", 1001) == (long, long)
    cell = f"Foo, Bar{' ' * 80}| Quux {long}; Doc 7 (other)"
    assert [(at, d, end) for at, d, end, _ in P._places(cell)] == [(m.start(), m.group(), P._end(cell, m.start())) for m in P._AT.finditer(cell)]
    assert P._places(cell)[1][2] == (",", "bar") and P._places(cell)[2][2] == ("quux", long)
    m = P.Model(r"\(other\)", {"word": {}, "words": 0, "pair": {}, "end": {}, "tail": {}, "ends": (0, 0)})
    text = "A (other)" + " " * 100 + "; B"
    assert m.ends_here(text, text.index(";"), None) == P.SUREST


def test_packed_cells_partial_sums(monkeypatch):
    """A task hands its counts on between cells, too, however many parses they have."""
    cells = [f"a{i}|b;c,d/e+f\ng{i}" for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"field_name": ["f"] * 30, "cell": cells})
    count = P._value_counter({"f": None}, {"f": {"word": {}, "words": 0, "pair": {}, "end": {}, "tail": {}, "ends": (0, 0)}})

    def sums(flush):
        monkeypatch.setattr(P, "FLUSH", flush)
        out, total = list(P._counted(iter([batch]), count)), Counter()
        for b in out:
            for r in b.to_pylist():
                total[r["kind"], r["key"]] += r["n"]
        return max(b.num_rows for b in out), total

    (most, whole), (few, parts) = sums(10**9), sums(50)
    assert parts == whole and few < most / 5


def test_packed_cells_code_lengths():
    counts = {"word": {P.START: 10, "a": 8, "b": 4, '"': 6}, "words": 32, "pair": {(P.START, "a"): 5, ("a", "b"): 4}, "end": {}, "tail": {}, "ends": (0, 0)}
    m = P.Model(None, counts, {P._value_key("a b"): 4 * P.WHOLE}, 16)
    assert m.spelled("a b") == 1 + 1 and m.spelled("b") == 3 and m.spelled("zz") == 10 and m.spelled('"') == 5
    assert m.bits("a b") == 1 + min(2, 2 + 2 / 4) and m.bits("b") == 1 + 3
    assert P._end('x Doc. 00012 " ', 15) == (".", "#") and P._end("", 0) is None and P._end("A", 1) == ("", "a")


def naive_tree(links):
    out = {}
    for n in links:
        seen, x, up = set(), n, []
        while x in links and x not in seen:
            seen.add(x)
            x = links[x]
            up.append(x)
        out[n] = ("cycle", -1, None) if x in links else (x, len(up), up)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy(spark, seed):
    rnd = random.Random(seed)
    links = {f"n{i}": f"n{rnd.randrange(max(1, i - 3), i + (3 if rnd.random() < 0.05 else 0)) if i > 1 else 0}" for i in range(1, 120)}
    links |= {f"c{i}": f"c{i + 1}" for i in range(150)} | {"x": "y", "y": "z", "z": "x", "w": "x", "s": "s"}
    df = spark.createDataFrame([(a, b, 0) for a, b in links.items()] + [(None, "x", 0), ("q", None, 0), ("x", "y", 0)], "a string, b string, node int")
    got = {r["node"]: (r["root"], r["depth"], r["up"]) for r in H.resolve(H.parent_links(df, "a", "b")).collect()}
    assert got == naive_tree(links)
    r = H.resolve(H.parent_links(df, "a", "b"))
    assert dict(rows(H.paths(r)))["c148"] == "c150/c149/c148" and dict(rows(H.paths(r)))["x"] is None
    assert dict(rows(H.descendant_counts(r)))["c150"] == 150


def test_all_descendants(spark):
    """Lists of descendants, of documents in and above circles too, and counts without pairs."""
    rnd = random.Random(5)
    links = {f"n{i}": f"n{rnd.randrange(max(0, i - 4), i)}" for i in range(1, 90)} | {f"c{i}": f"c{i + 1}" for i in range(70)}
    links |= {"x": "y", "y": "z", "z": "x", "w": "x", "v": "w", "s": "s", "t": "s"} | {f"r{i}": f"r{(i + 1) % 11}" for i in range(11)}
    pairs = set()
    for n in links:
        x = n
        while x in links and (links[x], n) not in pairs:
            x = links[x]
            pairs.add((x, n))
    df = spark.createDataFrame(list(links.items()), "node string, parent string")
    assert rows(H.all_descendants(df)) == sorted((p for p in pairs if p[0] != p[1]), key=repr)
    acyclic = {n for n in links if naive_tree(links)[n][0] != "cycle"}
    assert dict(rows(H.count_descendants(df))) == dict(Counter(a for a, n in pairs if n in acyclic))
    assert rows(H.count_descendants(df.where("false"))) == rows(H.all_descendants(df.where("false"))) == []


def test_hierarchy_ties_and_empty(spark):
    df = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "b")], "a string, b string")
    assert rows(H.resolve(H.parent_links(df, "a", "b"), with_path=False)) == [("a", "b", 1)]
    assert rows(H.resolve(H.parent_links(df.where("false"), "a", "b"))) == []


def test_components(spark):
    e = [("a", "b"), ("b", "c"), ("x", "y"), (None, "q"), ("z", "z")] + [(f"h{i:02d}", "hub") for i in range(50)] + [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(40)]
    got = dict(rows(connected_components(spark.createDataFrame(e, "a string, b string"))))
    assert got["c"] == got["a"] == "a" and got["y"] == "x" and got["hub"] == "h00" and got["k040"] == "k000" and got["z"] == "z" and "q" not in got
    assert rows(connected_components(spark.createDataFrame([], "a string, b string"))) == []


def test_doc_numbers(spark):
    df = spark.createDataFrame([("Doc. 12 → doc:3, document 4, DOC 123456789, doc#0005",), (None,)], "c string")
    assert [r[0] for r in df.select(doc_numbers(df.c)).collect()] == [["00000012", "00000003", "123456789", "00000005"], []]
