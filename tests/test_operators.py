"""Functions and operators of the intake kit on small fixtures."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from foliant.functions import dates as D
from foliant.functions import text as T
from foliant.operators import changes as C
from foliant.operators import forms as Q
from foliant.operators import graph as G
from foliant.operators import ledger as L
from foliant.operators import matching as M
from foliant.operators import units as U
import __spark_entry__ as entry
from tests.helpers import rows


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_names(spark):
    assert one(spark, T.norm_name, "  Acme   LTD ", None) == ["acme ltd", ""]
    assert one(spark, T.group_key, "The Acme Svcs Ltd.", "Acme & Co", "Acme plc", None) == ["acme services limited", "acme and company", "acme public limited company", ""]
    assert one(spark, T.core_name, "Acme Holdings Ltd", "Acme plc", "Ltd Inc", "Acme GmbH (No. 1234567)") == ["acme holdings", "acme", "", "acme"]
    assert [sorted(x) for x in one(spark, T.distinctive_tokens, "The Northern Light Power Company", "ab")] == [["light", "northern"], []]
    assert one(spark, T.strip_role, "Acme (UK) Ltd (signatory)", "Acme") == ["Acme (UK) Ltd", "Acme"]
    assert one(spark, T.entity_number, "Acme Ltd (company number SC123456)", "Acme") == ["SC123456", ""]
    assert one(spark, lambda c: F.transform(T.entity_lines(c), lambda e: e["name"]), "Acme Ltd; none\nBeta (the Customer)") == [["Acme Ltd", "Beta"]]
    assert one(spark, T.ref_key, "AB/12-3", "n/a") == ["ab123", ""]


def test_slugs_and_cells(spark):
    assert one(spark, T.name_slug, "Größe  & Co..", "Æon Łód", None) == ["Grosse-Co", "AEon-Lod", ""]
    assert one(spark, T.kind_slug, "Purchase order", "NDA", "not found", "Some new kind of paper", "~~") == ["order", "nda", "", "some-new-kind", "other"]
    assert one(spark, T.safe_name, 'a<b>:"c"?.', "con.txt") == ["a_b___c__", "_con.txt"]
    assert one(spark, lambda c: T.truncated(c, 5), "abcdef", "abc", None) == ["abcd…", "abc", ""]
    assert one(spark, T.first_line, "\n  \n x y \nz", "", None) == ["x y", None, None]
    assert one(spark, T.md_cell, "a|b\n c") == ["a\\|b c"]
    assert one(spark, T.natural_id, "7", "1234", "a") == ["007", "1234", "a"]
    assert one(spark, lambda c: T.stable_id("n", c), "A  b") == one(spark, lambda c: T.stable_id("n", c), "a B")
    assert one(spark, T.tolerant_int, "1,234", "1_0", "-3", "unknown", "2.9", None) == [1234, 10, None, None, 2, None]
    assert one(spark, lambda c: T.clock(c.cast("long")), "0", "25950", "42500", "2172000", "3840000") == ["0s", "25.9s", "42.5s", "36m 12s", "1h 04m"]


def test_references_and_quotes(spark):
    assert one(spark, T.cited_pages, "pp.4-6, p. 9 and page 9", "p.3-1", None) == [[4, 5, 6, 9], None, []]
    assert one(spark, T.cited_pages, "pp 4-6, p 9", "12", "P6 (p.2)", "P6", "page 0", "pages 1-20000") == [[4, 5, 6, 9], [12], [2], [6], None, None]
    assert len(one(spark, T.cited_pages, "pages 1-700")[0]) == 700
    assert one(spark, T.cited_paragraphs, "¶ 3, paragraphs 5–7 and paras. 9", "para 4", "¶ 4-2") == [[3, 5, 6, 7, 9], [], None]
    assert one(spark, T.cited_clauses, "cl.4.2 clause 7", "section 4.2, §7", "Clause 8.1A cl 3", None) == [["4.2", "7"], ["4.2", "7"], ["8.1A", "3"], []]
    assert one(spark, T.mm_label, 'a "b" [c]|<d>\n#', None) == ["a 'b' #91;c#93;#124;#60;d#62; #35;", ""]
    assert one(spark, T.evidence_quotes, 'p.3: "a b" | cl.2: “c” and "d"', "p.3: plain words | none", None) == [["a b", "c", "d"], ["plain words"], []]
    assert one(spark, lambda c: T.plain_tracked(T.merge_tracked(c)), "a {+b+}{+c+} {-d-}") == ["a bc d"]
    assert one(spark, lambda c: T.quoted_in(F.lit("a  b"), c), "x a\nb y", "ab", None) == [True, False, False]
    assert one(spark, lambda c: T.closed_labels(c, ("Draft", "Signed by all parties")), "draft (v3)", "Signed by all parties | x", "Other", "-") == [["Draft"], ["Signed by all parties"], [], []]
    assert one(spark, lambda c: T.closed_labels(c, ("A", "B", "A, B"), True), "a; b", "A, B") == [["A", "B"], ["A, B", "A", "B"]]


def test_filed_names(spark):
    from pyspark.sql import functions as F

    fit = lambda parts, suffix, n: spark.range(1).select(T.fitted_name(F.array(*map(F.lit, parts)), F.lit(suffix), n)).first()[0]
    assert fit(["001", "nda", "", "Acme"], ".pdf", 120) == "001 nda Acme.pdf"
    assert fit(["001", "aaaa", "bbbb"], ".x", 12) == "001 aa bbb.x"  # the longest first, the earlier where they tie
    assert fit(["001", "a-a-a-a-", "b"], ".x", 10) == "001 a b.x"
    assert fit(["0123456789", "ab"], ".x", 10) == "01234567.x" and fit(["", ""], "", 10) == "document"
    long = spark.createDataFrame([("7", ".PDF", "master", "Größe " * 60, "2024-01-02", "draft")], "a string, b string, c string, d string, e string, f string")
    name = long.select(T.filed_name(*[F.col(x) for x in "abcdef"])).first()[0]
    assert len(name) == 120 and name.startswith("7 draft-master Gro") and name.endswith(" 2024-01-02.pdf")


def test_dates(spark):
    got = one(spark, lambda c: F.transform(D.dates_in(c), lambda x: x.cast("string")), "on 3 May 2020, then 2019-01-02 and 31.2.2020, March 4th, 2021 to 5/6/2022", None)
    assert got == [["2020-05-03", "2019-01-02", "2021-03-04", "2022-06-05"], []]
    assert one(spark, lambda c: D.whole_date(c).cast("string"), "21st April 2012", "00/00/0000", "spring 2018", " 1 Sep 2020 ", "2020-01-01 x", "9 Mayor 2020") == ["2012-04-21", None, None, "2020-09-01", None, "2020-05-09"]
    df = spark.createDataFrame([(dt.date(2020, 1, 1), None), (dt.date(2030, 1, 1), None), (None, dt.date(2020, 1, 1)), (None, None)], "s date, e date")
    assert [r[0] for r in df.select(D.term_state(df.s, df.e, "2024-01-01")).collect()] == ["live", "future", "ended", "unknown"]


def test_matching(spark):
    ref = spark.createDataFrame([("1", "Acme Ltd"), ("2", "Beta Svcs"), ("3", "Beta Services"), ("4", None)], "id string, n string")
    mine = spark.createDataFrame([("ACME  ltd", 1), ("Acme Limited", 2), ("Beta services", 3), ("Beta Svcs.", 4), (None, 5)], "name string, k int")
    keys = [("same", T.norm_name(F.col("name")), T.norm_name(F.col("n"))), ("key", T.group_key(F.col("name")), T.group_key(F.col("n")))]
    got = {r["k"]: (r["id"], r["basis"]) for r in M.match_by_keys(mine, ref, "id", keys).collect()}
    assert got == {1: ("1", "same"), 2: ("1", "key"), 3: ("3", "same"), 4: (None, None), 5: (None, None)}
    assert rows(M.conflicting_keys(ref, T.group_key(F.col("n")), "id")) == [("beta services", 2)]
    names = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "a b c d"), (4, "a bc"), (5, None)], "i int, n string")
    assert rows(M.longest_prefix(names, "i", F.col("n"))) == [(2, 1), (3, 2)]
    sets = spark.createDataFrame([(1, "g", "a b c d e"), (2, "g", "a b c d"), (3, "g", "x y"), (4, "h", "a b c d"), (5, "g", ""), (6, "g", "a b c d")], "i int, g string, t string")
    near = M.similar_sets(sets, "i", "g", F.filter(F.split("t", " "), lambda x: x != ""), 0.8)
    assert [r[:3] for r in rows(near)] == [("g", 1, 2), ("g", 1, 6), ("g", 2, 6)]
    known = spark.createDataFrame([("h", "acc2", 2), ("h", "acc1", 1)], "k string, a string, o int")
    assert [r["learned_a"] for r in M.learned(known, "k", "a", "o", spark.createDataFrame([("h",), ("x",)], "kk string"), "kk").orderBy("kk").collect()] == ["acc1", None]
    n = M.numbered(spark.createDataFrame([(x,) for x in "dbcae"], "p string"), ["p"], 10)
    assert {r["p"]: r["number"] for r in n.collect()} == {"a": 10, "b": 11, "c": 12, "d": 13, "e": 14}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), (None, "9")], "k string, v string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", "")], "k string, v string")
    assert rows(C.changes(old, new, "k", ["v"])) == [("b", "changed"), ("c", "changed"), ("d", "added")]
    assert C.same_rows(old, old.orderBy(F.desc("k"))).first()[0] and not C.same_rows(old, old.unionByName(old)).first()[0]
    fix = spark.createDataFrame([("a", "v", "x", 1), ("a", "v", "y", 2), ("a", "nope", "z", 3), (None, "v", "q", 4)], "k string, field string, value string, o int")
    assert rows(C.overlay(old, "k", fix, "field", "value", ["o"], ["v"])) == [("a", "y"), ("b", "2"), ("c", None), (None, "9")]
    assert rows(C.missing_and_strays(old, new, "k")) == [("d", "stray")]
    scope = spark.createDataFrame([("a",)], "k string")
    assert rows(C.replay(old, scope, "k", spark.createDataFrame([("a", "n")], "k string, v string"))) == [("a", "n"), ("b", "2"), ("c", None), (None, "9")]


def test_graph(spark):
    s = spark.createDataFrame([("1", "A", ""), ("2", None, "x")], "i string, n string, p string")
    writes = G.node_rows(s, F.col("i"), "doc", F.col("n"), p=F.col("p")).unionByName(G.node_rows(s.limit(1), F.col("i"), "acc", F.lit("Z"), q=F.lit("not_found"), r=F.lit(5)))
    nodes = {r["id"]: (r["label"], r["name"], r["n_labels"], r["properties"]) for r in G.merge_nodes(writes).collect()}
    assert nodes == {"1": ("acc", "Z", 2, {"r": "5"}), "2": ("doc", None, 1, {"p": "x"})}
    labels = spark.createDataFrame([("1", "doc"), ("2", "acc")], "id string, label string")
    edges = spark.createDataFrame([("1", "2", "t"), ("2", "1", "t"), ("1", "9", "t"), ("8", "1", "t"), ("1", "2", "u"), ("1", "1", "v"), ("1", "2", "v")], "src string, dst string, type string")
    types = spark.createDataFrame([("t", "doc|x", "acc"), ("v", "any", "same type")], "type string, from_types string, to_types string")
    faults = {tuple(r)[:3]: r["fault"] for r in G.check_edges(edges, labels, types).collect()}
    assert faults == {("1", "2", "t"): None, ("2", "1", "t"): "labels", ("1", "9", "t"): "missing target", ("8", "1", "t"): "missing source", ("1", "2", "u"): "unknown type", ("1", "1", "v"): None, ("1", "2", "v"): "labels"}
    assert rows(G.placeholders(edges, labels, "p")) == [("9", "p")]
    m = spark.createDataFrame([("T", "a", None), ("T", "b", "a"), ("U", "c", "d"), ("U", "d", "c")], "t string, n string, p string")
    assert rows(G.tree_roots(m, "t", "n", "p")) == [("T", "a"), ("U", "c")]
    status = spark.createDataFrame([("a", "active"), ("b", "provisional"), ("c", "active")], "id string, status string")
    ends = spark.createDataFrame([("a", dt.date(2020, 1, 1), "superseded"), ("a", dt.date(2021, 1, 1), "terminated"), ("c", dt.date(2030, 1, 1), "terminated")], "dst string, effective date, status string")
    parts = spark.createDataFrame([("b", "a")], "src string, dst string")
    assert rows(G.settle(status, ends, parts, "2024-01-01")) == [("a", "terminated"), ("b", "parent ended"), ("c", "active")]


SCHEMA = {
    "type": "object", "required": ["id", "parts"], "additionalProperties": False,
    "properties": {"id": {"type": "string", "pattern": "^[0-9]+$"}, "day": {"anyOf": [{"type": "string", "format": "date"}, {"const": "not_found"}]}, "kind": {"enum": ["a", "b"]}, "parts": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/defs/part"}}, "layered": {"type": "boolean"}},
    "if": {"properties": {"kind": {"const": "b"}}, "required": ["kind"]}, "then": {"required": ["layered"]},
    "defs": {"part": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2}}}},
}


def test_forms(spark):
    forms = [
        ("1", '{"id": "7", "parts": [{"name": "ab"}], "day": "2024-02-29"}'), ("2", '{"id": "x", "parts": [], "day": "2023-02-29", "odd": 1}'),
        ("3", '{"id": "1", "id": "2", "parts": [1]}'), ("4", None), ("5", '{"id": "1", "kind": "b", "parts": [{"name": "a"}, {"name": "a"}]}'),
    ]
    df = spark.createDataFrame([(*f, 0) for f in forms], "f string, b string, path int")
    assert rows(Q.validate_forms(df, "f", "b", SCHEMA)) == sorted(
        [("2", "$.day", "anyOf"), ("2", "$.id", "pattern"), ("2", "$.odd", "additionalProperties"), ("2", "$.parts", "minItems"), ("3", "$", "json"), ("4", "$", "json")]
        + [("5", "$.layered", "required"), ("5", "$.parts", "uniqueItems"), ("5", "$.parts[0].name", "minLength"), ("5", "$.parts[1].name", "minLength")], key=repr
    )
    leaves = Q.form_leaves(spark.createDataFrame([("1", '{"a": {"b": "x", "b_evidence": 1}, "l": ["not_found", {"c": null}]}')], "f string, b string"), "f", "b")
    assert rows(leaves) == [("1", "a_b", "x"), ("1", "l", "not_found"), ("1", "l_c", "")]
    assert rows(Q.form_health(leaves)) == [("a_b", 1, 0, 0), ("l", 0, 1, 0), ("l_c", 0, 1, 0)]
    units = spark.createDataFrame([("1", 1, "the  exact words"), ("1", 2, " ")], "form string, unit_no int, body string")
    ev = spark.createDataFrame([("1", 1, "p.1", "exact words"), ("1", 1, "p.1", "other"), ("1", 2, "p.2", "x"), ("1", 3, "p.3", "x"), ("1", 1, "p.1", "w " * 41)], "form string, unit_no int, ref string, words string")
    assert [r["fault"] for r in sorted(Q.check_evidence(ev, units).collect(), key=lambda r: (r["ref"], r["words"]))] == [None, "not verbatim", "too long", "scan", "no such unit"]


def test_units_and_ledger(spark):
    d = spark.createDataFrame([(1, "x === page 1 ===\na b\n=== page 2 ===\nc d e"), (2, None), (3, "")], "i int, t string")
    u = U.text_units(d, "i", "t", r"=== page (\d+) ===")
    assert [r[2].strip() for r in rows(u)] == ["a b", "c d e"]
    assert [r[2] for r in rows(U.bounded_packet(u, "i", "unit_no", "body", 3))] == ["a b", "c"]
    assert one(spark, U.guess_language, "the cat of the house is in and by to", "der die das und ist", "le", None) == ["en", "de", None, None]
    led = [
        (1, "sort", "filer", "m", "a", "1", "ok", "1,000", "10", "2"), (2, "sort", "filer", "l", "a", "2", "error", "unknown", "x", None),
        (3, "sort", "judge", "m", "b", "1", "OK ", "50", None, "0"), (4, None, None, " ", None, "", None, "", None, None),
    ]
    df = spark.createDataFrame(led, "ledger_no long, stage string, role string, model string, target string, attempt string, outcome string, tokens string, duration_ms string, units_read string")
    got = {r["role"]: r for r in L.rollup_by_role(df).collect()}
    f, total = got["filer"], got[None]
    assert (f["agents"], f["retries"], f["failures"], f["tokens"], f["unknown_tokens"], f["targets"], f["unit_tokens"], f["units"], f["models"]) == (2, 1, 1, 1000, 1, 1, 1000, 2, "m, l")
    assert (total["agents"], total["targets"], total["models"], total["is_total"]) == (3, 2, "m, l", 1)
    assert rows(L.extrapolate(df, 10)) == [("filer", "per document", 1000, 10000), ("judge", "per account", 50, None)]


def test_small_helpers(spark, tmp_path):
    from foliant.functions.cascade import first_match
    from foliant.sources import tables

    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert [r[0] for r in df.select(first_match([(df.x > 3, "big"), (df.x > 0, F.lit("small"))], "none")).collect()] == ["small", "big", "none"]
    assert df.select(first_match([], "d")).first()[0] == "d"
    old, new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), spark.createDataFrame([("b", 9)], "k string, v int")
    assert rows(C.upsert(old, ["k"], new)) == [("a", 1), ("b", 9), (None, 3)]
    assert C.same_coverage(old, old.unionByName(old), "k").first()[0] and not C.same_coverage(old, new, "k").first()[0]
    (tmp_path / "erp_1.csv").write_text("a")
    assert tables.control_file(spark, str(tmp_path), "erp*").endswith("erp_1.csv") and tables.control_file(spark, str(tmp_path), "x*") is None
    (tmp_path / "erp_2.csv").write_text("a")
    with pytest.raises(tables.BadTable):
        tables.control_file(spark, str(tmp_path), "erp*")
    assert tables.as_at_in_headers(["Name", "Status (as at the day 2026-06-01)"]) == "2026-06-01" and tables.as_at_in_headers(["as at"]) is None


def test_empty_tables(spark):
    e = spark.createDataFrame([], "a string, b string, c string")
    assert rows(M.similar_sets(e, "a", "b", F.split("c", " "), 0.8)) == rows(C.changes(e, e, "a", ["b"])) == rows(G.tree_roots(e, "a", "b", "c")) == []
    assert C.same_rows(e, e).first()[0] is True
    with pytest.raises(ValueError, match="more than"):
        from foliant.session import bounded_rows

        bounded_rows(spark.range(5), 4, "it")


def test_parents_by_words(spark, tmp_path):
    cards = [
        (1, "1", "f", "Baslitket Supply Deed", None, None), (2, "2", "f", "Closing Letter", "Supply Deed 'Baslitket' -> doc 9; Closing Letter dated 3 May 2019 → not in pile", "doc 1"),
        (3, "3", "f", "Freight Annex", "Freight Annex => doc 00000004", None), (4, "4", "f", "Freight Annex", None, "doc 00000003 (draft)"), (5, "5", "f", "Freight Annex 2020", "Freight Annex", None),
        (6, "6", "g", "Site Letter", "Freight Annex", "doc 00000003"), (7, "00000003", "g", "Site Letter", None, None), (8, "8", "h", "Freight Annex", "Freight Annex; x", None), (9, "9", "h", "Freight Annex", None, None),
    ]
    spark.createDataFrame(cards, "card_no long, doc_id string, pile_folder string, q1_title string, q6_attaches_to string, q9_copy_or_draft_of string").write.parquet(f"{tmp_path}/cards.parquet")
    q = entry.queries()
    # two documents qualify for card 5; card 3 has two others; card 8 has one besides itself; "g" has no such title
    assert rows(q["parents_by_words"](spark, str(tmp_path))) == [(2, 1, "1"), (8, 1, "9")]
    assert rows(q["copy_instruments"](spark, str(tmp_path))) == [(4, "00000003", False), (6, "00000003", True)]
    pairs = [("A/1", "x", "a 1", "y"), ("A/1", "x", "B", "x"), (None, "Supply Deed One", "B", "Supply Deed One Two"), (None, "Supply Deed", None, "Rebate Note"), (None, None, None, "Rebate Note")]
    df = spark.createDataFrame(pairs, "ra string, ta string, rb string, tb string")
    assert [r[0] for r in df.select(T.same_instrument(df.ra, df.ta, df.rb, df.tb)).collect()] == [True, False, True, False, True]
    # titles of more than six words are found, too
    long = "one two three four five six seven eight"
    spark.createDataFrame([(1, "1", "f", long, None), (2, "2", "f", "x", f"see {long} below")], "card_no long, doc_id string, pile_folder string, q1_title string, q6_attaches_to string").write.parquet(f"{tmp_path}/long/cards.parquet")
    assert rows(q["parents_by_reference"](spark, f"{tmp_path}/long")) == [(2, "1")]


def cards_with(spark, path, *cards):
    """Cards with the given fields; all others are null."""
    fields = ["doc_id", "pile_folder", *[f"q{n}_evidence" for n in (2, 3, 4, 6, 7)], "q1_title", "q2_our_entity", "q3_signed", "q4_start_date", "q4_end", "q6_attaches_to", "q6_replaces", "q8_countries"]
    data = [(n, *[c.get(f) for f in fields]) for n, c in enumerate(cards, 1)]
    spark.createDataFrame(data, ", ".join(["card_no long", *[f"{f} string" for f in fields]])).write.parquet(f"{path}/cards.parquet")


def test_pages_cited(spark, tmp_path):
    cards_with(spark, tmp_path, {"doc_id": "1", "q2_evidence": "p.1", "q4_evidence": "pp.3-5", "q7_evidence": "p.1 p.9"}, {"doc_id": "2", "q7_evidence": "page 2"}, {"doc_id": "3"})
    assert rows(entry.queries()["pages_cited"](spark, str(tmp_path))) == [("1", 5), ("2", 1)]


def test_quotes_of_all_evidence(spark, tmp_path):
    long = " ".join(["word"] * 16)
    cards_with(spark, tmp_path, {"doc_id": "00000001", "q2_evidence": f'p.1: "{long}"', "q3_evidence": 'p.2: "not there"', "q4_evidence": "not found", "q7_evidence": 'p.3: "a  b" | p.4: "c"'})
    spark.createDataFrame([(1, "x a b y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    assert rows(q["quoted_words"](spark, str(tmp_path))) == [(1, "q2_evidence", 0, long, 16), (1, "q3_evidence", 0, "not there", 2), (1, "q7_evidence", 0, "a  b", 2), (1, "q7_evidence", 1, "c", 1)]
    assert rows(q["overlong_quotes"](spark, str(tmp_path))) == [(1, "q2_evidence", 16)]
    assert rows(q["quoted_passages"](spark, str(tmp_path))) == [(1, "q2_evidence", 0, False), (1, "q3_evidence", 0, False), (1, "q7_evidence", 0, True), (1, "q7_evidence", 1, False)]


def test_relation_circles(spark, tmp_path):
    cards_with(
        spark, tmp_path,
        {"doc_id": "00000001", "q6_attaches_to": "X -> doc 7; Y -> doc 2"}, {"doc_id": "00000002", "q6_attaches_to": "X -> doc 8; Y -> doc 1", "q6_replaces": "doc 3"},
        {"doc_id": "00000003", "q6_attaches_to": "X -> doc 9; Y -> doc 2", "q6_replaces": "doc 4"}, {"doc_id": "00000004", "q6_replaces": "doc 1"}, {"doc_id": "00000005", "q6_replaces": "doc 5"},
        {"doc_id": "00000001", "q6_attaches_to": "none"}, *[{"doc_id": f"{n:08}", "q6_attaches_to": f"doc {n + 1}"} for n in range(20, 31)],
    )
    # circles through the second link, within one relation; 2, 3, 4 and 1 are none, as two relations take part; a chain of eleven is none
    want = [("forms_part_of", "00000001"), ("forms_part_of", "00000002"), ("forms_part_of", "00000003"), ("supersedes", "00000005")]
    assert rows(entry.queries()["relation_circles"](spark, str(tmp_path))) == want
    edge = lambda *e: spark.createDataFrame(e, "src string, dst string, type string")
    assert rows(G.circle_nodes(edge((None, "a", "t"), ("a", None, "t"), ("a", "b", "t")))) == []


def test_all_answer_fields(spark, tmp_path):
    full = {f: "x" for f in ("q1_title", "q2_our_entity", "q3_signed", "q4_start_date", "q4_end", "q6_attaches_to", "q6_replaces", "q8_countries")}
    cards_with(
        spark, tmp_path, {**full, "doc_id": "1", "pile_folder": "f"}, {**full, "doc_id": "1", "pile_folder": "f", "q1_title": " X", "q4_end": "y", "q2_our_entity": None},
        {**full, "doc_id": "2", "pile_folder": "f", "q6_replaces": "see p.4", "q2_evidence": None}, {**full, "doc_id": "2", "pile_folder": "f", "q6_replaces": "SEE p.4 ", "q3_signed": "Not  found"},
    )
    q, d = entry.queries(), str(tmp_path)
    assert rows(q["answer_conflicts"](spark, d)) == [("1", "q2_our_entity, q4_end"), ("2", "q3_signed")]
    assert rows(q["answer_flags"](spark, d)) == [(2, "q2_our_entity: blank"), (3, "q6_replaces: marker"), (4, "q6_replaces: marker")]
    assert rows(q["gap_ranking"](spark, d)) == [("q2_our_entity", "f", 1), ("q3_signed", "f", 1)]


def test_first_packets(spark, tmp_path):
    page = lambda n, words: f"=== page {n} === " + " ".join([f"w{n}"] * words) + " "
    docs = [
        (1, page(1, 300) + page(2, 1000) + page(3, 5)), (2, "".join(f"[¶ {n}] p{n} " for n in range(1, 15))), (3, "no marker " * 700), (4, None), (5, page(1, 1) + page(2, 1) + page(3, 1)), (6, page(1, 1200) + page(2, 1)),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {}
    for r in entry.queries()["first_packets"](spark, str(tmp_path)).collect():
        words.setdefault((r["doc_id"], r["kind"]), {})[r["unit_no"]] = r["excerpt_md5"]
    md5 = lambda w, n: hashlib.md5(" ".join([w] * n).encode()).hexdigest()
    assert words.pop((2, "paragraph")) == {n: md5(f"p{n}", 1) for n in range(1, 13)}
    assert words == {(1, "page"): {1: md5("w1", 300), 2: md5("w2", 900)}, (3, "page"): {1: md5("no marker", 600)}, (5, "page"): {1: md5("w1", 1), 2: md5("w2", 1)}, (6, "page"): {1: md5("w1", 1200)}}


def test_undecided_names(spark, tmp_path):
    cards = [(1, "d1", "Beta Ltd | Acme Ltd"), (2, "d2", "BETA limited | Gamma"), (3, "d2", "Beta Ltd"), (4, "d3", "none"), (5, None, "Gamma")]
    spark.createDataFrame(cards, "card_no long, doc_id string, q2_their_signing_entities string").write.parquet(f"{tmp_path}/cards.parquet")
    spark.createDataFrame([("7", "Acme Ltd")], "account_number string, account string").write.parquet(f"{tmp_path}/erp_record.parquet")
    got = rows(entry.queries()["undecided_names"](spark, str(tmp_path)))
    beta = spark.range(1).select(T.group_key(F.lit("Beta Ltd"))).first()[0]
    assert got == [(beta, "d1"), (beta, "d2"), ("gamma", "d2")]


def test_route_rows(spark):
    from foliant.operators.routing import route_rows

    records = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("b", 3, "x"), (None, 4, "x"), ("c", 5, "x")], "name string, id long, said string")
    got = spark.createDataFrame(
        [(1, "a", "p", None), (2, "a", "p", ""), (3, "a", "q", None), (4, "b", "p", None), (5, None, "p", None), (6, "", None, None), (7, "z", None, None), (8, "c", None, "r"), (8, "c", None, "r")], "n int, name string, s string, t string"
    )
    want = [(1, 1, "kept", ""), (2, 1, "repeat", ""), (3, 1, "conflict", "s"), (4, None, "unknown", ""), (5, None, "ignored", ""), (6, None, "ignored", ""), (7, None, "unknown", ""), (8, 5, "kept", ""), (8, 5, "kept", "")]
    routed = route_rows(got, "n", "name", ["s", "t"], records, "name", "id")
    assert rows(routed.select("row_no", "record", "route", "differing")) == sorted(want, key=repr)
    assert route_rows(got.where("false"), "n", "name", ["s", "t"], records, "name", "id").count() == 0
    assert {r[2] for r in rows(route_rows(got, "n", "name", ["s"], records.where("false"), "name", "id"))} == {"unknown", "ignored"}


def test_inherited(spark):
    from foliant.operators.routing import inherited

    chain = [(f"n{i:04d}", f"n{i + 1:04d}", None, 0) for i in range(600)] + [("n0600", "n0000", "live", 0)]  # the circle above a settled node does not matter
    odd = [("a", "b", None, 0), ("b", "a", None, 0), ("c", "a", None, 0), ("d", None, None, 0), ("e", "gone", None, 0), ("f", None, "dead", 0), ("g", "f", None, 0), ("h", "g", "x" * 10_000, 0), (None, "f", None, 0)]
    got = {r["node"]: (r["state"], r["source"]) for r in inherited(spark.createDataFrame(chain + odd, "doc string, up string, s string, state int"), "doc", "up", "s", "unsure").collect()}
    assert all(got[f"n{i:04d}"] == ("live", "n0600") for i in range(601)) and None not in got and len(got) == 609
    assert [got[x][0] for x in "abcdefgh"] == ["unsure"] * 5 + ["dead", "dead", "x" * 10_000] and got["g"] == ("dead", "f") and got["e"][1] is None
    assert inherited(spark.createDataFrame([], "doc string, up string, s string"), "doc", "up", "s", "unsure").count() == 0
