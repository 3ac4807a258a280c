"""Names, titles, references, quotes and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that companies are written with in two ways.
COMPANY_WORDS = {
    "ltd": "limited", "limited": "limited", "plc": "public limited company", "public": "public", "svc": "services", "svcs": "services",
    "services": "services", "co": "company", "company": "company", "corp": "corporation", "corporation": "corporation",
    "inc": "incorporated", "incorporated": "incorporated", "&": "and", "and": "and",
}
#: Legal forms at the end of a name.
LEGAL_FORMS = (
    "ag", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "limited", "limited liability company", "llc",
    "ltd", "nv", "plc", "pty", "public limited company", "sa", "sarl", "srl",
)
#: Words too common in names to tell companies apart.
COMMON_WORDS = (
    "the", "and", "of", "limited", "ltd", "plc", "inc", "llc", "gmbh", "group", "company", "co", "services", "svcs", "holdings",
    "international", "uk", "partnership", "networks", "systems", "solutions", "industries", "engineering", "utilities", "power", "housing",
)
#: Answers that mean there is none.
EMPTY_ANSWERS = ("", "none", "not found", "n/a", "na", "-", "—")
#: Cells of an export that count as blank.
BLANKS = ("", "—", "–", "-", "n/a", "na", "none", "null")
#: Accented letters and what they become, one for one, then those that become two.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿđłÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝĐŁ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyydlAAAAAACEEEEIIIINOOOOOOUUUUYDL"
TWO_LETTERS = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}
#: Kinds of paper by what their words contain; the first that fits wins.
KIND_SLUGS = (
    (r"non[- ]?disclos|\bndas?\b|confidential", "nda"),
    (r"amend|side letter|variation|addend", "amendment"),
    (r"rebate|pricing|price list|discount", "rebate-letter"),
    (r"purchase order|\bp\.?o\.?\b|quotation|\bquote\b|order form|\borders?\b", "order"),
    (r"schedule|annex|appendix|exhibit", "schedule"),
    (r"credit application|credit account", "credit-application"),
    (r"local adoption|adoption of", "local-adoption"),
    (r"project|programme|program\b|\bsite\b|works agreement", "site-agreement"),
    (r"draft[ -]?master|unsigned master", "draft-master"),
    (r"master|framework|\bmsa\b|supply agreement|services agreement", "master-agreement"),
    (r"standard terms|terms and conditions|\bt&cs?\b|general terms", "standard-terms"),
    (r"guarantee|indemnit|surety", "guarantee"),
    (r"data (processing|terms)|code of conduct|\bedi\b|\bdpa\b|overlay", "overlay"),
    (r"internal|playbook|guidance", "internal-notes"),
    (r"letter|e-?mail|correspond", "letter"),
)
_EDGE = r"[.,;:!?'\"“”‘’()\[\]]+"


def squeeze(s: Column) -> Column:
    """Trimmed, runs of white space made one space."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def norm_name(s: Column) -> Column:
    """F01"""
    return F.lower(squeeze(F.coalesce(s, F.lit(""))))


def group_key(s: Column) -> Column:
    """one key for a company written two ways; '' for null."""
    words = F.create_map(*[F.lit(x) for kv in COMPANY_WORDS.items() for x in kv])
    bare = F.transform(F.split(F.regexp_replace(norm_name(s), r"^the\s+", ""), " "), lambda t: F.regexp_replace(t, f"^{_EDGE}|{_EDGE}$", ""))
    return F.array_join(F.filter(F.transform(bare, lambda t: F.coalesce(F.try_element_at(words, t), t)), lambda t: t != ""), " ")


def core_name(s: Column) -> Column:
    """the group key without company number and trailing legal forms; a name of legal forms only is ''."""
    forms = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))
    return F.trim(F.regexp_replace(group_key(entity_name(s)), rf"(?:(?:^|\s)(?:{forms}))+$", ""))


def distinctive_tokens(s: Column) -> Column:
    """different words of four letters or more, common ones left out."""
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9]+"), lambda t: F.length(t) >= 4)), F.array(*map(F.lit, COMMON_WORDS)))


def is_blank(s: Column) -> Column:
    """P06, for export cells"""
    return norm_name(s).isin(*BLANKS)


def is_empty_answer(s: Column) -> Column:
    """P06, for card answers"""
    return norm_name(s).isin(*EMPTY_ANSWERS)


def ref_key(s: Column) -> Column:
    """F05"""
    return F.when(is_blank(s), "").otherwise(F.regexp_replace(F.lower(s), "[^a-z0-9]+", ""))


def title_tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9]+"), lambda t: F.length(t) > 2))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard of title words; 0 where either has none."""
    x, y = title_tokens(a), title_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def strip_role(s: Column) -> Column:
    """F07"""
    return F.trim(F.regexp_replace(F.trim(s), r"\s*\([^()]*\)\s*$", ""))


#: A company number after its word, and the parentheses that name a role.
COMPANY_NUMBER = r"(?i)\(?\s*(?:company number|registered number|number|no\.?)\s*[:#]?\s*([A-Z]{0,2}\d{6,10})\s*\)?"
ROLE_BRACKETS = r"(?i)\s*\((?:the\s+)?['\"]?(?:customer|supplier|buyer|seller|company|purchaser|provider)['\"]?\)\s*"


def entity_number(s: Column) -> Column:
    """the company number, or ''."""
    return F.upper(F.regexp_extract(F.coalesce(s, F.lit("")), COMPANY_NUMBER, 1))


def entity_name(s: Column) -> Column:
    """the name without its number and role; '' for blank and not found."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), COMPANY_NUMBER, ""), ROLE_BRACKETS, " ")
    return F.when(is_blank(s) | (norm_name(s) == "not found"), "").otherwise(F.regexp_replace(squeeze(bare), r"^[ ,;.]+|[ ,;.]+$", ""))


def entity_lines(s: Column) -> Column:
    """the entities of a cell, one a line, as structs of name and number."""
    lines = F.split(F.coalesce(s, F.lit("")), r"\n|;|\s{2,}(?=[A-Z])")
    both = F.transform(lines, lambda x: F.struct(entity_name(x).alias("name"), entity_number(x).alias("number")))
    return F.filter(both, lambda e: (e["name"] != "") & (F.lower(e["name"]) != "none"))


def ascii_only(s: Column) -> Column:
    """accents folded, all else outside ASCII dropped."""
    out = F.coalesce(s, F.lit(""))
    for a, b in TWO_LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(out, ACCENTED, PLAIN), r"[^\x00-\x7f]", "")


def name_slug(s: Column) -> Column:
    """F11"""
    out = F.regexp_replace(F.regexp_replace(F.trim(ascii_only(s)), r"\s+", "-"), r"[^A-Za-z0-9.\-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "-{2,}", "-"), r"\.{2,}", "."), r"^[\-. ]+|[\-. ]+$", "")


def kind_slug(s: Column) -> Column:
    """the first rule that fits, else the first three words in at most 24 characters; '' where nothing is said."""
    text = F.lower(F.trim(ascii_only(s)))
    words = F.lower(name_slug(F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 3), " ")))
    out = F.when(is_empty_answer(text) | text.isin("not assessed", "unknown", "unclear", "can't tell", "cant tell"), "")
    for pattern, slug in KIND_SLUGS:
        out = out.when(text.rlike(pattern), slug)
    rest = F.regexp_replace(F.left(words, F.lit(24)), r"[\-.]+$", "")
    return out.otherwise(F.when(rest == "", "other").otherwise(rest))


def safe_name(s: Column) -> Column:
    """characters no file system takes become _, no trailing dots or spaces, device names get a _."""
    out = F.regexp_replace(F.regexp_replace(F.trim(s), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(out.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"), F.concat(F.lit("_"), out)).otherwise(out)


#: Fixed value: the most characters a file name may have.
FILED_NAME_LIMIT = 120


def fitted_name(parts: Column, suffix: Column, limit: int = FILED_NAME_LIMIT) -> Column:
    """the parts joined by spaces, and the suffix, within ``limit`` characters: of the parts after the first the longest, the earlier where they tie,
    loses a character at a time, but never its last; what is still too long is cut off."""
    length = lambda a: F.length(F.array_join(a, " ")) + F.length(suffix)
    bare = lambda x: F.regexp_replace(x, r"[\-. ]+$", "")

    def shorten(a: Column, _: Column) -> Column:
        sizes = F.transform(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.length)
        longest = F.array_max(sizes)
        at = F.array_position(sizes, longest)
        cut = F.transform(a, lambda x, i: F.when(i == at, F.coalesce(F.nullif(bare(F.left(x, F.length(x) - 1)), F.lit("")), F.left(x, F.lit(1)))).otherwise(x))
        return F.when((length(a) > limit) & (longest > 1), cut).otherwise(a)

    def fit(said: Column) -> Column:
        over = length(said) - limit
        steps = F.when(over > 0, F.sequence(F.lit(1), F.greatest(over, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        name = bare(F.left(F.array_join(F.aggregate(steps, said, shorten), " "), F.greatest(F.lit(1), F.lit(limit) - F.length(suffix))))
        return F.concat(F.coalesce(F.nullif(name, F.lit("")), F.get(said, F.lit(0)), F.lit("document")), suffix)

    # a one-element array binds the parts, so that their own expressions are evaluated once
    return F.get(F.transform(F.array(F.filter(parts, lambda x: x != "")), fit), F.lit(0))


def filed_name(doc_id: Column, ext: Column, kind: Column, party: Column, date: Column, status: Column) -> Column:
    """number, kind, party, date and status. A draft of a master agreement says so in its kind and not again in its status."""
    said = F.struct(
        F.coalesce(F.nullif(name_slug(doc_id), F.lit("")), F.lit("document")).alias("number"), kind_slug(kind).alias("kind"), name_slug(party).alias("party"),
        F.coalesce(date, F.lit("")).alias("date"), F.lower(name_slug(status)).alias("state"), F.lower(F.regexp_replace(name_slug(ext), r"^\.+", "")).alias("end"),
    )

    def name(p: Column) -> Column:
        master = (p["state"] == "draft") & p["kind"].isin("master-agreement", "draft-master")
        parts = F.array(p["number"], F.when(master, "draft-master").otherwise(p["kind"]), p["party"], p["date"], F.when(master, "").otherwise(p["state"]))
        return fitted_name(parts, F.when(p["end"] == "", "").otherwise(F.concat(F.lit("."), p["end"])))

    return F.get(F.transform(F.array(said), name), F.lit(0))


def truncated(s: Column, n: int) -> Column:
    """F15"""
    t = F.trim(F.coalesce(s, F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(max(1, n - 1)))), F.lit("…")))


def first_line(s: Column, n: int = 80) -> Column:
    """F16: the first line that is not blank, cut to ``n``; null where there is none."""
    return F.left(F.trim(F.get(F.filter(F.split(s, "\n"), lambda x: F.trim(x) != ""), F.lit(0))), F.lit(n))


def portable(path: Column) -> Column:
    """F17"""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def mm_label(s: Column) -> Column:
    """safe inside a quoted Mermaid label: quotes become apostrophes, line ends spaces, and what would close or break the label its entity."""
    plain = F.regexp_replace(F.coalesce(s, F.lit("")), r"\s*\n\s*", " ")
    for mark, safe in (('"', "'"), ("#", "#35;"), ("[", "#91;"), ("]", "#93;"), ("|", "#124;"), ("<", "#60;"), (">", "#62;")):
        plain = F.replace(plain, F.lit(mark), F.lit(safe))
    return plain


def md_cell(s: Column) -> Column:
    """safe inside a pipe table."""
    return F.replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def same_instrument(ref_a: Column, title_a: Column, ref_b: Column, title_b: Column) -> Column:
    """Equal references where both have one, else titles that are equal or at least 0.6 alike; a missing title speaks for it."""
    a, b = ref_key(ref_a), ref_key(ref_b)
    bare = lambda t: F.coalesce(t, F.lit("")) == ""
    alike = bare(title_a) | bare(title_b) | (norm_name(title_a) == norm_name(title_b)) | (title_similarity(title_a, title_b) >= 0.6)
    return F.when((a != "") & (b != ""), a == b).otherwise(alike)


def word_count(s: Column) -> Column:
    """F22"""
    return F.size(F.filter(F.split(F.trim(F.coalesce(s, F.lit(""))), r"\s+"), lambda w: w != ""))


def quoted_in(quote: Column, text: Column) -> Column:
    """whether the quote stands in the text, white space aside; false for an empty quote."""
    return F.coalesce(F.contains(squeeze(text), squeeze(quote)) & (squeeze(quote) != ""), F.lit(False))


#: How pages, paragraphs and clauses are cited.
PAGE_REF = r"\b(?:pages?|pp?\.?)\s*(\d+)(?:\s*[-–]\s*(\d+))?"
PARAGRAPH_REF = r"(?:¶|\bparagraphs?\b|\bparas?\.)\s*(\d+)(?:\s*[-–]\s*(\d+))?"
CLAUSE_REF = r"(?:\b(?:cl(?:ause)?\.?|section|sec\.)|§)\s*(\d+(?:\.\d+)*[A-Za-z]?)"
#: Fixed value: the longest range of pages or paragraphs that is believed.
LONGEST_RANGE = 10_000


def _cited_numbers(found: Column) -> Column:
    """Numbers of the citations, ranges expanded, in order; null if a range begins below 1, runs backward or is too long."""

    def expand(x: Column) -> Column:
        numbers = F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))
        a = F.get(numbers, F.lit(0)).try_cast("int")
        b = F.when(F.size(numbers) > 1, F.get(numbers, F.lit(1)).try_cast("int")).otherwise(a)
        return F.when((a >= 1) & (b >= a) & (b - a <= LONGEST_RANGE), F.sequence(a, F.greatest(a, b)))

    return F.array_distinct(F.flatten(F.transform(found, expand)))


def cited_pages(ref: Column) -> Column:
    """pages of p.3, pp 4-7, page 9 or a bare number, in order; null if a range is none. P6 is a clause label where a page is named otherwise."""
    r = F.trim(F.coalesce(ref, F.lit("")))
    found = F.regexp_extract_all(r, F.lit(f"(?i)({PAGE_REF})"), F.lit(1))
    named = F.filter(found, lambda x: ~x.rlike(r"^P\d"))
    return F.when(r.rlike(r"^\d+$"), _cited_numbers(F.array(r))).otherwise(_cited_numbers(F.when(F.size(named) > 0, named).otherwise(found)))


def cited_paragraphs(ref: Column) -> Column:
    """paragraphs of ¶ 3, paragraph 4 or paras. 4-6, in order; null if a range is none."""
    return _cited_numbers(F.regexp_extract_all(F.coalesce(ref, F.lit("")), F.lit(f"(?i)({PARAGRAPH_REF})"), F.lit(1)))


def cited_clauses(ref: Column) -> Column:
    """clause numbers of cl 4, clause 4.2, section 8.1A or § 7."""
    return F.regexp_extract_all(F.coalesce(ref, F.lit("")), F.lit(f"(?i){CLAUSE_REF}"), F.lit(1))


def evidence_quotes(s: Column) -> Column:
    """what stands between quotation marks in each ` | ` segment, else the segment without its reference."""

    def of(segment: Column) -> Column:
        marked = F.regexp_extract_all(segment, F.lit('["“]([^"”]+)["”]'), F.lit(1))
        return F.when(is_empty_answer(segment), F.array().cast("array<string>")).when(F.size(marked) > 0, marked).otherwise(F.array(F.regexp_replace(F.trim(segment), r"^[^:]{1,40}:\s*", "")))

    return F.filter(F.transform(F.flatten(F.transform(F.split(F.coalesce(s, F.lit("")), r" \| "), of)), lambda q: F.trim(q)), lambda q: q != "")


def merge_tracked(s: Column) -> Column:
    """neighbouring insertions become one, and deletions likewise."""
    return F.replace(F.replace(s, F.lit("+}{+"), F.lit("")), F.lit("-}{-"), F.lit(""))


def plain_tracked(s: Column) -> Column:
    """markers of tracked changes removed, their words kept."""
    return F.regexp_replace(s, r"\{[+\-]|[+\-]\}", "")


def stable_id(prefix: str, *values: Column) -> Column:
    """prefix and 20 hex digits of the hash of the normalised values, written as a list with a space after each comma."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(norm_name(v), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for v in values]
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256), F.lit(20)))


def natural_id(s: Column) -> Column:
    """numbers get at least three digits."""
    return F.when(s.rlike(r"^\d+$"), F.lpad(s, F.greatest(F.lit(3), F.length(s)), "0")).otherwise(s)


def tolerant_int(s: Column) -> Column:
    """A count typed by hand: commas and underscores dropped; null for words and negatives."""
    n = F.regexp_replace(F.trim(s), "[,_]", "").try_cast("double")
    return F.when(n >= 0, F.floor(n).cast("long"))


def clock(ms: Column) -> Column:
    """42.5s, 36m 12s, 1h 04m."""
    s = F.floor(ms / 1000 + 0.5)
    m = F.floor(s / 60)
    return (
        F.when(ms <= 0, "0s").when(ms < 60_000, F.concat(F.format_number(ms / 1000.0, 1), F.lit("s")))
        .when(m >= 60, F.format_string("%dh %02dm", F.floor(m / 60), m % 60)).otherwise(F.format_string("%dm %02ds", m, s % 60))
    )


def closed_labels(cell: Column, labels: tuple[str, ...], multi: bool = False) -> Column:
    """The permitted labels of a cell up to its first bar. With ``multi`` each part between commas, semicolons, slashes and line
    ends may name one; the whole cell as a label comes first; failing all, the longest label that the cell starts with."""
    text = F.trim(F.get(F.split(F.coalesce(cell, F.lit("")), r"\|"), F.lit(0)))
    by = F.create_map(*[F.lit(x) for v in labels for x in (v.lower(), v)])
    whole = F.array_compact(F.array(F.try_element_at(by, norm_name(text))))
    parts = F.array_compact(F.transform(F.split(text, r"\s*[,;/]\s*|\n"), lambda p: F.try_element_at(by, norm_name(p)))) if multi else F.array().cast("array<string>")
    starts = F.array_compact(F.array(F.coalesce(*[F.when(F.startswith(norm_name(text), F.lit(v.lower())), F.lit(v)) for v in sorted(labels, key=lambda v: (-len(v), v))])))
    exact = F.array_distinct(F.concat(whole, parts))
    return F.when(is_blank(cell), F.array().cast("array<string>")).when(F.size(exact) > 0, exact).otherwise(starts)


def row_hash(*columns: str) -> Column:
    """A hash of the named columns whatever their order; null and '' differ."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
