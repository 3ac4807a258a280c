"""Dates as people write them, day before month where only digits say it."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = "(" + "|".join(MONTHS) + ")[a-z]*"
_ORD = r"(?:st|nd|rd|th)?"
#: rewrites that turn the written shapes into year-month-day, in order: month first, day first with digits, day first with a name
REWRITES = (
    (rf"^{_NAME}\.?\s+(\d{{1,2}}){_ORD},?\s+(\d{{4}})(?!\d)", "$3-$1-$2"),
    (r"^(\d{1,2})[./](\d{1,2})[./](\d{4})(?!\d)", "$3-$2-$1"),
    (rf"^(\d{{1,2}}){_ORD}\.?\s+{_NAME}\.?,?\s+(\d{{4}})(?!\d)", "$3-$2-$1"),
)
_ISO = r"^(\d{4})-(\d{1,2}|" + "|".join(MONTHS) + r")-(\d{1,2})(?!\d)"


def month_number(word: Column) -> Column:
    """Two-digit month for a number or a month name; null for anything else."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    return F.coalesce(F.try_element_at(names, F.substring(word, 1, 3)), F.lpad(word, 2, "0"))


def _date(cell: Column, tail: str) -> Column:
    text = F.lower(F.trim(cell))
    for pattern, to in REWRITES:
        text = F.regexp_replace(text, pattern, to)
    # one bound variable, so that the rewritten text is evaluated once however often its parts are used
    parts = lambda t: F.concat_ws("-", F.regexp_extract(t, _ISO + tail, 1), month_number(F.regexp_extract(t, _ISO + tail, 2)), F.lpad(F.regexp_extract(t, _ISO + tail, 3), 2, "0"))
    iso = F.get(F.transform(F.array(text), lambda t: parts(t)), F.lit(0))
    return F.when(~iso.startswith("0000"), iso).try_cast("date")


def leading_date(cell: Column) -> Column:
    """The real calendar date a cell starts with; null where there is none (words, 31 Feb, month 0)."""
    return _date(cell, "")


def whole_date(cell: Column) -> Column:
    """As ``leading_date``, where the date is the whole cell."""
    return _date(cell, r"\s*$")

#: The four written shapes of a date inside a text: ISO, Month d yyyy, d Month yyyy, d.m.yyyy or d/m/yyyy.
_FULL = "january|february|march|april|may|june|july|august|september|october|november|december|" + "|".join(m for m in MONTHS if m != "may")
ANYWHERE = (
    r"\b\d{4}-\d{1,2}-\d{1,2}\b"
    rf"|\b(?:{_FULL})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
    rf"|\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_FULL})\.?,?\s+\d{{4}}\b"
    r"|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b"
)


def dates_in(text: Column) -> Column:
    """All real dates of a text in the order in which they stand there; impossible ones are dropped; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({ANYWHERE})"), F.lit(1))
    return F.array_compact(F.transform(found, leading_date))


def first_date(text: Column) -> Column:
    return F.get(dates_in(text), F.lit(0))


def term_state(start: Column, end: Column, as_at: str) -> Column:
    """ended, future, live or unknown at the as-at date, from dates alone."""
    day = F.lit(as_at).cast("date")
    return F.when(end < day, "ended").when(start > day, "future").when(start.isNotNull() | end.isNotNull(), "live").otherwise("unknown")
