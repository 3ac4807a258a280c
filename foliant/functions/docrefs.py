"""Document numbers inside link cells."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the word "doc" in any case, then the number.
DOC_NUMBER = r"(?i)\bdoc\b[\s.:#]*(\d+)"


def pad_number(number: Column, width: int = 8) -> Column:
    return F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)


def doc_numbers(cell: Column, width: int = 8) -> Column:
    """All document numbers of a cell in order, padded; an empty array for null or number-free cells."""
    found = F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(DOC_NUMBER), F.lit(1))
    return F.transform(found, lambda n: pad_number(n, width))


def first_doc_number(cell: Column, width: int = 8) -> Column:
    number = F.regexp_extract(F.coalesce(cell, F.lit("")), DOC_NUMBER, 1)
    return F.when(number != "", pad_number(number, width))
