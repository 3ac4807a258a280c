"""Texts as numbered units, bounded excerpts, and the language of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import word_count

#: Common words of each language, in the order in which ties are decided.
STOP_WORDS = {
    "en": "the and of to in is that for with by this shall or be are", "de": "der die und das ist nicht von mit dem den ein eine zu im auf",
    "fr": "le la les et des est dans pour une un du que par sur au", "nl": "de het een en van is niet dat met voor op zijn aan te ook",
    "es": "el la los las y de que en un una por con para es del", "it": "il la di che e un una per con non del della sono gli le",
}


def text_units(docs: DataFrame, doc_id: str, text: str, marker: str) -> DataFrame:
    """(doc_id, unit_no, body): what stands after each marker, numbered by the marker's own number (S22). ``marker`` is a regular
    expression with the number as its group; text before the first marker is no unit. Outer white space of a unit is left out."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(marker), F.lit(1))
    bodies = F.split(F.col(text), marker)
    zipped = F.arrays_zip(numbers.alias("n"), F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))).alias("b"))
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.explode(zipped).alias("u")).select(doc_id, F.col("u.n").cast("int").alias("unit_no"), F.regexp_replace(F.col("u.b"), r"^\s+|\s+$", "").alias("body"))


def bounded_packet(units: DataFrame, doc_id: str, order: str, body: str, budget: int) -> DataFrame:
    """(doc_id, order, excerpt): units in order until ``budget`` words are used; the unit that crosses it is cut."""
    w = Window.partitionBy(doc_id).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("_n").over(w), F.lit(0))
    left = units.withColumn("_n", word_count(F.col(body))).withColumn("_left", F.lit(budget) - used).where("_left > 0 and _n > 0")
    cut = F.array_join(F.slice(F.split(F.trim(body), r"\s+"), F.lit(1), F.col("_left").cast("int")), " ")
    return left.select(doc_id, order, cut.alias("excerpt"))


def first_units(docs: DataFrame, doc_id: str, text: str, page: str, paragraph: str, pages: int, paragraphs: int) -> DataFrame:
    """(doc_id, kind, unit_no, body): the first ``pages`` pages of a text with page markers, else the first ``paragraphs`` paragraphs of one
    with paragraph markers; a text without markers is page 1 (P10). The lowest numbers are the first; null texts have no unit."""
    has = lambda marker: F.col(text).rlike(marker)
    kinds = text_units(docs.where(has(page)), doc_id, text, page).withColumn("kind", F.lit("page")).unionByName(text_units(docs.where(~has(page) & has(paragraph)), doc_id, text, paragraph).withColumn("kind", F.lit("paragraph")))
    whole = docs.where(~has(page) & ~has(paragraph)).select(doc_id, F.lit(1).alias("unit_no"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("body"), F.lit("page").alias("kind"))
    w = Window.partitionBy(doc_id).orderBy("unit_no")
    return kinds.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.when(F.col("kind") == "page", pages).otherwise(paragraphs)).drop("_k").unionByName(whole).select(doc_id, "kind", "unit_no", "body")


def guess_language(text: Column, least: int = 5) -> Column:
    """The language with most common words, at least ``least``; the earlier one wins ties; null below that."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    among = lambda w, s: F.size(F.filter(w, lambda x: x.isin(*s.split())))
    # bound to a variable, so that the words are split and counted once
    hits = F.get(F.transform(F.array(words), lambda w: F.array(*[among(w, s) for s in STOP_WORDS.values()])), F.lit(0))
    name = F.transform(F.array(hits), lambda h: F.when(F.array_max(h) >= least, F.get(F.array(*map(F.lit, STOP_WORDS)), (F.array_position(h, F.array_max(h)) - 1).cast("int"))))
    return F.get(name, F.lit(0))
