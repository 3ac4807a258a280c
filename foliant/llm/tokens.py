"""What counts as a token and as a word."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A longest run of letters and digits of any script, or any other single character that is not white space.
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
JVM_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x{85}\x{1c}-\x{1f}]"
#: A longest run of letters and digits; the text is put in lower case first.
WORD = re.compile(r"[^\W_]+")


def token_count(text: Column) -> Column:
    """Number of tokens, without leaving the JVM; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(JVM_TOKEN))
