"""First-match rule cascades as one column."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds; null conditions do not hold. Values may be columns."""
    out = None
    for condition, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)
