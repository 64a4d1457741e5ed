"""Predicates are stated positively (true: the row is fine); what an unknown counts as is a policy."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import col

#: An unknown outcome counts as a violation, or as fine.
VIOLATES, PASSES = "violates", "passes"


def violation(ok: Column, unknown: str = VIOLATES) -> Column:
    """Whether a row violates ``ok``: never null."""
    if unknown not in (VIOLATES, PASSES):
        raise ValueError(f"unknown policy {unknown!r}")
    return ~F.coalesce(ok, F.lit(unknown == PASSES))


def in_list(x, values: Iterable) -> Column:
    """Membership of a literal list; an empty list is refused."""
    values = list(values)
    if not values:
        raise ValueError("an empty list holds nothing")
    return col(x).isin(*values)


def in_table(df: DataFrame, x: str, allowed: DataFrame, column: str, as_: str) -> DataFrame:
    """``df`` with a Boolean column: whether x is among a table's values; null where x is null."""
    values = allowed.select(F.col(column).alias("__allowed")).where("__allowed is not null").distinct()
    marked = df.join(values, F.col(x) == F.col("__allowed"), "left")
    return marked.withColumn(as_, F.when(F.col(x).isNotNull(), F.col("__allowed").isNotNull())).drop("__allowed")


def between(x, low, high) -> Column:
    return col(x).between(low, high)


def matches(x, pattern: str) -> Column:
    """Search, not full match."""
    return col(x).cast("string").rlike(pattern)


def like(x, pattern: str) -> Column:
    return col(x).cast("string").like(pattern)


def ilike(x, pattern: str) -> Column:
    return col(x).cast("string").ilike(pattern)


def length_between(x, low: int, high: int) -> Column:
    return F.length(col(x).cast("string")).between(low, high)


#: The signs of a format mask.
_MASK = {"9": "[0-9]", "A": "[A-Za-z]", "X": "[A-Za-z0-9]", "*": ".*"}


def mask_pattern(mask: str) -> str:
    """The exact regular expression of a mask: 9 digit, A letter, X either, * any run, other signs themselves."""
    return "^" + "".join(_MASK.get(c) or re.escape(c) for c in mask) + "$"


def has_format(x, mask: str) -> Column:
    return col(x).cast("string").rlike(mask_pattern(mask))


def is_type(x, type_name: str) -> Column:
    """Whether a text reads as a type; null stays null."""
    c = col(x)
    return F.when(c.isNotNull(), c.try_cast(type_name).isNotNull())


def character_mask(x, limit: int = 64) -> Column:
    """Digits as 9, capitals as A, small letters as a, all else itself."""
    c = F.substring(col(x).cast("string"), 1, limit)
    for pattern, mark in ((r"[0-9]", "9"), (r"\p{Lu}", "A"), (r"\p{Ll}", "a")):
        c = F.regexp_replace(c, pattern, mark)
    return c
