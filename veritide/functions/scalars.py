"""Scalar functions with strict unknowns: a null argument gives a null result unless the function is about blanks.

All are Column expressions and stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column by name; other values as they are or as literals."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _strict(args: list[Column], value: Column) -> Column:
    present = reduce(lambda a, b: a & b, [a.isNotNull() for a in args])
    return F.when(present, value)


def upper(t) -> Column:
    return F.upper(col(t))


def lower(t) -> Column:
    return F.lower(col(t))


def trim(t) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(col(t), r"^\s+|\s+$", "")


def length(t) -> Column:
    return F.length(col(t))


def left(t, n: int) -> Column:
    return F.substring(col(t), 1, max(n, 0))


def right(t, n: int) -> Column:
    c = col(t)
    return F.right(c, F.lit(n)) if n > 0 else F.when(c.isNotNull(), F.lit(""))


def mid(t, start: int, n: int) -> Column:
    """Characters from a 1-based place; a smaller start counts as 1."""
    return F.substring(col(t), max(start, 1), max(n, 0))


def substitute(t, old: str, new: str) -> Column:
    return F.replace(col(t), F.lit(old), F.lit(new))


def concat(*ts) -> Column:
    return F.concat(*[col(t).cast("string") for t in ts])


def absolute(x) -> Column:
    return F.abs(col(x))


def round_half_up(x, places: int = 0) -> Column:
    """Rounds halves away from zero on exact decimals."""
    return F.round(col(x).cast("decimal(38,12)"), places)


def integer(x) -> Column:
    return F.floor(col(x))


def modulo(a, b) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return F.try_mod(col(a), col(b))


def divide(a, b) -> Column:
    """True division; null for a zero divisor."""
    return F.try_divide(col(a), col(b))


def sign(x) -> Column:
    return F.signum(col(x)).cast("int")


def least(*xs) -> Column:
    cs = [col(x) for x in xs]
    return _strict(cs, F.least(*cs))


def greatest(*xs) -> Column:
    cs = [col(x) for x in xs]
    return _strict(cs, F.greatest(*cs))


def if_then(condition: Column, yes, no) -> Column:
    """An unknown condition gives an unknown result."""
    return F.when(condition, col(yes)).when(~condition, col(no))


def if_blank(x, other) -> Column:
    return F.coalesce(col(x), col(other))


def coalesce(*xs) -> Column:
    return F.coalesce(*[col(x) for x in xs])


def is_blank(x) -> Column:
    c = col(x)
    return c.isNull() | (trim(c.cast("string")) == "")


def is_number(t) -> Column:
    return F.coalesce(col(t).cast("string").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit(False))


def _part(d, start: int, n: int) -> Column:
    """A number by its place in an ISO date; null where there is none."""
    return F.substring(col(d).cast("string"), start, n).try_cast("int")


def year(d) -> Column:
    return _part(d, 1, 4)


def month(d) -> Column:
    return _part(d, 6, 2)


def day(d) -> Column:
    return _part(d, 9, 2)


# Cross-field checks of financial records.


def iban_country(t) -> Column:
    return F.substring(col(t), 1, 2)


def isin_country(t) -> Column:
    return F.substring(col(t), 1, 2)


def bic_country(t) -> Column:
    return F.substring(col(t), 5, 2)


def same_country(a, b) -> Column:
    return F.upper(col(a)) == F.upper(col(b))


def iban_bic_consistent(iban, bic) -> Column:
    return same_country(iban_country(iban), bic_country(bic))


#: Currencies without and with three decimal places; others have two.
ZERO_DECIMALS = ("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF")
THREE_DECIMALS = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")


def minor_units_ok(amount, currency) -> Column:
    """Whether an amount has no more decimals than its currency allows."""
    exact, c = col(amount).cast("decimal(38,6)"), F.upper(col(currency))
    fits = lambda n: F.round(exact, n) == exact
    return F.when(c.isin(*ZERO_DECIMALS), fits(0)).when(c.isin(*THREE_DECIMALS), fits(3)).when(c.isNotNull(), fits(2))


def settles_after_trade(trade, settle) -> Column:
    return col(settle) >= col(trade)


def sign_matches_side(amount, side) -> Column:
    s = F.upper(col(side))
    return F.when(s == "BUY", col(amount) >= 0).when(s == "SELL", col(amount) <= 0)


#: Functions added under a name, for controls that are given as data: name to a builder of a Column from Columns.
ADDED: dict[str, Callable[..., Column]] = {}


def register_function(name: str, build: Callable[..., Column]) -> None:
    """Add a function built from Columns, so that it stays inside Spark's plans; a name can't be taken twice."""
    if name in ADDED or name.startswith("_") or name in globals():
        raise ValueError(f"{name} is taken")
    ADDED[name] = build


def call(name: str, *arguments) -> Column:
    """The function of a name, an added one or one of this module, applied to columns, given as Columns or by name."""
    build = ADDED.get(name) or (None if name.startswith("_") else globals().get(name))
    if build is None or not callable(build) or name in ("register_function", "call"):
        raise ValueError(f"no function {name}")
    return build(*[col(a) for a in arguments])
