"""What must be true of a DataFrame, as values with an identity.

A control yields aggregate expressions over a scan and a verdict over those
aggregates; both are Columns, so a run of any number of controls is one
DataFrame.  No rows in scope is indeterminate, never a pass; only a row-count
control judges an empty scope.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.predicates import VIOLATES, violation

PASS, FAIL, INDETERMINATE = "pass", "fail", "indeterminate"

#: Functions whose result changes from run to run; a control may not call them.
UNSTABLE = ("rand(", "randn(", "uuid(", "now(", "current_timestamp(", "current_date(", "monotonically_increasing_id(", "shuffle(")


@dataclass(frozen=True)
class Threshold:
    """What still passes: at most ``rows`` violating rows, or a share of at most ``rate``, or an ``amount`` of ``of`` in them.

    With ``at_least`` the bound is the least number of rows, or share, or amount
    that must violate, for controls that state what has to happen.  An amount is
    the sum of absolute values of the column or expression ``of`` over violating
    rows; a missing value adds nothing.
    """

    rows: int = 0
    rate: float | None = None
    amount: float | None = None
    of: str | None = None
    at_least: bool = False

    def __post_init__(self):
        if (self.amount is None) != (self.of is None):
            raise ValueError("an amount is of some column")
        if self.amount is not None and self.rate is not None:
            raise ValueError("a threshold is a share or an amount")

    def holds(self, m: Callable[[str], Column]) -> Column:
        if self.amount is not None:
            value, bound = m("violating_amount"), F.lit(str(self.amount)).cast("decimal(38,6)")
        elif self.rate is not None:
            value, bound = F.try_divide(m("violating_rows").cast("double"), m("scanned_rows")), F.lit(self.rate)
        else:
            value, bound = m("violating_rows"), F.lit(self.rows)
        return value >= bound if self.at_least else value <= bound


def _text(c) -> str | None:
    return None if c is None else c if isinstance(c, str) else str(c)


@dataclass(frozen=True)
class Control:
    """Common part: name, scope, threshold, tags.  ``where`` keeps only rows for which it is definitely true."""

    name: str
    where: Column | str | None = field(default=None, kw_only=True)
    threshold: Threshold = field(default_factory=Threshold, kw_only=True)
    dimension: str = field(default="validity", kw_only=True)
    severity: str = field(default="major", kw_only=True)

    def scope(self) -> Column:
        if self.where is None:
            return F.lit(True)
        return F.coalesce(F.expr(self.where) if isinstance(self.where, str) else self.where, F.lit(False))

    def definition(self) -> dict:
        out = {"kind": type(self).__name__}
        for k, v in self.__dict__.items():
            out[k] = v.__dict__ if isinstance(v, Threshold) else _text(v) if isinstance(v, Column) else v
        return out

    def identity(self) -> str:
        """Hash of the canonical definition: equal controls have equal identities."""
        canonical = json.dumps(self.definition(), sort_keys=True, default=str)
        return hashlib.sha256(canonical.encode()).hexdigest()

    def validate(self, schema: StructType) -> list[str]:
        """What is wrong with the control for a schema, in words; empty if nothing is."""
        out = [f"{self.name}: no column {c}" for c in self.columns() if c not in schema.names]
        text = json.dumps(self.definition(), default=str).lower()
        if self.threshold.amount is not None and not isinstance(self, RowCheck):
            out.append(f"{self.name}: only a row check has an amount")
        return out + [f"{self.name}: {u[:-1]} is not repeatable" for u in UNSTABLE if u in text]

    def columns(self) -> tuple[str, ...]:
        return ()

    def verdict(self, m: Callable[[str], Column]) -> Column:
        return (
            F.when(m("scanned_rows") == 0, INDETERMINATE)
            .when(self.threshold.holds(m), PASS)
            .otherwise(FAIL)
        )


@dataclass(frozen=True)
class RowCheck(Control):
    """Every row in scope satisfies ``ok``; an unknown outcome counts by ``unknown``."""

    ok: Column | str
    unknown: str = field(default=VIOLATES, kw_only=True)

    def violating(self) -> Column:
        return violation(F.expr(self.ok) if isinstance(self.ok, str) else self.ok, self.unknown)

    def aggregates(self) -> dict[str, Column]:
        s, bad = self.scope(), self.violating()
        out = {"scanned_rows": F.count_if(s), "violating_rows": F.count_if(s & bad)}
        if self.threshold.of is not None:
            value = F.abs(F.expr(self.threshold.of).cast("decimal(28,6)"))
            out["violating_amount"] = F.coalesce(F.sum(F.when(s & bad, value)), F.lit(0).cast("decimal(38,6)"))
        return out


@dataclass(frozen=True)
class RowCount(Control):
    """The number of rows in scope lies within bounds."""

    low: int | None = None
    high: int | None = None

    def aggregates(self) -> dict[str, Column]:
        n = F.count_if(self.scope())
        return {"scanned_rows": n, "violating_rows": F.lit(0).cast("long") + n * 0}

    def verdict(self, m) -> Column:
        n, ok = m("scanned_rows"), F.lit(True)
        if self.low is not None:
            ok = ok & (n >= self.low)
        if self.high is not None:
            ok = ok & (n <= self.high)
        return F.when(ok, PASS).otherwise(FAIL)


@dataclass(frozen=True)
class Freshness(Control):
    """The latest ``column`` is no older than ``seconds`` at the given instant; no rows fail."""

    column: str
    instant: str
    seconds: int

    def columns(self):
        return (self.column,)

    def aggregates(self) -> dict[str, Column]:
        s = self.scope()
        age = F.unix_timestamp(F.lit(self.instant).cast("timestamp")) - F.unix_timestamp(F.max(F.when(s, F.col(self.column))).cast("timestamp"))
        return {"scanned_rows": F.count_if(s), "violating_rows": F.coalesce((age > self.seconds).cast("long"), F.lit(1).cast("long"))}

    def verdict(self, m) -> Column:
        return F.when(m("violating_rows") == 0, PASS).otherwise(FAIL)


@dataclass(frozen=True)
class AggregateBand(Control):
    """An aggregate over the rows in scope lies within bounds, e.g. ("avg", "price", 1, 100)."""

    aggregate: str
    column: str
    low: float | None = None
    high: float | None = None

    def columns(self):
        return (self.column,)

    def aggregates(self) -> dict[str, Column]:
        s = self.scope()
        value = getattr(F, self.aggregate)(F.when(s, F.col(self.column)))
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= self.low)
        if self.high is not None:
            ok = ok & (value <= self.high)
        return {"scanned_rows": F.count_if(s), "violating_rows": (~F.coalesce(ok, F.lit(False))).cast("long")}


@dataclass(frozen=True)
class UniqueKey(Control):
    """No two rows in scope share a key; a key with a null part violates."""

    key: tuple[str, ...]

    def columns(self):
        return self.key


@dataclass(frozen=True)
class Dependency(Control):
    """Rows with equal determinant have equal dependent; violating counts the dependents beyond one each."""

    determinant: tuple[str, ...]
    dependent: str

    def columns(self):
        return (*self.determinant, self.dependent)


@dataclass(frozen=True)
class References(Control):
    """Every child value is among the parent's; a null child violates, null parents don't count."""

    column: str
    parent: str
    parent_column: str

    def columns(self):
        return (self.column,)
