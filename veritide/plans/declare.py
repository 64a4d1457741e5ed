"""Declarations of datasets become controls; what they leave uncovered is listed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import predicates, validators
from .controls import Control, Freshness, RowCheck, RowCount, Threshold, UniqueKey


@dataclass(frozen=True)
class Attribute:
    """What is known of a column."""

    name: str
    required: bool = False
    most_missing: float = 0.0
    domain: tuple = ()
    low: float | None = None
    high: float | None = None
    semantic_type: str | None = None
    mask: str | None = None
    criticality: int = 1


@dataclass(frozen=True)
class Declaration:
    """What is known of a dataset: what one row is, its columns, how often and how much arrives."""

    dataset: str
    grain: tuple[str, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    load_column: str | None = None
    rhythm_seconds: int | None = None
    volume: tuple[int | None, int | None] = (None, None)
    extra: tuple[Control, ...] = field(default=())


def controls(d: Declaration, instant: str | None = None) -> list[Control]:
    """Controls that follow from a declaration; freshness is judged at ``instant``."""
    out: list[Control] = [UniqueKey(f"{d.dataset}.grain", d.grain, dimension="uniqueness")] if d.grain else []
    if d.volume != (None, None):
        out.append(RowCount(f"{d.dataset}.volume", *d.volume, dimension="volume"))
    if d.load_column and d.rhythm_seconds and instant:
        out.append(Freshness(f"{d.dataset}.freshness", d.load_column, instant, d.rhythm_seconds, dimension="timeliness"))
    for a in d.attributes:
        name = f"{d.dataset}.{a.name}"
        if a.required:
            t = Threshold(rate=a.most_missing) if a.most_missing else Threshold()
            out.append(RowCheck(f"{name}.complete", F.col(a.name).isNotNull(), threshold=t, dimension="completeness"))
        checks = {
            "domain": predicates.in_list(a.name, a.domain) if a.domain else None,
            "low": F.col(a.name) >= a.low if a.low is not None else None,
            "high": F.col(a.name) <= a.high if a.high is not None else None,
            "type": validators.VALIDATORS[a.semantic_type](a.name) if a.semantic_type else None,
            "mask": predicates.has_format(a.name, a.mask) if a.mask else None,
        }
        # What is missing is the completeness control's business.
        out += [RowCheck(f"{name}.{k}", c, unknown=predicates.PASSES) for k, c in checks.items() if c is not None]
    return [*out, *d.extra]


def gaps(d: Declaration, schema: StructType, planned: Sequence[Control]) -> list[tuple[str, str, int]]:
    """(column, dimension, criticality) without a control, most critical first."""
    known = {a.name: a for a in d.attributes}
    have = {(c.name.split(".")[1], c.dimension) for c in planned if c.name.count(".") >= 2}
    out = [
        (f.name, dimension, known[f.name].criticality if f.name in known else 0)
        for f in schema
        for dimension in ("completeness", "validity")
        if (f.name, dimension) not in have
    ]
    return sorted(out, key=lambda g: (-g[2], g[0], g[1]))


def schema_gate(schema: StructType, contract: StructType) -> list[str]:
    """How a schema breaks a contract: columns missing or retyped, or nullable against it."""
    have = {f.name: f for f in schema}
    out = []
    for f in contract:
        if f.name not in have:
            out.append(f"{f.name} is missing")
        elif have[f.name].dataType != f.dataType:
            out.append(f"{f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        elif have[f.name].nullable and not f.nullable:
            out.append(f"{f.name} may be null")
    return out


#: Expectations, checks and tests of other tools that have a control here.
_IMPORTED = {
    "expect_column_values_to_not_be_null": lambda n, k: RowCheck(n, F.col(k["column"]).isNotNull()),
    "expect_column_values_to_be_unique": lambda n, k: UniqueKey(n, (k["column"],)),
    "expect_compound_columns_to_be_unique": lambda n, k: UniqueKey(n, tuple(k["column_list"])),
    "expect_column_values_to_be_in_set": lambda n, k: RowCheck(n, predicates.in_list(k["column"], k["value_set"]), unknown=predicates.PASSES),
    "expect_column_values_to_be_between": lambda n, k: RowCheck(n, _range(k["column"], k.get("min_value"), k.get("max_value")), unknown=predicates.PASSES),
    "expect_column_values_to_match_regex": lambda n, k: RowCheck(n, predicates.matches(k["column"], k["regex"]), unknown=predicates.PASSES),
    "expect_table_row_count_to_be_between": lambda n, k: RowCount(n, k.get("min_value"), k.get("max_value")),
    "not_null": lambda n, k: RowCheck(n, F.col(k["column"]).isNotNull()),
    "unique": lambda n, k: UniqueKey(n, (k["column"],)),
    "accepted_values": lambda n, k: RowCheck(n, predicates.in_list(k["column"], k["values"]), unknown=predicates.PASSES),
}


def _range(column: str, low, high):
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(column) >= low)
    if high is not None:
        ok = ok & (F.col(column) <= high)
    return ok


def imported(rules: Sequence[dict]) -> tuple[list[Control], list[str]]:
    """(controls, names that have none) from rules {"type": ..., "kwargs": {...}}."""
    done, left = [], []
    for i, r in enumerate(rules):
        kind, k = r["type"], r.get("kwargs", {})
        if kind not in _IMPORTED:
            left.append(kind)
            continue
        mostly = k.get("mostly")
        control = _IMPORTED[kind](f"{kind}.{i}", k)
        if mostly is not None and isinstance(control, RowCheck):
            control = RowCheck(control.name, control.ok, unknown=control.unknown, threshold=Threshold(rate=round(1 - mostly, 9)))
        done.append(control)
    return done, left
