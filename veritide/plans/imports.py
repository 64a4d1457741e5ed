"""Rules written for other tools, read as controls; what has no control is listed with the reason."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import predicates
from .controls import Control, Freshness, References, RowCheck, RowCount, Threshold, UniqueKey
from .declare import Attribute, Declaration

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


@dataclass
class Imported:
    """Controls by dataset, and (where, why) of each rule that has none."""

    controls: dict[str, list[Control]] = field(default_factory=dict)
    unmapped: list[tuple[str, str]] = field(default_factory=list)

    def add(self, dataset: str, control: Control) -> None:
        self.controls.setdefault(dataset, []).append(control)


def _between(c: Column, low, high) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return ok


def _check(name: str, ok: Column, rate: float | None = None, rows: int = 0) -> RowCheck:
    """A row check under which a missing value passes, as in the tools that rules come from."""
    return RowCheck(name, ok, unknown=predicates.PASSES, threshold=Threshold(rows=rows, rate=rate))


def _named(test) -> tuple[str, dict]:
    """A test given as a name or as {name: options}; packages before the name don't count."""
    if isinstance(test, str):
        name, options = test, {}
    else:
        name, options = next(iter(test.items()))
    options = dict(options or {})
    return name.rsplit(".", 1)[-1], {**options, **options.get("arguments", {})}


def _ref(text: str) -> str:
    """The dataset that ref('x') or source('s', 'x') names."""
    names = re.findall(r"['\"]([^'\"]+)['\"]", text)
    return names[-1] if names else text.strip()


def from_dbt(document: Mapping) -> Imported:
    """Column and model tests of a schema file: models, seeds, snapshots and the tables of sources."""
    out = Imported()
    models = [m for part in ("models", "seeds", "snapshots") for m in document.get(part) or ()]
    models += [t for s in document.get("sources") or () for t in s.get("tables") or ()]

    def column_test(dataset: str, c: str, kind: str, k: dict) -> Control | str:
        name = f"{dataset}.{c}.{kind}"
        if kind == "not_null":
            return RowCheck(name, F.col(c).isNotNull(), where=k.get("where"))
        if kind == "unique":
            return UniqueKey(name, (c,), where=k.get("where"))
        if kind == "accepted_values":
            return _check(name, predicates.in_list(c, k["values"])) if k.get("values") else "it lists no values"
        if kind == "relationships":
            if not k.get("to") or not k.get("field"):
                return "it doesn't name a target and a field"
            # That tool passes over missing values.
            return References(name, c, _ref(k["to"]), k["field"], where=F.col(c).isNotNull())
        if kind == "accepted_range":
            low, high = k.get("min_value"), k.get("max_value")
            if low is None and high is None:
                return "it has no bound"
            if not k.get("inclusive", True):
                strict = F.lit(True)
                strict = strict & (F.col(c) > low) if low is not None else strict
                return _check(name, strict & (F.col(c) < high) if high is not None else strict)
            return _check(name, _between(F.col(c), low, high))
        if kind == "not_null_proportion":
            return RowCheck(name, F.col(c).isNotNull(), threshold=Threshold(rate=round(1 - float(k.get("at_least", 1.0)), 9)))
        return "no control says the same"

    for m in models:
        dataset = m["name"]
        for test in m.get("tests") or m.get("data_tests") or ():
            kind, k = _named(test)
            if kind == "unique_combination_of_columns" and k.get("combination_of_columns"):
                out.add(dataset, UniqueKey(f"{dataset}.{kind}", tuple(k["combination_of_columns"])))
            elif kind == "expression_is_true" and k.get("expression"):
                out.add(dataset, _check(f"{dataset}.{kind}", F.expr(k["expression"])))
            else:
                out.unmapped.append((f"{dataset}: {kind}", "no control says the same"))
        for column in m.get("columns") or ():
            for test in column.get("tests") or column.get("data_tests") or ():
                kind, k = _named(test)
                made = column_test(dataset, column["name"], kind, k)
                if isinstance(made, str):
                    out.unmapped.append((f"{dataset}.{column['name']}: {kind}", made))
                else:
                    out.add(dataset, made)
    return out


_SODA = re.compile(r"^(?P<metric>\w+)(?:\((?P<args>[^)]*)\))?\s*(?P<op><=|>=|=|<|>|between)\s*(?P<value>.+)$", re.IGNORECASE)
_SODA_REFERENCE = re.compile(r"^values in\s*\(?(?P<column>\w+)\)?\s+must exist in\s+(?P<parent>\w+)\s*\(?(?P<of>\w+)\)?$", re.IGNORECASE)


def from_soda(document: Mapping, instant: str | None = None) -> Imported:
    """Checks of "checks for <dataset>" blocks; freshness is judged at ``instant``."""
    out = Imported()

    def count_threshold(op: str, value: str, percent: bool) -> Threshold | str:
        n = float(value.strip().rstrip("%"))
        if op in (">", ">=") or op == "=" and n > 0:
            return "a lower bound on failures says that data are broken"
        if percent:
            return Threshold(rate=max(n / 100 - (1e-9 if op == "<" else 0), 0.0))
        return Threshold(rows=max(int(n) - (op == "<"), 0))

    def one(dataset: str, text: str, options: Mapping) -> Control | str:
        if m := _SODA_REFERENCE.match(text):
            return References(f"{dataset}: {text}", m["column"], m["parent"], m["of"], where=F.col(m["column"]).isNotNull())
        if not (m := _SODA.match(text)):
            return "its form is not known"
        metric, op, value = m["metric"].lower(), m["op"].lower(), m["value"].strip()
        columns = tuple(c.strip() for c in (m["args"] or "").split(",") if c.strip())
        name, percent = f"{dataset}: {text}", value.endswith("%") or metric.endswith("_percent")
        if metric == "row_count":
            if op == "between":
                low, high = re.split(r"\s+and\s+", value, flags=re.IGNORECASE)
                return RowCount(name, int(low), int(high))
            n = int(value)
            bounds = {"=": (n, n), ">": (n + 1, None), ">=": (n, None), "<": (None, n - 1), "<=": (None, n)}
            return RowCount(name, *bounds[op])
        if op == "between":
            return f"a range of {metric} has no control"
        if not columns:
            return "it names no column"
        if metric == "freshness":
            span = re.fullmatch(r"(\d+)\s*([smhd])", value)
            if not span or op not in ("<", "<=") or not instant:
                return "freshness takes an upper bound such as 1d, and an instant to judge at"
            return Freshness(name, columns[0], instant, int(span[1]) * _SECONDS[span[2]])
        threshold = count_threshold(op, value, percent)
        if isinstance(threshold, str):
            return threshold
        base = re.sub(r"_(count|percent)$", "", metric)
        if base == "missing":
            return RowCheck(name, F.col(columns[0]).isNotNull(), threshold=threshold)
        if base == "duplicate":
            return UniqueKey(name, columns, threshold=threshold)
        if base == "invalid":
            c = columns[0]
            rules = {
                "valid values": lambda v: predicates.in_list(c, v), "valid regex": lambda v: predicates.matches(c, v), "valid min": lambda v: F.col(c) >= v,
                "valid max": lambda v: F.col(c) <= v, "valid length": lambda v: F.length(c) == v, "valid min length": lambda v: F.length(c) >= v, "valid max length": lambda v: F.length(c) <= v,
            }
            ok = [rules[k](v) for k, v in options.items() if k in rules]
            if not ok or any(k.startswith("valid") and k not in rules for k in options):
                return "what is valid isn't stated in a way that is known"
            both = ok[0]
            for x in ok[1:]:
                both = both & x
            return RowCheck(name, both, unknown=predicates.PASSES, threshold=threshold)
        return f"{metric} has no control"

    for header, checks in document.items():
        block = re.match(r"^checks for\s+(\w+)\s*$", str(header), re.IGNORECASE)
        if not block:
            out.unmapped.append((str(header), "only blocks of checks are read"))
            continue
        for c in checks or ():
            text, options = (c, {}) if isinstance(c, str) else next(iter(c.items()))
            made = one(block[1], str(text).strip(), options or {})
            if isinstance(made, str):
                out.unmapped.append((f"{block[1]}: {text}", made))
            else:
                out.add(block[1], made)
    return out


# Names of expectations.
_EXPECTED: dict[str, Callable[[dict], Column]] = {
    "expect_column_values_to_be_in_set": lambda k: predicates.in_list(k["column"], k["value_set"]),
    "expect_column_values_to_not_be_in_set": lambda k: ~predicates.in_list(k["column"], k["value_set"]),
    "expect_column_values_to_be_between": lambda k: _between(F.col(k["column"]), k.get("min_value"), k.get("max_value")),
    "expect_column_value_lengths_to_be_between": lambda k: _between(F.length(k["column"]), k.get("min_value"), k.get("max_value")),
    "expect_column_value_lengths_to_equal": lambda k: F.length(k["column"]) == k["value"],
    "expect_column_values_to_match_regex": lambda k: predicates.matches(k["column"], k["regex"]),
}


def from_expectations(dataset: str, document: Mapping) -> Imported:
    """A suite of expectations; ``mostly`` becomes the largest violating share."""
    out = Imported()
    for i, e in enumerate(document.get("expectations") or ()):
        kind, k = e.get("expectation_type") or e.get("type"), e.get("kwargs") or {}
        name = f"{dataset}.{i}.{kind}"
        rate = None if k.get("mostly") is None else round(1 - float(k["mostly"]), 9)
        if kind == "expect_column_values_to_not_be_null":
            out.add(dataset, RowCheck(name, F.col(k["column"]).isNotNull(), threshold=Threshold(rate=rate)))
        elif kind == "expect_column_values_to_be_null":
            out.add(dataset, RowCheck(name, F.col(k["column"]).isNull(), threshold=Threshold(rate=rate)))
        elif kind == "expect_column_values_to_be_unique":
            out.add(dataset, UniqueKey(name, (k["column"],), threshold=Threshold(rate=rate)))
        elif kind == "expect_compound_columns_to_be_unique":
            out.add(dataset, UniqueKey(name, tuple(k["column_list"]), threshold=Threshold(rate=rate)))
        elif kind == "expect_table_row_count_to_be_between":
            out.add(dataset, RowCount(name, k.get("min_value"), k.get("max_value")))
        elif kind == "expect_table_row_count_to_equal":
            out.add(dataset, RowCount(name, k["value"], k["value"]))
        elif kind in _EXPECTED:
            out.add(dataset, _check(name, _EXPECTED[kind](k), rate))
        else:
            out.unmapped.append((name, "no control says the same"))
    return out


def from_contract(contract: Mapping) -> tuple[Declaration, list[str]]:
    """(declaration, what didn't come across) of an open data contract's first schema object."""
    schemas = contract.get("schema") or []
    if not isinstance(schemas, list) or not schemas or not isinstance(schemas[0], Mapping):
        raise ValueError("the contract has no list of schema objects")
    first, left = schemas[0], []
    if len(schemas) > 1:
        left.append(f"{len(schemas) - 1} further schema objects")
    left += [k for k in ("slaProperties", "team", "roles", "support", "price") if contract.get(k)]
    attributes, grain = [], []
    for p in first.get("properties") or ():
        options = p.get("logicalTypeOptions") or {}
        attributes.append(Attribute(p["name"], bool(p.get("required")), low=options.get("minimum"), high=options.get("maximum"), domain=tuple(options.get("enum") or ())))
        if p.get("primaryKey"):
            grain.append((p.get("primaryKeyPosition", 0), p["name"]))
        left += [f"{p['name']}: {k}" for k in ("classification", "transformLogic", "quality") if p.get(k)]
    return Declaration(first.get("name") or contract.get("dataProduct") or "", tuple(n for _, n in sorted(grain)), tuple(attributes)), left


#: Metrics and rules of open data contracts, by what they count.
_MISSING, _DOUBLE, _INVALID = ("nullValues", "nullCheck", "missingValues"), ("duplicateValues", "duplicateCount", "uniqueCheck"), ("invalidValues", "validValues")


def _allowed(block: Mapping) -> Threshold | str:
    """The threshold that a rule's bounds on failures allow; "less than 10" lets nine pass."""
    percent = str(block.get("unit", "")).lower() in ("percent", "%")
    if "mustBe" in block and block["mustBe"] == 0:
        return Threshold(rate=0.0) if percent else Threshold()
    for key, strict in (("mustBeLessOrEqualTo", False), ("mustBeLessThan", True)):
        if key in block:
            most = float(block[key])
            if percent:
                return Threshold(rate=max(most / 100 - (1e-9 if strict else 0), 0.0))
            return Threshold(rows=max(math.ceil(most) - 1 if strict else math.floor(most), 0))
    for key, strict in (("mustBeGreaterOrEqualTo", False), ("mustBeGreaterThan", True)):
        if key in block:
            least = float(block[key])
            if percent:
                return Threshold(rate=least / 100 + (1e-9 if strict else 0), at_least=True)
            return Threshold(rows=math.floor(least) + 1 if strict else math.ceil(least), at_least=True)
    if any(k.startswith("must") for k in block):
        return "its bounds aren't those of a control"
    return Threshold()


def _quality(dataset: str, column: str | None, i: int, block: Mapping) -> Control | str:
    kind = block.get("type", "library")
    if kind == "text":
        return "it is a text for people"
    if kind == "custom":
        return f"it is written for {block.get('engine', 'another engine')}"
    if kind == "sql":
        return "its query is run by suite.custom_sql()"
    rule = block.get("metric") or block.get("rule")
    options = block.get("arguments") or {}
    where = f"{dataset}.{column}" if column else dataset
    name = block.get("name") or f"{where}.{rule}.{i}"
    if rule == "rowCount":
        between = block.get("mustBeBetween") or (None, None)
        low = block.get("mustBeGreaterOrEqualTo", between[0] if "mustBeGreaterThan" not in block else math.floor(block["mustBeGreaterThan"]) + 1)
        high = block.get("mustBeLessOrEqualTo", between[1] if "mustBeLessThan" not in block else math.ceil(block["mustBeLessThan"]) - 1)
        if "mustBe" in block:
            low = high = block["mustBe"]
        return RowCount(name, low, high) if low is not None or high is not None else "it has no bound"
    allowed = _allowed(block)
    if isinstance(allowed, str):
        return allowed
    if rule in _DOUBLE:
        key = tuple(options.get("properties") or ([column] if column else ()))
        return UniqueKey(name, key, threshold=allowed) if key else "it names no columns"
    if column is None:
        return "it is about a column, and none is named"
    if rule in _MISSING:
        blanks = [v for v in options.get("missingValues") or () if v is not None]
        ok = F.col(column).isNotNull()
        return RowCheck(name, ok & ~F.col(column).cast("string").isin(*map(str, blanks)) if blanks else ok, threshold=allowed)
    if rule in _INVALID:
        values, pattern = options.get("validValues") or block.get("validValues"), options.get("pattern")
        if not values and not pattern:
            return "it says nothing of what is valid"
        ok = predicates.in_list(column, values) if values else F.lit(True)
        return RowCheck(name, ok & F.col(column).rlike(f"^(?:{pattern})$") if pattern else ok, unknown=predicates.PASSES, threshold=allowed)
    return "no control says the same"


def from_contracts(contract: Mapping) -> tuple[list[Declaration], Imported]:
    """(declarations, controls of quality rules by dataset) of every schema object of an open data contract.

    Rules of a library become controls with the bounds that they state; texts,
    queries and rules for other engines, and what no control says, are listed as
    unmapped, each with why.
    """
    out, declared = Imported(), []
    for one in contract.get("schema") or ():
        declaration, left = from_contract({**contract, "schema": [one]})
        declared.append(declaration)
        out.unmapped.extend((f"{declaration.dataset}: {what}", "no part of a declaration") for what in left if not what.endswith(": quality"))
        blocks = [(None, b) for b in one.get("quality") or ()] + [(p["name"], b) for p in one.get("properties") or () for b in p.get("quality") or ()]
        for i, (column, block) in enumerate(blocks):
            made = _quality(declaration.dataset, column, i, block)
            if isinstance(made, str):
                out.unmapped.append((f"{declaration.dataset}{'.' + column if column else ''}: {block.get('metric') or block.get('rule') or block.get('type')}", made))
            else:
                out.add(declaration.dataset, made)
    return declared, out


def to_contract(d: Declaration, version: str = "v3.0.0") -> dict:
    """An open data contract that from_contract() reads back."""
    def one(a: Attribute) -> dict:
        options = {k: v for k, v in (("minimum", a.low), ("maximum", a.high), ("enum", list(a.domain) or None)) if v is not None}
        out = {"name": a.name, "required": a.required, **({"logicalTypeOptions": options} if options else {})}
        if a.name in d.grain:
            out |= {"primaryKey": True, "primaryKeyPosition": d.grain.index(a.name) + 1}
        return out

    known = {a.name for a in d.attributes}
    parts = [*d.attributes, *[Attribute(g) for g in d.grain if g not in known]]
    return {"apiVersion": version, "kind": "DataContract", "schema": [{"name": d.dataset, "properties": [one(a) for a in parts]}]}


def bind(controls: Sequence[Control], **values) -> list[Control]:
    """Controls whose texts name parameters as $name, with the values in their place as SQL literals; a name without a value raises."""
    from dataclasses import fields, replace

    def literal(v) -> str:
        if v is None or isinstance(v, bool):
            return str(v).lower() if v is not None else "null"
        if isinstance(v, int | float):
            return repr(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def put(text: str) -> str:
        def value(m: re.Match) -> str:
            if m[1] not in values:
                raise ValueError(f"no value for ${m[1]}")
            return literal(values[m[1]])

        # Text in quotes stays as it is.
        return "".join(p if i % 2 else re.sub(r"\$([A-Za-z_]\w*)", value, p) for i, p in enumerate(re.split(r"('(?:[^'\\]|\\.)*')", text)))

    out = []
    for c in controls:
        texts = {f.name: put(v) for f in fields(c) if f.name in ("ok", "where") and isinstance(v := getattr(c, f.name), str)}
        out.append(replace(c, **texts) if texts else c)
    return out
