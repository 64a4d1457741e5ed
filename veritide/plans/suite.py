"""Evaluation of many controls in few scans.

All row controls over one dataset and segmentation share a single aggregation;
their scopes become conditional aggregates, and equal aggregates are computed
once.  Key controls aggregate by key first, so that one hot key is combined
before the shuffle, and each adds one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .controls import FAIL, INDETERMINATE, PASS, Control, Dependency, References, RowCheck, UniqueKey

METRICS = ("scanned_rows", "violating_rows")


@dataclass(frozen=True)
class Cost:
    controls: int
    scans: int


def cost(controls: Sequence[Control]) -> Cost:
    """Controls against the scans that they need."""
    keyed = sum(isinstance(c, UniqueKey | Dependency | References) for c in controls)
    return Cost(len(controls), keyed + (keyed < len(controls)))


def check(df: DataFrame, controls: Sequence[Control]) -> None:
    """Raise for controls that the schema or repeatability rules out."""
    wrong = [w for c in controls for w in c.validate(df.schema)]
    names = [c.name for c in controls]
    wrong += [f"{n}: two controls of that name" for n in sorted({n for n in names if names.count(n) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))


def _fused(df: DataFrame, controls: Sequence[Control], segments: Sequence[str]) -> DataFrame:
    aggregates: dict[str, Column] = {}
    where: dict[tuple[str, str], str] = {}
    for c in controls:
        for metric, value in c.aggregates().items():
            where[c.name, metric] = str(value)
            aggregates.setdefault(str(value), value)
    alias = {text: f"m{i}" for i, text in enumerate(aggregates)}
    wide = df.groupBy(*segments).agg(*[v.alias(alias[t]) for t, v in aggregates.items()])
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("control"),
                *[F.col(alias[where[c.name, m]]).cast("long").alias(m) for m in METRICS],
                c.verdict(lambda m, c=c: F.col(alias[where[c.name, m]])).alias("verdict"),
            )
            for c in controls
        ]
    )
    return wide.select(*segments, F.inline(rows))


def _judged(df: DataFrame, c: Control, segments: Sequence[str]) -> DataFrame:
    return df.select(
        *segments,
        F.lit(c.name).alias("control"),
        *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in METRICS],
    ).withColumn("verdict", c.verdict(F.col))


def _unique(df: DataFrame, c: UniqueKey, segments: Sequence[str]) -> DataFrame:
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in c.key])
    keys = df.where(c.scope()).groupBy(*segments, *[k for k in c.key if k not in segments]).agg(F.count(F.lit(1)).alias("n"))
    out = keys.groupBy(*segments).agg(
        F.sum("n").alias("scanned_rows"), F.sum(F.when(complete, F.col("n") - 1).otherwise(F.col("n"))).alias("violating_rows")
    )
    return _judged(out, c, segments)


def _dependency(df: DataFrame, c: Dependency, segments: Sequence[str]) -> DataFrame:
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*c.determinant, c.dependent)])
    group = [*segments, *[k for k in c.determinant if k not in segments]]
    scoped = df.where(c.scope())
    pairs = scoped.groupBy(*group, c.dependent).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.groupBy(*group).agg(F.sum("n").alias("n"), F.count_if(known).alias("d"))
    out = each.groupBy(*segments).agg(
        F.sum("n").alias("scanned_rows"), F.sum(F.greatest(F.col("d") - 1, F.lit(0))).alias("violating_rows")
    )
    return _judged(out, c, segments)


def orphans(df: DataFrame, c: References, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Rows in scope whose child value is null or not among the parent's."""
    there = parents[c.parent].select(F.col(c.parent_column).alias("__parent")).distinct()
    return df.where(c.scope()).join(there, F.col(c.column) == F.col("__parent"), "left_anti")


def _references(df: DataFrame, c: References, segments: Sequence[str], parents: Mapping[str, DataFrame]) -> DataFrame:
    # Counting by value first leaves the join one row for each value and segment.
    counted = df.where(c.scope()).groupBy(*segments, F.col(c.column).alias("__child")).agg(F.count(F.lit(1)).alias("n"))
    there = parents[c.parent].select(F.col(c.parent_column).alias("__parent")).distinct()
    joined = counted.join(there, F.col("__child") == F.col("__parent"), "left")
    out = joined.groupBy(*segments).agg(
        F.sum("n").alias("scanned_rows"), F.sum(F.when(F.col("__parent").isNull(), F.col("n")).otherwise(0)).alias("violating_rows")
    )
    return _judged(out, c, segments)


def evaluate(
    df: DataFrame,
    controls: Sequence[Control],
    segments: Sequence[str] = (),
    having: Column | None = None,
    parents: Mapping[str, DataFrame] | None = None,
    scan_limit: int | None = None,
) -> DataFrame:
    """One row for each control and segment: segments, control, scanned_rows, violating_rows, verdict.

    A null segment value stays null.  ``having`` filters on the result's columns
    before anything is rolled up.  With ``scan_limit`` only that many rows are
    read, for a preview; a column ``coverage`` then says so.
    """
    check(df, controls)
    if scan_limit is not None:
        return evaluate(df.limit(scan_limit), controls, segments, having, parents).withColumn("coverage", F.lit("preview"))
    parts, fused = [], [c for c in controls if hasattr(c, "aggregates")]
    if fused:
        parts.append(_fused(df, fused, segments))
    for c in controls:
        if isinstance(c, UniqueKey):
            parts.append(_unique(df, c, segments))
        elif isinstance(c, Dependency):
            parts.append(_dependency(df, c, segments))
        elif isinstance(c, References):
            parts.append(_references(df, c, segments, parents or {}))
    out = reduce(DataFrame.unionByName, parts)
    return out if having is None else out.where(having)


def roll_up(results: DataFrame) -> DataFrame:
    """One row per control over its segments: any fail fails, none judged is indeterminate; counts are sums."""
    fail, known = F.count_if(F.col("verdict") == FAIL), F.count_if(F.col("verdict") != INDETERMINATE)
    return results.groupBy("control").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("scanned_rows").alias("scanned_rows"),
        F.sum("violating_rows").alias("violating_rows"),
        F.when(fail > 0, FAIL).when(known > 0, PASS).otherwise(INDETERMINATE).alias("verdict"),
    )


def samples(df: DataFrame, control: RowCheck, columns: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` violating rows in a stated order; a top-n, so that runs agree."""
    return df.where(control.scope() & control.violating()).select(*columns).orderBy(*order).limit(n)


def quarantine(df: DataFrame, controls: Sequence[RowCheck]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; bad rows carry the names of the controls that they violate."""
    reasons = F.array_compact(F.array(*[F.when(c.scope() & c.violating(), F.lit(c.name)) for c in controls]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def delegate(df: DataFrame, name: str, violates, columns: Sequence[str], threshold=None) -> DataFrame:
    """Judge rows by a Python function from a pandas frame of ``columns`` to a Boolean for each row (true: it violates).

    Rows go through in Arrow batches, counted within their batch; an answer that
    is missing counts as a violation.
    """
    from .controls import Threshold

    def count(batches):
        import pandas as pd

        for batch in batches:
            bad = pd.Series(violates(batch)).astype("boolean").fillna(True)
            if len(bad) != len(batch):
                raise ValueError(f"{name}: {len(bad)} answers for {len(batch)} rows")
            yield pd.DataFrame({"n": [len(batch)], "bad": [int(bad.sum())]})

    counts = df.select(*columns).mapInPandas(count, "n long, bad long")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned_rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("violating_rows"))
    return _judged(totals, RowCheck(name, F.lit(True), threshold=threshold or Threshold()), ())


def custom_sql(spark, query: str, name: str, threshold=None, **tables: DataFrame) -> DataFrame:
    """Judge a query that returns violating_rows and, if it likes, scanned_rows."""
    from ..sources.guard import read_only
    from .controls import RowCheck, Threshold

    for view, df in tables.items():
        df.createOrReplaceTempView(view)
    found = spark.sql(read_only(query))
    if "violating_rows" not in found.columns:
        raise ValueError("the query has no column violating_rows")
    if "scanned_rows" not in found.columns:
        found = found.withColumn("scanned_rows", F.lit(None).cast("long"))
    control = RowCheck(name, F.lit(True), threshold=threshold or Threshold())
    return found.select(
        F.lit(name).alias("control"), *[F.col(m).cast("long").alias(m) for m in METRICS]
    ).withColumn("verdict", control.verdict(F.col))
