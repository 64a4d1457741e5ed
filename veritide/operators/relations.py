"""Relationships between datasets: comparisons of nine kinds, and proposals of likely references."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, kind: str, violating: Column, scanned: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("relationship"), scanned.cast("long").alias("scanned"), violating.cast("long").alias("violating"))


def _keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).dropna().distinct()


def row_count_parity(a: DataFrame, b: DataFrame, share: float = 0.0) -> DataFrame:
    """The counts differ by no more than a share of the first."""
    both = a.agg(F.count(F.lit(1)).alias("x")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("y"))))
    return _row(both, "row_count_parity", (F.abs(F.col("x") - F.col("y")) > share * F.col("x")).cast("int"), F.col("x"))


def aggregate_parity(a: DataFrame, b: DataFrame, column: str, tolerance: float = 0.0) -> DataFrame:
    """Sums, on exact decimals, differ by no more than an amount."""
    total = lambda df, n: df.agg(F.sum(F.col(column).try_cast("decimal(28,6)")).alias(n), F.count(F.lit(1)).alias(f"n{n}"))
    both = total(a, "x").join(F.broadcast(total(b, "y")))
    off = F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))) > F.lit(str(tolerance)).cast("decimal(28,6)")
    return _row(both, "aggregate_parity", off.cast("int"), F.col("nx"))


def value_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows of shared keys whose values differ; keys must be unique on both sides."""
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(column).alias("__v"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    joined = a.join(other, on)
    one = joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(column).eqNullSafe(F.col("__v"))).alias("bad"))
    return _row(one, "value_parity", F.col("bad"), F.col("n"))


def _sides(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    stacked = _keys(a, keys).withColumn("s", F.lit(1)).union(_keys(b, keys).withColumn("s", F.lit(2)))
    sides = stacked.groupBy(*[c for c in stacked.columns if c != "s"]).agg(F.sum("s").alias("s"))
    return sides.agg(*[F.count_if(F.col("s") == i).alias(n) for i, n in ((1, "only_a"), (2, "only_b"), (3, "both"))])


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """At least a share of the smaller side's keys is on both sides."""
    s = _sides(a, b, keys)
    smaller = F.col("both") + F.least("only_a", "only_b")
    return _row(s, "overlap", (F.col("both") < least * smaller).cast("int"), smaller)


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the first that the second lacks."""
    return _row(_sides(a, b, keys), "coverage", F.col("only_a"), F.col("only_a") + F.col("both"))


def mutually_exclusive(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on both sides."""
    return _row(_sides(a, b, keys), "mutually_exclusive", F.col("both"), F.col("only_a") + F.col("only_b") + F.col("both"))


def together_complete(a: DataFrame, b: DataFrame, population: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the population that neither side has."""
    return coverage(population.select(*keys), a.select(*keys).union(b.select(*keys)), keys).withColumn("relationship", F.lit("together_complete"))


def staleness(a: DataFrame, b: DataFrame, column: str, seconds: int) -> DataFrame:
    """The second's newest row is no further behind the first's than so many seconds."""
    newest = lambda df, n: df.agg(F.unix_timestamp(F.max(column).cast("timestamp")).alias(n), F.count(F.lit(1)).alias(f"n{n}"))
    both = newest(a, "x").join(F.broadcast(newest(b, "y")))
    late = F.coalesce(F.col("x") - F.col("y") > seconds, F.col("x").isNotNull())
    return _row(both, "staleness", late.cast("int"), F.col("nx"))


def identifier_consistency(a: DataFrame, b: DataFrame, key: str, identifier: str) -> DataFrame:
    """Keys that carry more than one identifier over both datasets."""
    both = a.select(key, identifier).union(b.select(key, identifier)).dropna()
    per_key = both.groupBy(key).agg(F.min(identifier).alias("x"), F.max(identifier).alias("y"))
    one = per_key.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") != F.col("y")).alias("bad"))
    return _row(one, "identifier_consistency", F.col("bad"), F.col("n"))


def _words(name: str) -> set[str]:
    parts = re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", name)
    return {w.lower() for w in parts} - {"", "id", "key", "code", "no"}


def name_strength(child: str, parent: str) -> float:
    """0.35 if two column names share a word beyond the usual endings."""
    return 0.35 if _words(child) & _words(parent) else 0.0


def confidence(strengths: Sequence[float]) -> float:
    """Independent signs, each held below certainty, combined."""
    out = 1.0
    for s in strengths:
        out *= 1 - min(s, 0.95)
    return 1 - out


def propose(found: DataFrame, schemas: Mapping[str, Sequence[str]]) -> list[tuple[str, str, float]]:
    """(child, parent, confidence) from mined inclusions (one row for each column pair), names and shared columns."""
    out = []
    for r in found.collect():
        ct, pt = r["child"].split(".")[0], r["parent"].split(".")[0]
        signs = [0.8 if r["orphans"] == 0 else 0.65, name_strength(r["child"].split(".")[-1], r["parent"].split(".")[-1])]
        a, b = set(schemas.get(ct, ())), set(schemas.get(pt, ()))
        if ct != pt and a | b and len(a & b) / len(a | b) >= 0.6:
            signs.append(0.5)
        out.append((r["child"], r["parent"], confidence(signs)))
    return sorted(out, key=lambda x: (-x[2], x[0], x[1]))
