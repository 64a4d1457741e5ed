"""Differences between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Places that copies of one row are dealt to.
SPREAD = 16


def schema_diff(spark, old: StructType, new: StructType) -> DataFrame:
    """(column, change, old_type, new_type) for added, removed and retyped columns."""
    a = {f.name: f.dataType.simpleString() for f in old}
    b = {f.name: f.dataType.simpleString() for f in new}
    rows = [
        (c, "added" if c not in a else "removed" if c not in b else "retyped", a.get(c), b.get(c))
        for c in sorted({*a, *b})
        if a.get(c) != b.get(c)
    ]
    return spark.createDataFrame(rows, "column string, change string, old_type string, new_type string")


def row_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: change (added, removed, changed, unchanged, ambiguous) and the changed columns.

    Keys compare null-safely.  A key that occurs twice on a side is ambiguous:
    neither row is taken for the other.
    """
    shared = [c for c in old.columns if c in new.columns and c not in keys]

    def side(df: DataFrame, p: str) -> DataFrame:
        one = df.groupBy(*[F.col(k).alias(f"{p}{i}") for i, k in enumerate(keys)])
        return one.agg(F.count(F.lit(1)).alias(f"{p}n"), *[F.first(c).alias(f"{p}_{c}") for c in shared])

    on = reduce(lambda x, y: x & y, [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(keys))])
    joined = side(old, "a").join(side(new, "b"), on, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in shared] or [F.lit(None).cast("string")]))
    change = (
        F.when((F.col("an") > 1) | (F.col("bn") > 1), "ambiguous")
        .when(F.col("an").isNull(), "added")
        .when(F.col("bn").isNull(), "removed")
        .when(F.size(changed) > 0, "changed")
        .otherwise("unchanged")
    )
    both = F.col("an").isNotNull() & F.col("bn").isNotNull()
    return joined.select(
        *[F.when(F.col("an").isNotNull(), F.col(f"a{i}")).otherwise(F.col(f"b{i}")).alias(k) for i, k in enumerate(keys)],
        change.alias("change"),
        F.when(both & (change == "changed"), changed).otherwise(F.array().cast("array<string>")).alias("columns"),
    )


def column_changes(diff: DataFrame) -> DataFrame:
    """(column, keys): in how many keys each column changed."""
    return diff.select(F.explode("columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("keys"))


def examples(diff: DataFrame, keys: Sequence[str], n: int = 100) -> DataFrame:
    """The first ``n`` keys of each change, by key; Spark limits each partition to ``n`` of a kind before the shuffle (for n up to 1,000)."""
    w = Window.partitionBy("change").orderBy(*keys)
    return diff.where("change <> 'unchanged'").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def selector_drift(approved: DataFrame, now: DataFrame) -> DataFrame:
    """(selector, attribute, change): attributes that a selector takes in or leaves out since it was approved."""
    pair = lambda df, side: df.select("selector", "attribute").distinct().withColumn("__s", F.lit(side))
    sides = pair(approved, 1).unionByName(pair(now, 2)).groupBy("selector", "attribute").agg(F.sum("__s").alias("__s"))
    return sides.where("__s < 3").select("selector", "attribute", F.when(F.col("__s") == 2, "added").otherwise("removed").alias("change"))


def keyless_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, rows): distinct rows only in the old table, only in the new one, and in both.

    Rows are dealt out by what they hold before they are combined, copies of one
    row to ``SPREAD`` places at most, so that no task combines a whole file's
    rows and none has all copies of a frequent one.
    """
    columns = [c for c in old.columns if c in new.columns]
    side = lambda df, s: df.select(*columns, F.lit(s == 1).alias("__old"), F.lit(s == 2).alias("__new"))
    both = side(old, 1).union(side(new, 2))
    dealt = both.withColumn("__place", F.monotonically_increasing_id() % SPREAD).repartition(*columns, "__place").drop("__place")
    sides = dealt.groupBy(*columns).agg(F.max("__old").alias("__old"), F.max("__new").alias("__new"))
    name = F.when(~F.col("__new"), "removed").when(~F.col("__old"), "added").otherwise("unchanged")
    return sides.groupBy(name.alias("change")).agg(F.count(F.lit(1)).alias("rows"))
