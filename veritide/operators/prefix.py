"""Running totals over a global order without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def running_totals(df: DataFrame, order: Sequence[str | Column], sums: Sequence[str], following: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Adds total_<c>, the sum of each ``sums`` column up to and including a row in ``order``, and next, the ``following`` of the row after it.

    Rows are dealt to partitions by range; each partition's sums, one row each,
    become the offsets of those after it.  ``order`` must tell rows apart and, with ``following``, rise.  With
    ``within``, each group of these columns is totalled by itself; a partition
    then has a row of sums for each group in it, and a large group many partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *within, *order).withColumn("__part", F.spark_partition_id()))
    first = F.min_by(following, F.struct(*order)) if following else F.lit(None)
    groups = [f"__w{i}" for i in range(len(within))]
    per = placed.groupBy(*[F.col(c).alias(g) for c, g in zip(within, groups, strict=True)], "__part").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums)], first.alias("first"))
    # One row for each partition, or for each partition and group.
    w = Window.partitionBy(*groups).orderBy("__part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *groups, F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))], F.lead("first").over(w).alias("__next")
    )
    on = F.col("__part") == F.col("__p")
    for c, g in zip(within, groups, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(g))
    inside = Window.partitionBy(*within, "__part").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets if within else F.broadcast(offsets), on)
    totals = {f"total_{c}": F.coalesce(F.sum(c).over(run), F.lit(0)) + F.col(f"__b{i}") for i, c in enumerate(sums)}
    if following:
        totals["next"] = F.coalesce(F.lead(following).over(inside), F.col("__next"))
    return out.withColumns(totals).drop("__part", "__p", "__next", *groups, *[f"__b{i}" for i in range(len(sums))])
