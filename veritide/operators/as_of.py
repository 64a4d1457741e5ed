"""As-of join: the latest row of another table at or before each row's time, carried across ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], found: str = "as_of", seconds: float | None = None) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` of its key at or before its time, and that row's time as ``found``.

    ``by`` and ``on`` are columns of both sides.  A value may be carried over any
    stretch of time, or over ``seconds`` at most.  Rows come out as often as they
    went in; where nothing came before, where the time is null or some key is,
    the values are null.  Of several rows of ``right`` of one key and time, the
    one of the greatest values counts.

    Both sides are dealt out by range of key and time, so a key with most of the
    rows is many partitions.  Within one, values are carried forward; only the
    first key of a partition can have begun before it, so what is carried into
    partitions is one row for each of them at most, and is broadcast.
    """
    spark = left.sparkSession
    own = left.columns
    known = F.col(on).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    value = F.struct(F.col(on).alias("__at"), *[F.col(c) for c in values])
    given = right.where(known).groupBy(*by, on).agg(F.max(value).alias("__v")).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(on).alias("__t"), "__v", F.lit(None).alias("__row"))
    asked = left.where(known).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(on).alias("__t"), F.lit(None).alias("__v"), F.struct(*own).alias("__row"))
    keys = [f"__b{i}" for i in range(len(by))]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A value stands before the rows of its own time.
    first = F.col("__row").isNotNull().alias("__asks")
    placed = cut(given.unionByName(asked).withColumn("__asks", first).repartitionByRange(n, *keys, "__t", "__asks").withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part", *keys).orderBy("__t", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("__in", F.last("__v", ignorenulls=True).over(w))
    last = placed.groupBy("__part", *keys).agg(F.max("__v").alias("__last"))
    # One row for each partition and key; a key's parts are as many as it has partitions.
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("__before", F.max("__last").over(earlier)).where("__before IS NOT NULL").select(F.col("__part").alias("__p"), *[F.col(k).alias(f"{k}_p") for k in keys], "__before")
    on_part = F.col("__part") == F.col("__p")
    for k in keys:
        on_part = on_part & (F.col(k) == F.col(f"{k}_p"))
    joined = inside.where("__asks").join(F.broadcast(carried), on_part, "left")
    best = F.coalesce("__in", "__before")
    if seconds is not None:
        age = F.col("__t").cast("timestamp").cast("double") - best["__at"].cast("timestamp").cast("double")
        best = F.when(age <= seconds, best)
    out = joined.withColumn("__best", best).select("__row.*", *[F.col(f"__best.{c}").alias(c) for c in values], F.col("__best.__at").alias(found))
    rest = left.where(~known).select(*own, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values], F.lit(None).cast(right.schema[on].dataType).alias(found))
    return out.unionByName(rest)
