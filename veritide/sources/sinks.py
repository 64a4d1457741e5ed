"""Metrics and evidence, appended to partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Rows (dataset, metric, value, computed_at, ...) by day."""
    metrics.withColumn("day", F.to_date("computed_at")).write.mode("append").partitionBy("day").parquet(path)


#: Leading hexadecimal digits by which a run's hashes are gathered, 4,096 groups of them.
_GROUP = 3


def _chained(rows: DataFrame, column: str, previous: Column) -> DataFrame:
    """(run, digest): hash of the previous run's and of this run's hashes in order, gathered by their first digits."""
    groups = rows.groupBy("run", F.substring(column, 1, _GROUP).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ""), 256).alias("h"), F.min(previous).alias("p"))
    return groups.groupBy("run").agg(F.sha2(F.concat(F.min("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "")), 256).alias("digest"))


def append_evidence(results: DataFrame, path: str, run: str, previous: str = "") -> str:
    """Append a run's verdicts, each with the hash of its content and the run's place in the chain; returns the run's hash.

    Records hash on their own, in parallel; the chain links one digest per run.
    """
    spark = results.sparkSession
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(results.columns)])), 256)
    hashed = results.withColumn("content_hash", content)
    digest = _chained(hashed.withColumn("run", F.lit(run)), "content_hash", F.lit(previous)).first()["digest"]
    hashed.withColumns({"run": F.lit(run), "previous": F.lit(previous), "run_hash": F.lit(digest)}).write.mode("append").partitionBy("run").parquet(path)
    return digest


def verify_chain(spark: SparkSession, path: str) -> DataFrame:
    """(run, intact): whether each run's records still give its hash."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in ("content_hash", "run", "previous", "run_hash")]
    again = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(fields)])), 256)
    checked = rows.withColumn("again", again)
    whole = _chained(checked, "again", F.col("previous")).withColumnRenamed("run", "of_run")
    each = checked.groupBy("run").agg((F.count_if(F.col("again") != F.col("content_hash")) == 0).alias("same"), F.first("run_hash").alias("run_hash"))
    return each.join(whole, F.col("run") == F.col("of_run")).select("run", (F.col("same") & (F.col("digest") == F.col("run_hash"))).alias("intact"))


def merkle_root(records: DataFrame, column: str = "content_hash") -> str:
    """Root over sorted record hashes, pairing level by level in Spark; equal hashes are told apart by a count."""
    from ..operators.prefix import running_totals

    counted = records.groupBy(F.col(column).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, ["h"], ["n"])
    level = placed.select("h", F.explode(F.sequence(F.col("total_n") - F.col("n"), F.col("total_n") - 1)).alias("i"))
    n = level.count()
    while n > 1:
        level = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
        n = (n + 1) // 2
    row = level.select("h").first()
    return row[0] if row else ""
