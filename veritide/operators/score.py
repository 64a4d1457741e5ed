"""Scores over verdicts: dimensions, composites, service levels, remediation order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals


def dimension_scores(results: DataFrame, by: Sequence[str] = ("dataset", "dimension")) -> DataFrame:
    """Share of scanned rows that pass; results that scanned nothing take no part."""
    return results.where("scanned_rows > 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("controls"),
        (1 - F.sum("violating_rows").cast("double") / F.sum("scanned_rows")).alias("score"),
    )


def composite(scores: DataFrame, tiers: Mapping[str, float], how: str = "weighted") -> DataFrame:
    """One score per dataset from rows (dataset, tier, score, rows): mean, min, or tiers weighted by criticality."""
    if how == "mean":
        return scores.groupBy("dataset").agg(F.avg("score").alias("score"))
    if how == "min":
        return scores.groupBy("dataset").agg(F.min("score").alias("score"))
    each = scores.groupBy("dataset", "tier").agg(F.try_divide(F.sum(F.col("score") * F.col("rows")), F.sum("rows")).alias("s"))
    weights = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    w = F.coalesce(F.try_element_at(weights, F.col("tier")), F.lit(1.0))
    return each.groupBy("dataset").agg(F.try_divide(F.sum(F.col("s") * w), F.sum(w)).alias("score"))


def _card(grouped) -> DataFrame:
    of = lambda v: F.count_if(F.col("verdict") == v)
    return grouped.agg(
        F.count(F.lit(1)).alias("controls"), of("pass").alias("passed"), of("fail").alias("failed"), of("indeterminate").alias("unjudged"),
        F.try_divide(of("pass").cast("double"), of("pass") + of("fail")).alias("pass_rate"),
    )


def scorecard(results: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return _card(results.groupBy(*by))


def estate(results: DataFrame, whole: str = "(all)") -> DataFrame:
    """A card for each dataset and one, named ``whole``, for all of them; results of no dataset are left out."""
    cards = _card(results.where("dataset is not null").rollup("dataset"))
    return cards.withColumn("dataset", F.coalesce("dataset", F.lit(whole)))


def service_level(results: DataFrame, objective: float, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Attained share, error budget and how much of it is used up."""
    attained = 1 - F.try_divide(F.sum("violating_rows").cast("double"), F.sum("scanned_rows"))
    out = results.groupBy(*by).agg(attained.alias("attained"))
    return out.select(*by, "attained", F.lit(1 - objective).alias("budget"), F.try_divide(1 - F.col("attained"), F.lit(1 - objective)).alias("consumed"), (F.col("attained") >= objective).alias("met"))


def least_trusted(trust: DataFrame, n: int) -> DataFrame:
    return trust.orderBy(F.asc("trust"), F.asc("node")).limit(n)


def admit(work: DataFrame, budget: float, group: str) -> DataFrame:
    """Work (group, item, priority, cost) taken by priority until each group's budget is used up; a large group is many tasks."""
    spent = running_totals(work, [F.desc("priority"), "item"], ["cost"], within=[group])
    return spent.withColumnRenamed("total_cost", "spent").withColumn("admitted", F.col("spent") <= budget)
