"""Filter interaction audit: every order of some filters, by aggregation over lattice edges.

What an order's step does to a document depends only on the set of filters
applied before and on the next filter, an edge of the lattice of subsets.  With
k filters there are k * 2^(k-1) edges (80 of five), however many orders pass
through them.  Documents are counted by what they fail, the counts are laid on
the edges, and an order's steps are a path over aggregated edges.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: The filters of failures(), in the order of their bits.
FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def _conditions(text: Column) -> list[Column]:
    """Whether a text fails A to D."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size("words")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [words, n < 100, 100 * F.size(F.array_distinct("words")) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by part, failed filters (bits in the order of FILTERS) and labels.

    E, identical to the text of a smaller doc_id, is decided by SHA-256 of the
    texts: all but the rows of the smallest doc_id fail it.  Rows without a doc_id
    neither fail E nor make others fail, and have no label; rows that repeat a
    doc_id count one by one.  A null text counts as empty, a null part as the
    empty string.  good and toxic: some label of the doc_id says so.
    """
    words, *conditions = _conditions(F.col("text"))
    facts = cut(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .select("doc_id", "part", "text", words.alias("words"))
        .select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0)).alias("mask"))
    )
    named = facts.where(F.col("doc_id").isNotNull())
    # Repeats of a row are one row from here on, so no key of the joins holds more rows than it has different texts.
    rows = named.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = (
        rows.join(first, ["digest", "doc_id"], "left")
        .withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))))
        .join(judged, "doc_id", "left")
        .select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    )
    nameless = facts.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return marked.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, applied, next, counts, shapley): what each filter does after each set of others.

    ``counted`` has part, mask, good, toxic and n; applied is a set of filters as
    bits, next the number of a filter.  shapley is the filter's removed, summed
    over all orders: an edge lies on |applied|! * (k - 1 - |applied|)! of them.
    """
    k = len(filters)
    all_edges = [(applied, f) for f in range(k) for applied in range(1 << k) if not applied >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next")) for a, f in all_edges])).alias("edge")
    laid = counted.select("part", "mask", "good", "toxic", "n", edge).select("*", "edge.applied", "edge.next").drop("edge")
    before, own = F.col("mask").bitwiseAND(F.col("applied")), F.expr("shiftleft(1, next)")
    fails = F.col("mask").bitwiseAND(own) != 0
    removed = (before == 0) & fails

    def of(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    summed = laid.groupBy("part", "applied", "next").agg(
        of((before == 0) & ~fails, "kept"),
        of(removed, "removed"),
        of((before != 0) & fails, "redundant"),
        of(F.col("mask") == own, "unique_fails"),
        of(removed & F.col("good"), "good_lost"),
        of(removed & F.col("toxic"), "toxic_lost"),
    )
    orders = F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)])
    paths = F.get(orders, F.bit_count("applied"))
    # A window holds the 2^(k-1) edges of a part and filter.
    return summed.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "next")))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters (k! of them) and step, zeros included.

    kept: documents left after the step; removed: by it; redundant: failing its
    filter, but removed before; unique_fails: failing its filter only; good_lost
    and toxic_lost: of the removed.  An empty table has no parts, so no rows.
    """
    steps = []
    for order in permutations(range(len(filters))):
        applied = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, applied, f))
            applied |= 1 << f
    paths = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    return (
        edges(counted, filters)
        .join(F.broadcast(paths), ["applied", "next"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over every document, by language and in every order; see failures() for nulls, ties and repeats."""
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
