"""Connected components of a link table, for groups of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours; partial aggregation absorbs hubs."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``links``: component is the smallest node that links reach.

    ``links`` has two columns of one orderable type; direction, repeats and
    self links don't matter, nulls are left out.  Alternating large-star and
    small-star steps: each node points its larger neighbours, then its smaller
    ones, at the smallest of them, until nothing changes; the number of rounds
    grows with the logarithm of the longest chain.  Each round is written to the
    checkpoint folder.
    """
    a, b = links.columns
    edges = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        joined = large.join(_least(large), "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
