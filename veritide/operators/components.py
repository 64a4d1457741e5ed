"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``links``, component being the smallest node that links reach.

    ``links`` has two columns; direction, repeats and self links don't matter,
    and a row with a null links nothing.  Every round each node, and the node it
    points at, takes the smallest label among its neighbours', and labels are then
    replaced by what they point at themselves; rounds grow with the logarithm of
    the longest chain.  Each is written to the checkpoint folder.
    """
    a, b = links.columns
    known = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = cut(known.union(known.select("v", "u")).distinct())
    state = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("label")).select(F.col("u").alias("node"), "label"))
    for _ in range(max_rounds):
        near = edges.join(state.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("low"))
        seen = state.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "low").alias("low"))
        given = seen.select("node", "low").union(seen.select(F.col("label"), "low")).groupBy("node").agg(F.min("low").alias("label"))
        above = given.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(given.join(above, "label").select("node", F.col("next").alias("label")))
        moved = new.join(state.select("node", F.col("label").alias("old")), "node").where("label <> old")
        state = new
        if moved.isEmpty():
            return state.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
