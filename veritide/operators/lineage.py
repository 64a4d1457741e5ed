"""Lineage as edges (source, target, kind): reach with attenuation, closures, trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

#: The share of an upstream defect that passes along each kind of edge.
ATTENUATION = {"identity": 1.0, "rename": 1.0, "derived": 0.7, "aggregated": 0.35, "filter": 0.9, "join_key": 0.8}


def _factor() -> Column:
    """The share that an edge passes on; a kind that isn't known, null included, raises."""
    pairs = F.create_map(*[F.lit(x) for kv in ATTENUATION.items() for x in kv])
    unknown = F.raise_error(F.concat(F.lit("unknown kind of edge: "), F.coalesce("kind", F.lit("null")))).cast("double")
    return F.when(F.coalesce(F.col("kind").isin(*ATTENUATION), F.lit(False)), F.try_element_at(pairs, F.col("kind"))).otherwise(unknown)


def blast_radius(edges: DataFrame, start: str, floor: float = 0.01, depth: int = 12, upstream: bool = False) -> DataFrame:
    """(node, strength, hops): nodes reached from ``start`` with the strongest path's strength, down to ``floor``.

    One join for each hop; only nodes that got stronger go on, so cycles end.
    Edges are found and dealt by their start once, not for each hop.
    """
    a, b = ("target", "source") if upstream else ("source", "target")
    steps = cut(edges.select(F.col(a).alias("from"), F.col(b).alias("to"), _factor().alias("factor")).repartition("from"))
    best = edges.sparkSession.createDataFrame([(start, 1.0, 0)], "node string, strength double, hops int")
    front = best
    for hop in range(1, depth + 1):
        reached = (
            front.join(steps, F.col("node") == F.col("from"))
            .select(F.col("to").alias("node"), (F.col("strength") * F.col("factor")).alias("strength"), F.lit(hop).alias("hops"))
            .where(F.col("strength") >= floor)
            .groupBy("node")
            .agg(F.max("strength").alias("strength"), F.min("hops").alias("hops"))
        )
        known = best.select(F.col("node").alias("k"), F.col("strength").alias("s"))
        front = reached.join(known, F.col("node") == F.col("k"), "left").where(F.col("s").isNull() | (F.col("strength") > F.col("s"))).select("node", "strength", "hops")
        front = cut(front)
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("node").agg(F.max("strength").alias("strength"), F.min_by("hops", -F.col("strength")).alias("hops")))
    return best.where(F.col("node") != start)


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    used = edges.select(F.col("source").alias("n")).union(edges.select("target")).distinct()
    return nodes.join(used, F.col("node") == F.col("n"), "left_anti")


def dataset_edges(edges: DataFrame) -> DataFrame:
    """Edges between datasets, from those between their columns ("dataset.column")."""
    of = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    out = edges.select(of("source").alias("source"), of("target").alias("target")).where("source <> target")
    return out.groupBy("source", "target").agg(F.count(F.lit(1)).alias("columns"))


def trust(nodes: DataFrame, edges: DataFrame, how: str = "min_product", max_rounds: int = 1000) -> DataFrame:
    """(node, trust) from own trust and that of inputs along attenuated edges.

    A deficit of trust passes along an edge scaled by its attenuation; ``how``
    combines inputs: min (the weakest), product, mean, or min_product (own trust
    times the weakest input).  Rounds go on until no value moves; an error is
    raised if that takes more than ``max_rounds``.
    """
    combine = {
        "min": F.min("passed"), "min_product": F.min("passed"),
        "product": F.when(F.min("passed") > 0, F.exp(F.sum(F.log(F.when(F.col("passed") > 0, F.col("passed")))))).otherwise(0.0), "mean": F.avg("passed"),
    }[how]
    current = nodes.select("node", F.col("trust").cast("double").alias("own"), F.col("trust").cast("double").alias("trust"))
    for _ in range(max_rounds):
        up = current.select(F.col("node").alias("source"), "trust")
        passed = edges.join(up, "source").select("target", (1 - (1 - F.col("trust")) * _factor()).alias("passed"))
        inputs = passed.groupBy(F.col("target").alias("t")).agg(combine.alias("inputs"))
        value = F.least("own", "inputs") if how == "min" else F.col("own") * F.col("inputs")
        new = current.join(inputs, F.col("node") == F.col("t"), "left").select("node", "own", F.when(F.col("inputs").isNull(), F.col("own")).otherwise(value).alias("trust"))
        new = cut(new)
        moved = new.join(current.select(F.col("node").alias("k"), F.col("trust").alias("old")), F.col("node") == F.col("k")).where(F.abs(F.col("trust") - F.col("old")) > 1e-12)
        current = new
        if moved.isEmpty():
            break
    else:
        raise RuntimeError(f"trust did not settle in {max_rounds} rounds")
    return current.select("node", "trust")


def usage(queries: DataFrame) -> DataFrame:
    """(dataset, day, queries, users) from (ts, user, datasets)."""
    return (
        queries.select(F.to_date("ts").alias("day"), "user", F.explode(F.array_distinct("datasets")).alias("dataset"))
        .groupBy("dataset", "day")
        .agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("user").alias("users"))
    )


def co_access(queries: DataFrame) -> DataFrame:
    """(a, b, queries): datasets read by one query."""
    pairs = F.expr("flatten(transform(ds, x -> transform(filter(ds, y -> x < y), y -> struct(x as a, y as b))))")
    return queries.select(F.array_distinct("datasets").alias("ds")).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("queries"))


def proposals(edges: DataFrame, controls: DataFrame) -> DataFrame:
    """(rule, target, detail): controls that lineage suggests.

    A control (column, control) of a column that is copied or renamed should hold
    on the copy too, and a key column that is copied to another dataset should
    reference its source; inferred edges are left to be confirmed first.
    """
    carried = edges.where(F.col("kind").isin("identity", "rename"))
    if "status" in edges.columns:
        carried = carried.where("status <> 'inferred'")
    # Both rules read it: edges are found once.
    carried = cut(carried.select("source", "target"))
    propagated = carried.join(controls, F.col("source") == F.col("column")).select(F.lit("propagated").alias("rule"), "target", F.col("control").alias("detail"))
    of = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    key = F.regexp_extract("target", r"[^.]*$", 0).rlike(r"(?i)(^id$|_id$|key$|^key_)")
    references = carried.where(key & (of("source") != of("target"))).select(F.lit("references").alias("rule"), "target", F.col("source").alias("detail"))
    return propagated.union(references).distinct()
