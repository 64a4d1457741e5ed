"""Alerts gathered into incidents along lineage, likely causes ranked; challengers and cadence of monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut
from .components import components

#: What a piece of evidence is worth, alone.
EVIDENCE = {"upstream failing": 1.0, "change": 0.6, "proximity": 0.25, "prior": 0.15}


def incidents(alerts: DataFrame, edges: DataFrame, minutes: int = 60, max_rounds: int = 1000) -> DataFrame:
    """(node, ts, root, since): each alert with the furthest upstream node that alerted shortly before it.

    alerts: (node, ts), one per node; edges: (source, target).  Alerts hand their
    root downstream, one hop for each round, until none changes; alerts of one
    instant on a cycle of edges have no first one and raise an error.
    """
    gap = minutes * 60
    state = cut(alerts.select("node", "ts", F.col("node").alias("root"), F.col("ts").alias("since")))
    # No path is longer than there are alerts.
    rounds = min(max_rounds, state.count() + 1)
    for _ in range(rounds):
        up = state.select(F.col("node").alias("source"), F.col("root").alias("u_root"), F.col("since").alias("u_since"), F.col("ts").alias("u_ts"))
        given = edges.join(up, "source").select(F.col("target").alias("t"), "u_root", "u_since", "u_ts")
        near = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("u_ts").cast("timestamp"))).between(0, gap)
        best = state.join(given, F.col("node") == F.col("t")).where(near).groupBy("node").agg(F.min(F.struct("u_since", "u_root")).alias("b"))
        new = state.join(best.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
            "node", "ts", F.coalesce("b.u_root", "root").alias("root"), F.coalesce("b.u_since", "since").alias("since")
        )
        new = cut(new)
        moved = new.join(state.select(F.col("node").alias("n"), F.col("root").alias("r")), (F.col("node") == F.col("n")) & (F.col("root") != F.col("r")))
        state = new
        if moved.isEmpty():
            break
    else:
        raise RuntimeError(f"incident roots did not settle in {rounds} rounds")
    return state


def causes(found: DataFrame, changes: DataFrame, hours: int = 24) -> DataFrame:
    """(root, node, at, rank): recent changes to an incident's nodes, at the root and latest first."""
    roots = found.groupBy("root").agg(F.min("since").alias("since"), F.count(F.lit(1)).alias("alerts"))
    members = found.select("root", "node").distinct()
    near = members.join(changes, "node").join(roots, "root")
    age = F.unix_timestamp(F.col("since").cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))
    w = Window.partitionBy("root").orderBy((F.col("node") != F.col("root")).cast("int"), age, "node")
    return near.where(age.between(0, hours * 3600)).select("root", "alerts", "node", "at", F.row_number().over(w).alias("rank"))


def upstream(nodes: DataFrame, edges: DataFrame, depth: int = 64) -> DataFrame:
    """(node, ancestor, hops): every node that a node's values come from within ``depth`` hops, itself included; one join for each hop."""
    front = cut(nodes.select("node").distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops")))
    steps = cut(edges.select(F.col("target").alias("ancestor"), F.col("source").alias("up")).distinct())
    # Each hop is written once; what is found is all hops, never written anew.
    found = front
    for hop in range(1, depth + 1):
        next_ = front.join(steps, "ancestor").select("node", F.col("up").alias("ancestor")).distinct()
        front = cut(next_.join(found, ["node", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def _dataset(node: str):
    return F.regexp_replace(node, r"\.[^.]*$", "")


def correlate(alerts: DataFrame, edges: DataFrame, changes: DataFrame, minutes: int = 60, lookback_hours: int = 12, depth: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((alert, node, ts, incident), (incident, signal, links), reach): alerts gathered into incidents.

    alerts: (alert, node, ts); edges: (source, target); changes: (change, node, at).
    Alerts are linked if they lie within ``minutes`` of each other and share an
    upstream node (lineage) or a dataset (time), or if one change touched what
    both come from, up to ``lookback_hours`` before them (change).  Incidents are
    what links connect, over chains of any length, named by their smallest alert.

    No pair is formed: what shares a key is dealt into cells as wide as the
    window, an alert is linked to the first of its cell, and neighbouring cells to
    each other where their nearest alerts are near enough.
    """
    width = minutes * 60
    reach = upstream(alerts, edges, depth)
    placed = cut(alerts.select("alert", "node", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec")).join(reach.drop("hops"), "node"))
    keyed = placed.select("alert", "sec", F.lit("lineage").alias("signal"), F.col("ancestor").alias("key")).unionByName(
        placed.where("node = ancestor").select("alert", "sec", F.lit("time").alias("signal"), _dataset("node").alias("key"))
    )
    keyed = keyed.where("sec IS NOT NULL").withColumn("cell", F.floor(F.col("sec") / width))
    cells = cut(keyed.groupBy("signal", "key", "cell").agg(F.min("alert").alias("first"), F.min("sec").alias("low"), F.max("sec").alias("high")))
    within = keyed.join(cells, ["signal", "key", "cell"]).select("signal", F.col("alert").alias("a"), F.col("first").alias("b"))
    later = cells.select("signal", "key", (F.col("cell") - 1).alias("cell"), F.col("first").alias("then"), F.col("low").alias("from"))
    across = cells.join(later, ["signal", "key", "cell"]).where(F.col("from") - F.col("high") <= width).select("signal", F.col("first").alias("a"), F.col("then").alias("b"))
    touched = placed.join(changes.select(F.col("node").alias("ancestor"), "change", F.unix_timestamp(F.col("at").cast("timestamp")).alias("at")), "ancestor")
    touched = touched.where(F.col("sec").between(F.col("at"), F.col("at") + lookback_hours * 3600)).select("change", "alert").distinct()
    by_change = touched.join(touched.groupBy("change").agg(F.min("alert").alias("b")), "change").select(F.lit("change").alias("signal"), F.col("alert").alias("a"), "b")
    links = cut(within.union(across).union(by_change).where("a <> b").distinct())
    groups = components(links.select("a", "b"))
    members = alerts.select("alert", "node", "ts").join(groups.select(F.col("node").alias("alert"), "component"), "alert", "left").select("alert", "node", "ts", F.coalesce("component", "alert").alias("incident"))
    signals = links.join(groups, F.col("a") == F.col("node")).groupBy(F.col("component").alias("incident"), "signal").agg(F.count(F.lit(1)).alias("links"))
    return members, signals, reach


def described(members: DataFrame, signals: DataFrame, reach: DataFrame) -> DataFrame:
    """(incident, alerts, nodes, opened_at, closed_at, origin, covers, signals): one row for each incident.

    origin is the node that most of the alerts come from (covers), of several the
    nearest to them, then the first by name.
    """
    whole = members.groupBy("incident").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("node").alias("nodes"), F.min("ts").alias("opened_at"), F.max("ts").alias("closed_at"))
    votes = members.join(reach, "node").groupBy("incident", "ancestor").agg(F.count(F.lit(1)).alias("covers"), F.sum("hops").alias("hops"))
    best = votes.groupBy("incident").agg(F.min(F.struct((-F.col("covers")).alias("c"), "hops", "ancestor")).alias("best"))
    told = signals.groupBy("incident").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    return whole.join(best, "incident").join(told, "incident", "left").select(
        "incident", "alerts", "nodes", "opened_at", "closed_at", F.col("best.ancestor").alias("origin"), (-F.col("best.c")).alias("covers"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals")
    )


def ranked_causes(found: DataFrame, edges: DataFrame, changes: DataFrame, failing: DataFrame, priors: DataFrame, most: int = 5, depth: int = 64) -> DataFrame:
    """(incident, rank, node, hops, score, evidence, change, considered): where to look first.

    found: (incident, origin, opened_at); changes: (change, node, at); failing:
    (node); priors: (node, times).  Candidates are the origin and all that it comes
    from.  Evidence is independent: an upstream node fails its own controls, a
    change touched the node (or "dataset.*") before the incident opened, it is the
    origin or at most two hops from it, it was the cause before.  A node without
    evidence isn't offered, but counts as considered.
    """
    reach = upstream(found.select(F.col("origin").alias("node")), edges, depth).withColumnRenamed("node", "origin")
    candidates = found.select("incident", "origin", "opened_at").join(reach, "origin").withColumnRenamed("ancestor", "node")
    # A change is looked up under each node, and under its dataset where it names all columns.
    dated = changes.select(F.col("node").alias("touched"), F.struct("at", "change").alias("c"))
    names = candidates.select("incident", "node", "opened_at", F.explode(F.array("node", F.concat(_dataset("node"), F.lit(".*")))).alias("touched"))
    last = names.join(dated, "touched").where(F.col("c.at") <= F.col("opened_at")).groupBy("incident", "node").agg(F.max("c").alias("c"))
    broken = failing.select("node").distinct().withColumn("broken", F.lit(True))
    before = priors.groupBy("node").agg(F.sum("times").alias("times"))
    known = candidates.join(last, ["incident", "node"], "left").join(broken, "node", "left").join(before, "node", "left")
    own = F.col("node") == F.col("origin")
    holds = {
        "upstream failing": F.col("broken").isNotNull() & ~own, "change": F.col("c").isNotNull(), "proximity": own | (F.col("hops") <= 2), "prior": F.coalesce(F.col("times") > 0, F.lit(False)),
    }
    missing = F.lit(1.0)
    for name, condition in holds.items():
        missing = missing * F.when(condition, 1.0 - EVIDENCE[name]).otherwise(1.0)
    scored = known.withColumn("evidence", F.array_compact(F.array(*[F.when(c, name) for name, c in holds.items()]))).withColumn("score", 1.0 - missing)
    # Candidates of one incident are ranked together: what one node comes from.
    w = Window.partitionBy("incident")
    order = w.orderBy(F.desc("score"), (~own).cast("int"), "node")
    offered = scored.withColumn("considered", F.count(F.lit(1)).over(w)).where(F.size("evidence") > 0).withColumn("rank", F.row_number().over(order))
    return offered.where(F.col("rank") <= most).select("incident", "rank", "node", "hops", "score", "evidence", F.col("c.change").alias("change"), "considered")


def tournament(scored: DataFrame, target: float = 0.05, least: int = 200) -> DataFrame:
    """(detector, n, gap, wins): which detector's p-values are best calibrated; few observations never win."""
    out = scored.where("p is not null").groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg((F.col("p") <= target).cast("double")) - target).alias("gap"))
    enough = F.col("n") >= least
    w = Window.orderBy(F.when(enough, 0).otherwise(1), "gap", "detector")
    # One row for each detector.
    return out.withColumn("wins", enough & (F.row_number().over(w) == 1))


def cadence(runs: DataFrame, base: int, floor: int, ceiling: int) -> DataFrame:
    """(control, seconds, hold): intervals half as long again after every ten passes in a row, the floor after a fail, held after three unjudged.

    Only the passes since the last fail count, so no history is gathered; runs
    that aren't judged don't break a row of passes.  ``t`` tells a control's runs
    apart.
    """
    last = runs.groupBy("control").agg(F.max(F.when(F.col("verdict") == "fail", F.col("t"))).alias("failed"), F.max(F.when(F.col("verdict") != "indeterminate", F.col("t"))).alias("judged"))
    since = lambda c: F.col(c).isNull() | (F.col("t") > F.col(c))
    counted = runs.join(last.withColumnRenamed("control", "__c"), F.col("control") == F.col("__c")).groupBy("control").agg(
        F.count_if((F.col("verdict") == "pass") & since("failed")).alias("passes"), F.count_if(since("judged")).alias("unjudged"), F.first("failed").isNotNull().alias("fell")
    )
    start = F.when(F.col("fell"), F.lit(float(floor))).otherwise(F.lit(float(base)))
    tens = F.floor(F.col("passes") / 10)
    seconds = F.when(tens > 0, F.least(start * F.pow(F.lit(1.5), tens), F.lit(float(ceiling)))).otherwise(start)
    return counted.select("control", seconds.alias("seconds"), (F.col("unjudged") >= 3).alias("hold"))
