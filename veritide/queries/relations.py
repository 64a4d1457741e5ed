"""Relationships, declarations, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incidents, mining, relations
from ..plans import declare, suite
from .catalogue import query


@query(
    "relationship_kinds",
    """SELECT 'row_count_parity' AS relationship, (SELECT count(*) FROM orders) AS scanned, 1::BIGINT AS violating
       UNION ALL SELECT 'aggregate_parity', (SELECT count(*) FROM orders), 1
       UNION ALL SELECT 'value_parity', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0), (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 0)
       UNION ALL SELECT 'overlap', (SELECT count(DISTINCT o_custkey) FROM orders), 0
       UNION ALL SELECT 'coverage', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
       UNION ALL SELECT 'mutually_exclusive', (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0), (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0)
       UNION ALL SELECT 'together_complete', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0)
       UNION ALL SELECT 'staleness', (SELECT count(*) FROM events), 1
       UNION ALL SELECT 'identifier_consistency', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0)""",
)
def _(t, spark):
    o, c, e = t("orders"), t("customer"), t("events")
    even, third = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")
    changed = third.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_orderstatus")))
    other = c.withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.col("c_name")))
    key = o.withColumnRenamed("o_custkey", "c_custkey")
    parts = [
        relations.row_count_parity(o, third, 0.1),
        relations.aggregate_parity(o, third, "o_totalprice", 1.0),
        relations.value_parity(changed, o, ["o_orderkey"], "o_orderstatus"),
        relations.overlap(key, c, ["c_custkey"], 0.99),
        relations.coverage(c, key, ["c_custkey"]),
        relations.mutually_exclusive(even, third, ["o_orderkey"]),
        relations.together_complete(even, third, o, ["o_orderkey"]),
        relations.staleness(e, e.where("ts < timestamp_ntz'2024-01-10 00:00:00'"), "ts", 3600),
        relations.identifier_consistency(c, other, "c_custkey", "c_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "relationship_discovery",
    """WITH k(child, parent, inside, known) AS (
         SELECT 'orders.o_custkey', 'customer.c_custkey', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), (SELECT count(DISTINCT o_custkey) FROM orders)
         UNION ALL SELECT 'customer.c_nationkey', 'nation.n_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)), (SELECT count(DISTINCT c_nationkey) FROM customer)
         UNION ALL SELECT 'nation.n_nationkey', 'customer.c_custkey', (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT c_custkey FROM customer)), (SELECT count(*) FROM nation)
         UNION ALL SELECT 'customer.c_nationkey', 'customer.c_custkey', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey IN (SELECT c_custkey FROM customer)), (SELECT count(DISTINCT c_nationkey) FROM customer)),
       s AS (SELECT *, CASE WHEN inside = known THEN 0.8 ELSE 0.65 END AS held, CASE WHEN split_part(split_part(child, '.', 2), '_', 2) = split_part(split_part(parent, '.', 2), '_', 2) OR split_part(split_part(child, '.', 2), '_', 1) = split_part(split_part(parent, '.', 2), '_', 1) THEN 0.35 ELSE 0 END AS named FROM k WHERE inside >= 0.9 * known)
       SELECT child, parent, round(1 - (1 - held) * (1 - named), 6)::DOUBLE AS confidence FROM s""",
)
def _(t, spark):
    tables = {n: t(n) for n in ("orders", "customer", "nation")}
    found = mining.inclusions(tables, {"orders": ["o_custkey"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey"]})
    rows = relations.propose(found, {n: df.columns for n, df in tables.items()})
    return spark.createDataFrame([(c, p, round(x, 6)) for c, p, x in rows], "child string, parent string, confidence double")


@query(
    "declared_controls",
    """SELECT 'customer.grain' AS control, count(*) AS scanned_rows, 0::BIGINT AS violating_rows, 'pass' AS verdict FROM customer
       UNION ALL SELECT 'customer.volume', count(*), 0, CASE WHEN count(*) >= 10 THEN 'pass' ELSE 'fail' END FROM customer
       UNION ALL SELECT 'customer.c_mktsegment.complete', count(*), 0, 'pass' FROM customer
       UNION ALL SELECT 'customer.c_mktsegment.domain', count(*), count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), CASE WHEN count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) = 0 THEN 'pass' ELSE 'fail' END FROM customer
       UNION ALL SELECT 'customer.c_acctbal.low', count(*), count(*) FILTER (WHERE c_acctbal < 0), CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) = 0 THEN 'pass' ELSE 'fail' END FROM customer""",
)
def _(t, spark):
    d = declare.Declaration(
        "customer", ("c_custkey",), (declare.Attribute("c_mktsegment", True, domain=("BUILDING", "MACHINERY")), declare.Attribute("c_acctbal", low=0)), volume=(10, None)
    )
    return suite.evaluate(t("customer"), declare.controls(d))


# Each user alerts at the first event; the user of the next number stands downstream.
@query(
    "incident_roots",
    """WITH u AS (SELECT user_id, floor(epoch(min(ts))) AS sec FROM events GROUP BY 1),
       g AS (SELECT user_id, CASE WHEN lag(user_id) OVER w = user_id - 1 AND sec - lag(sec) OVER w BETWEEN 0 AND 21600 THEN 0 ELSE 1 END AS starts FROM u WINDOW w AS (ORDER BY user_id)),
       i AS (SELECT user_id, sum(starts) OVER (ORDER BY user_id) AS island FROM g)
       SELECT CAST(user_id AS VARCHAR) AS node, CAST(min(user_id) OVER (PARTITION BY island) AS VARCHAR) AS root FROM i""",
)
def _(t, spark):
    u = t("events").groupBy("user_id").agg(F.min("ts").alias("ts"))
    alerts = u.select(F.col("user_id").cast("string").alias("node"), "ts")
    e = u.select(F.col("user_id").cast("string").alias("source"), (F.col("user_id") + 1).cast("string").alias("target"))
    return incidents.incidents(alerts, e, minutes=360).select("node", "root")


@query(
    "adaptive_cadence",
    """WITH r AS (SELECT user_id % 40 AS c, event_id AS t, CASE WHEN value < 1 THEN 'fail' WHEN event_type = 'error' THEN 'indeterminate' ELSE 'pass' END AS v FROM events),
       l AS (SELECT c, max(t) FILTER (WHERE v = 'fail') AS f, max(t) FILTER (WHERE v <> 'indeterminate') AS j FROM r GROUP BY 1),
       p AS (SELECT r.c, any_value(f) AS f, count(*) FILTER (WHERE v = 'pass' AND (f IS NULL OR t > f)) AS n, count(*) FILTER (WHERE j IS NULL OR t > j) AS tail FROM r JOIN l ON r.c = l.c GROUP BY 1)
       SELECT CAST(c AS VARCHAR) AS control, round(least(CASE WHEN f IS NULL THEN 60.0 ELSE 30.0 END * power(1.5, n // 10), 600.0), 6)::DOUBLE AS seconds, tail >= 3 AS hold FROM p""",
)
def _(t, spark):
    verdict = F.when(F.col("value") < 1, "fail").when(F.col("event_type") == "error", "indeterminate").otherwise("pass")
    runs = t("events").select((F.col("user_id") % 40).cast("string").alias("control"), F.col("event_id").alias("t"), verdict.alias("verdict"))
    return incidents.cadence(runs, 60, 30, 600).withColumn("seconds", F.round("seconds", 6))


# Alerts are one event in 23, each at its user's column; a user's column comes from the one before it, in runs of eight; changes are one event in 401.
ALERTS = """up AS (SELECT DISTINCT user_id AS node, user_id AS ancestor, 0 AS hops FROM events UNION ALL SELECT node, ancestor - 1, hops + 1 FROM up WHERE ancestor % 8 <> 0),
   alert AS (SELECT event_id AS alert, user_id AS node, ts, floor(epoch(ts)) AS sec FROM events WHERE event_id % 23 = 5), change AS (SELECT event_id AS change, user_id AS node, ts, floor(epoch(ts)) AS moment FROM events WHERE event_id % 401 = 7),
   placed AS (SELECT alert, node, sec, ancestor, hops FROM alert JOIN up USING (node)),
   link AS (SELECT a.alert AS a, b.alert AS b, 'lineage' AS signal FROM placed a JOIN placed b ON a.ancestor = b.ancestor AND a.alert <> b.alert AND abs(a.sec - b.sec) <= 10800
      UNION SELECT a.alert, b.alert, 'time' FROM alert a JOIN alert b ON a.node // 3 = b.node // 3 AND a.alert <> b.alert AND abs(a.sec - b.sec) <= 10800
      UNION SELECT a.alert, b.alert, 'change' FROM placed a JOIN change c ON a.ancestor = c.node AND a.sec BETWEEN moment AND moment + 43200 JOIN placed b ON b.ancestor = c.node AND b.sec BETWEEN moment AND moment + 43200 AND a.alert <> b.alert),
   way AS (SELECT alert AS a, alert AS b FROM alert UNION SELECT way.a, link.b FROM way JOIN link ON link.a = way.b), member AS (SELECT a AS alert, min(b) AS incident FROM way GROUP BY a)"""
REPORT = """whole AS (SELECT incident, count(*) AS alerts, count(DISTINCT node) AS nodes, min(ts) AS opened, max(ts) AS closed FROM member JOIN alert USING (alert) GROUP BY 1),
   vote AS (SELECT incident, ancestor, count(*) AS covers, sum(hops) AS hops FROM member JOIN placed USING (alert) GROUP BY 1, 2),
   origin AS (SELECT incident, ancestor AS origin, covers FROM vote QUALIFY row_number() OVER (PARTITION BY incident ORDER BY covers DESC, hops, concat('d', ancestor // 3, '.c', ancestor)) = 1),
   told AS (SELECT incident, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM link JOIN member ON alert = a GROUP BY 1)"""


def _column(user):
    return F.concat(F.lit("d"), F.floor(user / 3).cast("string"), F.lit(".c"), user.cast("string"))


def alerted(t):
    e, u = t("events"), F.col("user_id")
    edges = e.select("user_id").distinct().where(u % 8 != 0).select(_column(u - 1).alias("source"), _column(u).alias("target"))
    alerts = e.where("event_id % 23 = 5").select(F.col("event_id").alias("alert"), _column(u).alias("node"), "ts")
    changes = e.where("event_id % 401 = 7").select(F.col("event_id").alias("change"), _column(u).alias("node"), F.col("ts").alias("at"))
    return alerts, edges, changes


@query("incident_members", f"WITH RECURSIVE {ALERTS} SELECT alert, incident FROM member")
def _(t, spark):
    return incidents.correlate(*alerted(t), minutes=180)[0].select("alert", "incident")


@query(
    "incident_report",
    f"WITH RECURSIVE {ALERTS}, {REPORT} SELECT incident, alerts, nodes, strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened_at, strftime(closed, '%Y-%m-%d %H:%M:%S') AS closed_at, concat('d', origin // 3, '.c', origin) AS origin, covers, coalesce(signals, '') AS signals FROM whole JOIN origin USING (incident) LEFT JOIN told USING (incident)",
)
def _(t, spark):
    out = incidents.described(*incidents.correlate(*alerted(t), minutes=180))
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("opened_at", "closed_at")}
    return out.withColumns({**text, "signals": F.array_join("signals", ",")})


@query(
    "cause_ranking",
    f"""WITH RECURSIVE {ALERTS}, {REPORT}, c AS (SELECT incident, opened, origin, ancestor AS node, hops FROM whole JOIN origin USING (incident) JOIN up ON up.node = origin),
       l AS (SELECT incident, c.node, max(struct_pack(moment := change.ts, change := change)) AS c FROM c JOIN change ON (change.node = c.node OR (change.change % 2 = 0 AND change.node // 3 = c.node // 3)) AND change.ts <= opened WHERE change.change % 2 = 0 OR change.node = c.node GROUP BY 1, 2),
       f AS (SELECT DISTINCT user_id AS node FROM events WHERE event_id % 211 = 3), p AS (SELECT user_id AS node FROM events WHERE event_id % 307 = 11 GROUP BY 1),
       e AS (SELECT c.*, l.c.change AS change, f.node IS NOT NULL AND c.node <> origin AS broken, l.c IS NOT NULL AS changed, c.node = origin OR hops <= 2 AS close, p.node IS NOT NULL AS prior
             FROM c LEFT JOIN l USING (incident, node) LEFT JOIN f ON f.node = c.node LEFT JOIN p ON p.node = c.node),
       s AS (SELECT *, round(1 - (CASE WHEN broken THEN 0 ELSE 1 END) * (CASE WHEN changed THEN 1 - 0.6 ELSE 1 END) * (CASE WHEN close THEN 1 - 0.25 ELSE 1 END) * (CASE WHEN prior THEN 1 - 0.15 ELSE 1 END), 6) AS score, count(*) OVER (PARTITION BY incident) AS considered FROM e),
       r AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY score DESC, node <> origin, concat('d', node // 3, '.c', node)) AS rank FROM s WHERE broken OR changed OR close OR prior)
       SELECT incident, CAST(rank AS INTEGER) AS rank, concat('d', node // 3, '.c', node) AS node, CAST(hops AS INTEGER) AS hops, CAST(score AS DOUBLE) AS score,
         concat_ws(',', CASE WHEN broken THEN 'upstream failing' END, CASE WHEN changed THEN 'change' END, CASE WHEN close THEN 'proximity' END, CASE WHEN prior THEN 'prior' END) AS evidence, coalesce(change, -1) AS change, considered FROM r WHERE rank <= 5""",
)
def _(t, spark):
    """Changes of even numbers name all columns of the user's dataset; failing columns and earlier causes are other events' users."""
    alerts, edges, changes = alerted(t)
    found = incidents.described(*incidents.correlate(alerts, edges, changes, minutes=180)).select("incident", "origin", "opened_at")
    wide = changes.withColumn("node", F.when(F.col("change") % 2 == 0, F.regexp_replace("node", r"[^.]+$", "*")).otherwise(F.col("node")))
    of = lambda by, k: t("events").where(F.col("event_id") % by == k).select(_column(F.col("user_id")).alias("node"))
    out = incidents.ranked_causes(found, edges, wide, of(211, 3), of(307, 11).withColumn("times", F.lit(1)))
    return out.withColumns({"evidence": F.array_join("evidence", ","), "score": F.round("score", 6), "change": F.coalesce("change", F.lit(-1))})
