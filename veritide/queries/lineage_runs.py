"""Queries of lineage that run events, manifests and histories report; the rows of events and orders stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lineage, run_lineage
from .catalogue import query

_SUBTYPE = ("IDENTITY", "AGGREGATION", "JOIN", "WINDOW", "made up")


def run_events(t) -> DataFrame:
    """Each event as a run event: users are runs, event types jobs; some bodies are broken, some jobs have no name, some runs never complete."""
    # A row's text is ten times as wide: rows are dealt out first, as a table's file may be a single split.
    e = t("events").select("event_id", "user_id", "event_type", "ts").repartition("event_id")
    subtype = F.element_at(F.array(*map(F.lit, _SUBTYPE)), (F.col("event_id") % 5 + 1).cast("int"))
    fields = F.map_from_arrays(
        F.array(F.concat(F.lit("C"), (F.col("event_id") % 3).cast("string"))),
        F.array(F.struct(F.array(F.struct(F.concat(F.lit("raw_"), (F.col("user_id") % 7).cast("string")).alias("name"), F.concat(F.lit("F"), (F.col("event_id") % 4).cast("string")).alias("field"), F.array(F.struct(F.lit("DIRECT").alias("type"), subtype.alias("subtype"))).alias("transformations"))).alias("inputFields"))),
    )
    state = F.when(F.col("event_id") % 4 == 0, "COMPLETE").when(F.col("event_id") % 9 == 1, "FAIL").otherwise("RUNNING")
    body = F.to_json(
        F.struct(
            state.alias("eventType"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
            F.struct(F.lit("bank").alias("namespace"), F.when(F.col("event_id") % 17 != 3, F.col("event_type")).alias("name")).alias("job"),
            F.struct(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("runId")).alias("run"),
            F.array(F.struct(F.concat(F.lit("mart_"), F.col("event_type")).alias("name"), F.struct(F.struct(F.when(F.col("event_id") % 11 != 5, fields).alias("fields")).alias("columnLineage")).alias("facets"))).alias("outputs"),
        )
    )
    return e.select(F.when(F.col("event_id") % 97 == 13, "{broken").otherwise(body).alias("event"))


_READ = """e AS (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS moment, event_id % 97 = 13 AS broken, event_id % 17 = 3 AS nameless FROM events),
  good AS (SELECT *, 'bank/' || event_type AS job, 'r' || user_id AS run, CASE WHEN event_id % 4 = 0 THEN 'COMPLETE' WHEN event_id % 9 = 1 THEN 'FAIL' ELSE 'RUNNING' END AS said FROM e WHERE NOT broken AND NOT nameless),
  runs AS (SELECT job, run, CASE WHEN bool_or(said = 'COMPLETE') THEN 'complete' WHEN bool_or(said = 'FAIL') THEN 'failed' ELSE 'running' END AS state, min(moment) AS started, max(moment) AS ended, count(*) AS events FROM good GROUP BY 1, 2)"""
_EDGES = """x AS (SELECT DISTINCT job, run, 'raw_' || (user_id % 7) || '.f' || (event_id % 4) AS source, 'mart_' || event_type || '.c' || (event_id % 3) AS target,
      ['identity', 'aggregated', 'join_key', 'derived', 'derived'][event_id % 5 + 1] AS kind FROM good WHERE event_id % 11 <> 5),
  last AS (SELECT job, max(struct_pack(ended := ended, run := run)).run AS run FROM runs WHERE state = 'complete' GROUP BY job),
  edges AS (SELECT source, target, kind, job AS produced_by, count(*) AS runs, min(ended) AS first_seen, max(ended) AS last_seen, bool_or(run = l) AS current
      FROM (SELECT x.*, ended, last.run AS l FROM x JOIN runs USING (job, run) JOIN last USING (job) WHERE state = 'complete') GROUP BY 1, 2, 3, 4)"""


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("run_states", f"WITH {_READ} SELECT job, run, state, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, events FROM runs")
def _(t, spark):
    return run_lineage.runs(run_lineage.parse_events(run_events(t))[0]).select("job", "run", "state", _text("started"), _text("ended"), "events")


@query("run_lineage", f"WITH {_READ}, {_EDGES} SELECT source, target, kind, produced_by, runs, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, current FROM edges")
def _(t, spark):
    edges = run_lineage.from_run_events(run_lineage.parse_events(run_events(t))[0])
    return edges.select("source", "target", "kind", "produced_by", "runs", _text("first_seen"), _text("last_seen"), "current")


@query(
    "run_lineage_gaps",
    f"""WITH {_READ}, w AS (SELECT job, run, 'mart_' || event_type AS dataset, bool_or(event_id % 11 <> 5) AS told FROM good GROUP BY 1, 2, 3)
       SELECT 'unparsed' AS kind, NULL AS detail, count(*) AS n FROM e WHERE broken HAVING count(*) > 0 UNION ALL SELECT 'no job', NULL, count(*) FROM e WHERE nameless AND NOT broken HAVING count(*) > 0
       UNION ALL SELECT 'no column lineage', dataset, count(DISTINCT job) FROM w JOIN runs USING (job, run) WHERE state = 'complete' AND NOT told GROUP BY dataset""",
)
def _(t, spark):
    parsed, gaps = run_lineage.parse_events(run_events(t))
    both = gaps.withColumn("detail", F.lit(None).cast("string")).unionByName(run_lineage.silent_outputs(parsed))
    return both.groupBy("kind", "detail").agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_lineage_proposals",
    f"""WITH {_READ}, {_EDGES}, live AS (SELECT DISTINCT source, target FROM edges WHERE current AND kind = 'identity'),
       full_ AS (SELECT 'raw_' || (user_id % 7) || '.f' || (event_id % 4) AS c FROM events GROUP BY 1 HAVING count(value) = count(*) AND min(value) >= 0)
       SELECT 'propagated' AS rule, target, 'never negative' AS detail FROM live JOIN full_ ON c = source GROUP BY ALL""",
)
def _(t, spark):
    """Columns that always hold a value that isn't negative say so of the columns that current runs copy them to."""
    e = t("events").groupBy(F.concat(F.lit("raw_"), (F.col("user_id") % 7).cast("string"), F.lit(".f"), (F.col("event_id") % 4).cast("string")).alias("column"))
    controls = e.agg(F.count("value").alias("k"), F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).where("k = n AND least >= 0").select("column", F.lit("never negative").alias("control"))
    edges = run_lineage.from_run_events(run_lineage.parse_events(run_events(t))[0]).where("current")
    return lineage.proposals(edges, controls)


@query(
    "access_history_lineage",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), k AS (SELECT 'mart.c' || (o_orderkey % 6) AS target, 'stage_' || lower(o_orderstatus) || '.k' || (o_custkey % 5) AS source, o_orderkey % 13 = 4 AS base, o_orderkey % 101 = 7 AS broken FROM o)
       SELECT 'edge' AS what, source, target, count(*) AS n FROM k WHERE NOT base AND NOT broken GROUP BY ALL UNION ALL SELECT 'only base sources', NULL, target, count(*) FROM k WHERE base AND NOT broken GROUP BY ALL
       UNION ALL SELECT 'unparsed', NULL, NULL, count(*) FROM k WHERE broken HAVING count(*) > 0""",
)
def _(t, spark):
    """Each order as a write of one column, read directly from a staging table or, for some, known by its base only."""
    source = F.array(F.struct(F.concat(F.lit("STAGE_"), F.col("o_orderstatus")).alias("objectName"), F.concat(F.lit("K"), (F.col("o_custkey") % 5).cast("string")).alias("columnName")))
    base = F.col("o_orderkey") % 13 == 4
    column = F.struct(F.concat(F.lit("C"), (F.col("o_orderkey") % 6).cast("string")).alias("columnName"), F.when(~base, source).alias("directSources"), source.alias("baseSources"))
    body = F.to_json(F.array(F.struct(F.lit("MART").alias("objectName"), F.array(column).alias("columns"))))
    history = t("orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 101 == 7, "[{broken").otherwise(body).alias("objects_modified"))
    edges, gaps = run_lineage.from_access_history(history)
    named = gaps.select(F.col("kind").alias("what"), F.lit(None).cast("string").alias("source"), F.when(F.col("kind") != "unparsed", F.col("detail")).alias("target"))
    return edges.select(F.lit("edge").alias("what"), "source", "target").union(named).groupBy("what", "source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest_lineage",
    """WITH m AS (SELECT p_brand AS model, 'size_' || p_size AS need, p_size > 40 AND p_brand <> 'Brand#11' AS unknown FROM part), k AS (SELECT need FROM m WHERE NOT unknown)
       SELECT 'edge' AS what, 'db.raw.' || need AS source, 'db.mart.' || model AS target FROM m WHERE need IN (FROM k)
       UNION SELECT 'unknown dependency', 'source.x.' || need, 'model.' || model FROM m WHERE need NOT IN (FROM k)
       UNION SELECT 'uncompiled', 'db.mart.' || model, 'model.' || model FROM m WHERE right(model, 1) = '2'""",
)
def _(t, spark):
    """A manifest for each brand: its model reads a table for each size of its parts; large sizes are described by one brand's manifest only."""
    m = t("part").select(F.col("p_brand").alias("model"), F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("need"), ((F.col("p_size") > 40) & (F.col("p_brand") != "Brand#11")).alias("unknown")).distinct()

    target = F.struct(F.lit("model").alias("resource_type"), F.concat(F.lit('"db"."mart"."'), F.col("model"), F.lit('"')).alias("relation_name"), F.when(F.substring("model", -1, 1) != "2", "select 1").alias("compiled_code"), F.struct(F.collect_set(F.concat(F.lit("source.x."), F.col("need"))).alias("nodes")).alias("depends_on"))
    sources = F.map_from_entries(F.collect_set(F.when(~F.col("unknown"), F.struct(F.concat(F.lit("source.x."), F.col("need")), F.struct(F.lit("db").alias("database"), F.lit("raw").alias("schema"), F.col("need").alias("name"))))))
    docs = m.groupBy("model").agg(F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit("model."), F.first("model"))), F.array(target)).alias("nodes"), sources.alias("sources"))).alias("manifest"))
    edges, gaps = run_lineage.from_manifests(docs)
    return edges.select(F.lit("edge").alias("what"), "source", "target").union(gaps.select("kind", F.col("detail"), F.col("produced_by")))
