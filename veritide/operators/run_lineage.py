"""Column lineage that other systems report: run events, transformation manifests, query histories.

Every reader takes a DataFrame with a column of JSON text and gives edges
(source, target, kind, produced_by) between "dataset.column" names, lower-cased,
and what it couldn't read as gaps (produced_by, kind, detail).  Nothing is
collected: documents are parsed, exploded and aggregated where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = "struct<namespace:string,name:string,field:string,transformations:array<struct<type:string,subtype:string>>>"
_DATASET = f"struct<namespace:string,name:string,facets:struct<columnLineage:struct<fields:map<string,struct<inputFields:array<{_FIELD}>>>>>>"
_EVENT = f"eventType string, eventTime string, job struct<namespace:string,name:string>, run struct<runId:string>, inputs array<struct<namespace:string,name:string>>, outputs array<{_DATASET}>"

#: What the subtypes of the standard's transformations are called here.
SUBTYPES = {
    "IDENTITY": "identity", "TRANSFORMATION": "derived", "AGGREGATION": "aggregated", "FILTER": "filter", "JOIN": "join_key",
    "GROUP_BY": "filter", "SORT": "filter", "WINDOW": "derived", "CONDITIONAL": "derived",
}


def _named(dataset: Column, column: Column) -> Column:
    return F.concat(dataset, F.lit("."), F.lower(column))


def _told(c: Column) -> Column:
    """Null where a text says nothing."""
    return F.when(F.trim(c) != "", c)


def _parsed(df: DataFrame, body: str, schema: str, *keep: Column | str) -> DataFrame:
    """``keep``, body and e, the JSON text parsed once: a generator's output is computed once, where a projection would be repeated in every use of every field."""
    return df.select(*keep, F.col(body).alias("body"), F.explode(F.array(F.from_json(body, schema))).alias("e"))


def _kind(subtype: Column) -> Column:
    """The kind of a subtype; without one, or with one that isn't known, no more than "derived" is claimed."""
    known = F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(F.coalesce(subtype, F.lit("")))), F.lit("derived"))


def parse_events(events: DataFrame, body: str = "event") -> tuple[DataFrame, DataFrame]:
    """((job, run, state, at, outputs), gaps) of run events, one row for each readable one.

    A job is "namespace/name".  An event that is no JSON object, or has no job
    name, is a gap; one without a run id is a run of its own.
    """
    read = _parsed(events, body, _EVENT)
    name, space = _told(F.col("e.job.name")), _told(F.col("e.job.namespace"))
    # A text that isn't an object parses to a struct of nulls.
    shaped = F.substring(F.ltrim("body"), 1, 1) == "{"
    reason = F.when(F.col("e").isNull() | ~shaped | F.coalesce("e.eventType", "e.eventTime", "e.job.name", "e.job.namespace", "e.run.runId").isNull(), "unparsed").when(name.isNull(), "no job")
    marked = read.withColumn("reason", F.coalesce(reason, F.when(F.col("body").isNull(), F.lit("unparsed"))))
    gaps = marked.where(F.col("reason").isNotNull()).select(
        F.lit(None).cast("string").alias("produced_by"), F.col("reason").alias("kind"), F.substring(F.coalesce("body", F.lit("")), 1, 200).alias("detail")
    )
    good = marked.where(F.col("reason").isNull()).select(
        F.concat_ws("/", space, name).alias("job"),
        F.coalesce(_told(F.col("e.run.runId")), F.concat(F.lit("#"), F.hex(F.xxhash64("body")))).alias("run"),
        F.upper(F.coalesce("e.eventType", F.lit("OTHER"))).alias("state"),
        F.try_to_timestamp("e.eventTime").alias("at"),
        F.col("e.outputs").alias("outputs"),
    )
    return good, gaps


def runs(parsed: DataFrame) -> DataFrame:
    """(job, run, state, started, ended, events): one row for each run, whatever the order in which its events came.

    A run is complete once any event says so, else failed or aborted once one
    does, else running; events that are sent again change nothing but the count.
    """
    said = lambda *s: F.max(F.col("state").isin(*s))
    state = F.when(said("COMPLETE"), "complete").when(said("FAIL"), "failed").when(said("ABORT"), "aborted").otherwise("running")
    return parsed.groupBy("job", "run").agg(state.alias("state"), F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("events"))


def from_run_events(parsed: DataFrame) -> DataFrame:
    """(source, target, kind, produced_by, runs, first_seen, last_seen, current): edges of complete runs.

    A run's events are merged: its edges are those of all of them, once.  An edge
    is current if the job's latest complete run has it, so that a column that a
    job stopped writing keeps its history but no longer counts.  Of several
    transformations of a field the first says the kind.
    """
    known = runs(parsed).where("state = 'complete'").select("job", "run", "ended")
    # The latest run is one value for each job; ties go to the greater run id.
    latest = known.groupBy("job").agg(F.max(F.struct("ended", "run")).alias("latest")).select("job", "latest.run").withColumn("current", F.lit(True))
    output = parsed.select("job", "run", F.explode("outputs").alias("o")).select("job", "run", _told(F.col("o.name")).alias("dataset"), F.explode("o.facets.columnLineage.fields").alias("column", "detail"))
    field = output.select("job", "run", "dataset", "column", F.explode("detail.inputFields").alias("f"))
    edges = (
        field.select("job", "run", _named(_told(F.col("f.name")), _told(F.col("f.field"))).alias("source"), _named(F.col("dataset"), _told(F.col("column"))).alias("target"), _kind(F.get("f.transformations", F.lit(0))["subtype"]).alias("kind"))
        .where("source IS NOT NULL AND target IS NOT NULL")
        .distinct()
    )
    done = edges.join(known, ["job", "run"]).join(latest, ["job", "run"], "left")
    return done.groupBy("source", "target", "kind", F.col("job").alias("produced_by")).agg(
        F.count(F.lit(1)).alias("runs"), F.min("ended").alias("first_seen"), F.max("ended").alias("last_seen"), F.coalesce(F.max("current"), F.lit(False)).alias("current")
    )


def silent_outputs(parsed: DataFrame) -> DataFrame:
    """Gaps: outputs that a complete run wrote without ever saying from which columns."""
    complete = runs(parsed).where("state = 'complete'").select("job", "run")
    told = F.coalesce(F.size(F.map_keys("o.facets.columnLineage.fields")) > 0, F.lit(False))
    written = parsed.select("job", "run", F.explode("outputs").alias("o")).groupBy("job", "run", F.col("o.name").alias("dataset")).agg(F.max(told).alias("told"))
    return written.where("NOT told AND dataset IS NOT NULL").join(complete, ["job", "run"]).select(F.col("job").alias("produced_by"), F.lit("no column lineage").alias("kind"), F.col("dataset").alias("detail")).distinct()


_NODE = (
    "struct<resource_type:string,relation_name:string,database:string,schema:string,alias:string,name:string,compiled_code:string,compiled_sql:string,"
    "depends_on:struct<nodes:array<string>>>"
)


def from_manifests(manifests: DataFrame, body: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """((source, target, model), gaps): edges between the datasets of transformation projects, from their manifests.

    Models and snapshots are targets; what they depend on, tests aside, are
    sources under the relation's name, quotes removed.  A model without compiled
    SQL and a dependency that no manifest describes are gaps: neither is guessed.
    """
    read = manifests.select(F.from_json(body, f"nodes map<string,{_NODE}>, sources map<string,{_NODE}>").alias("m"))
    both = F.map_concat(F.coalesce("m.nodes", F.create_map().cast(f"map<string,{_NODE}>")), F.coalesce("m.sources", F.create_map().cast(f"map<string,{_NODE}>")))
    node = read.select(F.explode(both).alias("id", "n"))
    whole = F.concat_ws(".", _told(F.col("n.database")), _told(F.col("n.schema")), F.coalesce(_told(F.col("n.alias")), F.col("n.name")))
    relation = F.coalesce(_told(F.regexp_replace("n.relation_name", '["`]', "")), whole)
    all_ = node.select("id", relation.alias("relation"), F.col("n.resource_type").alias("type"), F.coalesce(_told(F.col("n.compiled_code")), _told(F.col("n.compiled_sql"))).isNotNull().alias("compiled"), F.col("n.depends_on.nodes").alias("needs")).dropDuplicates(["id"])
    models = all_.where(F.col("type").isin("model", "snapshot"))
    needed = models.select(F.col("relation").alias("target"), F.col("id").alias("model"), F.explode("needs").alias("need"))
    found = needed.join(all_.select(F.col("id").alias("need"), F.col("relation").alias("source")), "need", "left")
    edges = found.where("source IS NOT NULL").select("source", "target", "model").distinct()
    gaps = models.where("NOT compiled").select(F.col("id").alias("produced_by"), F.lit("uncompiled").alias("kind"), F.col("relation").alias("detail")).union(
        found.where("source IS NULL").select(F.col("model"), F.lit("unknown dependency"), F.col("need"))
    )
    return edges, gaps


_MODIFIED = "array<struct<objectName:string,columns:array<struct<columnName:string,directSources:array<struct<objectName:string,columnName:string>>,baseSources:array<struct<objectName:string,columnName:string>>>>>>"


def from_access_history(history: DataFrame, query: str = "query_id", modified: str = "objects_modified") -> tuple[DataFrame, DataFrame]:
    """(edges, gaps) of a warehouse's access history, whose rows say which columns each write read directly.

    A column of which only the base sources are known, several steps away, is a
    gap, and so is a row that can't be parsed.  Queries that wrote nothing say
    nothing.
    """
    read = history.select(F.concat(F.lit("access:"), F.coalesce(F.col(query).cast("string"), F.lit(""))).alias("produced_by"), F.col(modified).alias("body"), F.from_json(modified, _MODIFIED).alias("m"))
    columns = read.select("produced_by", F.explode("m").alias("o")).select("produced_by", F.lower("o.objectName").alias("dataset"), F.explode("o.columns").alias("c"))
    direct = columns.select("produced_by", _named(_told(F.col("dataset")), _told(F.col("c.columnName"))).alias("target"), F.explode("c.directSources").alias("s"), "dataset")
    edges = direct.select(_named(_told(F.lower("s.objectName")), _told(F.col("s.columnName"))).alias("source"), "target", F.lit("derived").alias("kind"), "produced_by")
    listed = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    gaps = columns.where(~listed("c.directSources") & listed("c.baseSources")).select("produced_by", F.lit("only base sources").alias("kind"), _named(F.col("dataset"), F.col("c.columnName")).alias("detail"))
    broken = read.where(F.col("body").isNotNull() & (F.col("m").isNull() | ~F.ltrim("body").startswith("["))).select("produced_by", F.lit("unparsed"), F.substring("body", 1, 200))
    return edges.where("source IS NOT NULL AND target IS NOT NULL").distinct(), gaps.union(broken)


def from_column_history(history: DataFrame) -> DataFrame:
    """Edges of a history that holds one edge a row: source_table_full_name, source_column_name, the same for target, entity_type, entity_id."""
    cell = lambda c: _told(F.lower(c))
    edges = history.select(
        _named(cell("source_table_full_name"), cell("source_column_name")).alias("source"),
        _named(cell("target_table_full_name"), cell("target_column_name")).alias("target"),
        F.lit("derived").alias("kind"),
        F.concat(F.lit("history:"), F.coalesce(_told(F.col("entity_type")), _told(F.col("entity_id").cast("string")), F.lit("catalog"))).alias("produced_by"),
    )
    return edges.where("source IS NOT NULL AND target IS NOT NULL").distinct()


def merged(*edges: DataFrame) -> DataFrame:
    """(source, target, kind, origins, n): edges of several readers as one set, with how many origins report each."""
    plain = [e.select("source", "target", "kind", "produced_by") for e in edges]
    out = plain[0]
    for e in plain[1:]:
        out = out.unionByName(e)
    return out.groupBy("source", "target", "kind").agg(F.min("produced_by").alias("origin"), F.count_distinct("produced_by").alias("origins"))
