import json

from veritide.operators import run_lineage


def event(state, at, run, fields=None, job="load", space="bank", output="mart.sales"):
    lineage = {c: {"inputFields": [{"name": d, "field": f, "transformations": [{"type": "DIRECT", "subtype": s}] if s else []} for d, f, s in sources]} for c, sources in (fields or {}).items()}
    return json.dumps({"eventType": state, "eventTime": at, "run": {"runId": run}, "job": {"namespace": space, "name": job}, "outputs": [{"name": output, "facets": {"columnLineage": {"fields": lineage}} if fields else {}}]})


def read(spark, bodies):
    return run_lineage.parse_events(spark.createDataFrame([(b, "x") for b in bodies], "event string, job string"))


def test_events_of_a_run_are_merged_whatever_their_order(spark):
    first = event("START", "2024-01-01T00:00:00Z", "r1", {"A": [("raw", "X", "IDENTITY")]})
    last = event("complete", "2024-01-01T00:05:00Z", "r1", {"b": [("raw", "y", "AGGREGATION"), ("raw", "z", "GROUP_BY")]})
    parsed, gaps = read(spark, [last, first, last])
    assert gaps.count() == 0
    edges = {(r.source, r.target, r.kind): (r.produced_by, r.runs, r.current) for r in run_lineage.from_run_events(parsed).collect()}
    assert edges == {(f"raw.{s}", f"mart.sales.{t}", k): ("bank/load", 1, True) for s, t, k in (("x", "a", "identity"), ("y", "b", "aggregated"), ("z", "b", "filter"))}
    assert [(r.state, r.events) for r in run_lineage.runs(parsed).collect()] == [("complete", 3)]


def test_a_text_is_parsed_once_however_many_fields_are_read(spark):
    parsed, gaps = read(spark, [event("COMPLETE", "2024-01-01T00:00:00Z", "r", {"a": [("raw", "x", "IDENTITY")]})])
    for df in (parsed, gaps, run_lineage.runs(parsed)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_only_complete_runs_move_values_and_the_latest_is_current(spark):
    rows = [
        event("COMPLETE", "2024-01-01T00:00:00Z", "r1", {"a": [("raw", "x", "IDENTITY")], "b": [("raw", "y", None)]}),
        event("COMPLETE", "2024-01-02T00:00:00Z", "r2", {"a": [("raw", "x", "IDENTITY")]}),
        event("FAIL", "2024-01-03T00:00:00Z", "r3", {"c": [("raw", "z", "IDENTITY")]}),
        event("START", "2024-01-04T00:00:00Z", "r4", {"c": [("raw", "z", "IDENTITY")]}),
        event("ABORT", "2024-01-05T00:00:00Z", "r5"),
    ]
    parsed, _ = read(spark, rows)
    got = {(r.target, r.kind): (r.runs, str(r.first_seen.date()), str(r.last_seen.date()), r.current) for r in run_lineage.from_run_events(parsed).collect()}
    assert got == {("mart.sales.a", "identity"): (2, "2024-01-01", "2024-01-02", True), ("mart.sales.b", "derived"): (1, "2024-01-01", "2024-01-01", False)}
    assert {r.run: r.state for r in run_lineage.runs(parsed).collect()} == {"r1": "complete", "r2": "complete", "r3": "failed", "r4": "running", "r5": "aborted"}


def test_what_cannot_be_read_is_a_gap(spark):
    nameless = json.dumps({"eventType": "COMPLETE", "job": {"namespace": "bank", "name": " "}, "run": {"runId": "r"}})
    parsed, gaps = read(spark, [None, "", "{half", "[]", "7", nameless, event("COMPLETE", "2024-01-01T00:00:00Z", "r", job="quiet")])
    assert sorted(r.kind for r in gaps.collect()) == ["no job"] + ["unparsed"] * 5
    assert [tuple(r) for r in run_lineage.silent_outputs(parsed).collect()] == [("bank/quiet", "no column lineage", "mart.sales")]
    assert run_lineage.from_run_events(parsed).count() == 0
    # Two events without a run id are two runs; without a namespace a job is its name.
    loose = [json.dumps({"eventType": "COMPLETE", "eventTime": f"2024-01-0{i}T00:00:00Z", "job": {"name": "j"}}) for i in (1, 2)]
    assert [(r.job, r.events) for r in run_lineage.runs(read(spark, loose)[0]).collect()] == [("j", 1)] * 2


def test_manifests(spark):
    manifest = {
        "nodes": {
            "model.p.a": {"resource_type": "model", "relation_name": '"db"."m"."a"', "compiled_code": "select 1", "depends_on": {"nodes": ["source.p.s", "model.p.b", "model.q.gone"]}},
            "model.p.b": {"resource_type": "snapshot", "database": "db", "schema": "m", "name": "b", "alias": "bee", "depends_on": {"nodes": []}},
            "test.p.t": {"resource_type": "test", "name": "t", "depends_on": {"nodes": ["model.p.a"]}},
        },
        "sources": {"source.p.s": {"database": "db", "schema": "raw", "name": "s"}},
    }
    edges, gaps = run_lineage.from_manifests(spark.createDataFrame([(json.dumps(manifest),), (None,), ("{}",)], "manifest string"))
    assert {tuple(r) for r in edges.collect()} == {("db.raw.s", "db.m.a", "model.p.a"), ("db.m.bee", "db.m.a", "model.p.a")}
    assert {tuple(r) for r in gaps.collect()} == {("model.p.b", "uncompiled", "db.m.bee"), ("model.p.a", "unknown dependency", "model.q.gone")}


def test_histories(spark):
    modified = [{"objectName": "DB.T", "columns": [{"columnName": "A", "directSources": [{"objectName": "DB.S", "columnName": "X"}]}, {"columnName": "B", "directSources": [], "baseSources": [{"objectName": "DB.R", "columnName": "Y"}]}]}]
    rows = [("q1", json.dumps(modified)), ("q1", json.dumps(modified)), ("q2", None), ("q3", "{no"), ("q4", "[]")]
    edges, gaps = run_lineage.from_access_history(spark.createDataFrame(rows, "query_id string, objects_modified string"))
    assert [tuple(r) for r in edges.collect()] == [("db.s.x", "db.t.a", "derived", "access:q1")]
    assert {tuple(r) for r in gaps.collect()} == {("access:q1", "only base sources", "db.t.b"), ("access:q3", "unparsed", "{no")}
    flat = spark.createDataFrame([("S", "X", "T", "A", "JOB", "7"), ("S", "X", "T", None, "JOB", "7"), ("S", "X", "T", "A", "", "7")], "source_table_full_name string, source_column_name string, target_table_full_name string, target_column_name string, entity_type string, entity_id string")
    assert {r.produced_by for r in run_lineage.from_column_history(flat).collect()} == {"history:JOB", "history:7"}
    both = run_lineage.merged(edges, run_lineage.from_column_history(flat))
    assert {(r.source, r.origins) for r in both.collect()} == {("db.s.x", 1), ("s.x", 2)}
