from veritide.operators import diff


def test_rows_are_dealt_before_they_are_combined(spark):
    nan = float("nan")
    old = spark.createDataFrame([(1, 0.0, "x")] + [(2, 1.0, None)] * 40 + [(None, nan, "y"), (4, 2.0, "z")], "a long, b double, only_old string")
    new = spark.createDataFrame([(1, -0.0, 1)] + [(2, 1.0, 1)] * 40 + [(None, nan, 1), (5, 2.0, 2), (5, 2.0, 3)], "a long, b double, only_new long")
    out = diff.keyless_diff(old, new)
    assert {r.change: r.rows for r in out.collect()} == {"unchanged": 3, "removed": 1, "added": 1}
    # Below where rows are dealt out, no task combines a file's rows.
    parts = out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(parts) == 2 and "Aggregate" in parts[0] and "Aggregate" not in parts[1]
    assert diff.keyless_diff(old.limit(0), new.limit(0)).count() == 0
