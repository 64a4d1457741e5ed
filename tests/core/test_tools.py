from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veritide.operators import lineage, mining, monitor, profile, reconcile
from veritide.plans import imports, suite
from veritide.plans.controls import RowCheck, RowCount
from veritide.sources import messages, readers


def test_parameters():
    made = imports.bind([RowCheck("a", "x = $who AND y = '$who' AND z > $n", where="$on"), RowCount("b", 1)], who="O'Neil", n=-2, on=True)
    assert made[0].ok == "x = 'O\\'Neil' AND y = '$who' AND z > -2" and made[0].where == "true" and made[1] == RowCount("b", 1)
    with pytest.raises(ValueError, match="no value"):
        imports.bind([RowCheck("a", "x = $who")])


def test_what_soda_checks_have_no_control_for():
    found = imports.from_soda({"checks for t": ["freshness(ts) < 2d", "row_count > 5", "duplicate_percent(a) < 1%", "nonsense", {"invalid_count(a) = 0": {"valid format": "email"}}, "max(a) = 3"], "for each x": []}, instant="2024-01-01")
    assert [type(c).__name__ for c in found.controls["t"]] == ["Freshness", "RowCount", "UniqueKey"] and found.controls["t"][0].seconds == 172_800 and found.controls["t"][1].low == 6
    assert len(found.unmapped) == 4


def test_contracts_go_there_and_back():
    contract = {"schema": [{"name": "t", "properties": [{"name": "a", "required": True, "primaryKey": True, "primaryKeyPosition": 2}, {"name": "b", "primaryKey": True, "primaryKeyPosition": 1, "logicalTypeOptions": {"minimum": 0}}]}, {}], "team": "x"}
    declared, left = imports.from_contract(contract)
    assert declared.grain == ("b", "a") and left == ["1 further schema objects", "team"]
    assert imports.from_contract(imports.to_contract(declared))[0] == declared
    with pytest.raises(ValueError):
        imports.from_contract({"schema": {"name": "t"}})


def test_delegate_and_preview(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 10 != 0, F.col("id")))
    got = suite.delegate(df, "d", lambda rows: rows["x"] > 90, ["x"]).first()
    assert (got.scanned_rows, got.violating_rows, got.verdict) == (100, 9, "fail")
    assert suite.delegate(df.limit(0), "d", lambda rows: rows["x"] > 90, ["x"]).first().verdict == "indeterminate"
    with pytest.raises(Exception, match="answers for"):
        suite.delegate(df, "d", lambda rows: [True], ["x"]).collect()


def test_proposals_from_edges(spark):
    edges = spark.createDataFrame([("a.k_id", "c.k_id", "identity", "declared"), ("a.v", "c.w", "derived", "declared"), ("a.k_id", "a.j_id", "rename", "declared"), ("a.k_id", "b.k_id", "identity", "inferred")], "source string, target string, kind string, status string")
    controls = spark.createDataFrame([("a.k_id", "r"), ("a.v", "s")], "column string, control string")
    got = {tuple(r) for r in lineage.proposals(edges, controls).collect()}
    assert got == {("propagated", "c.k_id", "r"), ("propagated", "a.j_id", "r"), ("references", "c.k_id", "a.k_id")}


def test_sketch_never_counts_too_few_and_adds_up(spark):
    df = spark.range(5000).withColumn("v", F.col("id") % 700)
    true = {r.v: r["count"] for r in df.groupBy("v").count().collect()}
    small = {"width": 256, "depth": 3}
    whole = profile.count_min(df, "v", **small)
    got = {r.value: r.estimate for r in profile.count_min_estimate(whole, df.select("v").distinct(), "v", **small).collect()}
    assert all(got[v] >= n for v, n in true.items()) and sum(got[v] > true[v] + 5000 * 2.72 / 256 for v in true) <= 0.1 * len(true)
    halves = profile.count_min(df.where("id < 100"), "v", **small).union(profile.count_min(df.where("id >= 100"), "v", **small)).groupBy("row", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, whole.collect()))


def test_codes_and_rates_that_are_missing(spark):
    mapping = spark.createDataFrame([("a", "X")], "code string, other string")
    df = spark.createDataFrame([("A",), (None,), ("b",)], "c string")
    with pytest.raises(Exception, match="no mapping"):
        reconcile.map_codes(df, "c", mapping).collect()
    assert sorted(str(r.c) for r in reconcile.map_codes(df.where("c is null or c = 'A'"), "c", mapping).collect()) == ["None", "X"]
    rates = spark.createDataFrame([("EUR", "USD", "2024-01-01", 2.0), ("USD", "EUR", "2024-01-02", 0.25)], "source string, target string, day string, rate double").withColumn("day", F.to_date("day"))
    rows = spark.createDataFrame([("EUR", d) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05")], "ccy string, d string").withColumn("d", F.to_date("d"))
    got = {str(r.d): r.rate for r in reconcile.dated_rates(rows, rates, "ccy", "d", "USD", carry_days=1).collect()}
    # A quote of the day before goes before an inverted rate of the day itself.
    assert got == {"2024-01-01": 2.0, "2024-01-02": 2.0, "2024-01-03": 4.0, "2024-01-05": None}


def test_scopes_budget_and_caveats(spark):
    df = spark.range(10).withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).withColumn("p", F.lit("x"))
    now = datetime(2024, 1, 10)
    assert readers.scan_scope(df, "ts", None)[1] == "full" and readers.scan_scope(df, "ts", "1970-01-01 00:05:00")[1] == "forward_only"
    assert readers.scan_scope(df, "ts", "1970-01-01 00:05:00", 60)[0].count() == 6
    assert readers.scan_scope(df, "ts", "1970-01-01 00:05:00", 60, now=now, last_sweep=datetime(2024, 1, 1), sweep_seconds=86400)[1] == "full"
    assert monitor.budget_level(2, 10_000, 1 / 91) == (0.0002, False) and monitor.budget_level(2, 10)[0] == 0.2
    assert len(mining.caveats(df, 1000, "p")) == 3 and mining.caveats(df, 10, small=5) == []


def test_ensemble_of_detectors(spark):
    rows = [("s", t, float(t % 7), float(t % 5) if t < 60 else 100.0) for t in range(61)]
    df = spark.createDataFrame(rows, "series string, t int, a double, b double")
    parts = {n: df.select("series", "t", F.col(n).alias("score")) for n in ("a", "b")}
    got = {r.t: r for r in monitor.ensemble(parts).collect()}
    ps = [monitor.conformal_p(p).where("t = 60").first().p for p in parts.values()]
    assert got[60].detectors == 2 and abs(got[60].p - min(2 * min(ps), max(ps))) < 1e-12 and min(got) == 20


def test_card_messages(spark):
    bits = sum(1 << (64 - e) for e in (2, 3, 4, 39))
    text = f"0200{bits:016X}164242424242424242000000000000001000" + "00"
    odd = sum(1 << (64 - e) for e in (3, 5, 39))
    df = spark.createDataFrame([(1, text), (2, f"0200{odd:016X}000000123456")], "id int, m string")
    got = {r.id: r for r in messages.iso8583_fields(df, "m").collect()}
    assert got[1].fields == {2: "4242424242424242", 3: "000000", 4: "000000001000", 39: "00"} and got[1].stopped_at is None and got[1].mti == "0200"
    assert got[2].fields == {3: "000000"} and got[2].stopped_at == 5


def test_copybook_of_groups_tables_and_redefinitions(spark):
    layout = messages.copybook(
        """
      * a comment
       01 REC.
          05 ID           PIC 9(4).
          05 NAME         PIC X(6).
          05 NAME-PARTS REDEFINES NAME.
             10 FIRST-PART PIC X(2).
             10 REST-PART PIC X(4).
          05 LINES OCCURS 2 TIMES.
             10 AMT       PIC S9(5)V99 COMP-3.
             10 TAG       PIC X.
          88 IS-ON VALUE 1.
          05 LAST-ONE     PIC 99.
        """
    )
    assert layout == [
        ("id", 1, 4, "zoned"), ("name", 5, 6, "text"), ("first_part", 5, 2, "text"), ("rest_part", 7, 4, "text"), ("amt_1", 11, 4, "packed:2"), ("tag_1", 15, 1, "text"),
        ("amt_2", 16, 4, "packed:2"), ("tag_2", 20, 1, "text"), ("last_one", 21, 2, "zoned"),
    ]
    raw = "1234ABCDEF".encode("cp037") + bytes.fromhex("0012345C") + "x".encode("cp037") + bytes.fromhex("0000100D") + "y7".encode("cp037") + "8".encode("cp037")
    got = messages.fixed_width(spark.createDataFrame([(bytearray(raw),)], "raw binary"), "raw", layout).first()
    assert (got.id, got.name, got.rest_part, float(got.amt_1), float(got.amt_2), got.tag_2, got.last_one) == (1234, "ABCDEF", "CDEF", 123.45, -1.0, "y", 78)
    with pytest.raises(ValueError):
        messages.copybook("01 A PIC Z(4).")
