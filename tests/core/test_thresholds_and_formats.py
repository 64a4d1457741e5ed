from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veritide.functions import scalars, validators
from veritide.operators import incidents, monitor, reconcile, score
from veritide.plans import imports, suite
from veritide.plans.controls import RowCheck, Threshold, UniqueKey
from veritide.sources import messages, readers, sinks


def verdict(df, threshold, ok="v < 10"):
    return suite.evaluate(df, [RowCheck("c", ok, threshold=threshold)]).first().verdict


def test_amounts_and_least_numbers(spark):
    df = spark.createDataFrame([(5, 1.0), (10, -40.5), (None, 9.5), (12, None)], "v int, a double")
    assert verdict(df, Threshold(amount=50.0, of="a")) == "pass"
    assert verdict(df, Threshold(amount=49.99, of="a")) == "fail"
    assert verdict(df, Threshold(amount=50.0, of="a", at_least=True)) == "pass"
    assert verdict(df, Threshold(amount=0.0, of="a"), "true") == "pass"
    assert [verdict(df, Threshold(rows=n, at_least=True)) for n in (3, 4)] == ["pass", "fail"]
    assert [verdict(df, Threshold(rate=r, at_least=True)) for r in (0.75, 0.76)] == ["pass", "fail"]
    by = suite.evaluate(df, [RowCheck("c", "v < 10", threshold=Threshold(amount=41, of="a * 1"))], segments=["v"])
    assert {r.v: r.verdict for r in by.collect()} == {5: "pass", 10: "pass", None: "pass", 12: "pass"}
    assert verdict(df.limit(0), Threshold(amount=1.0, of="a")) == "indeterminate"
    with pytest.raises(ValueError, match="only a row check"):
        suite.evaluate(df, [UniqueKey("u", ("v",), threshold=Threshold(amount=1.0, of="a"))])
    for wrong in ({"amount": 1.0}, {"of": "a"}, {"amount": 1.0, "of": "a", "rate": 0.1}):
        with pytest.raises(ValueError):
            Threshold(**wrong)


def test_match_report_of_nothing_and_of_wrong_keys(spark):
    side = reconcile.Side(["k"], "a")
    totals = lambda rows: side.totals(spark.createDataFrame(rows, "k int, a double"))
    got = reconcile.report(reconcile.match(totals([(1, 1.0), (1, 2.0), (2, 1.0), (3, 1.0)]), totals([(1, 3.0), (9, 1.0)]))).first()
    assert (got.pairs, got.totalled_pairs, got.left_only, got.right_only, got.left_rows, got.right_rows, got.verdict) == (1, 1, 2, 1, 4, 2, "misconfigured")
    assert got.match_rate == 0.5
    none = reconcile.report(reconcile.match(totals([]), totals([]))).first()
    assert none.match_rate is None and none.verdict == "nothing compared" and none.left_rows == 0
    breaks = reconcile.classify(reconcile.match(totals([(1, 1.0), (2, 5.0), (3, 7.0), (4, 2.0)]), totals([(1, 1.0), (2, -5.0), (4, 900.0), (5, 3.0)])), reconcile.Tolerance())
    assert [(r.rank, r.k0, r.kind) for r in reconcile.worst_first(breaks, 9).collect()] == [(1, "4", "genuine"), (2, "3", "missing"), (3, "5", "extra"), (4, "2", "sign")]


def card(elements, body):
    first = sum(1 << (64 - e) for e in elements if e <= 64) | (1 << 63 if max(elements) > 64 else 0)
    second = sum(1 << (128 - e) for e in elements if e > 64)
    return f"0200{first:016X}" + (f"{second:016X}" if max(elements) > 64 else "") + body


def test_second_bitmap_and_lengths(spark):
    rows = [card((3, 70, 102), "000000" + "301" + "05ABCDE"), card((3, 48, 55), "000000" + "004abcd" + "002XY"), card((3, 39), "0000000"), card((3, 65), "000000" + "1"), card((2,), "20" + "4" * 20), None, "02"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, m string")
    got = {r.id: (r.fields, r.stopped_at) for r in messages.iso8583_fields(df, "m").collect()}
    assert got[0] == ({3: "000000", 70: "301", 102: "ABCDE"}, None)
    assert got[1] == ({3: "000000", 48: "abcd", 55: "XY"}, None)
    assert got[2] == ({3: "000000"}, 39) and got[3] == ({3: "000000"}, 65) and got[4] == ({}, 2)
    assert not got[5][0] and not got[6][0]


def test_binary_and_zoned_numbers_of_a_copybook(spark):
    layout = messages.copybook(
        """
       01 REC.
          05 A PIC S9(4) COMP.
          05 B PIC 9(9) BINARY.
          05 C PIC S9(10)V99 COMP-4.
          05 D PIC S9(3)V99.
        """
    )
    assert layout == [("a", 1, 2, "binary:0"), ("b", 3, 4, "unsigned:0"), ("c", 7, 8, "binary:2"), ("d", 15, 5, "zoned:2")]
    raw = (-1234).to_bytes(2, "big", signed=True) + (4_000_000_000).to_bytes(4, "big") + (-98_765).to_bytes(8, "big", signed=True) + bytes.fromhex("F1F2F3F4D5")
    got = messages.fixed_width(spark.createDataFrame([(bytearray(raw),)], "raw binary"), "raw", layout).first()
    assert (got.a, got.b, got.c, got.d) == (Decimal(-1234), Decimal(4_000_000_000), Decimal("-987.65"), Decimal("-123.45"))
    ends = spark.createDataFrame([(bytearray(b"\x7f" + b"\xff" * 7),), (bytearray(b"\x80" + b"\0" * 7),), (bytearray(b"\0" * 8),)], "raw binary")
    assert [r[0] for r in ends.select(messages.binary_number("raw")).collect()] == [2**63 - 1, -(2**63), 0]
    for picture in ("COMP-1", "COMP-5", "SIGN LEADING"):
        with pytest.raises(ValueError):
            messages.copybook(f"01 A PIC S9(4) {picture}.")


def test_an_unknown_outcome_passes_a_dbt_expression(spark):
    found = imports.from_dbt({"models": [{"name": "m", "tests": [{"dbt_utils.expression_is_true": {"expression": "x > 1"}}]}]})
    got = suite.evaluate(spark.createDataFrame([(2,), (None,), (3,)], "x int"), found.controls["m"]).first()
    assert (got.scanned_rows, got.violating_rows, got.verdict) == (3, 0, "pass")


def test_quality_rules_of_every_object_of_a_contract(spark):
    rule = lambda **k: {"name": "v", "quality": [k]}
    contract = {
        "schema": [
            {"name": "a", "properties": [rule(metric="nullValues", mustBeLessThan=2), rule(metric="nullValues", mustBeGreaterThan=1), rule(metric="missingValues", arguments={"missingValues": [None, "n/a"]}), rule(metric="invalidValues", arguments={"validValues": ["x"]}, mustBeBetween=[1, 2])]},
            {"name": "b", "quality": [{"metric": "rowCount", "mustBe": 4}, {"metric": "rowCount"}, {"type": "sql", "query": "select 1"}, {"metric": "nullValues"}], "properties": [rule(metric="duplicateValues", mustBe=0), rule(metric="made up")], "team": []},
        ],
        "support": ["x"],
    }
    declared, found = imports.from_contracts(contract)
    assert [d.dataset for d in declared] == ["a", "b"]
    df = spark.createDataFrame([("x",), ("x",), ("n/a",), (None,)], "v string")
    assert [(r.violating_rows, r.verdict) for r in suite.evaluate(df, found.controls["a"]).collect()] == [(1, "pass"), (1, "fail"), (2, "fail")]
    assert {(r.violating_rows, r.verdict) for r in suite.evaluate(df, found.controls["b"]).collect()} == {(0, "pass"), (2, "fail")}
    left = dict(found.unmapped)
    assert set(left) == {"a.v: invalidValues", "b: rowCount", "b: sql", "b: nullValues", "b.v: made up", "a: support", "b: support"}


def test_names_can_be_added_once(spark, monkeypatch):
    for table in (validators.VALIDATORS, validators.CODE_LISTS, monitor.DETECTORS, scalars.ADDED, readers.FORMATS):
        for name in ("half", "sizes", ".x"):
            monkeypatch.delitem(table, name, raising=False)
    scalars.register_function("half", lambda c: c / 2)
    assert spark.range(5).select(scalars.call("half", "id").alias("h")).agg(F.sum("h")).first()[0] == 5.0
    validators.register_validator("half", lambda c: F.col(c) % 2 == 0)
    monitor.register_detector("half", lambda df: df.withColumn("score", F.col("value") / 2))
    series = spark.createDataFrame([("s", 1, 8.0)], "series string, t int, value double")
    assert monitor.detected(series, ["half"])["half"].first().score == 4.0
    readers.register_format("half", "json")
    for again in (lambda: scalars.register_function("half", abs), lambda: scalars.register_function("col", abs), lambda: validators.register_validator("half", abs), lambda: monitor.register_detector("half", abs), lambda: readers.register_format("half", "json"), lambda: scalars.call("gone", "id"), lambda: monitor.detected(series, ["gone"])):
        with pytest.raises(ValueError):
            again()
    validators.register_code_list("sizes", {datetime(2024, 1, 1).date(): ("S", "M")})
    assert validators.code_list("sizes") == ("S", "M")
    del validators.VALIDATORS["half"], validators.CODE_LISTS["sizes"], monitor.DETECTORS["half"], scalars.ADDED["half"], readers.FORMATS["half"]


def test_ibans_of_more_countries(spark):
    def iban(country, body):
        digits = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(digits) % 97:02d}{body}"

    rows = [iban("IQ", "NBIQ850123456789012"), iban("RU", "044525225" + "4" * 20), iban("FK", "SC" + "1" * 12), iban("IQ", "NBIQ85012345678901"), iban("ZZ", "1" * 16)]
    got = spark.createDataFrame([(r,) for r in rows], "v string").select(validators.iban("v")).collect()
    assert [r[0] for r in got] == [True, True, True, False, False]


def test_metrics_are_appended_by_day_and_the_latest_read(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for i, day in enumerate(("2024-01-01", "2024-01-02")):
        sinks.append_metrics(spark.createDataFrame([("d", "rows", float(i), day)], "dataset string, metric string, value double, computed_at string").withColumn("computed_at", F.to_timestamp("computed_at")), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 2 and rows.select("day").distinct().count() == 2
    assert readers.latest(rows, ["dataset", "metric"], "computed_at").first().value == 1.0


def test_ranking_of_trust_detectors_and_changes(spark):
    trust = spark.createDataFrame([("b", 0.1), ("a", 0.1), ("c", 0.9)], "node string, trust double")
    assert [r.node for r in score.least_trusted(trust, 2).collect()] == ["a", "b"]
    scored = spark.createDataFrame([("fair", i / 400) for i in range(400)] + [("eager", i / 4000) for i in range(400)] + [("young", i / 100) for i in range(100)], "detector string, p double")
    assert {r.detector: r.wins for r in incidents.tournament(scored).collect()} == {"fair": True, "eager": False, "young": False}
    start = datetime(2024, 1, 2)
    found = spark.createDataFrame([("n", "r", start), ("r", "r", start)], "node string, root string, since timestamp")
    changes = spark.createDataFrame([("n", start - timedelta(hours=1)), ("r", start - timedelta(hours=5)), ("r", start - timedelta(days=3)), ("n", start + timedelta(hours=1))], "node string, at timestamp")
    assert [(r.node, r["rank"]) for r in incidents.causes(found, changes).orderBy("rank").collect()] == [("r", 1), ("n", 2)]
