import pytest
from pyspark.sql import functions as F

from veritide.functions import predicates as P
from veritide.functions import scalars as S
from veritide.functions import validators as V
from veritide.plans import declare, suite
from veritide.plans.controls import Dependency, Freshness, References, RowCheck, RowCount, Threshold, UniqueKey
from veritide.sources.guard import read_only

ROWS = [(1, "a", 5.0), (2, None, None), (2, "b", -1.0), (None, "b", 3.0)]
SCHEMA = "k int, s string, v double"


def verdicts(df, controls, **kw):
    return {(r.control, *[r[c] for c in kw.get("segments", ())]): (r.scanned_rows, r.violating_rows, r.verdict) for r in suite.evaluate(df, controls, **kw).collect()}


def test_unknown_is_a_violation_and_an_unknown_filter_excludes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = verdicts(df, [RowCheck("a", "v > 0"), RowCheck("b", "v > 0", unknown=P.PASSES), RowCheck("c", "v > 0", where="s = 'b'"), RowCheck("d", "v > 0", threshold=Threshold(rate=0.5))])
    assert got == {("a",): (4, 2, "fail"), ("b",): (4, 1, "fail"), ("c",): (2, 1, "fail"), ("d",): (4, 2, "pass")}


def test_empty_scope_is_indeterminate_but_for_counts_and_freshness(spark):
    df = spark.createDataFrame([], "k int, s string, v double, t timestamp")
    controls = [
        RowCheck("row", "v > 0"), UniqueKey("key", ("k",)), Dependency("fd", ("k",), "s"), RowCount("count", 1), RowCount("none", 0, 5), Freshness("fresh", "t", "2024-01-01", 60),
        References("ref", "k", "p", "k"),
    ]
    got = verdicts(df, controls, parents={"p": df})
    assert {k[0]: v[2] for k, v in got.items()} == {
        "row": "indeterminate", "key": "indeterminate", "fd": "indeterminate", "count": "fail", "none": "pass", "fresh": "fail", "ref": "indeterminate",
    }


def test_keys_dependencies_references(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = verdicts(df, [UniqueKey("key", ("k",)), Dependency("fd", ("k",), "s"), References("ref", "k", "p", "k")], parents={"p": df.where("k = 1 or k is null")})
    assert got == {("key",): (4, 2, "fail"), ("fd",): (4, 0, "pass"), ("ref",): (4, 3, "fail")}


def test_segments_keep_nulls_and_roll_up(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = suite.evaluate(df, [RowCheck("a", "v > 0")], ["s"])
    assert {r.s: r.violating_rows for r in out.collect()} == {"a": 0, None: 1, "b": 1}
    assert suite.roll_up(out).first().verdict == "fail"


def test_validation_and_identity(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="no column"):
        suite.evaluate(df, [UniqueKey("x", ("nope",))])
    with pytest.raises(ValueError, match="not repeatable"):
        suite.evaluate(df, [RowCheck("x", "v > rand()")])
    with pytest.raises(ValueError, match="two controls"):
        suite.evaluate(df, [RowCheck("x", "v > 0"), RowCheck("x", "v > 1")])
    assert RowCheck("x", "v > 0").identity() == RowCheck("x", "v > 0").identity() != RowCheck("x", "v > 1").identity()


def test_fusion_shares_one_scan(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    controls = [RowCheck(str(i), f"v > {i}") for i in range(9)]
    assert suite.cost(controls) == suite.Cost(9, 1)
    plan = suite.evaluate(df, controls)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_quarantine_loses_nothing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    good, bad = suite.quarantine(df, [RowCheck("v", "v > 0"), RowCheck("s", "s is not null")])
    assert good.count() + bad.count() == 4
    assert sorted(",".join(r.reasons) for r in bad.collect()) == ["v", "v,s"]


@pytest.mark.parametrize("text", ["drop table x", "select 1; select 2", "with a as (select 1) insert into t select * from a", "", "set x = 1"])
def test_guard_refuses(text):
    with pytest.raises(ValueError):
        read_only(text)


def test_guard_lets_reads_pass():
    assert read_only("SELECT 'drop it; now' AS x -- delete\n;") == "SELECT 'drop it; now' AS x -- delete\n"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_scalars(spark):
    null = F.lit(None).cast("int")
    got = one(
        spark, trim=S.trim(F.lit("\t a ")), mid=S.mid(F.lit("abc"), -1, 2), right=S.right(F.lit("abc"), 0), concat=S.concat(F.lit("a"), null), least=S.least(F.lit(2), null),
        if_=S.if_then(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)), mod=S.modulo(F.lit(-10), F.lit(3)), zero=S.modulo(F.lit(1), F.lit(0)), half=S.round_half_up(F.lit("-2.5"), 0).cast("int"),
        blank=S.is_blank(F.lit("  ")), number=S.is_number(F.lit("1.")), year=S.year(F.lit("2026-02-30")), units=S.minor_units_ok(F.lit("1.005"), F.lit("KWD")),
    )
    assert got == {
        "trim": "a", "mid": "ab", "right": "", "concat": None, "least": None, "if_": None, "mod": -1, "zero": None, "half": -3, "blank": True, "number": False, "year": 2026, "units": True,
    }


GOOD = {
    "isin": "US0378331005", "sedol": "0263494", "cusip": "037833100", "figi": "BBG000BLNNH6", "lei": "5493001KJTIIGC8Y1R12", "iban": "GB82 WEST 1234 5698 7654 32", "bic": "DEUTDEFF", "mic": "XNAS",
    "aba_routing": "021000021", "upi": "QZABCDEFGHJK", "gtin": "4006381333931", "npi": "1234567893", "card_number": "4242 4242-4242 4242", "email": "a.b+c@x-y.co.uk", "uuid": "123e4567-e89b-12d3-a456-426614174000",
    "ulid": "01ARZ3NDEKTSV4RRFFQ69G5FAV", "iso_date": "2024-02-29", "hex_colour": "#a1B2c3", "ipv4": "255.0.10.1", "uti": "5493001KJTIIGC8Y1R12TRADE1",
}
BAD = {
    "isin": "US0378331006", "sedol": "0263495", "cusip": "037833101", "figi": "BBG000BLNNH7", "lei": "5493001KJTIIGC8Y1R13", "iban": "GB82WEST12345698765433", "bic": "DEUTDE", "mic": "xnas", "aba_routing": "021000022",
    "upi": "AZABCDEFGHJK", "gtin": "4006381333932", "npi": "1234567890", "card_number": "4242424242424241", "email": "a@b", "uuid": "123e4567", "ulid": "81ARZ3NDEKTSV4RRFFQ69G5FAV", "iso_date": "2023-02-29",
    "hex_colour": "#12", "ipv4": "256.0.0.1", "uti": "x",
}


@pytest.mark.parametrize("name", sorted(V.VALIDATORS))
def test_validators(spark, name):
    f = V.VALIDATORS[name]
    assert one(spark, good=f(F.lit(GOOD[name])), bad=f(F.lit(BAD[name])), none=f(F.lit(None).cast("string"))) == {"good": True, "bad": False, "none": None}


def test_code_list_versions():
    from datetime import date

    assert "HRK" in V.code_list("iso4217", date(2022, 1, 1)) and "HRK" not in V.code_list("iso4217")
    assert "ZWL" in V.code_list("iso4217", date(2024, 6, 1)) and "ZWL" not in V.code_list("iso4217", date(2025, 4, 1))
    assert {"GB", "ZW", "NA"} <= set(V.code_list("iso3166")) and len(V.code_list("iso3166")) >= 249 and "XX" not in V.code_list("iso3166")
    with pytest.raises(ValueError):
        V.code_list("iso4217", date(2020, 1, 1))


def test_account_numbers_of_countries_and_signs(spark):
    good = F.array(*[V.iban(F.lit(x)) for x in ("MR1300020001010000123456753", "XK051212012345678906", "BR1800360305000010009795493C1")])
    # The last two have right check digits, but one is of no issuing country and one is too short.
    bad = F.array(*[V.iban(F.lit(x)) for x in ("US64SVBKUS6S3300958879", "DE8937040044053201300")])
    got = one(spark, good=good, bad=bad, cusip=V.cusip(F.lit("837649128")), signs=V.cusip(F.lit("12*4@6#81")), wrong=V.cusip(F.lit("12*4@6#82")))
    assert got["good"] == [True] * 3 and got["bad"] == [False] * 2 and got["cusip"]
    digits = [1, 2, 36, 4, 37, 6, 38, 8]
    total = sum(sum(divmod(v * (1 + i % 2), 10)) for i, v in enumerate(digits))
    assert got["signs"] == ((10 - total % 10) % 10 == 1) and got["wrong"] == ((10 - total % 10) % 10 == 2)


def test_words_of_names_in_camel_case():
    from veritide.operators import relations

    assert relations.name_strength("customerId", "CustomerKey") == 0.35 and relations.name_strength("orderId", "CustomerKey") == 0.0


def test_import_of_rules(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    done, left = declare.imported([
        {"type": "not_null", "kwargs": {"column": "k"}}, {"type": "expect_column_values_to_be_between", "kwargs": {"column": "v", "min_value": 0, "mostly": 0.6}}, {"type": "unheard_of"},
    ])
    assert left == ["unheard_of"]
    assert sorted(v[2] for v in verdicts(df, done).values()) == ["fail", "pass"]


def test_gaps_and_gate(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    d = declare.Declaration("t", (), (declare.Attribute("k", True, criticality=5), declare.Attribute("v", low=0)))
    planned = declare.controls(d)
    assert declare.gaps(d, df.schema, planned)[0] == ("k", "validity", 5)
    assert declare.schema_gate(df.schema, spark.createDataFrame([], "k long, z int").schema) == ["k is int, not bigint", "z is missing"]


def test_adaptive_level_in_chunks_is_the_fold(spark):
    from veritide.operators import monitor

    import random

    rng = random.Random(3)
    rows = [(s, t, int(rng.random() < r)) for s, r in (("a", 0.05), ("b", 0.9), ("c", 0.0)) for t in range(700)]
    want = {}
    for s, _, a in rows:
        want[s] = min(1.0, max(0.0, want.get(s, 0.05) + 0.01 * (0.05 - a)))
    df = spark.createDataFrame(rows, "series string, t int, alert int")
    for chunk in (7, 4096):
        got = {r.series: r.level for r in monitor.adaptive_level(df, chunk=chunk).collect()}
        assert all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_keys_and_dependencies_of_many_columns(spark):
    from veritide.operators import mining

    df = spark.range(3000).selectExpr("id as a", "id % 50 as b", "(id % 50) div 5 as c", "id div 50 as d")
    assert {r.key for r in mining.keys(df, most=2).collect()} == {"a", "b,d"}
    got = {(r.determinant, r.dependent): r.support for r in mining.dependencies(df, most=1).collect()}
    want = {(r.determinant, r.dependent): r.support for d, e in (("b", "c"), ("c", "b"), ("d", "c")) for r in mining.dependency_support(df, [d], e).collect()}
    assert got[("b", "c")] == want[("b", "c")] == 1.0 and ("c", "b") not in got and ("d", "c") not in got
