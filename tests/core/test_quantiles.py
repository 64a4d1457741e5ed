import math
import random

import pytest

from veritide.operators import profile

AT = (0.5, 0.99, 0.999)


@pytest.fixture(scope="module")
def lognormal(spark):
    rng = random.Random(8)
    rows = [(i % 7, rng.lognormvariate(0, 2)) for i in range(200_000)]
    return spark.createDataFrame(rows, "part int, v double").cache(), sorted(v for _, v in rows)


def exact(values, q):
    return values[max(1, math.ceil(q * len(values))) - 1]


def test_tails_of_merged_magnitudes(lognormal):
    df, values = lognormal
    parts = profile.magnitudes(df, "v", ["part"])
    got = {r.quantile: r.value for r in profile.magnitude_quantiles(parts, AT).collect()}
    # Published for the reference: 0.2, 0.3 and 0.1 %.
    for q, bound in zip(AT, (0.002, 0.003, 0.001), strict=True):
        assert abs(got[q] / exact(values, q) - 1) <= bound
    # Merging in another grouping loses nothing.
    again = profile.magnitudes(df.selectExpr("v", "part % 2 AS part"), "v", ["part"])
    assert {r.quantile: r.value for r in profile.magnitude_quantiles(again, AT).collect()} == got


def test_ranks_of_merged_sketches(lognormal):
    df, values = lognormal
    folded = profile.merged_ranks(profile.sketches(df, ["v"], ["part"]), "v", AT)
    for r in folded.collect():
        assert r.n == len(values)
        rank = sum(v <= r.value for v in values) / len(values)
        assert abs(rank - r.quantile) <= 0.002


def test_signs_zeros_and_ends(spark):
    values = [-4.0, -1.0, 0.0, -0.0, 1e-300, 3.0, float("inf"), float("-inf"), None, float("nan")]
    parts = profile.magnitudes(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    at = [i / 8 for i in range(9)]
    got = [r.value for r in sorted(profile.magnitude_quantiles(parts, at).collect(), key=lambda r: r.quantile)]
    true = sorted(v for v in values if v is not None and v == v)
    for q, value in zip(at, got, strict=True):
        want = exact(true, q)
        assert value == want or abs(value - want) <= 0.001001 * abs(want)
    assert profile.magnitude_quantiles(parts.limit(0), at).count() == 0
    empty = profile.sketches(spark.createDataFrame([("a", None)], "s string, v double"), ["v"], ["s"])
    assert profile.merged_ranks(empty, "v", AT).count() == 0


def test_exact_ranks_need_no_group_in_one_task(spark):
    rows = [("a", float(i % 50 - 25)) for i in range(501)] + [("a", None)] * 5 + [(None, float(i)) for i in range(7)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", None, "none")}
    at = (0.0, 0.05, 0.5, 0.99, 1.0)
    out = profile.ranked_quantiles(df, "v", at, ["g"])
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r.g, r.quantile): r.value for r in out.collect()} == {(g, q): exact(v, q) if v else None for g, v in by.items() for q in at}
    whole = profile.exact_quantiles(df, "v", at, ["g"])
    assert "percentile" not in whole._jdf.queryExecution().optimizedPlan().toString().lower()

    def between(v, q):
        p = q * (len(v) - 1)
        return v[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * v[math.floor(p)] + (p - math.floor(p)) * v[math.ceil(p)]

    assert {(r.g, r.quantile): r.value for r in whole.collect()} == {(g, q): between(v, q) if v else None for g, v in by.items() for q in at}
    assert [tuple(r) for r in profile.exact_quantiles(df.where("false"), "v", (0.5,)).collect()] == [(0.5, None)]
