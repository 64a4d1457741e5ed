"""Long series and large groups of p-values, cut up, give what whole ones give."""

import pytest
from pyspark.sql import functions as F

from veritide.operators import monitor


@pytest.fixture
def small(monkeypatch):
    """Stretches of a few rows."""

    def shrink(size):
        stretches, ranks = monitor.stretches, monitor._ranks
        monkeypatch.setattr(monitor, "stretches", lambda df, back, series, t, _: stretches(df, back, series, t, size))
        monkeypatch.setattr(monitor, "_ranks", lambda df, by: ranks(df, by, size))

    return shrink


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def series(spark):
    """One series with two thirds of the rows, nulls and ties among its values."""
    i = F.col("id")
    return spark.range(300).select(
        F.when(i % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (i % 4).cast("string"))).alias("series"), i.alias("t"),
        F.when(i % 17 > 0, ((i * 37) % 23).cast("double")).alias("value"),
    )


@pytest.mark.parametrize("size", [1, 64])
def test_histories(spark, small, size):
    def all_of():
        df = series(spark)
        scored = df.withColumn("score", F.col("value"))
        return [rows(monitor.with_history(df, 12)), rows(monitor.conformal_p(scored, 12, 5)), rows(monitor.conformal_p(scored, 12, 5, half_life=4.0)), rows(monitor.shape_distance(df.na.fill(0.0), 3, 9))]

    whole = all_of()
    small(size)
    assert all_of() == whole


@pytest.mark.parametrize("dependent", [False, True])
def test_selection(spark, small, dependent):
    i = F.col("id")
    df = spark.range(400).select(F.when(i % 3 > 0, "hot").when(i % 2 == 0, "rest").alias("family"), i.alias("member"), F.when(i % 19 > 0, F.when(i % 11 == 0, i / 1e5).otherwise((i * 7919 % 97) / 97)).alias("p"))

    def all_of():
        one = rows(monitor.select_alerts(df, 0.1, dependent=dependent).select("member", "selected"))
        by = rows(monitor.select_alerts(df, 0.1, ["family"], dependent).select("member", "selected"))
        families = rows(monitor.simes(df, ["family"]).na.fill("none"))
        nested = rows(monitor.hierarchical(df, "family", 0.1).select("member", "selected"))
        return one, by, families, nested

    whole = all_of()
    assert len(whole[0]) == len(whole[1]) == 400 and len(whole[2]) == 3
    assert sum(r[1] for r in whole[0]) > 0
    # The rule itself, over all p-values.
    ps = sorted(r["p"] for r in df.where("p is not null").collect())
    m = len(ps)
    level = 0.1 / sum(1 / k for k in range(1, m + 1)) if dependent else 0.1
    cut = max((p for k, p in enumerate(ps, 1) if p <= level * k / m), default=-1)
    assert {r["member"] for r in df.collect() if r["p"] is not None and r["p"] <= cut} == {r[0] for r in whole[0] if r[1]}
    small(10)
    assert all_of() == whole


def test_harmonic(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (1000,), (1001,), (50000,)], "m long").select(monitor._harmonic(F.col("m"))).collect()]
    assert got == pytest.approx([sum(1 / k for k in range(1, m + 1)) for m in (1, 1000, 1001, 50000)], abs=1e-11)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_totals_within_groups(spark, parts):
    """A group over many partitions, a null one, nulls among its values and nothing at all."""
    from veritide.operators.prefix import running_totals

    i = F.col("id")
    df = spark.range(200).select(F.when(i % 5 > 1, "hot").when(i % 5 == 1, "rest").alias("g"), i.alias("t"), F.when(i % 7 > 0, i).alias("v"))
    want, sums = [], {}
    for r in sorted(df.collect(), key=lambda r: -r["t"]):
        sums[r["g"]] = sums.get(r["g"], 0) + (r["v"] or 0)
        want.append((r["g"] or "", r["t"], sums[r["g"]]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = running_totals(df, [F.desc("t")], ["v"], within=["g"]).select(F.coalesce("g", F.lit("")), "t", "total_v")
        assert rows(got) == sorted(want)
        assert running_totals(df.where("t < 0"), ["t"], ["v"], within=["g"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_changepoint_and_admission_match_a_plain_pass(spark):
    i = F.col("id")
    df = spark.range(240).select(F.when(i % 4 > 0, "hot").otherwise("rest").alias("series"), i.alias("t"), F.when(i % 13 > 0, i % 5 + F.when(i > 150, 9).otherwise(0)).alias("value"))
    got = {r["series"]: r for r in monitor.changepoint(df).collect()}
    for name in ("hot", "rest"):
        v = [(r["t"], float(r["value"])) for r in df.where(F.col("series") == name).orderBy("t").collect() if r["value"] is not None]
        x = [a for _, a in v]
        n, mean = len(x), sum(x) / len(x)
        spread = (sum((a - mean) ** 2 for a in x) / n) ** 0.5
        best = max((abs(sum(x[:k]) / k - sum(x[k:]) / (n - k)) / spread, -k) for k in range(20, n - 19))
        assert (got[name]["t"], got[name]["strength"]) == (v[-best[1] - 1][0], pytest.approx(best[0]))
    work = spark.createDataFrame([("a", k, k % 3, 1.0) for k in range(30)] + [("b", 1, 1, 9.0)], "team string, item int, priority int, cost double")
    from veritide.operators.score import admit

    taken = {(r["team"], r["item"]) for r in admit(work, 12.0, "team").where("admitted").collect()}
    first = sorted(range(30), key=lambda k: (-(k % 3), k))[:12]
    assert taken == {("a", k) for k in first} | {("b", 1)}


def test_sketches_keep_their_bounds(spark):
    """Distinct counts within three deviations, quantiles within their rank error, Count-Min never below."""
    from veritide.operators import profile

    n = 20_000
    df = spark.range(n).select((F.col("id") * 7919 % 5003).alias("c"), (F.col("id") % 4).alias("part"))
    merged = profile.merge_sketches(profile.sketches(df, ["c"], ["part"]), ["c"]).first()
    assert merged["rows"] == n and abs(merged["distinct"] - 5003) <= 3 * 1.04 / 2**7 * 5003
    for share, v in profile.approximate_quantiles(df, "c", (0.1, 0.5, 0.9), 1000).collect():
        assert abs(df.where(F.col("c") <= v).count() / n - share) <= 0.002
    exact = df.groupBy("c").count()
    sketch = profile.count_min(df, "c", 1 << 12, 5)
    found = profile.count_min_estimate(sketch, exact.select("c"), "c", 1 << 12, 5)
    gaps = [r[0] for r in found.join(exact, F.col("value").cast("long") == F.col("c")).select(F.col("estimate") - F.col("count")).collect()]
    assert len(gaps) == 5003 and min(gaps) >= 0 and sum(g > 2.72 * n / (1 << 12) for g in gaps) <= 0.01 * 5003
