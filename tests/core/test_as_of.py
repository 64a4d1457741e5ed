import random

import pytest

from veritide.operators import reconcile
from veritide.operators.as_of import as_of


def plain(left, right, seconds=None):
    out = []
    for i, k, t in left:
        best = max(((rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t), default=None)
        if best and seconds is not None and t - best[0] > seconds:
            best = None
        out.append((i, best[1] if best else None, best[0] if best else None))
    return out


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_as_of_against_looking_back(spark, parts):
    rng = random.Random(3)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", "only left", None])
    left = [(i, key(), rng.choice([None, *range(0, 400)])) for i in range(300)] + [(0, "a", 5), (0, "a", 5)]
    right = [(rng.choice(["a", "a", "b", "only right", None]), rng.choice([None, *range(0, 400, 3)]), rng.randrange(99)) for _ in range(60)] + [("c", -10**6, 7)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        a, b = spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int")
        got = sorted(((r.i, r.v, r.at) for r in as_of(a, b, ["k"], "t", ["v"], "at").collect()), key=str)
        assert got == sorted(plain(left, right), key=str)
        assert len(got) == len(left)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rates_as_of_prefers_quotes_and_bounds_age(spark):
    at = "TIMESTAMP '2024-01-0{} 00:00:00'"
    amounts = spark.sql(f"SELECT * FROM VALUES (1, 'eur', {at.format(5)}), (2, 'USD', {at.format(1)}), (3, 'JPY', {at.format(9)}), (4, null, {at.format(9)}), (5, 'EUR', {at.format(1)}) v(id, ccy, at)")
    rates = spark.sql(f"SELECT * FROM VALUES ('EUR', 'USD', {at.format(2)}, 1.1D), ('USD', 'EUR', {at.format(4)}, 0.5D), ('USD', 'JPY', {at.format(2)}, 100D), ('USD', 'EUR', {at.format(1)}, 0D) v(source, target, at, rate)")
    got = {r.id: (r.rate, r.rate_at and r.rate_at.day) for r in reconcile.rates_as_of(amounts, rates, "ccy", "at", "USD").collect()}
    assert got == {1: (1.1, 2), 2: (1.0, 1), 3: (0.01, 2), 4: (None, None), 5: (None, None)}
    near = {r.id: r.rate for r in reconcile.rates_as_of(amounts, rates, "ccy", "at", "USD", seconds=86400).collect()}
    assert near == {1: 2.0, 2: 1.0, 3: None, 4: None, 5: None}
    assert reconcile.rates_as_of(amounts.limit(0), rates, "ccy", "at", "USD").count() == 0
