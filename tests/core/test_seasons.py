from collections import Counter
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from veritide.operators import monitor

CLOSED = (date(2024, 3, 29), date(2024, 12, 25))


def period(day):
    works = lambda d: d.weekday() < 5 and d not in CLOSED
    if not works(day):
        return works(day), "none"
    after = day + timedelta(days=1)
    while not works(after):
        after += timedelta(days=1)
    if after.year != day.year:
        return True, "year"
    if (after.month - 1) // 3 != (day.month - 1) // 3:
        return True, "quarter"
    return True, "month" if after.month != day.month else "none"


def plain(rows, least, drivers):
    def keys(t):
        works, p = period(t.date())
        own = tuple(d(t) for d in drivers)
        yield "weekday", (works, p, t.weekday(), *own)
        yield "period", (works, p, *own)
        yield "any period", (works, p != "none", *own)
        yield "working day", (works, *own)
        if drivers:
            yield "declared", own
        yield "all", ()

    sizes = Counter((s, n, k) for s, t in rows for n, k in keys(t))
    out = Counter()
    for s, t in rows:
        name, members = next((n, sizes[s, n, k]) for n, k in keys(t) if n == "all" or sizes[s, n, k] >= least)
        out[s, t, name, members] += 1
    return out


def test_lattice_against_relaxing_each_point(spark):
    start = datetime(2023, 1, 1, 12)
    rows = [("a", start + timedelta(days=i)) for i in range(720)] + [("b", start + timedelta(days=i)) for i in range(25)] + [(None, start)] * 3
    df = spark.createDataFrame(rows, "series string, t timestamp")
    payday = lambda t: t.day == 15
    for drivers, columns in (([], {}), ([payday], {"payday": F.dayofmonth("t") == 15})):
        got = Counter((r.series, r.t, r.level, r.members) for r in monitor.season_lattice(df, 20, CLOSED, drivers=columns).collect())
        assert got == plain(rows, 20, drivers)


def test_year_ends_are_compared_with_period_ends(spark):
    rows = [("a", datetime(2022, 1, 1) + timedelta(days=i)) for i in range(730)]
    out = monitor.season_lattice(spark.createDataFrame(rows, "series string, t timestamp"))
    by_day = {r.t.date(): (r.level, r.members) for r in out.collect()}
    assert by_day[date(2022, 12, 30)] == ("any period", 24) and by_day[date(2022, 4, 29)][0] in ("any period", "period")
    assert by_day[date(2022, 12, 28)][0] == "weekday"
    assert monitor.season_lattice(spark.createDataFrame([], "series string, t timestamp")).count() == 0
    lost = monitor.season_lattice(spark.createDataFrame([("a", None)] * 25 + rows[:5], "series string, t timestamp"))
    assert lost.count() == 30


def test_seasonal_groups_and_levels_of_a_hot_series(spark):
    rows = [("hot", datetime(2023, 1, 2) + timedelta(days=i), i) for i in range(200)] + [("cold", datetime(2023, 1, 2) + timedelta(days=i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "series string, t timestamp, i int")
    seasons = {(r.series, r.season) for r in monitor.seasonal_groups(df, 20).collect()}
    assert seasons == {("hot", str(d)) for d in range(7)} | {("cold", "all")}
    alerts = df.selectExpr("series", "i AS t", "i % 9 = 0 AS alert")
    whole, cut = ({r.series: round(r.level, 9) for r in monitor.adaptive_level(alerts, chunk=c).collect()} for c in (4096, 7))
    assert whole == cut and set(whole) == {"hot", "cold"}
