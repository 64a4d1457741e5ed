"""Series of metrics: detectors, drift between samples, calibrated p-values and selection of alerts.

Series are rows (series, t, value).  History comes from windows over each
series, so that any number of series is judged at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut
from .prefix import running_totals


#: Rows of a stretch that one task judges, however long its series is.
STRETCH = 65_536


def _largest(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group, counted before the shuffle."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def stretches(df: DataFrame, back: int, series: str = "series", t: str = "t", size: int = STRETCH) -> DataFrame:
    """Rows dealt to stretches of about ``size`` rows of one series, so that a hot series isn't one task.

    Adds ``__stretch``, ``__i`` (the row's place in the order of its series or of
    all series) and ``__own``: the up to ``back`` rows before a stretch are
    repeated in front of it with ``__own`` false.  Where no series is longer than
    ``size``, each is one stretch and rows aren't put in a global order first.
    """
    size = max(size, back)
    if _largest(df, [series]) <= size:
        return df.withColumns({"__i": F.col(t), "__stretch": F.lit(0).cast("long"), "__own": F.lit(True)})
    placed = running_totals(df.withColumn("__one", F.lit(1)), [series, t], ["__one"]).withColumn("__i", F.col("total___one").cast("long")).drop("__one", "total___one")
    at = F.floor((F.col("__i") - 1) / size)
    ends = (F.col("__i") - 1) % size >= size - back
    to = F.array_compact(F.array(F.struct(at.alias("s"), F.lit(True).alias("own")), F.when(ends, F.struct((at + 1).alias("s"), F.lit(False).alias("own")))))
    out = placed.withColumn("__to", F.explode(to))
    return out.withColumn("__stretch", F.col("__to.s")).withColumn("__own", F.col("__to.own")).drop("__to")


def _gathered(df: DataFrame, name: str, value: Column, first: int, last: int, series: str = "series", t: str = "t", size: int = STRETCH) -> DataFrame:
    """Adds ``name``: the values of the rows from ``first`` to ``last`` places off, oldest first."""
    w = Window.partitionBy(series, "__stretch").orderBy("__i").rowsBetween(first, last)
    dealt = stretches(df, -first, series, t, size).withColumn(name, F.collect_list(value).over(w))
    return dealt.where("__own").drop("__stretch", "__i", "__own")


def _median(a: Column) -> Column:
    """Median of an array of doubles."""
    s, n = F.array_sort(a), F.size(a)
    low = F.element_at(s, (F.floor((n - 1) / 2) + 1).cast("int"))
    high = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def with_history(df: DataFrame, n: int = 60, series: str = "series", t: str = "t", value: str = "value") -> DataFrame:
    """Adds ``history``: up to n values before each row, oldest first."""
    return _gathered(df, "history", F.col(value).cast("double"), -n, -1, series, t)


def robust_deviation(df: DataFrame, n: int = 60, least: int = 10, value: str = "value") -> DataFrame:
    """Adds ``score``: distance from the history's median in scaled median deviations; null before ``least`` values."""
    h = with_history(df, n, value=value)
    h = h.withColumn("m", _median(F.col("history")))
    h = h.withColumn("d", _median(F.transform("history", lambda x: F.abs(x - F.col("m")))) * 1.4826)
    gap = F.abs(F.col(value) - F.col("m"))
    score = F.when(F.col("d") > 0, gap / F.col("d")).when(gap == 0, 0.0).otherwise(float("inf"))
    return h.withColumn("score", F.when(F.size("history") >= least, score)).drop("history", "m", "d")


def quantile_distance(df: DataFrame, n: int = 60, least: int = 10, value: str = "value") -> DataFrame:
    """Adds ``score``: 2 * |rank - 1/2| of the value among its history, ties counted half."""
    h = with_history(df, n, value=value)
    below = F.size(F.filter("history", lambda x: x < F.col(value)))
    equal = F.size(F.filter("history", lambda x: x == F.col(value)))
    rank = (below + equal / 2) / F.size("history")
    return h.withColumn("score", F.when(F.size("history") >= least, 2 * F.abs(rank - 0.5))).drop("history")


def forecast_residual(df: DataFrame, n: int = 60, span: int = 7, least: int = 10, value: str = "value") -> DataFrame:
    """Adds ``forecast`` (an exponential mean of the history) and ``score``: the residual against the history's median step."""
    alpha = 2 / (span + 1)
    h = with_history(df, n, value=value)
    mean = F.aggregate(
        F.slice("history", 2, n), F.get("history", F.lit(0)), lambda acc, x: acc * (1 - alpha) + x * alpha
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.size("history") - 1), lambda i: F.abs(F.get("history", i) - F.get("history", i - 1))
    )
    h = h.withColumn("forecast", F.when(F.size("history") >= least, mean))
    h = h.withColumn("step", F.when(F.size("history") >= least, _median(steps)))
    gap = F.abs(F.col(value) - F.col("forecast"))
    return h.withColumn("score", F.when(F.col("step") > 0, gap / F.col("step")).when(gap == 0, 0.0).when(gap > 0, float("inf"))).drop("history", "step")


def local_outlier(df: DataFrame, n: int = 60, k: int = 5, least: int = 10, value: str = "value") -> DataFrame:
    """Adds ``score``: mean distance to the k nearest of the history, over the typical one within the history."""
    h = with_history(df, n, value=value)

    def nearest(x: Column, own: bool) -> Column:
        gaps = F.array_sort(F.transform("history", lambda y: F.abs(y - x)))
        return F.aggregate(F.slice(gaps, 2 if own else 1, k), F.lit(0.0), lambda a, g: a + g) / k

    typical = _median(F.transform("history", lambda x: nearest(x, True)))
    mine = nearest(F.col(value), False)
    score = F.when(typical > 0, mine / typical).when(mine == 0, 1.0).otherwise(float("inf"))
    return h.withColumn("score", F.when(F.size("history") >= least, score)).drop("history")


def shape_distance(df: DataFrame, width: int = 7, n: int = 56, value: str = "value") -> DataFrame:
    """Adds ``score``: distance of the last ``width`` values, standardised, to the nearest earlier stretch of that length."""
    h = _gathered(df, "all", F.col(value).cast("double"), -(width + n - 1), 0)

    def standard(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a)
        return F.transform(a, lambda x: F.when(var > 0, (x - mean) / F.sqrt(var)).otherwise(0.0))

    last = standard(F.slice("all", -width, width))
    starts = F.sequence(F.lit(1), F.size("all") - 2 * width + 1)

    def distance(i: Column) -> Column:
        pair = F.zip_with(standard(F.slice("all", i, width)), last, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(pair, F.lit(0.0), lambda s, x: s + x))

    return h.withColumn("score", F.when(F.size("all") >= 2 * width + 3, F.array_min(F.transform(starts, distance)))).drop("all")


def changepoint(df: DataFrame, least: int = 20, value: str = "value") -> DataFrame:
    """(series, t, strength): the break that best splits each series: largest difference of means over the spread.

    Points without a value take no part.  Means on both sides come from running
    totals, so a long series is many tasks.
    """
    points = df.select("series", "t", F.col(value).cast("double").alias("v"), F.lit(1).alias("one")).where("v is not null")
    whole = points.groupBy(F.col("series").alias("__s")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.stddev_pop("v").alias("spread"))
    run = running_totals(points, ["t"], ["one", "v"], within=["series"])
    s = run.join(whole, F.col("series").eqNullSafe(F.col("__s"))).withColumnsRenamed({"total_one": "i", "total_v": "head"})
    gap = F.abs(F.col("head") / F.col("i") - (F.col("total") - F.col("head")) / F.nullif(F.col("n") - F.col("i"), F.lit(0)))
    strength = F.try_divide(gap, F.col("spread"))
    ok = s.where((F.col("i") >= least) & (F.col("n") - F.col("i") >= least)).withColumn("strength", strength).where("strength is not null")
    return ok.groupBy("series").agg(F.max_by("t", F.struct("strength", -F.col("i"))).alias("t"), F.max("strength").alias("strength"))


def since_accepted(df: DataFrame, accepted: DataFrame) -> DataFrame:
    """The points of each series from its last accepted break on; what came before says nothing about the new regime.

    accepted: series, at (the t from which the new regime holds).
    """
    last = accepted.groupBy(F.col("series").alias("__s")).agg(F.max("at").alias("__at"))
    return df.join(last, F.col("series") == F.col("__s"), "left").where(F.col("__at").isNull() | (F.col("t") >= F.col("__at"))).drop("__s", "__at")


# Drift between a reference and a current sample of one number.


def bin_shares(reference: DataFrame, current: DataFrame, value: str = "value", bins: int = 10, least: float = 1e-6) -> DataFrame:
    """(bin, p, q): shares of both samples in the reference's quantile bins, floored at ``least``."""
    edges = reference.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("edges"))
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("r")).union(current.select(F.col(value).alias("v"), F.lit(0).alias("r")))
    placed = both.where("v is not null").join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    counts = placed.groupBy("bin").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    floor = F.lit(least)
    return counts.join(F.broadcast(total)).select(
        "bin", F.greatest(F.try_divide(F.col("a").cast("double"), F.col("ta")), floor).alias("p"), F.greatest(F.try_divide(F.col("b").cast("double"), F.col("tb")), floor).alias("q"), "a", "b", "ta", "tb"
    )


def population_stability(shares: DataFrame) -> DataFrame:
    return shares.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def jensen_shannon(shares: DataFrame) -> DataFrame:
    m = (F.col("p") + F.col("q")) / 2
    return shares.agg((F.sum(F.col("p") * F.log2(F.col("p") / m) + F.col("q") * F.log2(F.col("q") / m)) / 2).alias("js"))


def chi_square(shares: DataFrame) -> DataFrame:
    """Statistic of the current counts against those that the reference's shares lead one to expect."""
    expected = F.greatest(F.col("a") / F.col("ta"), F.lit(1e-6)) * F.col("tb")
    return shares.agg(F.sum((F.col("b") - expected) * (F.col("b") - expected) / expected).alias("chi2"), (F.count(F.lit(1)) - 1).alias("degrees"))


def _distribution(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Distinct values with both cumulative counts, summed range by range."""
    both = reference.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("r")).union(current.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("r")))
    counts = both.where("v is not null").groupBy("v").agg(F.sum("r").alias("a"), F.sum(1 - F.col("r")).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    run = running_totals(counts, ["v"], ["a", "b"], following="v")
    return run.select("v", F.col("total_a").alias("ca"), F.col("total_b").alias("cb"), (F.col("next") - F.col("v")).alias("gap")).join(F.broadcast(total))


def kolmogorov_smirnov(reference: DataFrame, current: DataFrame, value: str = "value", critical: float = 1.36) -> DataFrame:
    d = _distribution(reference, current, value)
    out = d.agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"), F.first("ta").alias("na"), F.first("tb").alias("nb"))
    bound = critical * F.sqrt((F.col("na") + F.col("nb")) / (F.col("na") * F.col("nb")))
    return out.select("ks", (F.col("ks") > bound).alias("drifted"))


def wasserstein(reference: DataFrame, current: DataFrame, value: str = "value") -> DataFrame:
    d = _distribution(reference, current, value)
    return d.agg(F.sum(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb")) * F.col("gap")).alias("w1"))


# Calibration and selection.


def conformal_p(df: DataFrame, n: int = 200, least: int = 20, half_life: float | None = None, score: str = "score") -> DataFrame:
    """Adds ``p``: the weighted share of earlier scores at least as large; null, so no alert, before ``least`` scores."""
    h = _gathered(df, "past", F.col(score), -n, -1)
    if half_life:
        pairs = F.transform("past", lambda s, i: F.struct(F.pow(F.lit(0.5), (F.size("past") - i) / half_life).alias("w"), (s >= F.col(score)).alias("up")))
        above = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.when(x["up"], x["w"]).otherwise(0.0))
        total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["w"])
    else:
        above, total = F.size(F.filter("past", lambda s: s >= F.col(score))), F.size("past")
    return h.withColumn("p", F.when((F.size("past") >= least) & F.col(score).isNotNull(), (above + 1) / (total + 1))).drop("past")


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; beyond 1,000 by its expansion, whose error is then below 1e-14."""
    x = m.cast("double")
    short = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    return F.when(m <= 1000, short).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x))


def _ranks(df: DataFrame, by: Sequence[str], size: int = STRETCH) -> DataFrame:
    """(by, p, k, m): each different p-value of a group with the last of its ranks and the size of the group.

    Equal p-values are counted together first.  Where a group holds more than
    ``size`` values, ranks are summed range by range, so that it isn't one task.
    """
    keys = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    names = [f"__g{i}" for i in range(len(by))]
    counts = df.where("p is not null").groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"))
    if _largest(df, by) <= size:
        w = Window.partitionBy(*names)
        upto = w.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(*names, "p", F.sum("n").over(upto).alias("k"), F.sum("n").over(w).alias("m"))
    total = running_totals(counts, ["p"], ["n"], within=names)
    extent = total.groupBy(*names).agg(F.sum("n").alias("m"))
    extent = extent.select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(names)], "m")
    ranked = total.join(extent, _same(len(by), "__g", "__e")) if by else total.join(F.broadcast(extent))
    return ranked.select(*names, "p", F.col("total_n").cast("long").alias("k"), "m")


def _same(n: int, a: str, b: str) -> Column:
    on = F.lit(True)
    for i in range(n):
        on = on & F.col(f"{a}{i}").eqNullSafe(F.col(f"{b}{i}"))
    return on


def _step_up(df: DataFrame, by: Sequence[str], level: Column) -> DataFrame:
    """Adds ``selected``: p at or below the largest p with p <= level * k / m in its group, where there is one."""
    cuts = _ranks(df, by).where(F.col("p") <= level * F.col("k") / F.col("m"))
    names = [f"__g{i}" for i in range(len(by))]
    cuts = cuts.groupBy(*names).agg(F.max("p").alias("__cut"))
    keyed = df.withColumns({f"__k{i}": F.col(c) for i, c in enumerate(by)}) if by else df
    joined = keyed.join(cuts, _same(len(by), "__k", "__g"), "left") if by else keyed.join(F.broadcast(cuts))
    return joined.withColumn("selected", F.coalesce(F.col("p") <= F.col("__cut"), F.lit(False))).drop("__cut", *names, *[f"__k{i}" for i in range(len(by))])


def select_alerts(df: DataFrame, alpha: float = 0.05, by: Sequence[str] = (), dependent: bool = False) -> DataFrame:
    """Adds ``selected`` by the step-up rule on p-values within each group; with ``dependent``, its stricter form."""
    level = F.lit(alpha)
    return _step_up(df, by, level / _harmonic(F.col("m")) if dependent else level)


def simes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Family p-value: the smallest p_k * m / k."""
    names = [F.col(f"__g{i}").alias(c) for i, c in enumerate(by)]
    return _ranks(df, by).groupBy(*names).agg(F.least(F.min(F.col("p") * F.col("m") / F.col("k")), F.lit(1.0)).alias("p"), F.max("m").alias("members"))


def hierarchical(df: DataFrame, family: str, alpha: float = 0.05) -> DataFrame:
    """Families first, by their Simes p-values; members then, within selected families, at a level shrunk by the families' share."""
    families = cut(select_alerts(simes(df, [family]), alpha))
    share = families.agg((F.count_if("selected") / F.count(F.lit(1))).alias("share")).first()["share"] or 0.0
    members = df.where("p is not null").join(families.where("selected").select(family), family)
    return _step_up(members, [family], F.lit(alpha * share))


def adaptive_level(alerts: DataFrame, target: float = 0.05, step: float = 0.01, chunk: int = 4096) -> DataFrame:
    """(series, level): the alert level after following each series' past alerts (0 or 1) towards a target rate.

    Each alert shifts the level and holds it between 0 and 1.  Such steps compose
    to one shift between two bounds, so every ``chunk`` of a series becomes one
    step and a long series a short list.
    """
    counted = running_totals(alerts.select("series", "t", F.col("alert").cast("double").alias("alert"), F.lit(1).alias("one")), ["t"], ["one"], within=["series"])
    rows = counted.select("series", F.floor((F.col("total_one") - 1) / chunk).alias("part"), "t", "alert")
    each = rows.groupBy("series", "part").agg(F.array_sort(F.collect_list(F.struct("t", "alert"))).alias("a"))
    held = lambda x, low, high: F.greatest(low, F.least(high, x))
    zero, one = F.lit(0.0), F.lit(1.0)

    def follow(acc: Column, x: Column) -> Column:
        move = step * (target - x["alert"])
        return F.struct((acc["shift"] + move).alias("shift"), held(acc["low"] + move, zero, one).alias("low"), held(acc["high"] + move, zero, one).alias("high"))

    whole = F.aggregate("a", F.struct(zero.alias("shift"), zero.alias("low"), one.alias("high")), follow)
    steps = each.select("series", "part", whole.alias("s")).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("part", "s"))).alias("s"))
    level = F.aggregate("s", F.lit(float(target)), lambda acc, x: held(acc + x["s"]["shift"], x["s"]["low"], x["s"]["high"]))
    return steps.select("series", level.alias("level"))


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a rate."""
    n, p = trials.cast("double"), F.try_divide(successes.cast("double"), trials)
    middle, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / scale, (middle + half) / scale


def calibration(df: DataFrame, levels: Sequence[float] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(level, n, rate, low, high, valid): how often p-values fall below each level; valid if the level lies in the interval."""
    at = df.where("p is not null").select("p", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    out = at.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") <= F.col("level")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select("level", "n", (F.col("hits") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high")).withColumn("valid", F.col("level").between(F.col("low"), F.col("high")))


def seasonal_groups(df: DataFrame, least: int = 20) -> DataFrame:
    """Adds ``season``: weekday if every one of a series' weekdays has ``least`` points, else working day or weekend, else all.

    Counts by series and weekday are joined back, so no task holds a series.
    """
    day = F.weekday(F.to_date("t"))
    kind = F.when(F.col("__d") < 5, "workday").otherwise("weekend")
    by_day = df.groupBy("series", day.alias("__d")).agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_day.groupBy("series", kind.alias("__k")).agg(F.sum("n").alias("n"))
    of_days = by_day.groupBy(F.col("series").alias("__s")).agg(F.min("n").alias("days"))
    of_kinds = by_kind.groupBy(F.col("series").alias("__t")).agg(F.min("n").alias("kinds"))
    size = of_days.join(of_kinds, F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    marked = df.withColumn("__d", day).join(size, F.col("series").eqNullSafe(F.col("__s")))
    season = F.when(F.col("days") >= least, F.col("__d").cast("string")).when(F.col("kinds") >= least, kind).otherwise("all")
    return marked.withColumn("season", season).drop("__d", "__s", "days", "kinds")


#: Facets by which points are comparable, and what gives way first: the hour, then the weekday, then the kind of period end (any kind, then none), then the working day.
_LEVELS = {
    "hour": ("working", "period", "weekday", "hour"), "weekday": ("working", "period", "weekday"), "period": ("working", "period"), "any period": ("working", "any_period"),
    "working day": ("working",), "declared": (),
}


def _facets(t: Column, closed: Sequence[date], intraday: bool) -> dict[str, Column]:
    """working, period (the last working day of a year, quarter or month), any_period, weekday and hour of a moment."""
    def works(d: Column) -> Column:
        return (F.weekday(d) < 5) & ~d.isin(*closed) if closed else F.weekday(d) < 5

    day = F.to_date(t)
    # Ten days in a row without a working one don't occur; if they do, the month counts as not over.
    after = F.get(F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 10 + len(closed))), works), F.lit(0))
    period = F.when(~works(day) | after.isNull(), "none").when(F.year(after) != F.year(day), "year").when(F.quarter(after) != F.quarter(day), "quarter").when(F.month(after) != F.month(day), "month").otherwise("none")
    return {
        "working": works(day).cast("string"), "period": period, "any_period": (period != "none").cast("string"), "weekday": F.weekday(day).cast("string"),
        "hour": F.hour(t).cast("string") if intraday else F.lit(""),
    }


def season_lattice(df: DataFrame, least: int = 20, closed: Sequence[date] = (), intraday: bool = False, drivers: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds level, season and members: the finest group of comparable points of its series that a point has ``least`` of, itself included.

    A lattice of calendar facets, coarsened one at a time: hour, weekday, the kind
    of period end, period ends at all, working days.  ``drivers`` are declared
    conditions (Columns over ``df``), given up last of all, and then every point is
    comparable (level ``all``).  ``closed`` are days on which nothing works.  An
    ordinary day never shares a group with period ends before those are given up.

    Points are counted by series and finest group, in one aggregation; coarser
    groups are sums of those counts, so nothing holds a series.  A point without a
    time is in a group of its own kind.
    """
    declared = {f"declared_{k}": F.coalesce(c.cast("boolean"), F.lit(False)).cast("string") for k, c in sorted((drivers or {}).items())}
    facets = _facets(F.col("t").cast("timestamp"), list(closed), intraday) | declared
    # In a struct, a series without a name equals itself.
    marked = df.withColumns({"__s": F.struct("series"), "__f": F.struct(*[F.coalesce(c, F.lit("?")).alias(k) for k, c in facets.items()])})
    finest = marked.groupBy("__s", "__f").agg(F.count(F.lit(1)).alias("n"))
    said = lambda keys: F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(f"__f.{k}")) for k in keys])
    steps = [(name, [*keys, *declared]) for name, keys in _LEVELS.items() if (intraday or name != "hour") and (declared or name != "declared")]
    rows = [F.struct(F.lit(i).alias("level"), F.lit(name).alias("name"), said(keys).alias("season")) for i, (name, keys) in enumerate([*steps, ("all", [])])]
    laid = finest.select("__s", "__f", "n", F.inline(F.array(*rows)))
    sizes = laid.groupBy("__s", "level", "season").agg(F.sum("n").alias("members"))
    enough = laid.join(sizes, ["__s", "level", "season"]).where((F.col("members") >= least) | (F.col("name") == "all"))
    chosen = enough.groupBy("__s", "__f").agg(F.min(F.struct("level", "name", "season", "members")).alias("__c"))
    out = marked.join(chosen, ["__s", "__f"])
    return out.select(*df.columns, F.col("__c.name").alias("level"), F.col("__c.season").alias("season"), F.col("__c.members").alias("members"))


def ensemble(scored: dict[str, DataFrame], n: int = 200, least: int = 20) -> DataFrame:
    """(series, t, p, detectors): p-values of several detectors, each calibrated on its own past, joined by Simes' rule.

    Scores of detectors have scales of their own and are never mixed.
    """
    parts = [conformal_p(df, n, least).select("series", "t", F.lit(name).alias("detector"), "p") for name, df in scored.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return simes(long, ["series", "t"]).withColumnRenamed("members", "detectors")


#: What is expected before anything was seen.
DEFAULT_NULL_RATE, DEFAULT_AGE_SECONDS = (0.0, 0.2), (0.0, 3600.0)


def priors(attributes: DataFrame, by_type: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(attribute, low, high, source): the null rate to expect on the first day.

    attributes: attribute, mandatory, semantic_type, siblings (null rates of
    comparable attributes).  A declaration goes first, then the semantic type,
    then three or more siblings, halved and doubled, then the default.
    """
    known = by_type or {}
    bound = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v[i])]), F.col("semantic_type")) if known else F.lit(None).cast("double")
    mandatory, typed, many = F.coalesce("mandatory", F.lit(False)), bound(1).isNotNull(), F.coalesce(F.size("siblings") >= 3, F.lit(False))

    def choose(declared, of_type, of_siblings, default) -> Column:
        return F.when(mandatory, declared).when(typed, of_type).when(many, of_siblings).otherwise(default)

    return attributes.select(
        "attribute",
        choose(F.lit(0.0), bound(0), F.array_min("siblings") * 0.5, F.lit(DEFAULT_NULL_RATE[0])).alias("low"),
        choose(F.lit(0.0), bound(1), F.least(F.array_max("siblings") * 2.0, F.lit(1.0)), F.lit(DEFAULT_NULL_RATE[1])).alias("high"),
        choose(F.lit("declaration"), F.lit("semantic_type"), F.lit("siblings"), F.lit("default")).alias("source"),
    )


def budget_level(false_alarms: float, tests: int, resolution: float | None = None) -> tuple[float, bool]:
    """(level, reachable): the level at which so many tests give that many false alarms, and whether p-values are fine enough for it."""
    level = min(1.0, false_alarms / tests) if tests > 0 else 0.0
    return level, resolution is None or level >= resolution


def rolled_up(df: DataFrame, family: str, alpha: float = 0.05, share: float = 0.6, least: int = 5) -> DataFrame:
    """(family, member, p, covers): findings of two levels, with families that fail as a whole as one finding.

    A family of ``least`` members or more of which a ``share`` lies below the
    shrunk level is one finding with the family's own p-value; member is null
    and covers the members below the level.
    """
    families = select_alerts(simes(df, [family]).withColumnRenamed("p", "family_p").withColumn("p", F.col("family_p")), alpha)
    level = families.agg((alpha * F.count_if("selected") / F.count(F.lit(1))).alias("level"))
    opened = families.where("selected").select(F.col(family).alias("__f"), "family_p")
    inside = df.where("p is not null").join(opened, F.col(family) == F.col("__f")).join(F.broadcast(level))
    extent = inside.groupBy("__f").agg(F.count_if(F.col("p") <= F.col("level")).alias("below"), F.count(F.lit(1)).alias("all"), F.first("family_p").alias("family_p"))
    whole = (F.col("all") >= least) & (F.col("below") >= share * F.col("all"))
    rolled = extent.where(whole).select(F.col("__f").alias("family"), F.lit(None).cast("string").alias("member"), F.col("family_p").alias("p"), F.col("below").alias("covers"))
    apart = extent.where(~whole).select(F.col("__f").alias("__g"))
    single = hierarchical(df.select(F.col(family).alias("family"), F.col("member"), "p"), "family", alpha).where("selected")
    kept = single.join(apart, F.col("family") == F.col("__g"), "left_semi").select("family", F.col("member").cast("string").alias("member"), "p", F.lit(1).cast("long").alias("covers"))
    return rolled.unionByName(kept)


#: Detectors by name, of series (series, t, value): each adds a score that is larger the stranger a point is, or null.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"robust_deviation": robust_deviation, "quantile_distance": quantile_distance, "forecast_residual": forecast_residual, "local_outlier": local_outlier}


def register_detector(name: str, detect: Callable[[DataFrame], DataFrame]) -> None:
    """Add a detector; a name can't be taken twice."""
    if name in DETECTORS:
        raise ValueError(f"{name} is taken")
    DETECTORS[name] = detect


def detected(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """What detectors, all or those named, say of series; ensemble() joins it."""
    names = list(DETECTORS if names is None else names)
    if unknown := [n for n in names if n not in DETECTORS]:
        raise ValueError(f"no detector {', '.join(unknown)}")
    return {n: DETECTORS[n](df) for n in names}
