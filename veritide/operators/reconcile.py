"""Reconciliation of keyed amounts: two-way with classified breaks, n-way, and roll-forward.

Both sides are summed by key before they meet, so that the join carries one row
per key and a hot key is combined on the map side.  Amounts are exact decimals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .as_of import as_of

from ..sources.store import cut

AMOUNT = "decimal(38,6)"
RATE = "decimal(18,9)"


def normal_key(c: Column) -> Column:
    """1, '1', ' 1 ' and 1.00 are one key."""
    text = F.trim(c.cast("string"))
    number = F.regexp_replace(F.regexp_replace(text, r"^(-?[0-9]+\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), number).otherwise(text)


@dataclass(frozen=True)
class Tolerance:
    """A difference is within the larger of an absolute amount and a share of the left side's size."""

    absolute: float = 0.0
    relative: float = 0.0

    def holds(self, left: Column, right: Column) -> Column:
        allowed = F.greatest(
            F.lit(str(self.absolute)).cast(AMOUNT), (F.abs(left) * F.lit(str(self.relative)).cast(AMOUNT)).cast(AMOUNT)
        )
        return F.abs(left - right) <= allowed


@dataclass(frozen=True)
class Side:
    """How one side's rows become keyed amounts: sign, scale, and rates by currency (missing rates are refused)."""

    keys: Sequence[str]
    amount: str
    currency: str | None = None
    rates: DataFrame | None = None
    negate: bool = False
    scale: float = 1.0
    places: int | None = None

    def totals(self, df: DataFrame) -> DataFrame:
        """Key columns k0.., amount (null if any row lacks one), rows."""
        value = F.col(self.amount).try_cast(AMOUNT)
        if self.rates is not None:
            rates = self.rates.select(F.col("currency").alias("__ccy"), F.col("rate").cast(RATE).alias("__rate"))
            df = df.join(F.broadcast(rates) if rates.count() <= 10_000 else rates, F.col(self.currency) == F.col("__ccy"), "left")
            missing = F.col("__rate").isNull() & F.col(self.amount).isNotNull()
            value = value * F.when(missing, F.raise_error(F.lit("no rate for a currency")).cast(RATE)).otherwise(F.col("__rate"))
        if self.scale != 1:
            value = value * F.lit(str(self.scale)).cast(AMOUNT)
        value = (-value if self.negate else value).cast(AMOUNT)
        if self.places is not None:
            value = F.bround(value, self.places).cast(AMOUNT)
        # The text of a whole number is normal as it is, without patterns for every row.
        whole = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
        keys = [(F.col(k).cast("string") if k in whole else normal_key(F.col(k))).alias(f"k{i}") for i, k in enumerate(self.keys)]
        rows = df.select(*keys, value.alias("v"))
        return rows.groupBy(*[f"k{i}" for i in range(len(self.keys))]).agg(
            F.when(F.count_if(F.col("v").isNull()) == 0, F.sum("v").cast(AMOUNT)).alias("amount"),
            F.count(F.lit(1)).alias("rows"),
        )


def direct_or_inverse(rates: DataFrame, target: str) -> DataFrame:
    """(currency, rate) into ``target`` from (source, target, rate) rows: direct if there is one, else inverse."""
    direct = rates.where(F.col("target") == target).select(F.col("source").alias("currency"), F.col("rate").cast("double").alias("r"), F.lit(0).alias("o"))
    inverse = rates.where(F.col("source") == target).select(
        F.col("target").alias("currency"), F.try_divide(F.lit(1.0), F.col("rate").cast("double")).alias("r"), F.lit(1).alias("o")
    )
    own = rates.sparkSession.createDataFrame([(target, 1.0, -1)], "currency string, r double, o int")
    return own.union(direct).union(inverse).where("r is not null").groupBy("currency").agg(F.min_by("r", "o").alias("rate"))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two totals on all key columns, nulls equal: keys, left, right, left_rows, right_rows."""
    keys = [c for c in left.columns if c.startswith("k")]
    a = left.select(*[F.col(k).alias(f"a{k}") for k in keys], F.col("amount").alias("left"), F.col("rows").alias("left_rows"))
    b = right.select(*[F.col(k).alias(f"b{k}") for k in keys], F.col("amount").alias("right"), F.col("rows").alias("right_rows"))
    on = reduce(lambda x, y: x & y, [F.col(f"a{k}").eqNullSafe(F.col(f"b{k}")) for k in keys])
    joined = a.join(b, on, "full_outer")
    there = F.col("left_rows").isNotNull()
    return joined.select(
        *[F.when(there, F.col(f"a{k}")).otherwise(F.col(f"b{k}")).alias(k) for k in keys], "left", "right", "left_rows", "right_rows"
    )


def shifted_match(matched: DataFrame, day_key: str, window: int) -> DataFrame:
    """Pair leftovers whose keys differ only by up to ``window`` days in ``day_key`` (ISO text).

    Offsets are tried by distance, later days first; at one offset a key has one
    partner at most, so each step is an equi-join.  The result has ``offset``:
    null for rows matched on the day or not at all.
    """
    keys = [c for c in matched.columns if c.startswith("k")]
    other = [k for k in keys if k != day_key]
    matched = cut(matched)
    exact = matched.where("left_rows is not null and right_rows is not null").withColumn("offset", F.lit(None).cast("int"))
    lefts = matched.where("right_rows is null").select(*keys, "left", "left_rows")
    rights = matched.where("left_rows is null").select(*[F.col(k).alias(f"r_{k}") for k in keys], "right", "right_rows")
    done = exact
    for offset in [o for d in range(1, window + 1) for o in (d, -d)]:
        on = reduce(
            lambda x, y: x & y,
            [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in other]
            + [F.date_add(F.col(day_key).try_cast("date"), offset).cast("string") == F.col(f"r_{day_key}")],
        )
        pairs = cut(lefts.join(rights, on).withColumn("offset", F.lit(offset)))
        done = done.unionByName(pairs.select(*keys, "left", "right", "left_rows", "right_rows", "offset"))
        taken = pairs.select(*[F.col(k).alias(f"t_{k}") for k in keys], *[F.col(f"r_{k}").alias(f"u_{k}") for k in keys])
        same = lambda p, q: reduce(lambda x, y: x & y, [F.col(f"{p}{k}").eqNullSafe(F.col(f"{q}{k}")) for k in keys])
        lefts = cut(lefts.join(taken, same("", "t_"), "left_anti"))
        rights = cut(rights.join(taken, same("r_", "u_"), "left_anti"))
    none = F.lit(None)
    done = done.unionByName(
        lefts.select(*keys, "left", none.cast(AMOUNT).alias("right"), "left_rows", none.cast("long").alias("right_rows"), none.cast("int").alias("offset"))
    )
    return done.unionByName(
        rights.select(
            *[F.col(f"r_{k}").alias(k) for k in keys], none.cast(AMOUNT).alias("left"), "right", none.cast("long").alias("left_rows"), "right_rows", none.cast("int").alias("offset")
        )
    )


def classify(matched: DataFrame, tolerance: Tolerance, rounding: float = 0.01) -> DataFrame:
    """Add ``kind``: the first that fits of missing, extra, no_amount, matched, timing, sign, duplicate, rounding, genuine."""
    left, right = F.col("left"), F.col("right")
    multiple = reduce(lambda a, b: a | b, [(right == left * n) | (left == right * n) for n in (2, 3, 4)])
    timing = F.col("offset").isNotNull() if "offset" in matched.columns else F.lit(False)
    ok = tolerance.holds(left, right)
    return matched.withColumn(
        "kind",
        F.when(F.col("right_rows").isNull(), "missing")
        .when(F.col("left_rows").isNull(), "extra")
        .when(left.isNull() | right.isNull(), "no_amount")
        .when(ok & timing, "timing")
        .when(ok, "matched")
        .when(timing, "timing")
        .when(left == -right, "sign")
        .when((left != 0) & multiple, "duplicate")
        .when(F.abs(left - right) <= F.lit(str(rounding)).cast(AMOUNT), "rounding")
        .otherwise("genuine"),
    )


def attribute_rate(breaks: DataFrame, least: int = 20, spread: float = 0.001) -> DataFrame:
    """Genuine breaks become "rate" if at least ``least`` of them, and a majority, share one right/left ratio.

    The shared ratio is the upper median and must differ from 1 by ``spread``.
    """
    ratio = F.when((F.col("kind") == "genuine") & (F.col("left") != 0), (F.col("right") / F.col("left")).cast("double"))
    marked = breaks.withColumn("ratio", ratio)
    n = F.count("ratio")
    middle = marked.agg(n.alias("n"), F.expr("percentile_disc(0.5) within group (order by ratio desc)").alias("middle"))
    near = F.abs(F.col("ratio") / F.col("middle") - 1) <= spread
    joined = marked.join(F.broadcast(middle))
    counted = joined.agg(F.count_if(near).alias("near"))
    shared = (F.col("n") >= least) & (F.col("near") * 2 > F.col("n")) & (F.abs(F.col("middle") - 1) >= spread)
    return (
        joined.join(F.broadcast(counted))
        .withColumn("kind", F.when(F.coalesce(shared & near, F.lit(False)), "rate").otherwise(F.col("kind")))
        .drop("n", "middle", "near", "ratio")
    )


def summary(breaks: DataFrame) -> DataFrame:
    """Per kind: keys, sum of absolute differences, whether a person must look."""
    gap = F.abs(F.coalesce("left", F.lit(0).cast(AMOUNT)) - F.coalesce("right", F.lit(0).cast(AMOUNT)))
    return breaks.groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.sum(gap).cast(AMOUNT).alias("gap")).withColumn(
        "needs_person", F.col("kind").isin("genuine", "missing", "extra", "no_amount")
    )


def n_way(sides: Mapping[str, DataFrame], tolerance: Tolerance) -> DataFrame:
    """Totals (key, amount) of three or more sides: one row per key with each side's amount and the odd sides.

    The value that a strict majority of sides agrees on stands; without one every side is odd.
    """
    names = sorted(sides)
    stacked = reduce(DataFrame.unionByName, [sides[n].select(F.col("key"), F.lit(n).alias("side"), F.col("amount").cast(AMOUNT).alias("amount")) for n in names])
    wide = stacked.groupBy("key").pivot("side", names).agg(F.sum("amount").cast(AMOUNT))
    votes = F.array(
        *[
            F.struct(
                reduce(lambda a, b: a + b, [F.coalesce(tolerance.holds(F.col(n), F.col(m)), F.lit(False)).cast("int") for m in names]).alias("votes"),
                F.lit(-i).alias("place"),
                F.col(n).alias("value"),
            )
            for i, n in enumerate(names)
        ]
    )
    best = F.array_max(F.transform(votes, lambda v: F.struct(v["votes"], v["place"], v["value"])))
    agreed = F.when(best["votes"] * 2 > len(names), best["value"])
    odd = F.array_compact(F.array(*[F.when(~F.coalesce(tolerance.holds(F.col("agreed"), F.col(n)), F.lit(False)), F.lit(n)) for n in names]))
    return wide.withColumn("agreed", agreed).withColumn("odd", odd)


def roll_forward(balances: DataFrame, keys: Sequence[str], period: str, tolerance: Tolerance) -> DataFrame:
    """opening + movements against closing, and each opening against the closing before it."""
    w = Window.partitionBy(*keys).orderBy(period)
    dec = lambda c: F.col(c).cast(AMOUNT)
    before = F.lag(dec("closing")).over(w)
    return balances.select(
        *keys,
        period,
        (dec("closing") - dec("opening") - dec("movements")).cast(AMOUNT).alias("gap"),
        tolerance.holds((dec("opening") + dec("movements")).cast(AMOUNT), dec("closing")).alias("rolls"),
        F.when(before.isNotNull(), tolerance.holds(before, dec("opening"))).alias("carries"),
    )


def dated_rates(amounts: DataFrame, rates: DataFrame, currency: str, day: str, target: str, carry_days: int = 0) -> DataFrame:
    """Adds rate and rate_day: the rate into ``target`` of the row's day, or of the latest day up to ``carry_days`` before it.

    rates: (source, target, day, rate); a quoted rate goes before an inverted one
    of any day, as a quote is no arithmetic.  Without a rate both are null.  A
    rate is copied to the days that it may be carried to, so the join is by
    equality.
    """
    if carry_days < 0:
        raise ValueError("carry_days can't be negative")
    quoted = rates.where(F.col("target") == target).select(F.col("source").alias("__ccy"), F.col("day").alias("__of"), F.col("rate").cast("double").alias("__rate"), F.lit(0).alias("__how"))
    inverse = rates.where((F.col("source") == target) & (F.col("rate") != 0)).select(F.col("target"), "day", 1 / F.col("rate").cast("double"), F.lit(1))
    spread = quoted.union(inverse).select("*", F.explode(F.sequence(F.lit(0), F.lit(carry_days))).alias("__age"))
    best = spread.groupBy("__ccy", F.date_add("__of", F.col("__age")).alias("__day")).agg(F.min(F.struct("__how", "__age", "__rate", "__of")).alias("__b"))
    joined = amounts.join(best, (F.upper(currency) == F.col("__ccy")) & (F.col(day) == F.col("__day")), "left")
    own = F.upper(currency) == target
    return joined.withColumns({"rate": F.when(own, 1.0).otherwise(F.col("__b.__rate")), "rate_day": F.when(own, F.col(day)).otherwise(F.col("__b.__of"))}).drop("__ccy", "__day", "__b")


def rates_as_of(amounts: DataFrame, rates: DataFrame, currency: str, at: str, target: str, seconds: float | None = None) -> DataFrame:
    """Adds rate and rate_at: the latest rate into ``target`` at or before the row's time, however long ago, or ``seconds`` ago at most.

    rates: (source, target, at, rate).  A quoted rate goes before an inverted one
    of any time.  Rows of the target currency itself have rate 1; without a rate
    both are null.  Every row comes out once.
    """
    quoted = rates.where(F.col("target") == target).select(F.upper("source").alias("__ccy"), F.col("at").alias("__when"), F.col("rate").cast("double").alias("__quoted"))
    inverse = rates.where((F.col("source") == target) & (F.col("rate") != 0)).select(F.upper("target").alias("__ccy"), F.col("at").alias("__when"), (1 / F.col("rate").cast("double")).alias("__inverse"))
    asked = amounts.withColumns({"__ccy": F.upper(currency), "__when": F.col(at)})
    one = as_of(asked, quoted, ["__ccy"], "__when", ["__quoted"], "__quoted_at", seconds)
    both = as_of(one, inverse, ["__ccy"], "__when", ["__inverse"], "__inverse_at", seconds)
    own = F.coalesce(F.col("__ccy") == target, F.lit(False))
    rate = {"rate": F.when(own, 1.0).otherwise(F.coalesce("__quoted", "__inverse")), "rate_at": F.when(own, F.col(at)).when(F.col("__quoted").isNotNull(), F.col("__quoted_at")).otherwise(F.col("__inverse_at"))}
    return both.withColumns(rate).select(*amounts.columns, "rate", "rate_at")


#: Fixed value: below this share of matched rows the keys don't fit, rather than the books.
POOR_MATCH = 0.9


def report(matched: DataFrame) -> DataFrame:
    """One row on how two sides lined up: pairs, totalled_pairs, left_only, right_only, left_rows, right_rows, match_rate, verdict.

    totalled_pairs compare sums, as their key repeats.  match_rate is the share of
    rows whose key is on both sides; it is null, and the verdict "nothing
    compared", where neither side has rows, which isn't agreement.  A rate under
    POOR_MATCH is "misconfigured": then each break is a gap of the keys.
    """
    left, right = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    both = F.col("left_rows").isNotNull() & F.col("right_rows").isNotNull()
    out = matched.agg(
        F.count_if(both).alias("pairs"), F.count_if(both & ((left > 1) | (right > 1))).alias("totalled_pairs"), F.count_if(F.col("right_rows").isNull()).alias("left_only"),
        F.count_if(F.col("left_rows").isNull()).alias("right_only"), F.coalesce(F.sum(left), F.lit(0)).alias("left_rows"), F.coalesce(F.sum(right), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.when(both, left + right)), F.lit(0)).alias("__both"),
    )
    rate = F.try_divide(F.col("__both").cast("double"), F.col("left_rows") + F.col("right_rows"))
    verdict = F.when(F.col("match_rate").isNull(), "nothing compared").when(F.col("match_rate") < POOR_MATCH, "misconfigured").otherwise("comparable")
    return out.withColumn("match_rate", rate).drop("__both").withColumn("verdict", verdict)


def worst_first(breaks: DataFrame, n: int) -> DataFrame:
    """The ``n`` breaks to look at first, ranked: those that a person must look at, then the larger difference, then by key.

    A top-n, so no task sorts all breaks; what agrees isn't a break.
    """
    keys = [c for c in breaks.columns if c.startswith("k") and c[1:].isdigit()]
    gap = F.abs(F.coalesce("left", F.lit(0).cast(AMOUNT)) - F.coalesce("right", F.lit(0).cast(AMOUNT))).cast(AMOUNT)
    person = F.col("kind").isin("genuine", "missing", "extra", "no_amount")
    order = [F.desc("needs_person"), F.desc("gap"), *keys]
    first = breaks.where("kind <> 'matched'").withColumns({"gap": gap, "needs_person": person}).orderBy(*order).limit(n)
    # The window ranks n rows.
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def map_codes(df: DataFrame, column: str, mapping: DataFrame, strict: bool = True) -> DataFrame:
    """``column`` in the other side's codes, from (code, other) rows, case aside; an unmapped code raises, or stays null if not ``strict``."""
    pairs = mapping.select(F.upper("code").alias("__code"), F.col("other").alias("__other"), F.lit(True).alias("__there"))
    joined = df.join(pairs, F.upper(F.col(column).cast("string")) == F.col("__code"), "left")
    missing = F.col(column).isNotNull() & F.col("__there").isNull()
    value = F.when(missing, F.raise_error(F.concat(F.lit("no mapping for the code "), F.col(column).cast("string"))).cast("string")) if strict else F.when(missing, F.lit(None).cast("string"))
    return joined.withColumn(column, value.otherwise(F.col("__other"))).drop("__code", "__other", "__there")


def unmapped_codes(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """(code, rows) of codes that a mapping lacks, before a run fails on them."""
    known = mapping.select(F.upper("code").alias("__code"))
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    return found.join(known, F.upper("code") == F.col("__code"), "left_anti")
