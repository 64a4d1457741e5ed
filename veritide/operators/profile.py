"""Profiles: one aggregation over all columns, unpivoted to one row per column; sketches for what must merge."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.predicates import character_mask
from .prefix import running_totals

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _missing(df: DataFrame, c: str) -> Column:
    """Nulls, and NaN for floating columns."""
    isnan = F.isnan(c) if dict(df.dtypes)[c] in ("float", "double") else F.lit(False)
    return F.col(c).isNull() | isnan


#: What columns() tells of each column, in this order.
METRICS = ("rows", "nulls", "distinct", "min", "max", "mean", "stddev", "min_length", "max_length", "mean_length", "blanks")


def columns(df: DataFrame, names: Sequence[str] | None = None, rsd: float = 0.01, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per column (and segment) with the ``metrics`` asked for: rows, nulls, distinct (estimated), numeric and text summaries.

    Only what is asked for is computed; the sketch behind distinct costs more than
    all else.  Values are cast and freed of NaN once, below the aggregation.
    """
    names = list(names or [c for c in df.columns if c not in by])
    if unknown := [m for m in metrics if m not in METRICS]:
        raise ValueError(f"no metric {', '.join(unknown)}")
    kinds = {f.name: f.dataType for f in df.schema}
    keys = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    values = [F.when(~_missing(df, c), F.col(c).cast("double") if isinstance(kinds[c], NumericType) and not set(metrics) & {"distinct"} else F.col(c)).alias(f"v{i}") for i, c in enumerate(names)]
    parts = []
    for i, c in enumerate(names):
        value = F.col(f"v{i}")
        number = value.cast("double") if isinstance(kinds[c], NumericType) else F.lit(None).cast("double")
        text = value if isinstance(kinds[c], StringType) else F.lit(None).cast("string")
        told = {
            "rows": F.count(F.lit(1)), "nulls": F.count(F.lit(1)) - F.count(value), "distinct": F.approx_count_distinct(value, rsd), "min": F.min(number), "max": F.max(number),
            "mean": F.avg(number), "stddev": F.stddev_pop(number), "min_length": F.min(F.length(text)), "max_length": F.max(F.length(text)), "mean_length": F.avg(F.length(text)),
            "blanks": F.count_if(F.trim(text) == ""),
        }
        parts.append(F.struct(F.lit(c).alias("column"), *[told[m].alias(m) for m in METRICS if m in metrics]).alias(f"c{i}"))
    wide = df.select(*keys, *values).groupBy(*[f"__by{i}" for i in range(len(by))]).agg(*parts)
    return wide.select(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)], F.inline(F.array(*[F.col(f"c{i}") for i in range(len(names))])))


def _at_ranks(df: DataFrame, c: str, by: Sequence[str], asked: Column) -> DataFrame:
    """(by, quantile, all, rank, value): the values at the ranks that ``asked``, an array of (quantile, rank) made of all, the count of values, names.

    Equal values are one row, and running totals over ranges of them give the ranks, so
    that neither a group's values nor its distinct ones must fit into one task.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    counted = df.where(F.col(c).isNotNull()).groupBy(*[F.col(x).alias(k) for x, k in zip(by, keys, strict=True)], F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_totals(counted, ["value"], ["n"], within=keys)
    groups = df.groupBy(*[F.col(x).alias(f"__g{i}") for i, x in enumerate(by)]).agg(F.count(c).alias("all"))
    wanted = groups.select("*", F.explode(asked).alias("__a")).select(*[f"__g{i}" for i in range(len(by))], "all", "__a.quantile", "__a.rank")
    hit = (F.col("total_n") >= F.col("rank")) & (F.col("total_n") - F.col("n") < F.col("rank"))
    # A row for each group and rank; all values pass by them.
    on = reduce(lambda x, y: x & y, [F.col(f"__g{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)], hit)
    found = upto.join(wanted, on).select(*[f"__g{i}" for i in range(len(by))], "quantile", "rank", "value")
    same = reduce(lambda x, y: x & y, [F.col(f"w.__g{i}").eqNullSafe(F.col(f"f.__g{i}")) for i in range(len(by))], (F.col("w.quantile") == F.col("f.quantile")) & (F.col("w.rank") == F.col("f.rank")))
    out = wanted.alias("w").join(found.alias("f"), same, "left")
    return out.select(*[F.col(f"w.__g{i}").alias(x) for i, x in enumerate(by)], "w.quantile", "w.all", "w.rank", "f.value")


def exact_quantiles(df: DataFrame, c: str, at: Sequence[float] = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """(quantile, value) by linear interpolation; null where there are no values."""
    place = lambda q: F.lit(float(q)) * (F.col("all") - 1)
    pair = [f(place(q)).cast("long") + 1 for q in at for f in (F.floor, F.ceil)]
    asked = F.array_distinct(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), pair[2 * i + j].alias("rank")) for i, q in enumerate(at) for j in (0, 1)]))
    ends = _at_ranks(df.select(*by, F.col(c).cast("double").alias(c)), c, by, asked)
    folded = ends.groupBy(*by, "quantile").agg(F.max("all").alias("all"), F.min("value").alias("low"), F.max("value").alias("high"))
    at_ = F.col("quantile") * (F.col("all") - 1)
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil(at_) - at_) * F.col("low") + (at_ - F.floor(at_)) * F.col("high"))
    return folded.select(*by, "quantile", value.alias("value"))


def ranked_quantiles(df: DataFrame, c: str, at: Sequence[float] = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """(quantile, value): the value at rank ceil(quantile * n), the first for 0; null where there are no values."""
    asked = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.greatest(F.ceil(F.lit(float(q)) * F.col("all")), F.lit(1)).cast("long").alias("rank")) for q in at])
    return _at_ranks(df, c, by, asked).select(*by, "quantile", "value")


def approximate_quantiles(df: DataFrame, c: str, at: Sequence[float] = QUANTILES, accuracy: int = 10_000, by: Sequence[str] = ()) -> DataFrame:
    wide = df.groupBy(*by).agg(F.percentile_approx(c, list(at), accuracy).alias("q"))
    pairs = F.arrays_zip(F.array(*map(F.lit, at)).alias("quantile"), F.col("q").alias("value"))
    return wide.select(*by, F.inline(pairs).alias("quantile", "value"))


def top_values(df: DataFrame, c: str, k: int = 20) -> DataFrame:
    """The k most frequent values, ties by value."""
    counted = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.orderBy(F.desc("rows"), "value").limit(k)


def top_masks(df: DataFrame, c: str, k: int = 5) -> DataFrame:
    return top_values(df.where(F.col(c).isNotNull()).select(character_mask(c).alias("mask")), "mask", k)


def character_classes(df: DataFrame, c: str) -> DataFrame:
    """Rows whose text holds digits, capitals, small letters, punctuation, characters beyond ASCII."""
    has = lambda p: F.count_if(F.col(c).rlike(p))
    return df.agg(
        has("[0-9]").alias("digits"), has("[A-Z]").alias("capitals"), has("[a-z]").alias("small"),
        has(r"[!-/:-@\[-`{-~]").alias("punctuation"), has(r"[^\x00-\x7F]").alias("beyond_ascii"),
    )


def sketches(df: DataFrame, names: Sequence[str], by: Sequence[str], k: int = 4096) -> DataFrame:
    """Mergeable state for each segment: rows, nulls, a distinct sketch and, for numbers, a quantile sketch of parameter ``k``."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts = []
    for c in names:
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.hll_sketch_agg(F.col(c).cast("string"), 14).alias(f"{c}__distinct")]
        if isinstance(kinds[c], NumericType):
            parts.append(F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"{c}__quantiles"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *parts)


def merge_sketches(parts: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fold segments: rows, nulls and distinct estimates of each column."""
    folded = parts.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        *[F.sum(f"{c}__nulls").alias(f"{c}__nulls") for c in names],
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{c}__distinct")).alias(f"{c}__distinct") for c in names],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct")) for c in names]
    return folded.select(*by, F.inline(F.array(*rows)))


def merged_ranks(parts: DataFrame, name: str, at: Sequence[float] = QUANTILES, by: Sequence[str] = (), k: int = 4096) -> DataFrame:
    """(quantile, value, n) of a column from the quantile sketches of segments, folded.

    The rank of a value is off by 0.1 % of the rows at most, nearly always; far in
    a long tail that may be far off in value: see magnitudes().  Segments without a
    value give no rows.
    """
    folded = parts.groupBy(*by).agg(F.kll_merge_agg_double(f"{name}__quantiles", k).alias("s")).withColumn("n", F.kll_sketch_get_n_double("s"))
    each = F.inline(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias("value")) for q in at]))
    return folded.where("n > 0").select(*by, "n", each).select(*by, "quantile", "value", "n")


def magnitudes(df: DataFrame, c: str, by: Sequence[str] = (), error: float = 0.001) -> DataFrame:
    """(by, sign, bucket, n): how many values of a column lie in each of the intervals that grow by a constant factor.

    A sketch as a table: segments merge by adding n up, in any grouping and with
    nothing lost, and every quantile is off by at most ``error`` of its value,
    however long the tail.  Nulls and NaN are left out; zeros have sign 0, values
    that aren't finite keep their sign in a bucket of their own.
    """
    v = F.col(c).cast("double")
    step = math.log1p(2 * error / (1 - error))
    size = F.abs(v)
    bucket = F.when(size == 0, 0).when(size == float("inf"), _ENDLESS).otherwise(F.ceil(F.log(F.when(size > 0, size)) / step)).cast("int")
    kept = df.where(v.isNotNull() & ~F.isnan(v))
    return kept.groupBy(*by, F.signum(v).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_ENDLESS = 1 << 30


def magnitude_quantiles(parts: DataFrame, at: Sequence[float] = (0.5, 0.95, 0.99, 0.999), by: Sequence[str] = (), error: float = 0.001) -> DataFrame:
    """(quantile, value, n) from merged magnitudes: the value at rank ceil(quantile * n), the first for 0, within ``error`` of itself.

    A window holds the buckets of one group: at ``error`` 0.001 five thousand
    cover values between 1 and 20,000 times as much.
    """
    step = math.log1p(2 * error / (1 - error))
    folded = parts.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))
    size = F.when(F.col("bucket") == _ENDLESS, float("inf")).otherwise(F.exp(F.col("bucket") * step) * 2 / (1 + math.exp(step)))
    # From the largest negative values up to the largest positive ones.
    w = Window.partitionBy(*by).orderBy("sign", F.col("sign") * F.col("bucket"))
    upto = folded.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("quantile")
    rank = F.greatest(F.ceil(F.col("quantile") * F.col("all")), F.lit(1))
    hit = upto.select("*", wanted).where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return hit.select(*by, "quantile", F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * size).alias("value"), F.col("all").alias("n"))


def segment_plan(current: DataFrame, ledger: DataFrame, newest_mutable: int = 3) -> DataFrame:
    """What to profile again: (segment, state) from (segment, fingerprint) now and as last profiled.

    new, changed, mutable (one of the newest), unverifiable (no fingerprint) or settled.
    """
    old = ledger.select(F.col("segment").alias("s"), F.col("fingerprint").alias("old"))
    joined = current.join(old, F.col("segment") == F.col("s"), "left")
    newest = F.row_number().over(Window.orderBy(F.desc("segment"))) <= newest_mutable
    return joined.withColumn("newest", newest).select(
        "segment",
        F.when(F.col("s").isNull(), "new")
        .when(F.col("fingerprint").isNull() | F.col("old").isNull(), "unverifiable")
        .when(F.col("fingerprint") != F.col("old"), "changed")
        .when(F.col("newest"), "mutable")
        .otherwise("settled")
        .alias("state"),
    )


def key_candidates(profile: DataFrame, error: float = 0.01) -> DataFrame:
    """Columns of a profile that may be keys, or are constant."""
    full = (F.col("nulls") == 0) & (F.col("rows") > 0)
    return profile.select(
        "column",
        (full & (F.col("distinct") >= F.col("rows") * (1 - 3 * error))).alias("key_candidate"),
        (full & (F.col("distinct") == 1)).alias("constant"),
    )


def detectable_rate(rows: Column) -> Column:
    """The share of bad rows that a clean sample of so many rows rules out at 95 %: the rule of three."""
    return F.try_divide(F.lit(3.0), rows)


def sample_fraction(rows: int, full_up_to: int = 5_000_000, target: int = 1_000_000) -> float:
    return 1.0 if rows <= full_up_to else target / rows


def metric_points(profile: DataFrame, dataset: str, computed_at: str, by: Sequence[str] = (), sampling: str = "full", representative: bool = True, run_id: str | None = None) -> DataFrame:
    """A profile's numbers as metric points, each with where it comes from; numbers that a column doesn't have are left out."""
    skip = {"column", *by}
    numbers = [c for c, kind in profile.dtypes if c not in skip and kind in ("bigint", "int", "double")]
    rate = F.try_divide(F.col("nulls").cast("double"), F.col("rows"))
    with_rate = profile.withColumn("null_rate", rate)
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in [*numbers, "null_rate"]]))
    segment = F.concat_ws("|", *[F.concat(F.lit(f"{b}="), F.coalesce(F.col(b).cast("string"), F.lit("null"))) for b in by]) if by else F.lit(None).cast("string")
    points = with_rate.select(F.col("column").alias("attribute"), segment.alias("segment"), F.col("rows").alias("rows_examined"), each).where("value is not null")
    whole = with_rate.groupBy(segment.alias("segment")).agg(F.max("rows").alias("rows_examined")).select(
        F.lit(None).cast("string").alias("attribute"), "segment", "rows_examined", F.lit("row_count").alias("metric"), F.col("rows_examined").cast("double").alias("value")
    )
    return points.where("metric <> 'rows'").unionByName(whole).select(
        F.lit(dataset).alias("dataset"), "attribute", "segment", "metric", "value", F.lit(computed_at).cast("timestamp").alias("computed_at"), "rows_examined",
        F.lit(sampling).alias("sampling"), F.lit(representative).alias("representative"), F.lit(run_id).cast("string").alias("run_id"),
    )


def suggested(profile: DataFrame, representative: bool = True, error: float = 0.01) -> DataFrame:
    """(column, suggestion, prefill): what a declaration may take over from a profile; nothing is filled in from rows that don't represent the table."""
    found = key_candidates(profile, error).join(profile.select(F.col("column").alias("__c"), "rows", "nulls", "distinct", "blanks"), F.col("column") == F.col("__c"))
    says = F.array_compact(
        F.array(
            F.when(F.col("key_candidate"), "grain"), F.when((F.col("nulls") == 0) & (F.col("rows") > 0), "required"), F.when(F.col("constant"), "constant: worth a look"),
            F.when((F.col("rows") > 0) & (F.col("nulls") == F.col("rows")), "always null: worth a look"), F.when(F.col("blanks") > 0, "blank texts: worth a look"),
        )
    )
    out = found.select("column", F.explode(says).alias("suggestion"))
    return out.withColumn("prefill", F.lit(representative) & F.col("suggestion").isin("grain", "required"))


def count_min(df: DataFrame, c: str, width: int = 1 << 16, depth: int = 5) -> DataFrame:
    """(row, bucket, n): a Count-Min sketch as a table of at most width * depth rows; sketches add up by (row, bucket)."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), F.col(c)), F.lit(width)).cast("int").alias("bucket")) for i in range(depth)])).alias("x")
    known = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k"))
    return known.select("k", cells).groupBy("x.row", "x.bucket").agg(F.sum("k").alias("n"))


def count_min_estimate(sketch: DataFrame, values: DataFrame, c: str, width: int = 1 << 16, depth: int = 5) -> DataFrame:
    """(value, estimate): never below the true count; above it by more than e / width of all rows in one of e ** depth cases."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), F.col(c)), F.lit(width)).cast("int").alias("bucket")) for i in range(depth)])).alias("x")
    asked = values.select(F.col(c).alias("value"), cells).select("value", F.col("x.row").alias("r"), F.col("x.bucket").alias("b"))
    return asked.join(sketch, (F.col("r") == F.col("row")) & (F.col("b") == F.col("bucket")), "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
