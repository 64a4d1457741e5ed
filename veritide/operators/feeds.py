"""Files that should arrive: names, calendars, arrival, trailers, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a file-name pattern.
_TOKENS = {"{yyyymmdd}": r"([0-9]{8})", "{yyyy-mm-dd}": r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "{hhmm}": r"([0-9]{4})", "{hhmmss}": r"([0-9]{6})", "{seq}": r"([0-9]+)"}


def name_pattern(pattern: str) -> tuple[str, list[str]]:
    """Regular expression of a file-name pattern and its tokens in order."""
    parts = re.split(r"(\{[a-z-]+\})", pattern)
    tokens = [p[1:-1] for p in parts if p in _TOKENS]
    unknown = [p for p in parts if p.startswith("{") and p not in _TOKENS]
    if unknown:
        raise ValueError(f"no token {unknown[0]}")
    return "^" + "".join(_TOKENS.get(p) or re.escape(p) for p in parts) + "$", tokens


def parsed_names(files: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """Adds day and seq of each file name; readable is false for other names."""
    expression, tokens = name_pattern(pattern)
    out = files.withColumn("readable", F.col(name).rlike(expression))
    day: Column = F.lit(None).cast("date")
    seq: Column = F.lit(None).cast("long")
    for i, t in enumerate(tokens, 1):
        value = F.nullif(F.regexp_extract(name, expression, i), F.lit(""))
        if t in ("yyyymmdd", "yyyy-mm-dd"):
            day = F.try_to_timestamp(value, F.lit("yyyyMMdd" if t == "yyyymmdd" else "yyyy-MM-dd")).cast("date")
        elif t == "seq":
            seq = value.try_cast("long")
    out = out.withColumn("day", day).withColumn("seq", seq)
    return out.withColumn("readable", F.col("readable") & (F.col("day").isNotNull() if "yyyy" in pattern else F.lit(True)))


def easter(year: int) -> date:
    """Western Easter Sunday, by the anonymous Gregorian rule."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (date(year + month // 12, month % 12 + 1, 1)) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def observed(day: date) -> date:
    """A weekend holiday is kept on the nearest weekday."""
    return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day


def calendar(spark, first: date, last: date, holidays: Sequence[date] = ()) -> DataFrame:
    """(day, business, n): n numbers business days; others carry the number of the one before."""
    days = spark.sql("SELECT explode(sequence(:a, :b)) AS day", args={"a": first, "b": last})
    off = F.col("day").isin(list(holidays)) if holidays else F.lit(False)
    out = days.withColumn("business", (F.weekday("day") < 5) & ~off)
    # A calendar has a few thousand rows, however large the data are.
    return out.withColumn("n", F.sum(F.col("business").cast("int")).over(Window.orderBy("day")).cast("int"))


def shift(df: DataFrame, cal: DataFrame, day: str, by: int) -> DataFrame:
    """Adds ``shifted``: the business day that many away from each day."""
    at = cal.select(F.col("day").alias("__d"), F.col("n").alias("__n"))
    to = cal.where("business").select(F.col("day").alias("shifted"), F.col("n").alias("__t"))
    return df.join(F.broadcast(at), F.col(day) == F.col("__d"), "left").join(F.broadcast(to), F.col("__n") + by == F.col("__t"), "left").drop("__d", "__n", "__t")


def expected_at(day, at: str, zone: str) -> Column:
    """The instant in UTC, without a zone, at which something due at a local time of day is due."""
    local = F.to_timestamp_ntz(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(at)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def business_dates(df: DataFrame, cal: DataFrame, ts: str, zone: str, boundary: str = "00:00:00") -> DataFrame:
    """Adds ``business_date``: the business day that an instant (UTC, without a zone) belongs to.

    A local day begins at ``boundary``; what falls on a day off belongs to the
    business day before.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts).cast("timestamp_ntz"))
    early = F.date_format(local, "HH:mm:ss") < boundary
    day = F.date_sub(F.to_date(local), F.when(early, 1).otherwise(0))
    return shift(df.withColumn("__day", day), cal, "__day", 0).withColumnRenamed("shifted", "business_date").drop("__day")


def arrivals(expected: DataFrame, files: DataFrame, early_minutes: int = 60) -> DataFrame:
    """Status of each expected day and of each file that nobody expects.

    expected: (day, due timestamp, seq or null); files: parsed names with
    arrived, rows_declared and rows_read.  One of missing, duplicate,
    out_of_sequence, truncated, early, late, on_time, unexpected_day,
    unreadable_name.
    """
    good = files.where("readable")
    each = good.groupBy("day").agg(
        F.count(F.lit(1)).alias("files"), F.min("arrived").alias("arrived"), F.min("seq").alias("seq"),
        F.max((F.coalesce(F.col("rows_read"), F.lit(0)) < F.coalesce(F.col("rows_declared"), F.lit(0))).cast("int")).alias("short"),
    )
    w = Window.orderBy("day")
    each = each.withColumn("before", F.lag("seq").over(w))
    joined = expected.select(F.col("day").alias("e_day"), "due").join(each, F.col("e_day") == F.col("day"), "full_outer")
    minutes = (F.unix_timestamp(F.col("arrived").cast("timestamp")) - F.unix_timestamp(F.col("due").cast("timestamp"))) / 60
    status = (
        F.when(F.col("e_day").isNull(), "unexpected_day")
        .when(F.col("files").isNull(), "missing")
        .when(F.col("files") > 1, "duplicate")
        .when(F.col("seq") != F.col("before") + 1, "out_of_sequence")
        .when(F.col("short") == 1, "truncated")
        .when(minutes > 0, "late")
        .when(minutes < -early_minutes, "early")
        .otherwise("on_time")
    )
    rest = files.where(~F.col("readable")).select(F.lit(None).cast("date").alias("day"), F.lit("unreadable_name").alias("status"))
    return joined.select(F.coalesce("e_day", "day").alias("day"), status.alias("status")).unionByName(rest)


def trailers(lines: DataFrame, marker: str, headers: int = 0, delimiter: str = ",", amount: int | None = None) -> DataFrame:
    """Declared against found for rows (file, line): a trailer is marker, count and, with ``amount``, a total.

    ``amount`` is the 0-based field that is summed.
    """
    parts = F.split("line", re.escape(delimiter))
    trailer = F.get(parts, F.lit(0)) == marker
    total = F.get(parts, F.lit(amount)).try_cast("decimal(38,6)") if amount is not None else F.lit(None).cast("decimal(38,6)")
    out = lines.groupBy("file").agg(
        (F.count_if(~trailer) - headers).alias("rows"),
        F.max(F.when(trailer, F.get(parts, F.lit(1)).try_cast("long"))).alias("declared_rows"),
        F.sum(F.when(~trailer, total)).cast("decimal(38,6)").alias("total"),
        F.max(F.when(trailer, F.get(parts, F.lit(2)).try_cast("decimal(38,6)"))).alias("declared_total"),
    )
    ok = F.coalesce(F.col("rows") == F.col("declared_rows"), F.lit(False))
    return out.withColumn("ok", ok if amount is None else ok & F.coalesce(F.col("total") == F.col("declared_total"), F.lit(False)))


def manifest_missing(promised: DataFrame, landed: DataFrame, name: str = "name") -> DataFrame:
    return promised.join(landed.select(name).distinct(), name, "left_anti")
