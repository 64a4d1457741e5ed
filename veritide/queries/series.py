"""Series of metrics, drift, calibration, selection; streams run over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import monitor
from ..plans.controls import RowCheck
from ..sources import readers
from ..streaming import judge
from .catalogue import query

DAILY = "(SELECT event_type AS series, CAST(CAST(ts AS DATE) AS VARCHAR) AS t, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2)"


def daily(t):
    return t("events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").cast("string").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("daily_volume_series", f"SELECT * FROM {DAILY}")
def _(t, spark):
    return daily(t)


HISTORY = f"SELECT series, t, value, list(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS h FROM {DAILY}"


@query("robust_deviation", f"""WITH a AS ({HISTORY}), b AS (SELECT *, list_median(h) AS m FROM a), c AS (SELECT *, 1.4826 * list_median(list_transform(h, lambda x: abs(x - m))) AS d FROM b)
   SELECT series, t, value, round(CASE WHEN len(h) >= 10 THEN CASE WHEN d > 0 THEN abs(value - m) / d WHEN value = m THEN 0 END ELSE -1 END, 6) AS score FROM c""")
def _(t, spark):
    return rounded(monitor.robust_deviation(daily(t)).withColumn("score", F.coalesce("score", F.lit(-1.0))), "score")


@query("quantile_distance", f"""WITH a AS ({HISTORY}) SELECT series, t, value, round(CASE WHEN len(h) >= 10 THEN 2 * abs((len(list_filter(h, lambda x: x < value)) + len(list_filter(h, lambda x: x = value)) / 2) / len(h) - 0.5) ELSE -1 END, 6) AS score FROM a""")
def _(t, spark):
    return rounded(monitor.quantile_distance(daily(t)).withColumn("score", F.coalesce("score", F.lit(-1.0))), "score")


@query("ewma_residual", f"""WITH a AS ({HISTORY}), b AS (SELECT *, CASE WHEN len(h) >= 10 THEN list_reduce(h, lambda p, x: p * 0.75 + x * 0.25) END AS f FROM a)
   SELECT series, t, round(coalesce(f, -1), 6) AS forecast FROM b""")
def _(t, spark):
    return monitor.forecast_residual(daily(t)).select("series", "t", F.round(F.coalesce("forecast", F.lit(-1.0)), 6).alias("forecast"))


@query("local_outlier", f"""WITH a AS ({HISTORY}),
   b AS (SELECT *, list_median(list_transform(h, lambda x: list_sum(list_slice(list_sort(list_transform(h, lambda y: abs(y - x))), 2, 6)) / 5)) AS typical,
     list_sum(list_slice(list_sort(list_transform(h, lambda y: abs(y - value))), 1, 5)) / 5 AS mine FROM a)
   SELECT series, t, value, round(CASE WHEN len(h) >= 10 THEN CASE WHEN typical > 0 THEN mine / typical WHEN mine = 0 THEN 1 ELSE 'Infinity'::DOUBLE END ELSE -1 END, 6) AS score FROM b""")
def _(t, spark):
    return rounded(monitor.local_outlier(daily(t)).withColumn("score", F.coalesce("score", F.lit(-1.0))), "score")


def _standard(a: str) -> str:
    return f"CASE WHEN list_aggregate({a}, 'var_pop') > 0 THEN list_transform({a}, lambda x: (x - list_avg({a})) / sqrt(list_aggregate({a}, 'var_pop'))) ELSE list_transform({a}, lambda x: 0) END"


@query("shape_distance", f"""WITH a AS (SELECT series, t, value, list(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS h FROM {DAILY}),
   s AS (SELECT series, t, unnest(range(1, len(h) - 6)) AS i, h FROM a WHERE len(h) >= 11), p AS (SELECT series, t, list_slice(h, i, i + 3) AS one, list_slice(h, len(h) - 3, len(h)) AS two FROM s),
   z AS (SELECT series, t, {_standard("one")} AS one, {_standard("two")} AS two FROM p),
   d AS (SELECT series, t, min(sqrt((one[1] - two[1]) ** 2 + (one[2] - two[2]) ** 2 + (one[3] - two[3]) ** 2 + (one[4] - two[4]) ** 2)) AS score FROM z GROUP BY 1, 2)
   SELECT a.series, a.t, a.value, round(coalesce(d.score, -1), 6) AS score FROM a LEFT JOIN d USING (series, t)""")
def _(t, spark):
    return rounded(monitor.shape_distance(daily(t), width=4, n=20).withColumn("score", F.coalesce("score", F.lit(-1.0))), "score")


@query("changepoint", """WITH s AS (SELECT CAST(user_id % 3 AS VARCHAR) AS series, event_id AS t, value + CASE WHEN event_id > 6000 THEN 500 ELSE 0 END AS v FROM events),
   w AS (SELECT *, row_number() OVER o AS i, count(*) OVER p AS n, sum(v) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS head, sum(v) OVER p AS total, stddev_pop(v) OVER p AS spread FROM s WINDOW o AS (PARTITION BY series ORDER BY t), p AS (PARTITION BY series)),
   g AS (SELECT *, abs(head / i - (total - head) / nullif(n - i, 0)) / spread AS strength FROM w WHERE i >= 20 AND n - i >= 20)
   SELECT series, arg_max(t, strength) AS t, round(max(strength), 4) AS strength FROM g GROUP BY 1""")
def _(t, spark):
    s = t("events").select((F.col("user_id") % 3).cast("string").alias("series"), F.col("event_id").alias("t"), (F.col("value") + F.when(F.col("event_id") > 6000, 500).otherwise(0)).alias("value"))
    return monitor.changepoint(s).withColumn("strength", F.round("strength", 4))


HALVES = "a AS (SELECT value AS v FROM events WHERE event_id % 2 = 0), b AS (SELECT value * 1.2 + 1 AS v FROM events WHERE event_id % 2 = 1)"


def halves(t):
    e = t("events")
    return e.where("event_id % 2 = 0").select("value"), e.where("event_id % 2 = 1").select((F.col("value") * 1.2 + 1).alias("value"))


BINS = f"""WITH {HALVES}, e AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM a),
   c AS (SELECT len(list_filter(e, lambda x: x < v)) AS bin, sum(r) AS a, sum(1 - r) AS b FROM (SELECT v, 1 AS r FROM a UNION ALL SELECT v, 0 FROM b), e WHERE v IS NOT NULL GROUP BY 1),
   s AS (SELECT bin, a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c), q AS (SELECT *, greatest(a / ta, 1e-6) AS p, greatest(b / tb, 1e-6) AS q FROM s)"""


@query("psi", BINS + " SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM q")
def _(t, spark):
    return rounded(monitor.population_stability(monitor.bin_shares(*halves(t))), "psi")


@query("jensen_shannon", BINS + " SELECT round(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2, 6) AS js FROM q")
def _(t, spark):
    return rounded(monitor.jensen_shannon(monitor.bin_shares(*halves(t))), "js")


@query("chi_square", BINS + " SELECT round(sum((b - a / ta * tb) * (b - a / ta * tb) / (a / ta * tb)), 4) AS chi2, count(*) - 1 AS degrees FROM q")
def _(t, spark):
    return monitor.chi_square(monitor.bin_shares(*halves(t))).withColumn("chi2", F.round("chi2", 4))


CUMULATIVE = f"""WITH {HALVES}, c AS (SELECT v, sum(r) AS a, sum(1 - r) AS b FROM (SELECT v, 1 AS r FROM a UNION ALL SELECT v, 0 FROM b) WHERE v IS NOT NULL GROUP BY 1),
   d AS (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS cb, lead(v) OVER (ORDER BY v) - v AS gap FROM c)"""


@query("ks", CUMULATIVE + " SELECT round(max(abs(ca - cb)), 6) AS ks, max(abs(ca - cb)) > 1.36 * sqrt(2 * (SELECT count(*) FROM a)::DOUBLE / ((SELECT count(*) FROM a) * (SELECT count(*) FROM b))) AS drifted FROM d")
def _(t, spark):
    return rounded(monitor.kolmogorov_smirnov(*halves(t)), "ks")


@query("wasserstein", CUMULATIVE + " SELECT round(sum(abs(ca - cb) * gap), 4) AS w1 FROM d")
def _(t, spark):
    return monitor.wasserstein(*halves(t)).select(F.round("w1", 4).alias("w1"))


@query("conformal_p", f"""WITH s AS (SELECT event_type AS series, event_id AS t, value AS score FROM events), h AS (SELECT *, list(score) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS past FROM s)
   SELECT series, t, round(CASE WHEN len(past) >= 20 THEN (len(list_filter(past, lambda x: x >= score)) + 1) / (len(past) + 1) ELSE -1 END, 6) AS p FROM h""")
def _(t, spark):
    s = t("events").select(F.col("event_type").alias("series"), F.col("event_id").alias("t"), F.col("value").alias("score"))
    return monitor.conformal_p(s, n=50).select("series", "t", F.round(F.coalesce("p", F.lit(-1.0)), 6).alias("p"))


PS = "(SELECT event_type AS family, event_id, CASE WHEN event_id % 40 = 0 THEN (event_id % 97) / 1e5 ELSE (event_id * 7919 % 9973) / 9973 END AS p FROM events)"


def ps(t):
    i = F.col("event_id")
    p = F.when(i % 40 == 0, (i % 97) / 1e5).otherwise((i * 7919 % 9973) / 9973)
    return t("events").select(F.col("event_type").alias("family"), "event_id", p.alias("p"))


@query("bh_select", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM {PS}), c AS (SELECT *, max(CASE WHEN p <= 0.05 * k / m THEN p END) OVER (PARTITION BY family) AS cut FROM r)
   SELECT family, event_id, coalesce(p <= cut, FALSE) AS selected FROM c""")
def _(t, spark):
    return monitor.select_alerts(ps(t), 0.05, ["family"]).select("family", "event_id", "selected")


@query("simes_family", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM {PS}) SELECT family, round(least(min(p * m / k), 1), 9) AS p, count(*) AS members FROM r GROUP BY 1")
def _(t, spark):
    return monitor.simes(ps(t), ["family"]).select("family", F.round("p", 9).alias("p"), "members")


@query("hierarchical_select", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM {PS}),
   f AS (SELECT family, least(min(p * m / k), 1) AS fp FROM r GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY fp) AS j, count(*) OVER () AS n FROM f),
   s AS (SELECT family, coalesce(fp <= (SELECT max(fp) FROM g WHERE fp <= 0.05 * j / n), FALSE) AS sel FROM g), q AS (SELECT count(*) FILTER (WHERE sel) / count(*) AS share FROM s),
   c AS (SELECT r.*, max(CASE WHEN p <= 0.05 * share * k / m THEN p END) OVER (PARTITION BY family) AS cut FROM r JOIN s USING (family), q WHERE sel)
   SELECT family, event_id, coalesce(p <= cut, FALSE) AS selected FROM c""")
def _(t, spark):
    return monitor.hierarchical(ps(t), "family").select("family", "event_id", "selected")


@query("calibration", f"SELECT level, count(*) AS n, round(count(*) FILTER (WHERE p <= level) / count(*), 6) AS rate FROM {PS}, (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS level) GROUP BY 1")
def _(t, spark):
    return monitor.calibration(ps(t)).select("level", "n", F.round("rate", 6).alias("rate"))


@query("adaptive_level", """SELECT event_type AS series, round(list_reduce(list_prepend(0.05::DOUBLE, list(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END::DOUBLE ORDER BY event_id)),
   lambda level, alert: greatest(0, least(1, level + 0.01 * (0.05 - alert)))), 6) AS level FROM events GROUP BY 1""")
def _(t, spark):
    alerts = t("events").select(F.col("event_type").alias("series"), F.col("event_id").alias("t"), (F.col("event_id") % 20 == 0).cast("int").alias("alert"))
    return rounded(monitor.adaptive_level(alerts), "level")


@query("seasonal_groups", """WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS t FROM events GROUP BY 1, 2), e AS (SELECT *, (isodow(t) - 1) AS wd, CASE WHEN isodow(t) <= 5 THEN 'workday' ELSE 'weekend' END AS k FROM d),
   c AS (SELECT *, count(*) OVER (PARTITION BY series, wd) AS cd, count(*) OVER (PARTITION BY series, k) AS ck FROM e)
   SELECT series, CAST(t AS VARCHAR) AS t, CASE WHEN min(cd) OVER s >= 4 THEN CAST(wd AS VARCHAR) WHEN min(ck) OVER s >= 4 THEN k ELSE 'all' END AS season FROM c WINDOW s AS (PARTITION BY series)""")
def _(t, spark):
    return monitor.seasonal_groups(daily(t), 4).select("series", "t", "season")


@query("latest_metric", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t, spark):
    return readers.latest(t("events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("watermark_incremental", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 6 HOURS GROUP BY 1")
def _(t, spark):
    return readers.changed_since(t("events"), "ts", "2024-01-20 00:00:00", 6 * 3600).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


STREAM = [RowCheck("value", "value >= 10"), RowCheck("kind", "event_type in ('click', 'view')")]


def stream_of(t, spark):
    """The events as a stream of files."""
    events = t("events")
    folder = events.inputFiles()[0].rpartition("/")[0]
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(folder)


def drained(stream, spark, mode="append"):
    """What a stream yields when everything there is has been read.

    Rows and state are kept in the shared folder; only what is complete after each
    batch, a row for each group, goes by way of the driver.
    """
    from ..sources.store import cut, folder

    name = f"s{uuid.uuid4().hex}"
    at = f"{folder(spark)}/{name}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{at}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    writer.format("memory").queryName(name).start().awaitTermination()
    out = cut(spark.table(name))
    spark.catalog.dropTempView(name)
    return out


@query("tumbling_window_verdicts", """SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, control, count(*) AS scanned_rows, count(*) FILTER (WHERE NOT coalesce(ok, FALSE)) AS violating_rows,
   CASE WHEN count(*) FILTER (WHERE NOT coalesce(ok, FALSE)) = 0 THEN 'pass' ELSE 'fail' END AS verdict
   FROM (SELECT ts, 'value' AS control, value >= 10 AS ok FROM events UNION ALL SELECT ts, 'kind', event_type IN ('click', 'view') FROM events) GROUP BY 1, 2""")
def _(t, spark):
    out = drained(judge.window_verdicts(stream_of(t, spark), STREAM, "ts", "1 day"), spark, "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("tag_stream", "SELECT concat_ws(',', CASE WHEN NOT coalesce(value >= 10, FALSE) THEN 'value' END, CASE WHEN NOT coalesce(event_type IN ('click', 'view'), FALSE) THEN 'kind' END) AS violations, count(*) AS n FROM events GROUP BY 1")
def _(t, spark):
    tagged = judge.tag(stream_of(t, spark), STREAM).select(F.array_join("violations", ",").alias("violations"))
    return drained(tagged.groupBy("violations").agg(F.count(F.lit(1)).alias("n")), spark, "complete")


@query("count_window_verdicts", "SELECT event_type AS key, CAST(sum(n // 100) AS BIGINT) AS windows FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def _(t, spark):
    out = drained(judge.count_windows(stream_of(t, spark), STREAM[0], "event_type", 100), spark)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "season_lattice",
    """WITH e AS (SELECT event_type AS series, event_id, ts, CAST(ts AS DATE) AS d, event_id % 40 = 0 AS payday FROM events),
      f AS (SELECT *, isodow(d) <= 5 AS w, CASE WHEN isodow(d) = 5 THEN d + 3 WHEN isodow(d) = 6 THEN d + 2 ELSE d + 1 END AS after FROM e),
      g AS (SELECT *, CASE WHEN NOT w THEN 'none' WHEN year(after) <> year(d) THEN 'year' WHEN quarter(after) <> quarter(d) THEN 'quarter' WHEN month(after) <> month(d) THEN 'month' ELSE 'none' END AS p FROM f),
      l AS (SELECT *, unnest([{'i': 0, 'n': 'hour', 's': concat('working=', w, ', period=', p, ', weekday=', isodow(d) - 1, ', hour=', hour(ts), ', declared_payday=', payday)},
          {'i': 1, 'n': 'weekday', 's': concat('working=', w, ', period=', p, ', weekday=', isodow(d) - 1, ', declared_payday=', payday)}, {'i': 2, 'n': 'period', 's': concat('working=', w, ', period=', p, ', declared_payday=', payday)},
          {'i': 3, 'n': 'any period', 's': concat('working=', w, ', any_period=', p <> 'none', ', declared_payday=', payday)}, {'i': 4, 'n': 'working day', 's': concat('working=', w, ', declared_payday=', payday)},
          {'i': 5, 'n': 'declared', 's': concat('declared_payday=', payday)}, {'i': 6, 'n': 'all', 's': ''}]) AS x FROM g),
      c AS (SELECT series, event_id, x, count(*) OVER (PARTITION BY series, x) AS members FROM l),
      b AS (SELECT series, event_id, min(struct_pack(i := x.i, n := x.n, s := x.s, m := members)) AS b FROM c WHERE members >= 20 OR x.n = 'all' GROUP BY 1, 2)
      SELECT series, b.n AS level, b.s AS season, b.m AS members, count(*) AS points FROM b GROUP BY ALL""",
)
def _(t, spark):
    """Every event as a point of its type's series; the comparable ones of each."""
    e = t("events").select(F.col("event_type").alias("series"), F.col("ts").alias("t"), "event_id")
    out = monitor.season_lattice(e, 20, intraday=True, drivers={"payday": F.col("event_id") % 40 == 0})
    return out.groupBy("series", "level", "season", "members").agg(F.count(F.lit(1)).alias("points"))


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(
    "opened_window_verdicts",
    """WITH RECURSIVE u AS (SELECT user_id, list(ts ORDER BY ts) AS ts FROM events GROUP BY 1),
       w AS (SELECT user_id, ts, ts[1] AS s FROM u UNION ALL SELECT user_id, rest, rest[1] FROM (SELECT user_id, list_filter(ts, lambda x: x >= s + INTERVAL 36 HOUR) AS rest FROM w) WHERE len(rest) > 0),
       n AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS next FROM w), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
       SELECT CAST(user_id AS VARCHAR) AS key, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS scanned_rows, count(*) FILTER (WHERE NOT coalesce(value >= 10, FALSE)) AS violating_rows,
         CASE WHEN count(*) FILTER (WHERE NOT coalesce(value >= 10, FALSE)) = 0 THEN 'pass' ELSE 'fail' END AS verdict
       FROM n JOIN events USING (user_id), m WHERE ts >= s AND ts < s + INTERVAL 36 HOUR AND (next IS NOT NULL OR s + INTERVAL 36 HOUR <= mark) GROUP BY 1, 2""",
)
def _(t, spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        out = drained(judge.opened_windows(stream_of(t, spark), STREAM[0], "user_id", "ts", 36 * 3600, "1 hour"), spark)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "stream_reconciliation",
    """WITH l AS (SELECT event_id AS k, ts AS a, value AS v FROM events WHERE event_id % 10 <> 9),
       r AS (SELECT event_id AS k, ts + CASE event_id % 6 WHEN 1 THEN INTERVAL 7 MINUTE WHEN 2 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 MINUTE END AS a, CASE WHEN event_id % 7 = 3 THEN value + 5 ELSE value END AS v FROM events WHERE event_id % 10 <> 8),
       m AS (SELECT least((SELECT max(a) FROM l), (SELECT max(a) FROM r)) - INTERVAL 1 HOUR AS mark),
       j AS (SELECT l.k AS lk, r.k AS rk, l.a AS la, r.a AS ra, l.v AS lv, r.v AS rv FROM l FULL JOIN r ON l.k = r.k AND r.a BETWEEN l.a - INTERVAL 30 MINUTE AND l.a + INTERVAL 30 MINUTE)
       SELECT CASE WHEN rk IS NULL THEN 'missing' WHEN lk IS NULL THEN 'extra' WHEN NOT coalesce(abs(lv - rv) <= 1, lv IS NULL AND rv IS NULL) THEN 'off' ELSE 'matched' END AS kind, count(*) AS n, min(coalesce(lk, rk)) AS first, max(coalesce(lk, rk)) AS last
       FROM j, m WHERE (lk IS NOT NULL AND rk IS NOT NULL) OR coalesce(la, ra) + INTERVAL 30 MINUTE < mark GROUP BY 1""",
)
def _(t, spark):
    """Two replays of the events as streams, one of them late, off or short of some messages."""
    shift = F.when(F.col("event_id") % 6 == 1, 7).when(F.col("event_id") % 6 == 2, 180).otherwise(0)
    left = stream_of(t, spark).where("event_id % 10 <> 9")
    right = stream_of(t, spark).where("event_id % 10 <> 8").withColumns(
        {"ts": F.col("ts") + F.make_dt_interval(mins=shift), "value": F.when(F.col("event_id") % 7 == 3, F.col("value") + 5).otherwise(F.col("value"))}
    )
    out = drained(judge.reconciled(left, right, "event_id", "value", "ts", "30 minutes", "1 hour", 1.0), spark)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
