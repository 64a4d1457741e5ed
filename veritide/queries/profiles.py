"""Profiles and mined constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.predicates import character_mask
from ..operators import classify, mining, profile
from .catalogue import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS stddev FROM lineitem"""
        for c in NUMBERS
    ),
)
def _(t, spark):
    p = profile.columns(t("lineitem"), NUMBERS, metrics=("rows", "nulls", "min", "max", "mean", "stddev"))
    return p.select("column", "rows", "nulls", "min", "max", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


@query(
    "profile_string",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, round(avg(length({c})), 4) AS mean_length, count(*) FILTER (WHERE trim({c}) = '') AS blanks FROM customer"""
        for c in ("c_name", "c_mktsegment")
    ),
)
def _(t, spark):
    p = profile.columns(t("customer"), ["c_name", "c_mktsegment"], metrics=("rows", "nulls", "min_length", "max_length", "mean_length", "blanks"))
    return p.select("column", "rows", "nulls", "min_length", "max_length", F.round("mean_length", 4).alias("mean_length"), "blanks")


@query("profile_segmented", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def _(t, spark):
    e = t("events").withColumn("day", F.to_date("ts").cast("string"))
    return profile.columns(e, ["value"], by=["day"], metrics=("rows", "min", "max", "mean")).select("day", "rows", "min", "max", F.round("mean", 4).alias("mean"))


@query("profile_distinct_estimate")
def _(t, spark):
    return profile.columns(t("lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"], metrics=("distinct",)).select("column", "distinct")


@query("exact_quantiles", "SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS quantile, round(unnest(quantile_cont(o_totalprice, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])), 4) AS value FROM orders")
def _(t, spark):
    return profile.exact_quantiles(t("orders"), "o_totalprice").select("quantile", F.round("value", 4).alias("value"))


@query("approximate_quantiles")
def _(t, spark):
    return profile.approximate_quantiles(t("orders"), "o_totalprice")


@query("masks", "SELECT regexp_replace(regexp_replace(regexp_replace(substr(c_name, 1, 64), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') AS mask, count(*) AS n FROM customer GROUP BY 1")
def _(t, spark):
    return t("customer").groupBy(character_mask("c_name").alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query("top_values", "SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS rows FROM lineitem GROUP BY 1 ORDER BY rows DESC, value LIMIT 20")
def _(t, spark):
    return profile.top_values(t("lineitem"), "l_partkey")


@query("top_masks", "SELECT regexp_replace(regexp_replace(regexp_replace(p_brand, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') AS value, count(*) AS rows FROM part GROUP BY 1 ORDER BY rows DESC, value LIMIT 5")
def _(t, spark):
    return profile.top_masks(t("part"), "p_brand")


@query("character_classes", r"SELECT count(*) FILTER (WHERE regexp_matches(p_name, '[0-9]')) AS digits, count(*) FILTER (WHERE regexp_matches(p_name, '[A-Z]')) AS capitals, count(*) FILTER (WHERE regexp_matches(p_name, '[a-z]')) AS small, count(*) FILTER (WHERE regexp_matches(p_name, '[!-/:-@\[-`{-~]')) AS punctuation, count(*) FILTER (WHERE regexp_matches(p_name, '[^\x00-\x7F]')) AS beyond_ascii FROM part")
def _(t, spark):
    return profile.character_classes(t("part"), "p_name")


@query("merged_sketches")
def _(t, spark):
    parts = profile.sketches(t("events").withColumn("day", F.to_date("ts")), ["user_id", "event_type"], ["day"])
    return profile.merge_sketches(parts, ["user_id", "event_type"])


@query("segments_to_profile", """WITH d AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS segment FROM events), r AS (SELECT segment, row_number() OVER (ORDER BY segment DESC) AS k, CAST(right(segment, 2) AS INTEGER) AS n FROM d)
   SELECT segment, CASE WHEN n % 7 = 0 THEN 'new' WHEN n % 5 = 0 THEN 'changed' WHEN k <= 3 THEN 'mutable' ELSE 'settled' END AS state FROM r""")
def _(t, spark):
    n = F.right("segment", F.lit(2)).cast("int")
    now = t("events").groupBy(F.to_date("ts").cast("string").alias("segment")).agg(F.count(F.lit(1)).alias("fingerprint"))
    old = now.where(n % 7 != 0).withColumn("fingerprint", F.col("fingerprint") + F.when(n % 5 == 0, 1).otherwise(0))
    return profile.segment_plan(now, old)


@query("key_candidates", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS key_candidate, count(DISTINCT {c}) = 1 AS constant FROM nation""" for c in ("n_nationkey", "n_name", "n_regionkey")))
def _(t, spark):
    return profile.key_candidates(profile.columns(t("nation")))


@query("key_mining", """SELECT 'o_orderkey' AS key, 1.0::DOUBLE AS unique_rate WHERE (SELECT count(DISTINCT o_orderkey) >= 0.999 * count(*) FROM orders)
   UNION ALL SELECT 'o_custkey,o_orderdate', (SELECT count(DISTINCT (o_custkey, o_orderdate))::DOUBLE / count(*) FROM orders) WHERE (SELECT count(DISTINCT (o_custkey, o_orderdate)) >= 0.999 * count(*) AND count(DISTINCT o_custkey) < 0.999 * count(*) AND count(DISTINCT o_orderdate) < 0.999 * count(*) FROM orders)""")
def _(t, spark):
    return mining.keys(t("orders"), ["o_orderkey", "o_custkey", "o_orderdate"], most=2)


def _support(det, dep, source):
    cols = ", ".join(det)
    return f"""SELECT '{','.join(det)}' AS determinant, '{dep}' AS dependent, CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, sum(top)::DOUBLE / sum(n) AS support
      FROM (SELECT {cols}, sum(n) AS n, max(n) AS top FROM (SELECT {cols}, {dep}, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {cols})"""


FD_COLUMNS = ["c_custkey", "c_nationkey", "region", "c_mktsegment"]
FD_SOURCE = "(SELECT c_custkey, c_nationkey, n_regionkey AS region, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(
    "fd_mining",
    "SELECT * FROM (" + " UNION ALL ".join(_support([a], b, FD_SOURCE) for a in FD_COLUMNS for b in FD_COLUMNS if a != b) + ") WHERE support >= 0.95 AND groups < 0.9 * rows",
)
def _(t, spark):
    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("region"), "c_mktsegment")
    return mining.dependencies(df, most=1)


@query("conditional_dependencies", "SELECT o_orderstatus AS value, count(*) AS rows FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t, spark):
    o = t("orders").withColumn("tag", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 7).otherwise(F.col("o_orderkey")))
    return mining.conditional_dependencies(o, "o_orderstatus", "o_custkey", "tag")


@query("conditional_completeness", """SELECT event_type AS value, 'v' AS "column", count(*) AS rows FROM events WHERE event_type < 'p' GROUP BY 1 HAVING count(*) >= 50""")
def _(t, spark):
    e = t("events").withColumn("v", F.when((F.col("event_type") < "p") | (F.col("event_id") % 2 == 0), F.col("value")))
    return mining.conditional_completeness(e, "event_type", ["v"])


@query(
    "inclusion_mining",
    """SELECT 'orders.o_custkey' AS child, 'customer.c_custkey' AS parent, 1.0::DOUBLE AS containment, 0::BIGINT AS orphans
       UNION ALL SELECT 'customer.c_nationkey', 'nation.n_nationkey', 1.0, 0 UNION ALL SELECT 'nation.n_nationkey', 'customer.c_custkey', (SELECT count(*) FILTER (WHERE n_nationkey IN (SELECT c_custkey FROM customer))::DOUBLE / count(*) FROM nation), (SELECT count(*) FILTER (WHERE n_nationkey NOT IN (SELECT c_custkey FROM customer)) FROM nation)
       UNION ALL SELECT 'customer.c_nationkey', 'customer.c_custkey', (SELECT count(DISTINCT c_nationkey) FILTER (WHERE c_nationkey IN (SELECT c_custkey FROM customer))::DOUBLE / count(DISTINCT c_nationkey) FROM customer), (SELECT count(DISTINCT c_nationkey) FILTER (WHERE c_nationkey NOT IN (SELECT c_custkey FROM customer)) FROM customer)""",
)
def _(t, spark):
    tables = {n: t(n) for n in ("orders", "customer", "nation")}
    return mining.inclusions(tables, {"orders": ["o_custkey"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey"]})


@query("ordering_invariants", """SELECT * FROM (SELECT 'l_discount' AS low, 'l_extendedprice' AS high, count(*) FILTER (WHERE l_discount < l_extendedprice) >= 0.97 * count(*) AS strict, count(*) AS rows, count(*) FILTER (WHERE l_discount <= l_extendedprice)::DOUBLE / count(*) AS support FROM lineitem HAVING NOT max(l_discount) < min(l_extendedprice)
   UNION ALL SELECT 'net', 'l_extendedprice', FALSE, count(*), 1.0 FROM lineitem) WHERE support >= 0.97""")
def _(t, spark):
    df = t("lineitem").withColumn("net", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice") - 1).otherwise(F.col("l_extendedprice")))
    return mining.orderings(df, ["l_discount", "l_extendedprice", "net"]).where("high = 'l_extendedprice'")


@query("arithmetic_identities", "SELECT 'l_extendedprice' AS a, '*' AS op, 'l_tax' AS b, 'tax' AS c, count(*) AS rows, 1.0::DOUBLE AS support FROM lineitem UNION ALL SELECT 'l_extendedprice', '+', 'tax', 'gross', count(*), 1.0 FROM lineitem")
def _(t, spark):
    df = t("lineitem").withColumn("tax", F.col("l_extendedprice") * F.col("l_tax")).withColumn("gross", F.col("l_extendedprice") + F.col("tax"))
    return mining.identities(df, ["l_extendedprice", "l_tax", "tax", "gross"])


@query("column_type_hit_rates", """SELECT 'ip' AS "column", 'ipv4' AS type, count(*) AS values, 1.0::DOUBLE AS rate FROM events UNION ALL SELECT 'day', 'iso_date', count(*), 1.0 FROM events""")
def _(t, spark):
    df = t("events").select(F.concat((F.col("event_id") % 250).cast("string"), F.lit(".0.0.1")).alias("ip"), F.to_date("ts").cast("string").alias("day"), "event_type")
    return mining.column_types(df, df.columns, {k: V.VALIDATORS[k] for k in ("ipv4", "iso_date", "email", "uuid", "lei")})


def labelled(t):
    # Rows are dealt out before some twenty checks each, as a table's file may be a single split.
    e, id_ = t("events").repartition("event_id"), F.col("event_id")
    ip = F.concat((id_ % 250).cast("string"), F.lit(".0.0.1"))
    return e.select(
        ip.alias("ip"), F.lit("GB0000000000").alias("isin"), F.concat(F.lit("X"), F.lpad((id_ % 1000).cast("string"), 3, "0")).alias("entity_lei"), ip.alias("settlement_ccy"),
        F.when(id_ % 3 == 0, "SELL").otherwise(" buy ").alias("side"), F.lit("BUY").alias("only"), F.when(id_ % 50 == 7, F.concat(F.lit("AB"), (10 + id_ % 90).cast("string"))).alias("few"),
        F.when(id_ % 10 < 9, F.to_date("ts").cast("string")).otherwise("soon").alias("trade_date"), F.when(id_ < 7, F.lit("a@b.cd")).alias("note"),
    )


@query(
    "column_classes",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 50 = 7) AS f, count(*) FILTER (WHERE event_id % 10 < 9) AS d FROM events), x AS (
         SELECT 'ip' AS "column", 'ipv4' AS type, 'check' AS stage, 1.0::DOUBLE AS rate, n AS examined, n * ln(0.35) AS e, NULL AS sure, '' AS conflicts FROM c
         UNION ALL SELECT 'isin', 'isin', 'name', 0.0, 0, NULL, 0.4, 'refuted' FROM c UNION ALL SELECT 'entity_lei', 'mic', 'shape', 1.0, n, NULL, 0.5 + 0.35 * (1 - exp(-n / 50.0)), 'refuted' FROM c
         UNION ALL SELECT 'settlement_ccy', 'ipv4', 'check', 1.0, n, n * ln(0.35), NULL, 'misnamed' FROM c UNION ALL SELECT 'side', 'trade_side', 'code list', 1.0, n, n * ln(2.0 / 36 ** 4), NULL, '' FROM c
         UNION ALL SELECT 'only', 'trade_side', 'code list', 1.0, n, NULL, 0.5, '' FROM c UNION ALL SELECT 'few', 'mic', 'shape', 1.0, f, NULL, 0.5 + 0.35 * (1 - exp(-f / 50.0)), '' FROM c
         UNION ALL SELECT 'trade_date', 'iso_date', 'check', d / n, n, d * ln(0.78), NULL, '' FROM c UNION ALL SELECT 'note', NULL, NULL, NULL, 0, NULL, NULL, '' FROM c)
       SELECT "column", type, stage, CASE WHEN rate >= 0.99 THEN 'clean' WHEN rate >= 0.8 OR stage = 'name' THEN 'contaminated' END AS fit, round(rate, 6) AS rate, examined, round(conf, 6) AS confidence, coalesce(stage <> 'name' AND rate >= 0.8 AND conf >= 0.8, FALSE) AS evidence, conflicts
       FROM (SELECT *, coalesce(sure, CASE WHEN e < -36 THEN 1 ELSE 1 - exp(e) END) AS conf FROM x)""",
)
def _(t, spark):
    out = classify.classify(labelled(t)).select("column", "type", "stage", "fit", "rate", "examined", "confidence", "evidence", F.array_join("conflicts", ",").alias("conflicts"))
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "confidence")})


@query("name_contradictions", "SELECT r AS rank, c AS \"column\", named, type, conflict, 1.0::DOUBLE AS failing FROM (VALUES (1, 'entity_lei', 'lei', 'mic', 'refuted'), (2, 'isin', 'isin', 'isin', 'refuted'), (3, 'settlement_ccy', 'iso4217', 'ipv4', 'misnamed')) v(r, c, named, type, conflict) WHERE (SELECT count(*) FROM events) >= 8")
def _(t, spark):
    return classify.contradictions(classify.classify(labelled(t)))


@query(
    "merged_tails",
    """WITH v AS (SELECT l_returnflag AS flag, CASE WHEN l_linenumber = 3 THEN -l_extendedprice WHEN l_linenumber = 5 THEN 0 ELSE l_extendedprice * l_quantity * l_quantity END::DOUBLE AS v FROM lineitem),
       r AS (SELECT flag, v, row_number() OVER (PARTITION BY flag ORDER BY v) AS r, count(*) OVER (PARTITION BY flag) AS n FROM v),
       e AS (SELECT flag, q, n, v FROM r, (VALUES (0.0), (0.05), (0.25), (0.5), (0.95), (0.99), (0.999), (1.0)) t(q) WHERE r = greatest(ceil(q * n), 1))
       SELECT flag, q::DOUBLE AS quantile, n, v = 0 AS zero, v < 0 AS negative, TRUE AS within FROM e""",
)
def _(t, spark):
    """Magnitudes by day of receipt, merged by flag; each quantile is held against the exact one."""
    at = (0.0, 0.05, 0.25, 0.5, 0.95, 0.99, 0.999, 1.0)
    value = F.when(F.col("l_linenumber") == 3, -F.col("l_extendedprice")).when(F.col("l_linenumber") == 5, 0).otherwise(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity"))
    rows = t("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("day"), value.cast("double").alias("v"))
    got = profile.magnitude_quantiles(profile.magnitudes(rows, "v", ["flag", "day"]), at, ["flag"])
    true = profile.ranked_quantiles(rows, "v", at, ["flag"]).select(F.col("flag").alias("f"), F.col("quantile").alias("q"), F.col("value").alias("x"))
    both = got.join(true, (F.col("flag") == F.col("f")) & (F.col("quantile") == F.col("q")))
    return both.select("flag", "quantile", "n", (F.col("value") == 0).alias("zero"), (F.col("value") < 0).alias("negative"), (F.abs(F.col("value") - F.col("x")) <= 0.0010001 * F.abs("x")).alias("within"))


@query(
    "merged_segment_quantiles",
    "SELECT l_returnflag AS flag, q::DOUBLE AS quantile, count(*) AS n, TRUE AS near FROM lineitem, (VALUES (0.01), (0.25), (0.5), (0.75), (0.99)) t(q) GROUP BY 1, 2",
)
def _(t, spark):
    """Quantile sketches of each flag and line number, folded to flags; near: the value's true rank is within 0.3 % of the quantile."""
    rows = t("lineitem").select(F.col("l_returnflag").alias("flag"), "l_linenumber", F.col("l_extendedprice").cast("double").alias("v"))
    folded = profile.merged_ranks(profile.sketches(rows, ["v"], ["flag", "l_linenumber"]), "v", (0.01, 0.25, 0.5, 0.75, 0.99), ["flag"])
    asked = folded.groupBy(F.col("flag").alias("f")).agg(F.collect_list(F.struct("quantile", "value", "n")).alias("asked"))
    at_most = rows.join(F.broadcast(asked), F.col("flag") == F.col("f")).select("flag", "v", F.explode("asked").alias("a"))
    counted = at_most.groupBy("flag", "a.quantile", "a.n").agg(F.count_if(F.col("v") <= F.col("a.value")).alias("upto"), F.count_if(F.col("v") < F.col("a.value")).alias("below"))
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    return counted.select("flag", "quantile", "n", ((low <= F.col("quantile") + 0.003) & (high >= F.col("quantile") - 0.003)).alias("near"))
