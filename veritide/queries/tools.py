"""Imports of other tools' rules, metric points, sketches, dated rates, code mapping, selection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import diff, entity, feeds, lineage, mining, monitor, profile, reconcile, score
from ..plans import imports, suite
from ..sources import readers
from . import movement, series
from .catalogue import query

DBT = {
    "models": [
        {
            "name": "orders",
            "tests": [{"dbt_utils.expression_is_true": {"expression": "o_totalprice > 1000"}}, {"dbt_utils.unique_combination_of_columns": {"combination_of_columns": ["o_custkey", "o_orderdate"]}}, "made_up"],
            "columns": [
                {"name": "o_orderkey", "tests": ["unique", "not_null"]},
                {"name": "o_orderstatus", "tests": [{"accepted_values": {"values": ["F", "O"]}}]},
                {"name": "o_custkey", "tests": [{"relationships": {"to": "ref('customer')", "field": "c_custkey"}}]},
                {"name": "o_totalprice", "tests": [{"dbt_utils.accepted_range": {"min_value": 2000, "inclusive": False}}, {"dbt_utils.not_null_proportion": {"at_least": 0.9}}]},
            ],
        }
    ]
}


def _rows(parts):
    """(control, counts of violating rows) as one statement."""
    return " UNION ALL ".join(f"SELECT '{name}' AS control, (SELECT count(*) FROM orders{where}) AS scanned_rows, CAST(({bad}) AS BIGINT) AS violating_rows, CASE WHEN ({ok}) THEN 'pass' ELSE 'fail' END AS verdict" for name, where, bad, ok in parts)


def _zero(name, bad, where=""):
    return (name, where, bad, f"({bad}) = 0")


@query(
    "dbt_tests",
    _rows(
        [
            _zero("orders.expression_is_true", "SELECT count(*) FROM orders WHERE NOT o_totalprice > 1000"),
            _zero("orders.unique_combination_of_columns", "SELECT count(*) - count(DISTINCT (o_custkey, o_orderdate)) FROM orders"),
            _zero("orders.o_orderkey.unique", "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders"),
            _zero("orders.o_orderkey.not_null", "SELECT count(*) FROM orders WHERE o_orderkey IS NULL"),
            _zero("orders.o_orderstatus.accepted_values", "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
            _zero("orders.o_custkey.relationships", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
            _zero("orders.o_totalprice.accepted_range", "SELECT count(*) FROM orders WHERE NOT o_totalprice > 2000"),
            ("orders.o_totalprice.not_null_proportion", "", "SELECT count(*) FROM orders WHERE o_totalprice IS NULL", "(SELECT count(*) FROM orders WHERE o_totalprice IS NULL) <= 0.1 * (SELECT count(*) FROM orders)"),
        ]
    ),
)
def _(t, spark):
    found = imports.from_dbt(DBT)
    assert [w for w, _ in found.unmapped] == ["orders: made_up"]
    return suite.evaluate(t("orders"), found.controls["orders"], parents={"customer": t("customer")})


SODA = {
    "checks for orders": [
        "row_count between 1 and 1000000000", "missing_count(o_totalprice) = 0", "duplicate_count(o_custkey, o_orderdate) = 0", "missing_percent(o_custkey) < 5%",
        {"invalid_percent(o_orderstatus) < 40 %": {"valid values": ["F", "O"]}}, {"invalid_count(o_orderpriority) = 0": {"valid regex": "^[1-5]-.*"}}, "values in (o_custkey) must exist in customer (c_custkey)",
        "avg(o_totalprice) > 5", "missing_count(o_custkey) > 3",
    ],
    "filter orders": [],
}


@query(
    "soda_checks",
    _rows(
        [
            ("orders: row_count between 1 and 1000000000", "", "SELECT 0", "(SELECT count(*) FROM orders) BETWEEN 1 AND 1000000000"),
            _zero("orders: missing_count(o_totalprice) = 0", "SELECT count(*) FROM orders WHERE o_totalprice IS NULL"),
            _zero("orders: duplicate_count(o_custkey, o_orderdate) = 0", "SELECT count(*) - count(DISTINCT (o_custkey, o_orderdate)) FROM orders"),
            _zero("orders: missing_percent(o_custkey) < 5%", "SELECT count(*) FROM orders WHERE o_custkey IS NULL"),
            ("orders: invalid_percent(o_orderstatus) < 40 %", "", "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", "(SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) < 0.4 * (SELECT count(*) FROM orders)"),
            _zero("orders: invalid_count(o_orderpriority) = 0", "SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-')"),
            _zero("orders: values in (o_custkey) must exist in customer (c_custkey)", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
        ]
    ),
)
def _(t, spark):
    found = imports.from_soda(SODA)
    assert len(found.unmapped) == 3
    return suite.evaluate(t("orders"), found.controls["orders"], parents={"customer": t("customer")})


EXPECTATIONS = {
    "expectations": [
        {"expectation_type": "expect_column_values_to_not_be_in_set", "kwargs": {"column": "l_linestatus", "value_set": ["X"]}},
        {"type": "expect_column_value_lengths_to_equal", "kwargs": {"column": "l_returnflag", "value": 1}},
        {"type": "expect_column_values_to_be_between", "kwargs": {"column": "l_quantity", "min_value": 5, "max_value": 45, "mostly": 0.7}},
        {"type": "expect_compound_columns_to_be_unique", "kwargs": {"column_list": ["l_orderkey", "l_linenumber"]}},
        {"type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}},
    ]
}


@query(
    "expectation_suite",
    """WITH n AS (SELECT count(*) AS n FROM lineitem), r AS (
         SELECT 'lineitem.0.expect_column_values_to_not_be_in_set' AS control, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'X') AS bad, 0.0 AS most
         UNION ALL SELECT 'lineitem.1.expect_column_value_lengths_to_equal', (SELECT count(*) FROM lineitem WHERE length(l_returnflag) <> 1), 0.0
         UNION ALL SELECT 'lineitem.2.expect_column_values_to_be_between', (SELECT count(*) FROM lineitem WHERE NOT l_quantity BETWEEN 5 AND 45), 0.3
         UNION ALL SELECT 'lineitem.3.expect_compound_columns_to_be_unique', (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem), 0.0
         UNION ALL SELECT 'lineitem.4.expect_table_row_count_to_be_between', 0, 0.0)
       SELECT control, n AS scanned_rows, bad AS violating_rows, CASE WHEN bad <= most * n THEN 'pass' ELSE 'fail' END AS verdict FROM r, n""",
)
def _(t, spark):
    return suite.evaluate(t("lineitem"), imports.from_expectations("lineitem", EXPECTATIONS).controls["lineitem"])


CONTRACT = {
    "schema": [
        {
            "name": "customer",
            "properties": [
                {"name": "c_custkey", "primaryKey": True, "primaryKeyPosition": 1, "required": True}, {"name": "c_acctbal", "logicalTypeOptions": {"minimum": 0, "maximum": 9000}},
                {"name": "c_mktsegment", "logicalTypeOptions": {"enum": ["BUILDING", "MACHINERY"]}},
            ],
        }
    ]
}


@query(
    "contract_controls",
    """WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT 'customer.grain' AS control, (SELECT count(*) - count(DISTINCT c_custkey) FROM customer) AS bad
         UNION ALL SELECT 'customer.c_custkey.complete', (SELECT count(*) FROM customer WHERE c_custkey IS NULL) UNION ALL SELECT 'customer.c_acctbal.low', (SELECT count(*) FROM customer WHERE c_acctbal < 0)
         UNION ALL SELECT 'customer.c_acctbal.high', (SELECT count(*) FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'customer.c_mktsegment.domain', (SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')))
       SELECT control, n AS scanned_rows, bad AS violating_rows, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM r, n""",
)
def _(t, spark):
    from ..plans import declare

    return suite.evaluate(t("customer"), declare.controls(imports.from_contract(CONTRACT)[0]))


@query("run_parameters", "SELECT 'dear' AS control, count(*) FILTER (WHERE o_orderstatus = 'F') AS scanned_rows, count(*) FILTER (WHERE o_orderstatus = 'F' AND NOT o_totalprice < 250000.5) AS violating_rows, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F' AND NOT o_totalprice < 250000.5) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM orders")
def _(t, spark):
    from ..plans.controls import RowCheck

    stated = [RowCheck("dear", "o_totalprice < $most", where="o_orderstatus = $status")]
    return suite.evaluate(t("orders"), imports.bind(stated, most=250000.5, status="F"))


@query("scan_limit", "SELECT 'price' AS control, least(count(*), 1000) AS scanned_rows, 0::BIGINT AS violating_rows, 'pass' AS verdict, 'preview' AS coverage FROM orders")
def _(t, spark):
    from ..plans.controls import RowCheck

    return suite.evaluate(t("orders"), [RowCheck("price", "o_orderkey IS NOT NULL")], scan_limit=1000)


@query("delegated_check", "SELECT 'digits' AS control, count(*) AS scanned_rows, count(*) FILTER (WHERE o_orderkey % 7 = 3) AS violating_rows, CASE WHEN count(*) FILTER (WHERE o_orderkey % 7 = 3) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM orders")
def _(t, spark):
    return suite.delegate(t("orders"), "digits", lambda rows: rows["o_orderkey"] % 7 == 3, ["o_orderkey"])


@query(
    "profile_points",
    " UNION ALL ".join(
        f"SELECT 'customer' AS dataset, '{c}' AS attribute, c_mktsegment AS segment, metric, value FROM (SELECT 'c_mktsegment=' || c_mktsegment AS c_mktsegment, unnest(['nulls', 'min', 'max', 'null_rate']) AS metric, unnest([(count(*) - count({c}))::DOUBLE, min({c})::DOUBLE, max({c})::DOUBLE, (count(*) - count({c}))::DOUBLE / count(*)]) AS value FROM customer GROUP BY c_mktsegment)"
        for c in ("c_custkey", "c_acctbal")
    )
    + " UNION ALL SELECT 'customer', NULL, 'c_mktsegment=' || c_mktsegment, 'row_count', count(*)::DOUBLE FROM customer GROUP BY c_mktsegment",
)
def _(t, spark):
    by = ["c_mktsegment"]
    points = profile.metric_points(profile.columns(t("customer"), ["c_custkey", "c_acctbal"], by=by), "customer", "2024-01-01 00:00:00", by=by)
    return points.where("metric IN ('nulls', 'min', 'max', 'null_rate', 'row_count')").select("dataset", "attribute", "segment", "metric", "value")


@query(
    "profile_suggestions",
    """SELECT 'c_custkey' AS "column", 'grain' AS suggestion, TRUE AS prefill FROM customer HAVING count(DISTINCT c_custkey) = count(*)
       UNION ALL SELECT 'c_custkey', 'required', TRUE FROM customer HAVING count(c_custkey) = count(*) UNION ALL SELECT 'c_mktsegment', 'required', TRUE FROM customer HAVING count(c_mktsegment) = count(*)
       UNION ALL SELECT 'gone', 'always null: worth a look', FALSE UNION ALL SELECT 'one', 'constant: worth a look', FALSE UNION ALL SELECT 'one', 'required', TRUE""",
)
def _(t, spark):
    df = t("customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("gone"), F.lit("x").alias("one"))
    return profile.suggested(profile.columns(df))


@query("count_min", "SELECT user_id AS value, count(*) AS estimate FROM events GROUP BY 1")
def _(t, spark):
    e = t("events")
    wide = {"width": 1 << 20, "depth": 7}
    return profile.count_min_estimate(profile.count_min(e, "user_id", **wide), e.select("user_id").distinct(), "user_id", **wide)


@query(
    "dated_rates",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), q AS (SELECT day, 1 + (day - DATE '1990-01-01') % 10 / 10.0 AS rate FROM d WHERE (day - DATE '1990-01-01') % 5 <> 0),
       a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS ccy FROM orders),
       b AS (SELECT a.o_orderkey, a.day, ccy, (SELECT max(q.day) FROM q WHERE q.day BETWEEN a.day - 2 AND a.day) AS of FROM a)
       SELECT o_orderkey, CASE WHEN ccy = 'USD' THEN 1.0 WHEN ccy = 'EUR' THEN q.rate::DOUBLE ELSE round(1 / (q.rate::DOUBLE * 100), 12) END AS rate, CAST(CASE WHEN ccy = 'USD' THEN b.day ELSE of END AS VARCHAR) AS rate_day
       FROM b LEFT JOIN q ON q.day = b.of""",
)
def _(t, spark):
    o = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    number = F.date_diff("day", F.lit("1990-01-01").cast("date"))
    known = o.select("day").distinct().where(number % 5 != 0).withColumn("r", (1 + (number % 10) / 10.0))
    rates = known.select(F.lit("EUR").alias("source"), F.lit("USD").alias("target"), "day", F.col("r").alias("rate")).union(known.select(F.lit("USD"), F.lit("JPY"), "day", F.col("r") * 100))
    third = F.col("o_orderkey") % 3
    amounts = o.withColumn("ccy", F.when(third == 0, "USD").when(third == 1, "eur").otherwise("JPY"))
    out = reconcile.dated_rates(amounts, rates, "ccy", "day", "USD", carry_days=2)
    return out.select("o_orderkey", F.when(third == 2, F.round("rate", 12)).otherwise(F.col("rate")).alias("rate"), F.col("rate_day").cast("string").alias("rate_day"))


@query("code_mapping", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' END AS o_orderstatus FROM orders")
def _(t, spark):
    mapping = spark.createDataFrame([("f", "FILLED"), ("O", "OPEN")], "code string, other string")
    return reconcile.map_codes(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", mapping, strict=False)


@query("unmapped_codes", "SELECT o_orderstatus AS code, count(*) AS rows FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def _(t, spark):
    return reconcile.unmapped_codes(t("orders"), "o_orderstatus", spark.createDataFrame([("f", "FILLED"), ("O", "OPEN")], "code string, other string"))


LEVELS = """p AS (SELECT o_orderpriority AS f, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 10 <> 0 THEN (o_orderkey % 7 + 1) / 1e7 WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 97 = 0 THEN 1e-12 ELSE (o_orderkey % 1000 + 1) / 1001.0 END AS p FROM orders)"""


@query(
    "family_rollup",
    f"""WITH {LEVELS}, k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p) AS k, count(*) OVER (PARTITION BY f) AS m FROM p),
       s AS (SELECT f, least(min(p * m / k), 1.0) AS p, any_value(m) AS m FROM k GROUP BY f), sk AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM s),
       sel AS (SELECT f, p, m FROM sk WHERE p <= (SELECT max(p) FROM sk WHERE p <= 0.05 * k / n)), lv AS (SELECT 0.05 * (SELECT count(*) FROM sel) / (SELECT count(*) FROM s) AS level),
       ext AS (SELECT sel.f, sel.p, count(*) FILTER (WHERE k.p <= level) AS below, any_value(k.m) AS m FROM sel JOIN k ON k.f = sel.f, lv GROUP BY sel.f, sel.p),
       cut AS (SELECT k.f, max(k.p) FILTER (WHERE k.p <= level * k.k / k.m) AS c FROM k JOIN sel USING (f), lv GROUP BY k.f)
       SELECT f AS family, NULL AS member, round(p, 12) AS p, below AS covers FROM ext WHERE m >= 5 AND below >= 0.6 * m
       UNION ALL SELECT k.f, CAST(o_orderkey AS VARCHAR), round(k.p, 12), 1 FROM k JOIN cut ON k.f = cut.f AND k.p <= c JOIN ext ON ext.f = k.f WHERE NOT (ext.m >= 5 AND below >= 0.6 * ext.m)""",
)
def _(t, spark):
    n, f = F.col("o_orderkey"), F.col("o_orderpriority")
    p = F.when((f == "1-URGENT") & (n % 10 != 0), (n % 7 + 1) / 1e7).when((f == "2-HIGH") & (n % 97 == 0), 1e-12).otherwise((n % 1000 + 1) / 1001.0)
    out = monitor.rolled_up(t("orders").select(f.alias("fam"), n.cast("string").alias("member"), p.alias("p")), "fam")
    return out.withColumn("p", F.round("p", 12))


@query(
    "first_day_priors",
    """SELECT n_name AS attribute, CASE WHEN n_nationkey % 4 = 0 THEN 0.0 WHEN n_nationkey % 4 = 1 THEN 0.0 WHEN n_nationkey % 4 = 2 THEN 0.05 ELSE 0.0 END AS low,
       CASE WHEN n_nationkey % 4 = 0 THEN 0.0 WHEN n_nationkey % 4 = 1 THEN 0.02 WHEN n_nationkey % 4 = 2 THEN 0.6 ELSE 0.2 END AS high, CASE n_nationkey % 4 WHEN 0 THEN 'declaration' WHEN 1 THEN 'semantic_type' WHEN 2 THEN 'siblings' ELSE 'default' END AS source FROM nation""",
)
def _(t, spark):
    four = F.col("n_nationkey") % 4
    siblings = F.when(four == 2, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))).otherwise(F.array(F.lit(0.1)))
    a = t("nation").select(F.col("n_name").alias("attribute"), (four == 0).alias("mandatory"), F.when(four == 1, "isin").alias("semantic_type"), siblings.alias("siblings"))
    return monitor.priors(a, {"isin": (0.0, 0.02)})


@query("watermark_scope", "SELECT 'pass over the rows examined' AS verdict, 'incremental' AS coverage, count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 HOUR OR user_id % 50 = 0 AND ts + INTERVAL 100 DAY >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 HOUR")
def _(t, spark):
    e = t("events").withColumn("changed", F.when(F.col("user_id") % 50 == 0, F.col("ts") + F.expr("INTERVAL 100 DAYS")))
    rows, coverage = readers.scan_scope(e, "ts", "2024-01-10 00:00:00", 3600, "changed")
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(readers.qualified(F.lit("pass"), coverage).alias("verdict"), F.lit(coverage).alias("coverage"), "rows")


@query("entailed_orderings", "SELECT 'a' AS low, 'b' AS high FROM lineitem HAVING min(l_quantity) >= 0 AND min(l_tax) >= 0 AND count(*) FILTER (WHERE l_tax * 100 <= l_quantity + 5) >= 0.97 * count(*)")
def _(t, spark):
    whole = t("lineitem").select((F.col("l_tax") * 100).alias("a"), (F.col("l_quantity") + 5).alias("b")).withColumn("c", F.col("a") + F.col("b"))
    # a <= c and b <= c follow from a + b = c; a <= b doesn't.
    return mining.not_entailed(whole, mining.orderings(whole).where("low < high"), mining.identities(whole)).select("low", "high")


@query(
    "meaning_groups",
    """SELECT 'm' || (n_nationkey % 5) AS meaning, 'concept' AS "by", 'd' || n_regionkey || '.' || n_name AS attribute FROM nation WHERE n_nationkey < 15 AND (SELECT count(DISTINCT n2.n_regionkey) FROM nation n2 WHERE n2.n_nationkey < 15 AND n2.n_nationkey % 5 = nation.n_nationkey % 5) >= 2
       UNION ALL SELECT 't', 'term', 'd' || n_regionkey || '.' || n_name FROM nation WHERE (n_nationkey >= 15 OR (SELECT count(DISTINCT n2.n_regionkey) FROM nation n2 WHERE n2.n_nationkey < 15 AND n2.n_nationkey % 5 = nation.n_nationkey % 5) < 2)""",
)
def _(t, spark):
    n = t("nation")
    a = n.select(
        F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("dataset"), F.col("n_name").alias("attribute"),
        F.when(F.col("n_nationkey") < 15, F.concat(F.lit("m"), (F.col("n_nationkey") % 5).cast("string"))).alias("concept"), F.lit("t").alias("term"), F.lit("s").alias("semantic_type"),
    )
    return mining.meaning_groups(a)


# Rules that add nothing, cards of an estate, local times, accepted breaks, examples of changes, drift of selectors.

@query("blocking_rule_yield", """WITH c AS (SELECT c_custkey AS id, c_mktsegment || c_nationkey AS k1, c_mktsegment || c_nationkey || (c_custkey % 2) AS k2, c_nationkey || '/' || floor(c_acctbal / 1000) AS k3, c_name AS k4 FROM customer),
   r AS (SELECT id, unnest([1, 2, 3, 4]) AS i, unnest([k1, k2, k3, k4]) AS k FROM c), p AS (SELECT a.id AS a, b.id AS b, a.i FROM r a JOIN r b ON a.i = b.i AND a.k = b.k AND a.id < b.id),
   m AS (SELECT i, min(i) OVER (PARTITION BY a, b) AS first FROM p), n AS (SELECT i, count(*) AS pairs, count(*) FILTER (WHERE i = first) AS fresh FROM m GROUP BY 1)
   SELECT ['segment', 'half', 'balance', 'name'][t.i] AS rule, coalesce(pairs, 0) AS pairs, coalesce(fresh, 0) AS fresh, CASE WHEN coalesce(pairs, 0) = 0 THEN 'useless' WHEN fresh = 0 THEN 'redundant' ELSE 'needed' END AS verdict
   FROM (SELECT unnest([1, 2, 3, 4]) AS i) t LEFT JOIN n USING (i)""")
def _(t, spark):
    segment = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    half = F.concat(segment, (F.col("c_custkey") % 2).cast("string"))
    balance = F.concat("c_nationkey", F.lit("/"), movement.step("c_acctbal", 1000))
    return entity.rule_yield(t("customer"), "c_custkey", {"segment": segment, "half": half, "balance": balance, "name": F.col("c_name")})


@query("estate_scorecard", f"""SELECT coalesce(dataset, '(all)') AS dataset, count(*) AS controls, count(*) FILTER (WHERE violating_rows = 0) AS passed, count(*) FILTER (WHERE violating_rows > 0) AS failed, 0 AS unjudged,
   round(count(*) FILTER (WHERE violating_rows = 0) / count(*), 6) AS pass_rate FROM {movement.RESULTS} GROUP BY ROLLUP (dataset)""")
def _(t, spark):
    judged = movement.results(t).withColumn("verdict", F.when(F.col("violating_rows") == 0, "pass").otherwise("fail"))
    return score.estate(judged).withColumn("pass_rate", F.round("pass_rate", 6))


@query("business_dates", """WITH l AS (SELECT timezone('America/New_York', timezone('UTC', ts)) AS local FROM events), d AS (SELECT CAST(local - INTERVAL 3 HOUR AS DATE) AS day FROM l),
   b AS (SELECT day - CAST(greatest(isodow(day) - 5, 0) AS INTEGER) AS day FROM d)
   SELECT CAST(day AS VARCHAR) AS business_date, CAST(timezone('UTC', timezone('America/New_York', day + TIME '06:30:00')) AS VARCHAR) AS due, count(*) AS n FROM b GROUP BY 1, 2""")
def _(t, spark):
    events = t("events")
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    cal = feeds.calendar(spark, date(first.year - 1, 12, 1), date(last.year + 1, 1, 31))
    due = F.date_format(feeds.expected_at("business_date", "06:30:00", "America/New_York"), "yyyy-MM-dd HH:mm:ss")
    return feeds.business_dates(events.select("ts"), cal, "ts", "America/New_York", "03:00:00").groupBy(F.col("business_date").cast("string").alias("business_date"), due.alias("due")).agg(F.count(F.lit(1)).alias("n"))


@query("accepted_breaks", f"""SELECT d.* FROM {series.DAILY} d LEFT JOIN (SELECT event_type AS series, max(CAST(CAST(ts AS DATE) AS VARCHAR)) AS at FROM events WHERE event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-15' GROUP BY 1) a USING (series) WHERE a.at IS NULL OR d.t >= a.at""")
def _(t, spark):
    accepted = t("events").where("event_id % 97 = 0 and ts < timestamp_ntz'2024-01-15'").select(F.col("event_type").alias("series"), F.to_date("ts").cast("string").alias("at"))
    return monitor.since_accepted(series.daily(t), accepted)


@query("row_diff_examples", f"SELECT * FROM ({movement.ROW_DIFF}) WHERE change <> 'unchanged' QUALIFY row_number() OVER (PARTITION BY change ORDER BY o_orderkey) <= 20")
def _(t, spark):
    found = diff.row_diff(t("orders").select(*movement.COLUMNS), movement.new_orders(t), ["o_orderkey"])
    return diff.examples(found, ["o_orderkey"], 20).withColumn("columns", F.array_join("columns", ","))


@query("selector_drift", """WITH a AS (SELECT DISTINCT p_brand AS selector, p_type || p_size AS attribute FROM part WHERE p_size > 20), b AS (SELECT DISTINCT p_brand AS selector, p_type || p_size AS attribute FROM part WHERE p_size > 10 AND p_size <= 40)
   SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(t, spark):
    part = t("part").select(F.col("p_brand").alias("selector"), F.concat("p_type", F.col("p_size").cast("string")).alias("attribute"), "p_size")
    return diff.selector_drift(part.where("p_size > 20"), part.where("p_size > 10 and p_size <= 40"))


QUALITY = {
    "schema": [
        {
            "name": "customer",
            "quality": [{"metric": "rowCount", "mustBeGreaterThan": 10}, {"type": "text", "description": "looks right"}, {"metric": "duplicateValues", "arguments": {"properties": ["c_nationkey", "c_mktsegment"]}, "mustBeLessThan": 100}],
            "properties": [
                {"name": "c_custkey", "quality": [{"rule": "duplicateValues", "mustBe": 0}, {"metric": "nullValues", "mustBeLessThan": 1, "unit": "percent"}]},
                {"name": "c_mktsegment", "quality": [{"metric": "invalidValues", "arguments": {"validValues": ["BUILDING", "MACHINERY"]}, "mustBeLessOrEqualTo": 90, "unit": "percent"}, {"type": "custom", "engine": "soda"}]},
            ],
        },
        {"name": "orders", "properties": [{"name": "o_clerk", "quality": [{"metric": "invalidValues", "arguments": {"pattern": "[A-Z].*"}}]}, {"name": "o_orderstatus", "quality": [{"metric": "invalidValues", "arguments": {"pattern": "[FOP]"}, "mustBe": 0}]}]},
    ]
}


@query(
    "contract_quality",
    """WITH c AS (SELECT count(*) AS n, count(*) - count(DISTINCT (c_nationkey, c_mktsegment)) AS doubles, count(*) - count(DISTINCT c_custkey) AS twice, count(*) FILTER (WHERE c_custkey IS NULL) AS nulls, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS bad FROM customer),
       r AS (SELECT 'customer.rowCount.0' AS control, n AS scanned_rows, 0 AS violating_rows, n >= 11 AS ok FROM c UNION ALL SELECT 'customer.duplicateValues.2', n, doubles, doubles <= 99 FROM c UNION ALL SELECT 'customer.c_custkey.duplicateValues.3', n, twice, twice = 0 FROM c
         UNION ALL SELECT 'customer.c_custkey.nullValues.4', n, nulls, nulls / n < 0.01 FROM c UNION ALL SELECT 'customer.c_mktsegment.invalidValues.5', n, bad, bad / n <= 0.9 FROM c
         UNION ALL SELECT 'orders.o_orderstatus.invalidValues.1', count(*), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) = 0 FROM orders)
       SELECT control, scanned_rows, violating_rows, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS verdict FROM r""",
)
def _(t, spark):
    _, found = imports.from_contracts(QUALITY)
    one, two = (suite.evaluate(t(d), [c for c in found.controls[d] if "o_clerk" not in c.name]) for d in ("customer", "orders"))
    return one.unionByName(two)
