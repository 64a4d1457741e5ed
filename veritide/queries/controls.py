"""Predicates, scalar functions, aggregate controls, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import validators as V
from ..plans import suite
from ..plans.controls import AggregateBand, Dependency, Freshness, References, RowCheck, RowCount, Threshold, UniqueKey
from .catalogue import query

#: orders with a price and a status missing now and then.
HOLES = "(SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)"


def holes(t):
    return t("orders").withColumn("p", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice"))).withColumn(
        "s", F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderstatus"))
    )


def verdict_sql(scanned: str, violating: str, passes: str) -> str:
    return f"CASE WHEN {scanned} = 0 THEN 'indeterminate' WHEN {passes} THEN 'pass' ELSE 'fail' END AS verdict"


def row_sql(name: str, source: str, ok: str, where: str = "TRUE", unknown: str = "FALSE", passes: str = "v = 0") -> str:
    return f"""WITH m AS (SELECT count(*) FILTER (WHERE {where}) AS n,
      count(*) FILTER (WHERE coalesce({where}, FALSE) AND NOT coalesce({ok}, {unknown})) AS v FROM {source})
    SELECT '{name}' AS control, n AS scanned_rows, v AS violating_rows, {verdict_sql('n', 'v', passes)} FROM m"""


def row_query(name, source, ok, sql_ok, where=None, sql_where="TRUE", unknown=P.VIOLATES, threshold=Threshold(), passes="v = 0"):
    sources = {"orders": lambda t: t("orders"), "holes": holes}
    frm = HOLES if source == "holes" else source

    @query(name, row_sql(name, frm, sql_ok, sql_where, "TRUE" if unknown == P.PASSES else "FALSE", passes))
    def run(t, spark):
        df = sources.get(source, lambda t: t(source))(t)
        return suite.evaluate(df, [RowCheck(name, ok(), where=where, unknown=unknown, threshold=threshold)])


row_query("not_null", "holes", lambda: F.col("p").isNotNull(), "p IS NOT NULL")
row_query("not_null_filtered", "holes", lambda: F.col("p").isNotNull(), "p IS NOT NULL", where="s = 'F'", sql_where="s = 'F'")
row_query("unknown_violates", "holes", lambda: F.col("p") > 1000, "p > 1000")
row_query("unknown_passes", "holes", lambda: F.col("p") > 1000, "p > 1000", unknown=P.PASSES)
row_query("in_set", "holes", lambda: P.in_list("s", ["F", "O"]), "s IN ('F', 'O')")
row_query("not_in_set", "holes", lambda: ~P.in_list("s", ["P"]), "s NOT IN ('P')")
row_query("between", "holes", lambda: P.between("p", 1000, 300000), "p BETWEEN 1000 AND 300000")
row_query("regex", "customer", lambda: P.matches("c_name", r"#0+[1-9]*[02468]$"), r"regexp_matches(c_name, '#0+[1-9]*[02468]$')")
row_query("like", "part", lambda: P.like("p_type", "%STEEL%"), "p_type LIKE '%STEEL%'")
row_query("ilike", "part", lambda: P.ilike("p_type", "%steel%"), "p_type ILIKE '%steel%'")
row_query("length_between", "orders", lambda: P.length_between("o_orderpriority", 5, 8), "length(o_orderpriority) BETWEEN 5 AND 8")
row_query("has_format", "part", lambda: P.has_format("p_brand", "AAAAA#99"), "regexp_matches(p_brand, '^[A-Za-z]{5}#[0-9][0-9]$')")
row_query("compare", "lineitem", lambda: F.col("l_discount") <= F.col("l_tax"), "l_discount <= l_tax")
row_query("division_safe", "lineitem", lambda: S.divide("l_extendedprice", F.col("l_linenumber") - 1) > 1000, "l_extendedprice / nullif(l_linenumber - 1, 0) > 1000")
row_query("modulo_sign", "customer", lambda: S.modulo(F.col("c_acctbal").cast("int"), F.col("c_nationkey") - 3) >= 0, "CAST(trunc(c_acctbal) AS INTEGER) % nullif(c_nationkey - 3, 0) >= 0")
row_query("compound_not", "holes", lambda: ~((F.col("p") > 200000) & (F.col("s") == "O")) | (F.col("o_custkey") % 2 == 0), "NOT (p > 200000 AND s = 'O') OR o_custkey % 2 = 0")
row_query("rate_threshold", "holes", lambda: F.col("p").isNotNull(), "p IS NOT NULL", threshold=Threshold(rate=0.06), passes="v::DOUBLE / n <= 0.06")
row_query("type_check", "part", lambda: P.is_type(F.regexp_replace("p_brand", "^[^0-9]*", ""), "int"), "TRY_CAST(regexp_replace(p_brand, '^[^0-9]*', '') AS INTEGER) IS NOT NULL")


@query("in_table", """SELECT count(*) AS scanned_rows, count(*) FILTER (WHERE NOT coalesce(c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3), FALSE)) AS violating_rows FROM customer""")
def _(t, spark):
    allowed = t("nation").where("n_regionkey < 3")
    marked = P.in_table(t("customer"), "c_nationkey", allowed, "n_nationkey", "ok")
    return marked.agg(F.count(F.lit(1)).alias("scanned_rows"), F.count_if(P.violation(F.col("ok"))).alias("violating_rows"))


@query(
    "text_fns",
    """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, trim('  ' || c_name || ' ') AS trimmed, length(c_name) AS len,
       left(c_name, 4) AS l4, right(c_name, 3) AS r3, substr(c_name, 3, 5) AS m, replace(c_name, '0', 'o') AS sub,
       c_name || '/' || CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS con FROM customer""",
)
def _(t, spark):
    return t("customer").select(
        "c_custkey", S.upper("c_mktsegment").alias("up"), S.lower("c_mktsegment").alias("low"), S.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
        S.length("c_name").cast("long").alias("len"), S.left("c_name", 4).alias("l4"), S.right("c_name", 3).alias("r3"), S.mid("c_name", 3, 5).alias("m"),
        S.substitute("c_name", "0", "o").alias("sub"), S.concat("c_name", F.lit("/"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).alias("con"),
    )


@query(
    "number_fns",
    """SELECT o_orderkey, abs(o_totalprice - 150000) AS a, CAST(round(CAST(o_totalprice AS DECIMAL(28,6)), 1) AS DOUBLE) AS r, CAST(floor(o_totalprice / 7) AS BIGINT) AS i,
       CAST(o_orderkey % nullif(o_custkey % 5, 0) AS DOUBLE) AS md, CAST(sign(o_totalprice - 150000) AS INTEGER) AS sg,
       CASE WHEN p IS NOT NULL THEN least(p, 1000.0) END AS lo, CASE WHEN p IS NOT NULL THEN greatest(p, 1000.0) END AS hi FROM """ + HOLES,
)
def _(t, spark):
    return holes(t).select(
        "o_orderkey", S.absolute(F.col("o_totalprice") - 150000).alias("a"), S.round_half_up("o_totalprice", 1).cast("double").alias("r"), S.integer(F.col("o_totalprice") / 7).alias("i"),
        S.modulo("o_orderkey", F.col("o_custkey") % 5).cast("double").alias("md"), S.sign(F.col("o_totalprice") - 150000).alias("sg"), S.least("p", F.lit(1000.0)).alias("lo"), S.greatest("p", F.lit(1000.0)).alias("hi"),
    )


@query(
    "logic_fns",
    """SELECT o_orderkey, CASE WHEN p > 1000 THEN 'big' WHEN NOT p > 1000 THEN 'small' END AS iff, coalesce(s, '?') AS blank, coalesce(p, o_totalprice) AS co,
       (s IS NULL OR trim(s) = '') AS isb, regexp_matches(o_orderpriority, '^-?[0-9]+([.][0-9]+)?$') AS num FROM """ + HOLES,
)
def _(t, spark):
    return holes(t).select(
        "o_orderkey", S.if_then(F.col("p") > 1000, F.lit("big"), F.lit("small")).alias("iff"), S.if_blank("s", F.lit("?")).alias("blank"),
        S.coalesce("p", "o_totalprice").alias("co"), S.is_blank("s").alias("isb"), S.is_number("o_orderpriority").alias("num"),
    )


@query("date_fns", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
def _(t, spark):
    return t("orders").select("o_orderkey", S.year("o_orderdate").alias("y"), S.month("o_orderdate").alias("m"), S.day("o_orderdate").alias("d"))


@query(
    "cross_field_fns",
    """SELECT s_suppkey, substr(s_name, 1, 2) AS ic, substr(s_name, 5, 2) AS bc, upper(substr(s_name, 1, 2)) = upper(substr(s_name, 5, 2)) AS same,
       CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal >= 0 ELSE s_acctbal <= 0 END AS side,
       CASE WHEN s_suppkey % 2 = 0 THEN round(CAST(s_acctbal AS DECIMAL(28,6)), 0) = CAST(s_acctbal AS DECIMAL(28,6)) ELSE round(CAST(s_acctbal AS DECIMAL(28,6)), 2) = CAST(s_acctbal AS DECIMAL(28,6)) END AS units
       FROM supplier""",
)
def _(t, spark):
    even = F.col("s_suppkey") % 2 == 0
    return t("supplier").select(
        "s_suppkey", S.iban_country("s_name").alias("ic"), S.bic_country("s_name").alias("bc"), S.iban_bic_consistent("s_name", "s_name").alias("same"),
        S.sign_matches_side("s_acctbal", F.when(even, "BUY").otherwise("SELL")).alias("side"), S.minor_units_ok("s_acctbal", F.when(even, "JPY").otherwise("EUR")).alias("units"),
    )


@query("row_count_band", "SELECT 'rows' AS control, count(*) AS scanned_rows, 0::BIGINT AS violating_rows, CASE WHEN count(*) >= 1000 THEN 'pass' ELSE 'fail' END AS verdict FROM orders")
def _(t, spark):
    return suite.evaluate(t("orders"), [RowCount("rows", 1000)])


@query(
    "unique_key",
    """WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber), m AS (SELECT CAST(sum(n) AS BIGINT) AS s, CAST(sum(n - 1) AS BIGINT) AS v FROM k)
       SELECT 'key' AS control, s AS scanned_rows, v AS violating_rows, CASE WHEN v = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM m""",
)
def _(t, spark):
    return suite.evaluate(t("lineitem"), [UniqueKey("key", ("l_orderkey", "l_linenumber"))])


@query(
    "unique_key_nulls",
    f"""WITH k AS (SELECT o_custkey, s, count(*) AS n FROM {HOLES} GROUP BY ALL),
       m AS (SELECT CAST(sum(n) AS BIGINT) AS c, CAST(sum(CASE WHEN o_custkey IS NULL OR s IS NULL THEN n ELSE n - 1 END) AS BIGINT) AS v FROM k)
       SELECT 'key' AS control, c AS scanned_rows, v AS violating_rows, CASE WHEN v = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM m""",
)
def _(t, spark):
    return suite.evaluate(holes(t), [UniqueKey("key", ("o_custkey", "s"))])


def fd_sql(name, source, det, dep):
    return f"""WITH g AS (SELECT count(*) AS n, count(DISTINCT {dep}) FILTER (WHERE {det} IS NOT NULL) AS d FROM {source} GROUP BY {det}),
       m AS (SELECT CAST(sum(n) AS BIGINT) AS c, CAST(sum(greatest(d - 1, 0)) AS BIGINT) AS v FROM g)
       SELECT '{name}' AS control, c AS scanned_rows, v AS violating_rows, CASE WHEN v = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM m"""


@query("fd_holds", fd_sql("fd", "nation", "n_nationkey", "n_regionkey"))
def _(t, spark):
    return suite.evaluate(t("nation"), [Dependency("fd", ("n_nationkey",), "n_regionkey")])


@query("fd_broken", fd_sql("fd", "lineitem", "l_partkey", "l_suppkey"))
def _(t, spark):
    return suite.evaluate(t("lineitem"), [Dependency("fd", ("l_partkey",), "l_suppkey")])


SEGMENTED = f"""SELECT s, count(*) AS scanned_rows, count(*) FILTER (WHERE NOT coalesce(p > 100000, FALSE)) AS violating_rows,
    CASE WHEN count(*) FILTER (WHERE NOT coalesce(p > 100000, FALSE))::DOUBLE / count(*) <= 0.245 THEN 'pass' ELSE 'fail' END AS verdict, 'price' AS control
    FROM {HOLES} GROUP BY s"""
PRICE = RowCheck("price", "p > 100000", threshold=Threshold(rate=0.245))


@query("segmented_verdict", SEGMENTED)
def _(t, spark):
    return suite.evaluate(holes(t), [PRICE], ["s"])


@query("segmented_having", f"SELECT * FROM ({SEGMENTED}) WHERE scanned_rows >= 4000")
def _(t, spark):
    return suite.evaluate(holes(t), [PRICE], ["s"], having=F.col("scanned_rows") >= 4000)


@query("segment_roll_up", f"SELECT 'price' AS control, count(*) AS segments, CAST(sum(scanned_rows) AS BIGINT) AS scanned_rows, CAST(sum(violating_rows) AS BIGINT) AS violating_rows, CASE WHEN count(*) FILTER (WHERE verdict = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM ({SEGMENTED})")
def _(t, spark):
    return suite.roll_up(suite.evaluate(holes(t), [PRICE], ["s"]))


FUSED = [
    RowCheck("price_known", "p is not null", threshold=Threshold(rate=0.1)),
    RowCheck("price_range", "p between 1000 and 400000", where="s = 'F'"),
    RowCheck("status", "s in ('F', 'O', 'P')", unknown=P.PASSES),
    RowCheck("nothing", "p > 0", where="o_orderkey < 0"),
    RowCount("rows", 100, 10_000_000),
    AggregateBand("mean_price", "avg", "p", 10_000, 500_000),
]


@query(
    "fused_suite",
    " UNION ALL ".join(
        f"SELECT * FROM ({part})"
        for part in [
            row_sql("price_known", HOLES, "p IS NOT NULL", passes="v::DOUBLE / n <= 0.1"),
            row_sql("price_range", HOLES, "p BETWEEN 1000 AND 400000", "s = 'F'"),
            row_sql("status", HOLES, "s IN ('F','O','P')", unknown="TRUE"),
            row_sql("nothing", HOLES, "p > 0", "o_orderkey < 0"),
            "SELECT 'rows', count(*), 0::BIGINT, CASE WHEN count(*) BETWEEN 100 AND 10000000 THEN 'pass' ELSE 'fail' END FROM orders",
            f"SELECT 'mean_price', count(*), CAST(NOT avg(p) BETWEEN 10000 AND 500000 AS BIGINT), CASE WHEN avg(p) BETWEEN 10000 AND 500000 THEN 'pass' ELSE 'fail' END FROM {HOLES}",
        ]
    ),
)
def fused_suite(t, spark):
    return suite.evaluate(holes(t), FUSED)


@query(
    "freshness",
    """SELECT 'fresh' AS control, count(*) AS scanned_rows, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts))) > 172800 AS BIGINT) AS violating_rows,
       CASE WHEN epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts))) > 172800 THEN 'fail' ELSE 'pass' END AS verdict FROM events""",
)
def _(t, spark):
    return suite.evaluate(t("events"), [Freshness("fresh", "ts", "2024-02-01 00:00:00", 172800)])


ORPHANS = "(SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN -o_custkey WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS ck FROM orders)"


def with_orphans(t):
    key = F.when(F.col("o_orderkey") % 13 == 0, -F.col("o_custkey")).when(F.col("o_orderkey") % 29 != 0, F.col("o_custkey"))
    return t("orders").withColumn("ck", key)


REFERENCES = References("customer", "ck", "customer", "c_custkey")


@query(
    "reference_integrity",
    f"""SELECT 'customer' AS control, o_orderstatus, count(*) AS scanned_rows, count(*) FILTER (WHERE c_custkey IS NULL) AS violating_rows,
        CASE WHEN count(*) FILTER (WHERE c_custkey IS NULL) = 0 THEN 'pass' ELSE 'fail' END AS verdict
        FROM {ORPHANS} o LEFT JOIN customer c ON ck = c_custkey GROUP BY o_orderstatus""",
)
def _(t, spark):
    return suite.evaluate(with_orphans(t), [REFERENCES], ["o_orderstatus"], parents={"customer": t("customer")})


@query("reference_orphans_sample", f"SELECT o_orderkey, CAST(ck AS DOUBLE) AS ck FROM {ORPHANS} o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = ck) ORDER BY o_orderkey LIMIT 50")
def _(t, spark):
    return suite.orphans(with_orphans(t), REFERENCES, {"customer": t("customer")}).select("o_orderkey", F.col("ck").cast("double").alias("ck")).orderBy("o_orderkey").limit(50)


@query("violation_samples", f"SELECT o_orderkey, s, p FROM {HOLES} WHERE NOT coalesce(p > 1000, FALSE) ORDER BY o_orderkey LIMIT 25")
def _(t, spark):
    return suite.samples(holes(t), RowCheck("p", "p > 1000"), ["o_orderkey", "s", "p"], 25, ["o_orderkey"])


@query(
    "quarantine_split",
    f"""SELECT CASE WHEN a AND b THEN 'known,status' WHEN a THEN 'known' WHEN b THEN 'status' ELSE '' END AS why, count(*) AS n
        FROM (SELECT p IS NULL AS a, NOT coalesce(s IN ('F','O'), FALSE) AS b FROM {HOLES}) GROUP BY 1""",
)
def _(t, spark):
    good, bad = suite.quarantine(holes(t), [RowCheck("known", "p is not null"), RowCheck("status", "s in ('F', 'O')")])
    both = good.select(F.lit("").alias("why")).union(bad.select(F.array_join("reasons", ",").alias("why")))
    return both.groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query(
    "custom_sql",
    """SELECT 'big' AS control, count(*) AS scanned_rows, count(*) FILTER (WHERE l_quantity * p_retailprice < l_extendedprice / 4) AS violating_rows,
       CASE WHEN count(*) FILTER (WHERE l_quantity * p_retailprice < l_extendedprice / 4) <= 100 THEN 'pass' ELSE 'fail' END AS verdict
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(t, spark):
    text = """SELECT count(*) AS scanned_rows, count_if(l_quantity * p_retailprice < l_extendedprice / 4) AS violating_rows
              FROM cs_lineitem JOIN cs_part ON l_partkey = p_partkey"""
    return suite.custom_sql(spark, text, "big", Threshold(rows=100), cs_lineitem=t("lineitem"), cs_part=t("part"))


@query(
    "validators",
    r"""SELECT user_id, event_id, regexp_matches(v, '^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$') AS ip,
       (3 * (event_id // 100000000 % 10) + 7 * (event_id // 10000000 % 10) + (event_id // 1000000 % 10) + 3 * (event_id // 100000 % 10) + 7 * (event_id // 10000 % 10)
        + (event_id // 1000 % 10) + 3 * (event_id // 100 % 10) + 7 * (event_id // 10 % 10) + (event_id % 10)) % 10 = 0 AS aba,
       TRY_CAST('2024-02-' || lpad(CAST(event_id % 32 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS day
       FROM (SELECT *, CAST(event_id % 300 AS VARCHAR) || '.1.2.' || CAST(user_id AS VARCHAR) AS v FROM events)""",
)
def _(t, spark):
    text = F.concat((F.col("event_id") % 300).cast("string"), F.lit(".1.2."), F.col("user_id").cast("string"))
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("event_id") % 32).cast("string"), 2, "0"))
    return t("events").select(
        "user_id", "event_id", V.ipv4(text).alias("ip"), V.aba_routing(F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("aba"), V.iso_date(day).alias("day")
    )


@query(
    "luhn_valid",
    """SELECT event_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(substr(c, i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(c, i, 1) AS INTEGER)) % 10 ELSE CAST(substr(c, i, 1) AS INTEGER) END)) % 10 = 0 AS ok
       FROM (SELECT event_id, '4' || lpad(CAST(event_id AS VARCHAR), 15, '0') AS c FROM events)""",
)
def _(t, spark):
    return t("events").select("event_id", V.card_number(F.concat(F.lit("4"), F.lpad(F.col("event_id").cast("string"), 15, "0"))).alias("ok"))


@query(
    "codelist_membership",
    """WITH c AS (SELECT n_name, chr(CAST(65 + n_nationkey % 26 AS INTEGER)) || chr(CAST(65 + (n_nationkey * 5 + 4) % 26 AS INTEGER)) AS two FROM nation)
       SELECT n_name, substr(n_name, 1, 2) IN ('AR','BR','CA','NA') AS short, two IN ('AE','BJ','CO','GI','HN','IS','MM','NR','TV','UA') AS iso FROM c""",
)
def _(t, spark):
    letter = lambda n: F.char(65 + n % 26)
    two = F.concat(letter(F.col("n_nationkey")), letter(F.col("n_nationkey") * 5 + 4))
    return t("nation").select("n_name", P.in_list(F.substring("n_name", 1, 2), "AR BR CA NA".split()).alias("short"), P.in_list(two, V.code_list("iso3166")).alias("iso"))


@query(
    "threshold_amounts",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT o_totalprice < 300000) AS dear, sum(o_totalprice) FILTER (WHERE NOT o_totalprice < 300000) AS amount, count(*) FILTER (WHERE NOT o_orderstatus <> 'F') AS closed, sum(o_totalprice) AS total FROM orders)
       SELECT 'within amount' AS control, n AS scanned_rows, dear AS violating_rows, CASE WHEN coalesce(amount, 0) <= 1000000000 THEN 'pass' ELSE 'fail' END AS verdict FROM c
       UNION ALL SELECT 'beyond amount', n, dear, CASE WHEN coalesce(amount, 0) <= 1000.5 THEN 'pass' ELSE 'fail' END FROM c
       UNION ALL SELECT 'some closed', n, closed, CASE WHEN closed >= 10 THEN 'pass' ELSE 'fail' END FROM c UNION ALL SELECT 'most closed', n, closed, CASE WHEN closed / n >= 0.9 THEN 'pass' ELSE 'fail' END FROM c""",
)
def _(t, spark):
    dear = lambda name, amount: RowCheck(name, "o_totalprice < 300000", threshold=Threshold(amount=amount, of="o_totalprice"))
    closed = lambda name, **k: RowCheck(name, "o_orderstatus <> 'F'", threshold=Threshold(at_least=True, **k))
    return suite.evaluate(t("orders"), [dear("within amount", 1e9), dear("beyond amount", 1000.5), closed("some closed", rows=10), closed("most closed", rate=0.9)])
