from collections import Counter
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from veritide.operators import entity
from veritide.queries import ORACLE, QUERIES

KEYS = ("x", "y", "z")


def by_hand(rows):
    """What each rule adds, from all pairs of ids."""
    met = [{tuple(sorted((a[0], b[0]))) for a, b in combinations(rows, 2) if a[0] != b[0] and a[i] is not None and a[i] == b[i]} for i in range(1, len(KEYS) + 1)]
    return {name: (len(met[i]), len(met[i] - set().union(*met[:i]))) for i, name in enumerate(KEYS)}


def yields(spark, rows, **how):
    df = spark.createDataFrame(rows, "id long, x string, y string, z string")
    return {r.rule: (r.pairs, r.fresh) for r in entity.rule_yield(df, "id", {k: F.col(k) for k in KEYS}, **how).collect()}


def test_rules_are_counted_without_pairs(spark):
    rows = [(i, f"{i % 3}", f"{i % 7}" if i % 5 else None, f"{i % 4}") for i in range(90)]
    assert yields(spark, rows) == by_hand(rows)
    # A large block: eight thousand million pairs are counted, none is formed.
    big = spark.range(130_000).select("id", F.lit("one").alias("x"), (F.col("id") % 2).cast("string").alias("y"), F.col("id").cast("string").alias("z"))
    got = {r.rule: (r.pairs, r.fresh, r.verdict) for r in entity.rule_yield(big, "id", {k: F.col(k) for k in KEYS}).collect()}
    assert got == {"x": (130_000 * 129_999 // 2, 130_000 * 129_999 // 2, "needed"), "y": (65_000 * 64_999, 0, "redundant"), "z": (0, 0, "useless")}


def test_ids_with_several_rows_pair_once(spark):
    rows = [(i, f"{i % 3}", f"{i % 7}", f"{i % 4}") for i in range(40)] + [(i, f"{(i + 1) % 3}", f"{i % 7}", None) for i in range(0, 40, 9)] + [(3, "0", "3", "3")] * 2
    assert yields(spark, rows) == yields(spark, rows, largest=5) == by_hand(rows)


def test_blocks_agree_with_their_sql_on_signed_zeros(spark, tmp_path):
    balances = [0.0, -0.0, -0.0, 3.0, 499.99, 500.0, -0.01, -500.0, None]
    rows = [(i, f"Customer#{i}", 1, b, "FURNITURE") for i, b in enumerate(balances * 2)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    duckdb.execute(f"CREATE OR REPLACE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    for name in ("blocking_pairs", "match_scores", "blocking_rule_yield"):
        got = sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(duckdb.sql(ORACLE[name]).fetchall(), key=repr), name


def shuffled(spark, run):
    """What run() returns, and the rows that it shuffled."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    known = stages()
    got = run()
    return got, sum(n for stage, n in stages().items() if stage not in known)


def alike(spark, folder, n=4500):
    """A customer table of ``n`` rows in one block, more than fit one sub-block."""
    spark.range(n).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "1 AS c_nationkey", "CAST(id % 40 AS DOUBLE) AS c_acctbal", "'FURNITURE' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    duckdb.execute(f"CREATE OR REPLACE VIEW customer AS FROM '{folder}/customer.parquet/*.parquet'")


def test_scored_pairs_are_not_shuffled(spark, tmp_path):
    alike(spark, tmp_path)
    sums = "count(*) AS n, sum(a) AS a, sum(b) AS b, sum(CAST(weight * 1000000 AS BIGINT)) AS w"
    got, rows = shuffled(spark, lambda: QUERIES["match_scores"](spark, str(tmp_path)).selectExpr("count(*)", "sum(a)", "sum(b)", "sum(CAST(round(weight * 1000000) AS BIGINT))").collect())
    assert tuple(got[0]) == duckdb.sql(f"SELECT {sums} FROM ({ORACLE['match_scores']})").fetchall()[0]
    assert got[0][0] == 4500 * 4499 // 2
    assert rows < 20 * 4500


MIXED = [(i, f"{i % 3}", f"{i % 7}" if i % 5 else None, f"{i % 4}", f"n{i % 2}" if i % 11 else None) for i in range(60)]
MIXED += [(i, f"{(i + 1) % 3}", f"{i % 7}", None, "n1") for i in range(0, 60, 9)] + [(3, "0", "3", "3", "n1")] * 2 + [(50, None, None, None, "n0"), (None, "0", "0", "0", "n0")]


def pairs_by_hand():
    known = [r for r in MIXED if r[0] is not None]
    return {tuple(sorted((x[0], y[0]))) for x, y in combinations(known, 2) if x[0] != y[0] and any(x[i] is not None and x[i] == y[i] for i in (1, 2, 3))}


def test_ids_with_several_rows_are_scored_by_all_of_them(spark, monkeypatch):
    df = spark.createDataFrame(MIXED, "id long, x string, y string, z string, name string")
    same = lambda x, y: None if x is None or y is None else int(x == y)
    want = Counter((a, b, same(x[4], y[4]), same(x[1], y[1])) for a, b in pairs_by_hand() for x in MIXED if x[0] == a for y in MIXED if y[0] == b)
    fields = [entity.Field("name"), entity.Field("x")]
    for buckets in (entity.BUCKETS, 7, 1):
        monkeypatch.setattr(entity, "BUCKETS", buckets)
        for largest in (1000, 2):
            agreed, _ = entity.blocked_agreements(df, "id", {k: F.col(k) for k in KEYS}, fields, largest)
            assert Counter(tuple(r) for r in agreed.collect()) == want, (buckets, largest)


def test_weights_rounded_by_pattern_equal_weights_rounded_by_row(spark, monkeypatch):
    agreed = spark.createDataFrame([(x, y) for x in (0, 1, None) for y in (0, 1, None)], "agree_p int, agree_q int")
    fields = [entity.Field("p", m=0.95, u=0.2), entity.Field("q", m=0.8, u=0.02)]
    got = [tuple(r) for r in entity.score(agreed, fields, digits=3).collect()]
    assert got == [tuple(r) for r in entity.score(agreed, fields).withColumn("weight", F.round("weight", 3)).collect()]
    monkeypatch.setattr(entity, "PATTERNS", 0)
    assert got == [tuple(r) for r in entity.score(agreed, fields, digits=3).collect()]


def test_blocked_pairs_are_not_shuffled(spark, tmp_path, monkeypatch):
    alike(spark, tmp_path)
    got, rows = shuffled(spark, lambda: QUERIES["blocking_pairs"](spark, str(tmp_path)).selectExpr("count(*)", "sum(a)", "sum(b)").collect())
    assert tuple(got[0]) == duckdb.sql(f"SELECT count(*), sum(a), sum(b) FROM ({ORACLE['blocking_pairs']})").fetchall()[0]
    assert rows < 20 * 4500
    df = spark.createDataFrame(MIXED, "id long, x string, y string, z string, name string")
    for buckets in (entity.BUCKETS, 7, 1):
        monkeypatch.setattr(entity, "BUCKETS", buckets)
        for largest in (1000, 2):
            pairs, wide = entity.blocked_pairs(df, "id", {k: F.col(k) for k in KEYS}, largest)
            assert sorted(tuple(r) for r in pairs.collect()) == sorted(pairs_by_hand()), (buckets, largest)
            sizes = Counter((k, r[i]) for r in MIXED if r[0] is not None for i, k in enumerate(KEYS, 1) if r[i] is not None)
            assert {(r.rule, r.key): r.n for r in wide.collect()} == {k: n for k, n in sizes.items() if n > largest}
