from datetime import date

import pytest
from pyspark.sql import functions as F

from veritide.operators import entity, feeds, incidents, lineage
from veritide.plans.controls import RowCheck
from veritide.sources import messages, readers, sinks
from veritide.streaming import judge


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    df.write.csv(f"{tmp_path}/x.csv", header=True)
    df.write.json(f"{tmp_path}/x.jsonl")
    df.write.partitionBy("s").parquet(f"{tmp_path}/x.parquet")
    for p in ("x.csv", "x.jsonl", "x.parquet"):
        assert sorted((r.id, r.s) for r in readers.read_files(spark, f"{tmp_path}/{p}", "id int, s string").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        readers.read_files(spark, "x.exe")


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    assert readers.sample(df, "full").count() == 1000 and readers.sample(df, "reservoir", rows=10).count() == 10
    assert 20 < readers.sample(df, "systematic", fraction=0.05).count() < 90
    assert readers.sample(df, "recent_partitions", partition="g").select("g").distinct().collect()[0].g == 1
    assert readers.sample(df, "stratified", strata="g", fractions={0: 1.0, 1: 0.0}).count() == 500


def test_paged_endpoint(spark):
    def fetch(page):
        return [{"id": page * 2 + i, "name": "n"} for i in range(2)] if page < 3 else []

    readers.rest_source(spark, "pages_for_test", fetch, "id int, name string")
    assert sorted(r.id for r in spark.read.format("pages_for_test").load().collect()) == list(range(6))


def test_evidence_chain(spark, tmp_path):
    results = spark.createDataFrame([("a", 1, "pass"), ("b", 2, "fail")], "control string, n int, verdict string")
    path = f"{tmp_path}/evidence"
    first = sinks.append_evidence(results, path, "r1")
    second = sinks.append_evidence(results, path, "r2", first)
    assert first != second
    assert {r.run: r.intact for r in sinks.verify_chain(spark, path).collect()} == {"r1": True, "r2": True}
    assert len(sinks.merkle_root(spark.read.parquet(path))) == 64


def test_messages(spark):
    body = "8=FIX.4.2|35=D|49=ME|56=YOU|34=7|55=IBM|54=1|38=100|44=12.5|".replace("|", "\x01")
    text = body + f"10={sum(map(ord, body)) % 256:03d}\x01"
    row = messages.fix(spark.createDataFrame([(text,)], "m string"), "m").first()
    assert (row.symbol, row.quantity, row.checksum_ok) == ("IBM", "100", True)
    mt = "{1:F01BANKDEFFXXXX0}{2:I103BANKUS33N}{4:\n:20:REF1\n:32A:240101EUR12,5\n:70:LINE1\nLINE2\n-}"
    row = messages.swift_mt(spark.createDataFrame([(mt,)], "m string"), "m").first()
    assert row.mt == "103" and [(f["tag"], f["value"]) for f in row.fields] == [("20", "REF1"), ("32A", "240101EUR12,5"), ("70", "LINE1\nLINE2")]
    xml = '<Document xmlns="urn:x"><FIToFICstmrCdtTrf><CdtTrfTxInf><PmtId><EndToEndId>E1</EndToEndId></PmtId><IntrBkSttlmAmt Ccy="EUR">10.50</IntrBkSttlmAmt><Dbtr><Nm>A</Nm></Dbtr><Cdtr><Nm>B</Nm></Cdtr></CdtTrfTxInf></FIToFICstmrCdtTrf></Document>'
    row = messages.pacs008(spark.createDataFrame([(xml,)], "m string"), "m").first()
    assert (row.end_to_end_id, float(row.amount), row.currency, row.debtor) == ("E1", 10.5, "EUR", "A")
    row = messages.iso8583_header(spark.createDataFrame([("0200C000000000000001",)], "m string"), "m").first()
    assert row.mti == "0200" and row.elements == [1, 2, 64]
    raw = "AB ".encode("cp037") + bytes.fromhex("F1F2D3") + bytes.fromhex("01234C")
    row = messages.fixed_width(spark.createDataFrame([(raw,)], "r binary"), "r", [("t", 1, 3, "text"), ("z", 4, 3, "zoned"), ("p", 7, 3, "packed:2")]).first()
    assert (row.t, row.z, float(row.p)) == ("AB", -123, 12.34)


def test_calendar_rules():
    assert feeds.easter(2024) == date(2024, 3, 31) and feeds.nth_weekday(2024, 11, 3, 4) == date(2024, 11, 28) and feeds.nth_weekday(2024, 5, 0, -1) == date(2024, 5, 27)
    assert feeds.observed(date(2024, 6, 1)) == date(2024, 5, 31)


def test_estimation_finds_the_pairs():
    fields = [entity.Field("a"), entity.Field("b"), entity.Field("c")]
    counts = [((1, 1, 1), 90), ((1, 1, 0), 10), ((0, 0, 0), 850), ((1, 0, 0), 45), ((0, 1, None), 5)]
    fitted, share = entity.estimate(counts, fields)
    assert 0.05 < share < 0.15 and all(f.m > 0.8 and f.u < 0.2 for f in fitted)


def test_enforcement(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, v double").parquet(f"{tmp_path}/in")
    good, dead = [], []
    q = judge.enforce(
        stream, [RowCheck("v", "v > 0")], "quarantine", lambda d, _: good.extend(r.id for r in d.collect()), lambda d, _: dead.extend((r.id, r.violations) for r in d.collect()), f"{tmp_path}/c"
    )
    q.awaitTermination()
    assert good == [1] and sorted(dead) == [(2, ["v"]), (3, ["v"])]
    again = judge.enforce(stream, [RowCheck("v", "v > 0")], "block", lambda d, _: None, lambda d, _: None, f"{tmp_path}/c2", most_dead=1)
    with pytest.raises(Exception, match="dead letters"):
        again.awaitTermination()


def test_large_blocks_are_compared_whole(spark):
    hot = spark.range(1100).select(F.col("id").alias("k"), F.lit("one").alias("g"))
    pairs, wide = entity.blocked_pairs(hot, "k", {"g": F.col("g")})
    assert pairs.count() == 1100 * 1099 // 2 and wide.count() == 1
    rows = [(i % 90, None if i % 13 == 0 else "ab"[i % 3 == 0], i % 7) for i in range(100)] + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "k long, g string, h long")
    got = entity.blocked_pairs(df, "k", {"g": F.col("g"), "h": F.col("h")}, largest=8)[0].collect()
    want = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and (a[1] and a[1] == b[1] or a[2] == b[2])}
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_roots_and_trust_travel_any_number_of_hops(spark):
    names = [f"n{i:02}" for i in range(16)]
    edges = spark.createDataFrame([(a, b, "identity") for a, b in zip(names, names[1:])], "source string, target string, kind string")
    alerts = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node string, i int").select("node", F.timestamp_seconds("i").alias("ts"))
    assert {r.root for r in incidents.incidents(alerts, edges).collect()} == {"n00"}
    with pytest.raises(RuntimeError):
        incidents.incidents(alerts, edges, max_rounds=5)
    nodes = spark.createDataFrame([(n, 0.25 if n == "n00" else 1.0) for n in names], "node string, trust double")
    assert {r.trust for r in lineage.trust(nodes, edges).collect()} == {0.25}
    with pytest.raises(RuntimeError):
        lineage.trust(nodes, edges, max_rounds=5)


def test_edges_of_unknown_kinds_raise(spark):
    e = spark.createDataFrame([("a", "b", "copied")], "source string, target string, kind string")
    with pytest.raises(Exception, match="unknown kind of edge"):
        lineage.blast_radius(e, "a").collect()


def test_evidence_of_equal_records_and_tampering(spark, tmp_path):
    rows = spark.createDataFrame([("c", i % 3, "pass") for i in range(200)], "control string, n int, verdict string")
    path = f"{tmp_path}/evidence"
    first = sinks.append_evidence(rows, path, "r1")
    second = sinks.append_evidence(rows, path, "r2", first)
    assert first != second and {r.run: r.intact for r in sinks.verify_chain(spark, path).collect()} == {"r1": True, "r2": True}
    spark.read.parquet(f"{path}/run=r2").limit(150).write.parquet(f"{tmp_path}/other/run=r2")
    assert [r.intact for r in sinks.verify_chain(spark, f"{tmp_path}/other").collect()] == [False]


def test_merkle_root_against_a_plain_version(spark):
    import hashlib

    hashes = [hashlib.sha256(str(i % 30).encode()).hexdigest() for i in range(41)]
    level = sorted(hashes)
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    df = spark.createDataFrame([(h,) for h in hashes], "content_hash string")
    assert sinks.merkle_root(df) == sinks.merkle_root(df.repartition(7)) == level[0]
