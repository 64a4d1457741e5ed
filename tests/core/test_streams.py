import random
from datetime import datetime, timedelta

import pytest

from veritide.plans.controls import RowCheck
from veritide.queries.series import _ROCKS, drained
from veritide.streaming import judge

START = datetime(2024, 1, 1)
CHECK = RowCheck("low", "v >= 10")


def written(spark, tmp_path, name, batches):
    """A stream that reads one batch of rows after another."""
    folder = str(tmp_path / name)
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, None if m is None else START + timedelta(minutes=m), v) for k, m, v in rows], "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def minutes(rows):
    return sorted((r.key, int((r.start - START).total_seconds() // 60), r.scanned_rows, r.violating_rows, r.verdict) for r in rows)


def test_windows_open_with_a_keys_first_message(spark, rocks, tmp_path):
    batches = [[("a", 3, 50.0), ("a", 12, 5.0), ("b", 0, 50.0), ("a", None, 1.0)], [("a", 13, 50.0), ("a", 40, None), ("b", 9, 5.0)], [("c", 200, 50.0)]]
    got = minutes(drained(judge.opened_windows(written(spark, tmp_path, "s", batches), CHECK, "k", "ts", 600), spark).collect())
    # The last window of each key is closed by its timer; c's is still open.
    assert got == [("a", 3, 2, 1, "fail"), ("a", 13, 1, 0, "pass"), ("a", 40, 1, 1, "fail"), ("b", 0, 2, 1, "fail")]


def test_windows_do_not_depend_on_how_time_is_cut_into_batches(spark, rocks, tmp_path):
    rng = random.Random(4)
    rows = sorted(((rng.choice("ab"), rng.randrange(0, 3000), float(rng.randrange(20))) for _ in range(300)), key=lambda r: r[1])
    end = [("z", 10_000, 50.0)]
    one, many = ([rows, end], [rows[:70], rows[70:200], rows[200:], end])
    got = [minutes(drained(judge.opened_windows(written(spark, tmp_path, f"s{len(b)}", b), CHECK, "k", "ts", 3600), spark).collect()) for b in (one, many)]
    want = []
    for k in "ab":
        start = None
        for _, m, v in (r for r in rows if r[0] == k):
            if start is None or m >= start + 60:
                start = m
                want.append([k, m, 0, 0])
            want[-1][2] += 1
            want[-1][3] += v < 10
    assert got[0] == got[1] == sorted((*w, "fail" if w[3] else "pass") for w in want)


def test_count_windows_over_batches(spark, tmp_path):
    rng = random.Random(2)
    values = [float(rng.randrange(20)) for _ in range(95)]
    batches = [[("a", i, v) for i, v in enumerate(values)][a:b] for a, b in ((0, 3), (3, 40), (40, 41), (41, 95))]
    got = sorted((r.number, r.scanned_rows, r.violating_rows) for r in drained(judge.count_windows(written(spark, tmp_path, "s", batches), CHECK, "k", 10), spark).collect())
    assert [(n, s) for n, s, _ in got] == [(i, 10) for i in range(9)]
    assert sum(v for *_, v in got) <= sum(v < 10 for v in values)


def test_sessions(spark, tmp_path):
    batches = [[("a", 0, 5.0), ("a", 8, 50.0), ("a", 30, 50.0)], [("b", 500, 50.0)], [("b", 900, 50.0)]]
    out = drained(judge.session_verdicts(written(spark, tmp_path, "s", batches), CHECK, "k", "ts", "10 minutes"), spark).collect()
    got = sorted((r.k, r.scanned_rows, r.violating_rows, r.verdict) for r in out)
    assert got == [("a", 1, 0, "pass"), ("a", 2, 1, "fail"), ("b", 1, 0, "pass")]


def test_two_streams_are_reconciled_and_the_lonely_given_out(spark, tmp_path):
    left = [[("a", 0, 1.0), ("b", 5, 1.0), ("d", 6, None), (None, 6, 1.0)], [("c", 100, 1.0)], [("late", 600, 1.0)]]
    right = [[("a", 4, 1.0), ("b", 40, 1.0), ("d", 6, None)], [("c", 101, 3.0)], [("x", 590, 1.0)], [("late", 700, 1.0)]]
    out = drained(judge.reconciled(written(spark, tmp_path, "l", left), written(spark, tmp_path, "r", right), "k", "v", "ts", "10 minutes"), spark).collect()
    got = sorted((r.key, r.kind) for r in out)
    # Both messages named late, and x, may still find a partner: nothing beyond them has come on both sides.
    assert got == [("a", "matched"), ("b", "extra"), ("b", "missing"), ("c", "off"), ("d", "matched")]
