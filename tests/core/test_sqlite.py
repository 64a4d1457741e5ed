import json
import sqlite3

import pytest

from veritide.sources import sqlite


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "a b.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "t x" (id INTEGER, name VARCHAR(9), price REAL, raw BLOB, odd)')
        db.executemany('INSERT INTO "t x" VALUES (?, ?, ?, ?, ?)', [(i if i % 50 else None, f"{'N' if i % 2 else 'n'}{i % 10}" if i % 9 else None, i / 4 if i % 7 else None, bytes([i % 256]), str(i)) for i in range(1000)])
    return path


def reader(database, **options):
    source = sqlite.SqliteSource({"database": database, "dbtable": "t x", **options})
    return source.reader(source.schema())


def rows_read(reader):
    return [row for p in reader.partitions() for row in reader.read(p)]


def test_conditions_reach_the_database(database):
    read = lambda *where: len(rows_read(reader(database, where=json.dumps(where))))
    assert read() == 1000
    assert read(("name", "=", "n4")) == 89
    assert read(("id", ">", 900), ("price", "<", 240.0)) == sum(i > 900 and i % 50 != 0 and i % 7 != 0 and i / 4 < 240 for i in range(1000))
    assert read(("id", "in", [3, 5, 50])) == 2
    assert read(("id", "is null", None)) == 20 and read(("id", "is not null", None)) == 980
    assert read(("name", "starts with", "N")) == sum(i % 2 and i % 9 > 0 for i in range(1000))
    # What SQLite would compare in its own way is refused, and so are unknown columns and operators.
    for wrong in (("id", "=", "3"), ("price", "=", float("nan")), ("gone", "=", 1), ("id", "like", 1), ("raw", "=", "x"), ("id", "in", [1, None]), ("id", "=", True)):
        with pytest.raises(ValueError):
            read(wrong)


@pytest.mark.parametrize("parts", [1, 2, 7, 5000])
def test_ranges_hold_every_row_once(database, parts):
    r = reader(database, partitioncolumn="id", numpartitions=str(parts))
    rows = rows_read(r)
    assert len(rows) == 1000 and len({row[4] for row in rows}) == 1000
    assert 1 <= len(r.partitions()) <= parts
    some = reader(database, partitioncolumn="id", numpartitions=str(parts), where=json.dumps([("name", "=", "N3")]))
    assert len(rows_read(some)) == sum(i % 10 == 3 and i % 9 > 0 for i in range(1000))
    assert rows_read(reader(database, partitioncolumn="id", numpartitions="3", where=json.dumps([("id", ">", 10**6)]))) == []


def test_same_rows_as_filters_in_spark(spark, database):
    t = sqlite.read_sqlite(spark, database, "t x", "id", 4)
    assert [f.dataType.simpleString() for f in t.schema] == ["bigint", "string", "double", "binary", "string"]
    plain = spark.createDataFrame(t.collect(), t.schema)
    names = ("id", "name", "price", "odd")
    for where, condition in (([("id", ">", 40), ("id", "<=", 777), ("name", "=", "N3")], "id > 40 AND id <= 777 AND name = 'N3'"), ([("name", "starts with", "n"), ("price", "<", 100)], "name LIKE 'n%' AND price < 100"), ([("id", "is null")], "id IS NULL")):
        got = sqlite.read_sqlite(spark, database, "t x", "id", 4, where)
        assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, plain.where(condition).select(*names).collect())), condition
    # Filters of two uses of one table keep apart.
    assert t.where("id < 10").union(t.where("id > 990")).count() == plain.where("id < 10 OR id > 990").count()
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, database, "gone")
    with pytest.raises(Exception, match="whole number"):
        sqlite.read_sqlite(spark, database, "t x", "price").count()
    with pytest.raises(sqlite3.OperationalError), sqlite._opened(database) as db:
        db.execute('DELETE FROM "t x"')
