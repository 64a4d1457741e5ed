"""Tables of SQLite files as a Spark source that reads ranges of a key in parallel and leaves conditions to the database."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

#: A condition is (column, operator, value); null tests have no use for a value.
OPERATORS = ("=", "<", "<=", ">", ">=", "in", "starts with", "is null", "is not null")
#: Values that a column of a type is compared with in the database as Spark would compare them.
_ALIKE = {LongType: (int,), DoubleType: (int, float), StringType: (str,)}


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _kind(declared: str) -> DataType:
    """By the rules of SQLite's type affinity."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else StringType()


def _opened(path: str) -> sqlite3.Connection:
    """A connection that can't write."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


class SqliteReader(DataSourceReader):
    """Reads a table in ranges of a column, with conditions that the database applies."""

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema
        self.path, self.table = options["database"], options["dbtable"]
        self.key, self.parts = options.get("partitioncolumn"), max(1, int(options.get("numpartitions", 1)))
        self.conditions: list[str] = []
        self.values: list = []
        for column, operator, value in json.loads(options.get("where", "[]")):
            self._add(column, operator, value)

    def _add(self, column: str, operator: str, value) -> None:
        if column not in self.columns.names or operator not in OPERATORS:
            raise ValueError(f"no condition {column!r} {operator!r}")
        name, kinds = _name(column), _ALIKE.get(type(self.columns[column].dataType), ())
        if operator.startswith("is "):
            self.conditions.append(f"{name} {operator.upper()}")
            return
        given = list(value) if operator == "in" else [value]
        if any(type(v) not in kinds or v != v for v in given):
            raise ValueError(f"SQLite would compare {column!r} with {value!r} in its own way")
        if operator == "in":
            self.conditions.append(f"{name} IN ({', '.join('?' * len(given))})")
            self.values.extend(given)
        elif operator == "starts with":
            # LIKE would not tell small letters from capitals.
            self.conditions.append(f"substr({name}, 1, ?) = ?")
            self.values.extend((len(value), value))
        else:
            self.conditions.append(f"{name} {operator} ?")
            self.values.append(value)

    def statement(self, low: int | None = None, high: int | None = None, nulls: bool = False) -> tuple[str, list]:
        """The query of one range, low included and high not; ``nulls`` adds rows without a key."""
        where, values = list(self.conditions), list(self.values)
        if self.key is not None and (low is not None or high is not None):
            key, sides = _name(self.key), []
            for bound, sign in ((low, ">="), (high, "<")):
                if bound is not None:
                    sides.append(f"{key} {sign} ?")
                    values.append(bound)
            inside = " AND ".join(sides)
            where.append(f"({inside} OR {key} IS NULL)" if nulls else inside)
        names = ", ".join(_name(c) for c in self.columns.names)
        return f"SELECT {names} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def partitions(self) -> list[InputPartition]:
        if self.key is None or self.parts == 1:
            return [InputPartition((None, None, False))]
        if not isinstance(self.columns[self.key].dataType, LongType):
            raise ValueError(f"{self.key} isn't a whole number, so its range can't be divided")
        where = f" WHERE {' AND '.join(self.conditions)}" if self.conditions else ""
        with _opened(self.path) as db:
            low, high = db.execute(f"SELECT min({_name(self.key)}), max({_name(self.key)}) FROM {_name(self.table)}{where}", self.values).fetchone()
        if low is None:
            return [InputPartition((None, None, False))]
        step = -(-(high - low + 1) // self.parts)
        edges = [None, *[low + i * step for i in range(1, self.parts) if low + i * step <= high], None]
        return [InputPartition((a, b, a is None)) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        sql, values = self.statement(*partition.value)
        casts = [{LongType: int, DoubleType: float, StringType: str}.get(type(f.dataType)) for f in self.columns]
        with _opened(self.path) as db:
            for row in db.execute(sql, values):
                yield tuple(v if v is None or cast is None else cast(v) for v, cast in zip(row, casts, strict=True))


class SqliteSource(DataSource):
    """Options: database (path), dbtable, where (conditions as JSON), and for parallel reads partitionColumn (whole numbers) and numPartitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _opened(self.options["database"]) as db:
            columns = db.execute(f"PRAGMA table_info({_name(self.options['dbtable'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']}")
        return StructType([StructField(c[1], _kind(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, database: str, table: str, column: str | None = None, partitions: int = 8, where: Sequence[tuple] = ()) -> DataFrame:
    """A table of a SQLite file that all executors can open.

    ``where`` holds conditions (column, operator, value), all of which must hold;
    the database applies them, so other rows are never read.  A value that it
    would compare otherwise than Spark does raises.  With ``column``, a column of
    whole numbers, ranges of it are read in parallel; rows without a value of it
    come with the first.  The file is opened for reading only.

    Conditions are part of what is loaded rather than handed down from later
    filters: in Spark 4.1 all uses of one loaded Python source share the filters
    that were handed down last, so that a union of two filtered reads of it would
    lose rows.
    """
    spark.dataSource.register(SqliteSource)
    options = {"database": database, "dbtable": table, "where": json.dumps([list(w) + [None] * (3 - len(w)) for w in where])}
    if column:
        options |= {"partitionColumn": column, "numPartitions": str(partitions)}
    return spark.read.format("sqlite_table").options(**options).load()
