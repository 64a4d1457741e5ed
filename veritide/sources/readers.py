"""Tables from files, object stores, databases and web endpoints, through Spark's data sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Readers by file extension.
FORMATS = {
    "csv": ("csv", {"header": "true"}),
    "tsv": ("csv", {"header": "true", "sep": "\t"}),
    "txt": ("csv", {"header": "true"}),
    "parquet": ("parquet", {}),
    "pq": ("parquet", {}),
    "json": ("json", {"multiLine": "true"}),
    "jsonl": ("json", {}),
    "ndjson": ("json", {}),
}

def register_format(extension: str, source: str, **options: str) -> None:
    """Read files of an extension with a source of Spark's, or one registered with it; an extension can't be taken twice."""
    if extension.lower() in FORMATS:
        raise ValueError(f".{extension} is taken")
    FORMATS[extension.lower()] = (source, options)


#: Driver URLs by database.
JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "db2": "jdbc:db2://{host}:{port}/{database}",
    "teradata": "jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}",
    "redshift": "jdbc:redshift://{host}:{port}/{database}",
    "snowflake": "jdbc:snowflake://{host}:{port}/?db={database}",
    "clickhouse": "jdbc:clickhouse://{host}:{port}/{database}",
    "trino": "jdbc:trino://{host}:{port}/{database}",
    "databricks": "jdbc:databricks://{host}:{port}/{database}",
    "bigquery": "jdbc:bigquery://{host}:{port};ProjectId={database}",
    "sqlite": "jdbc:sqlite:{database}",
}


def read_files(spark: SparkSession, path: str, schema: StructType | str | None = None, base_path: str | None = None, **options: str) -> DataFrame:
    """A file, folder or pattern by its extension; folders named column=value become partition columns.

    Text formats want a schema, since guessing one reads all data twice; without
    it their columns are texts.
    """
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension not in FORMATS:
        raise ValueError(f"no reader for .{extension}")
    name, defaults = FORMATS[extension]
    reader = spark.read.format(name).options(**{**defaults, **options})
    if base_path:
        reader = reader.option("basePath", base_path)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, kind: str, table: str, *, host: str = "", port: int = 0, database: str = "", column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric column and its bounds it is read in parallel ranges."""
    url = JDBC_URLS[kind].format(host=host, port=port, database=database)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def sample(df: DataFrame, plan: str, *, fraction: float = 0.01, rows: int = 1000, strata: str | None = None, fractions: Mapping | None = None, partition: str | None = None, newest: int = 1, order: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """Rows by a plan: full, head, systematic, stratified, reservoir or recent_partitions.  Filter before sampling."""
    if plan == "full":
        return df
    if plan == "head":
        return df.limit(rows)
    if plan == "systematic":
        step = max(1, round(1 / fraction))
        return df.where(F.pmod(F.xxhash64(*(order or df.columns)), F.lit(step)) == 0)
    if plan == "stratified":
        return df.sampleBy(strata, fractions, seed)
    if plan == "reservoir":
        return df.orderBy(F.rand(seed)).limit(rows)
    if plan == "recent_partitions":
        last = df.select(partition).distinct().orderBy(F.desc(partition)).limit(newest)
        return df.join(F.broadcast(last), partition, "left_semi")
    raise ValueError(f"no plan {plan!r}")


def rest_source(spark: SparkSession, name: str, fetch, schema: str) -> None:
    """Register a paged web endpoint as a data source: ``fetch(page)`` returns rows as dicts, none after the last page.

    Pages are read one after another by one task; the option ``pages`` lets that
    many tasks read one page each.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    columns = StructType.fromDDL(schema).names

    class Pages(DataSourceReader):
        def __init__(self, options):
            self.pages = int(options.get("pages", 0))

        def partitions(self):
            return [InputPartition(i) for i in range(self.pages)] or [InputPartition(None)]

        def read(self, partition):
            page = partition.value or 0
            while rows := fetch(page):
                yield from (tuple(r.get(c) for c in columns) for r in rows)
                if partition.value is not None:
                    return
                page += 1

    class Endpoint(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Pages(self.options)

    spark.dataSource.register(Endpoint)


def changed_since(df: DataFrame, column: str, mark, lookback_seconds: int = 0) -> DataFrame:
    """Rows at or after a stored high point, less a lookback for late rows; all rows without one."""
    if mark is None:
        return df
    return df.where(F.col(column) >= F.lit(mark).cast("timestamp") - F.make_dt_interval(secs=F.lit(lookback_seconds)))


def scan_scope(df: DataFrame, column: str, mark, lookback_seconds: int = 0, change_column: str | None = None, now=None, last_sweep=None, sweep_seconds: int | None = None) -> tuple[DataFrame, str]:
    """(rows to read, coverage): full, incremental, or forward_only where a restatement would not be seen.

    All rows are read without a high point or when a sweep is due; else those at
    or after it less the lookback, and those whose ``change_column`` is.
    """
    due = sweep_seconds is not None and (last_sweep is None or (now - last_sweep).total_seconds() >= sweep_seconds)
    if mark is None or due:
        return df, "full"
    low = F.lit(mark).cast("timestamp") - F.make_dt_interval(secs=F.lit(lookback_seconds))
    wanted = F.col(column) >= low
    if change_column:
        wanted = wanted | (F.col(change_column) >= low)
    return df.where(wanted), "incremental" if lookback_seconds or change_column else "forward_only"


def qualified(verdict: Column, coverage: str) -> Column:
    """A verdict said at the width at which it was established."""
    return verdict if coverage == "full" else F.concat(verdict, F.lit(" over the rows examined"))


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
