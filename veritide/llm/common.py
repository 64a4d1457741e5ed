"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one slice of a batch holds at most, unless one text alone is longer.
SLICE_CHARS = 2_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only on a local master where none is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="veritide-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables, as Parquet, in a folder of their own below the checkpoint folder.

    A table that is read back loses its lineage, and later steps read only the
    columns they need.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where a few keys may hold most of ``left``.

    ``right`` has one row for each key; its column ``rows`` says how many rows of
    ``left`` have that key.  Keys with more than a thousandth of the sum are fewer
    than a thousand; those are broadcast, the others are shuffled.  ``how`` is
    "inner" or "left"; keys aren't null.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    heavy = F.col(rows) * 1000 > total
    hot = right.where(heavy)
    of_hot = left.join(F.broadcast(hot), key)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(~heavy), key, how)
    return of_hot.unionByName(others)


#: Buckets of 32,768 bits, 4 KB, of a bitmap; there are BITS bits a key or more, up to the most buckets (32 MB).
MOST_BUCKETS, BITS = 8192, 16


def bitmaps(keys: DataFrame) -> tuple[DataFrame, int]:
    """((bucket, bits), number of buckets): a bit for each of ``keys``, one column of longs, by their lowest bits."""
    key = keys.columns[0]
    wanted = max(1, BITS * keys.count())
    buckets = min(MOST_BUCKETS, 1 << (math.ceil(wanted / 32768) - 1).bit_length())
    bucket = F.pmod(F.shiftright(key, 15), F.lit(buckets)).cast("int")
    return keys.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(key, F.lit(32768))).alias("bits")), buckets


def bitmap_bytes(keys: DataFrame) -> bytes:
    """The bitmap of ``keys`` as one string of a power of two of bytes, 32 MB at most."""
    rows, buckets = bitmaps(keys)
    out = bytearray(4096 * buckets)
    for r in rows.collect():
        out[4096 * r["bucket"] : 4096 * (r["bucket"] + 1)] = r["bits"]
    return bytes(out)


def marked_by(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with whether its long ``key`` has a bit set by ``keys``: true for all that are in it and, as keys share bits, for some others.

    The bitmap is broadcast, so that most rows that a join would leave alone
    aren't shuffled for it.
    """
    rows, buckets = bitmaps(keys)
    wide = df.join(F.broadcast(rows), F.pmod(F.shiftright(key, 15), F.lit(buckets)).cast("int") == F.col("bucket"), "left")
    position = F.pmod(key, F.lit(32768)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return wide.withColumn(flag, F.coalesce(F.getbit(byte, position % 8) == 1, F.lit(False))).drop("bucket", "bits")


def may_be_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long ``key`` may be in ``keys``: all that are, and a few others."""
    return marked_by(df, key, keys, "__may").where("__may").drop("__may")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str, max_chars: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of consecutive runs of rows; null texts become empty ones."""
    column = batch.column(batch.schema.get_field_index(text))
    texts: list[str] = []
    first, size = 0, 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if texts and size + len(t) > max_chars:
            yield first, i, texts
            texts, first, size = [], i, 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, first + len(texts), texts


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    schema: str,
) -> DataFrame:
    """One output row for each input row: the columns ``keep``, then what ``make()`` computes from the texts.

    ``make`` runs once in each task and returns a function from a list of texts
    to a dict of columns; ``schema`` is the DDL of those columns.
    """
    kept = df.select(*[F.col(c) for c in keep])
    out = kept.schema
    for f in _schema(df.sparkSession, schema):
        out = out.add(f)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for a, b, texts in slices(batch, text):
                columns = f(texts)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in keep]
                    + [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()],
                    names=[*keep, *columns],
                )

    select = list(dict.fromkeys([*keep, text]))
    return df.select(*[F.col(c) for c in select]).mapInArrow(run, out)


def _schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def tokenizer_file(name: str, path: str | None = None) -> str:
    """``path`` if given, else the place of one of the installed public vocabulary files."""
    if path:
        return path
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
