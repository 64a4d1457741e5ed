"""Vector code compression: product codes by Elkan's form of Lloyd's algorithm.

Vectors of integers are cut into parts; each part position has a codebook that a
fixed number of rounds fits.  From round to round every part keeps an upper
bound of the distance to its entry and a lower bound of the distance to each
entry of the codebook, shifted by how far the entries moved.  An entry is left
out only if the triangle inequality says that it is strictly farther; what
remains is compared by squared distances in integers, so ties are ties.  Stored
bounds are rounded outwards (upper ones up, lower ones down to half precision),
which costs comparisons but never a result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot, table

SCALE = 1024
#: Relative room for rounding in computed distances, far above that of double precision.
_ROOM = 1e-9
#: Rows of a batch whose bounds are worked on at once.
_ROWS = 2048
_STATE = "vec_id {id}, label {label}, vector binary, code binary, error long, upper binary, lower binary"


def _up(values: np.ndarray) -> np.ndarray:
    return np.nextafter((values * (1 + _ROOM)).astype(np.float32), np.float32(np.inf))


def _down(values: np.ndarray) -> np.ndarray:
    """Half-precision values that are no greater; a bound beyond their range is lowered to its end."""
    values = np.clip(values * (1 - _ROOM), 0, 65504)
    half = values.astype(np.float16)
    return np.where(half > values, np.nextafter(half, np.float16(-1)), half)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, in integers, of all rows of ``a`` from all rows of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        out += gap * gap
    return out


class Entries:
    """A codebook of one part position: its entries, how far they moved and how far they are apart."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        apart = np.sqrt(squares(now, now)) * (1 - _ROOM) / 2
        self.half = apart.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1, initial=np.inf)
        if before is not None:
            gap = now - before
            self.moved = np.sqrt((gap * gap).sum(axis=1)) * (1 + _ROOM)


def assign(x: np.ndarray, entries: Entries, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """(code, upper, lower) of each row of ``x``: its nearest entry, the one of lower index in a tie, and new bounds.

    Without a code to start from every distance is computed; otherwise ``upper``
    and ``lower`` are the bounds before the entries moved.
    """
    c = entries.now
    if code is None:
        d = squares(x, c)
        code = d.argmin(axis=1)
        root = np.sqrt(d)
        return code, _up(root[np.arange(len(x)), code]), _down(root)
    upper = _up(upper + entries.moved[code])
    lower = _down(lower - entries.moved)
    code = code.copy()
    # Strictly below half the way to the nearest other entry: none can be as near.
    todo = np.flatnonzero(upper >= entries.nearest[code])
    near = (upper[todo, None] >= lower[todo]) & (upper[todo, None] >= entries.half[code[todo]])
    near[np.arange(len(todo)), code[todo]] = False
    some = near.any(axis=1)
    todo, near = todo[some], near[some]
    gap = x[todo] - c[code[todo]]
    own = (gap * gap).sum(axis=1)
    root = np.sqrt(own)
    upper[todo] = _up(root)
    lower[todo, code[todo]] = _down(root)
    near &= (upper[todo, None] >= lower[todo]) & (upper[todo, None] >= entries.half[code[todo]])
    row, entry = np.nonzero(near)
    gap = x[todo[row]] - c[entry]
    d = (gap * gap).sum(axis=1)
    lower[todo[row], entry] = _down(np.sqrt(d))
    best = np.full(near.shape, np.iinfo(np.int64).max)
    best[row, entry] = d
    best[np.arange(len(todo)), code[todo]] = own
    code[todo] = best.argmin(axis=1)
    upper[todo] = _up(np.sqrt(best[np.arange(len(todo)), code[todo]]))
    return code, upper, lower


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of the usable vectors, and their length, a multiple of ``parts``."""
    column = F.col("embedding")
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding")).where(column.isNotNull() & ~bad)
    dims = parts * math.ceil((usable.agg(F.max(F.size("embedding"))).first()[0] or 0) / parts)
    # Whatever lies beyond couldn't be squared and summed in 64 bits.
    most = math.isqrt((1 << 60) // max(1, dims))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("int")

    ints = F.transform(column, whole)
    padded = F.concat(ints, F.array_repeat(F.lit(0), F.lit(dims) - F.size(ints)))
    return usable.select("vec_id", "label", padded.alias("ints")), dims


def _matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _rows(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def _round(df: DataFrame, books: np.ndarray, before: np.ndarray | None, schema: str, last: bool) -> DataFrame:
    """Every part assigned to the entries of ``books``; ``before`` is what they were when the bounds of ``df`` were right."""
    parts, k, d = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Entries(books[p], None if before is None else before[p]) for p in range(parts)]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                n = part.num_rows
                if before is None:
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, parts, d)
                    old = (None,) * 3
                else:
                    x = _matrix(part.column(2), np.int32, parts, d)
                    old = (_matrix(part.column(3), np.uint8, parts), _matrix(part.column(5), np.float32, parts), _matrix(part.column(6), np.float16, parts, k))
                wide = x.astype(np.int64)
                code = np.empty((n, parts), np.uint8)
                upper = np.empty((n, parts), np.float32)
                lower = np.empty((n, parts, k), np.float16)
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    mine = [None if o is None else o[:, p] for o in old]
                    if mine[0] is not None:
                        mine = [mine[0].astype(np.int64), mine[1].astype(np.float64), mine[2].astype(np.float64)]
                    code[:, p], upper[:, p], lower[:, p] = assign(wide[:, p], entries[p], *mine)
                    gap = wide[:, p] - books[p][code[:, p]]
                    error += (gap * gap).sum(axis=1)
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), nothing if last else _rows(x), _rows(code), pa.array(error), nothing if last else _rows(upper), nothing if last else _rows(lower)],
                    names=["vec_id", "label", "vector", "code", "error", "upper", "lower"],
                )

    return df.mapInArrow(run, schema)


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries replaced by the floored means of their parts; each task sends one row for each number of a codebook at most."""
    parts, k, d = books.shape

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, k, d + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), np.int32, parts, d).astype(np.int64)
            code = _matrix(batch.column(1), np.uint8, parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
        at = np.flatnonzero(np.repeat(sums[:, :, -1].reshape(-1) > 0, d + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], names=["place", "total"])

    # parts * entries * (length + 1) rows at most.
    rows = state.select("vector", "code").mapInArrow(add, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros(parts * k * (d + 1), np.int64)
    for r in rows:
        sums[r["place"]] = r["total"]
    sums = sums.reshape(parts, k, d + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def encode(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks): product codes and what they lose.

    code is a byte for each part; error the sum of squared distances; label_error
    the sum of error over rows of an equal label, those without one together (null
    where it doesn't fit a long).  Left out are null vectors and those with null or
    non-finite components.  A component x counts as floor(1024 * x); beyond what
    64 bits can square and sum (2^27 for 64 components) it counts as that bound.
    Vectors shorter than the longest, or than a multiple of ``parts``, count as if
    zeros followed.  The codebooks start from the ``entries`` (256 at most) smallest
    vec_ids, rows without one last and equal ones by their vectors, and have fewer
    entries if there are fewer rows.  Rows that repeat a vec_id are encoded each;
    an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    source, dims = integer_vectors(vectors, vec_id, embedding, label, parts)
    d = dims // parts
    first = source.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, d).transpose(1, 0, 2)
    kinds = {"id": source.schema["vec_id"].dataType.simpleString(), "label": source.schema["label"].dataType.simpleString()}
    schema = _STATE.format(**kinds)
    if not len(first):
        return spark.createDataFrame([], f"vec_id {kinds['id']}, label {kinds['label']}, code binary, error long, label_error long"), books
    scratch = Scratch(spark, "codes")
    state, before = source, None
    for turn in range(rounds + 1):
        state = scratch.keep(_round(state, books, before, schema, turn == rounds), f"round-{turn}")
        if turn:
            scratch.drop(f"round-{turn - 1}")
        if turn < rounds:
            before, books = books, _means(state, books)
    same = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = state.select("vec_id", "label", "code", "error", same.alias("same"))
    sums = coded.groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS long)").alias("label_error"))
    return join_hot(coded, sums, "same", "rows").select("vec_id", "label", "code", "error", "label_error"), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Four-byte codes of every embedding; see encode() for nulls, ties and repeats."""
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
