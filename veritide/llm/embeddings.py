"""Near-duplicate embeddings by sorted projection passes.

A pass orders the vectors by the concatenated signs of random projections and
compares each with a bounded window of neighbours; links that hold by cosine in
double precision join the groups of all passes.  Near vectors share long
prefixes of signs and so stand close in some pass.  Equal vectors are one node
throughout.  An exact check of the groups against each other adds what no pass
found; within the joined groups links are then counted block by block, so that
a large group yields counts, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

#: Signs in a sort key: the bits of a non-negative long.
_BITS = 62
#: (largest group, vectors of a block) of the counting step: small groups spread, large ones copy each vector less often.
BLOCKS = ((4096, 256), (65_536, 1024), (None, 4096))
#: Vectors of one side of a task of the exact check at most, components of such a side at most, and vectors of a side compared at once.
WIDE, CELLS, TILE = 16_384, 1 << 20, 1024


def sort_keys(vectors: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """(vector, pass) sort keys; vectors that point the same way have the same keys."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], passes * _BITS))
    signs = (vectors @ planes > 0).reshape(len(vectors), passes, _BITS)
    return signs @ (np.int64(1) << np.arange(_BITS - 1, -1, -1, dtype=np.int64))


def usable(column: str) -> Column:
    """Whether a vector can link: not null or empty, no null or non-finite component, not all zero."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(F.col(column), lambda x: x != 0), F.lit(False))


class _Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, i: int) -> int:
        p = self.parent
        while (q := p.get(i, i)) != i:
            p[i] = i = p.get(q, q)
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def window_links(nodes: DataFrame, passes: int, window: int, least: float, seed: int) -> DataFrame:
    """(a, b): links found in all passes; those of a task form a forest.

    The sorted keys are numbered and cut into chunks; the first ``window`` rows of
    a chunk also go to the chunk before it, so that every row meets its whole
    window however many partitions there are.
    """
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = part.column(1).to_pylist()
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(values):
                    by_size.setdefault(len(v), []).append(i)
                for size, rows in by_size.items():
                    m = np.array([values[i] for i in rows], np.float64)
                    m /= np.abs(m).max(axis=1, keepdims=True)
                    keys = sort_keys(m, passes, seed)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.arange(passes, dtype=np.int64) + passes * size, len(rows))),
                            pa.array(keys.T.reshape(-1)),
                            part.column(0).take(pa.array(np.tile(rows, passes))),
                        ],
                        names=["pass", "key", "node"],
                    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        forest = _Forest()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                turn = part.column(0).to_numpy(zero_copy_only=False)
                node = part.column(2).to_numpy(zero_copy_only=False)
                values = part.column(3).to_pylist()
                found: list[tuple[int, int]] = []
                chunk = part.column(1).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, (turn[1:] != turn[:-1]) | (chunk[1:] != chunk[:-1])])
                for s, e in zip(starts, np.r_[starts[1:], len(turn)], strict=True):
                    m = np.array(values[s:e], np.float64)
                    m /= np.abs(m).max(axis=1, keepdims=True)
                    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
                    who = node[s:e]
                    lead = 0
                    if rest is not None and rest[0] == (turn[s], chunk[s]):
                        lead = len(rest[1])
                        who, m = np.concatenate([rest[1], who]), np.concatenate([rest[2], m])
                    for step in range(1, min(window, len(who) - 1) + 1):
                        first = max(0, lead - step)
                        near = np.einsum("ij,ij->i", m[first : len(m) - step], m[first + step :]) >= least
                        for i in (np.flatnonzero(near) + first).tolist():
                            if forest.join(int(who[i]), int(who[i + step])):
                                found.append((int(who[i]), int(who[i + step])))
                    rest = ((turn[s], chunk[s]), who[-window:], m[-window:])
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"]
                    )

    keyed = nodes.mapInArrow(spread, "pass long, key long, node long")
    spark = nodes.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(
        keyed.repartitionByRange(n, "pass", "key", "node")
        .sortWithinPartitions("pass", "key", "node")
        .select("pass", "node", F.monotonically_increasing_id().alias("at"))
    )
    # The id has the number of the range above bit 33 and the row in it below.
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    total = sum(c for _, c in counts)
    if not total:
        return spark.createDataFrame([], "a long, b long")
    before = np.cumsum([0, *[c for _, c in counts]]).tolist()
    offsets = spark.createDataFrame([(p, o) for (p, _), o in zip(counts, before, strict=False)], "part long, before long")
    chunk_rows = max(window, math.ceil(total / n))
    chunk, inside = F.expr(f"pos div {chunk_rows}"), F.col("pos") % chunk_rows
    chunks = F.when((inside < window) & (chunk > 0), F.array(chunk - 1, chunk)).otherwise(F.array(chunk))
    dealt = (
        placed.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("part"))
        .select("pass", "node", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"))
        .select("pass", F.explode(chunks).alias("chunk"), "node", "pos")
        .join(nodes, "node")
        .select("pass", "chunk", "node", "vector", "pos")
    )
    return dealt.repartitionByRange(n, "chunk").sortWithinPartitions("chunk", "pos").mapInArrow(compare, "a long, b long")


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    m = np.array(vectors, np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows and columns, as (row, column)."""
    across = np.ascontiguousarray(near.T)
    new_row, new_column = near.any(axis=1), near.any(axis=0)
    out: list[tuple[int, int]] = []
    for start in np.flatnonzero(new_row).tolist():
        if not new_row[start]:
            continue
        new_row[start] = False
        todo = [(True, start)]
        while todo:
            is_row, i = todo.pop()
            new = new_column if is_row else new_row
            reached = np.flatnonzero((near if is_row else across)[i] & new)
            new[reached] = False
            for j in reached.tolist():
                out.append((i, j) if is_row else (j, i))
                todo.append((not is_row, j))
    return out


def missed_links(nodes: DataFrame, roots: DataFrame, count: int, dims: int, least: float) -> DataFrame:
    """(a, b): links between nodes that ``roots`` has in different components, enough of them to join what all such links join.

    Every pair of blocks is one task's work, compared tile by tile, so memory is
    bounded at any number and length of vectors; work grows with count squared.
    """
    wide = max(1, min(WIDE, CELLS // max(1, dims)))
    blocks = max(1, math.ceil(count / wide))
    known = nodes.join(roots, "node", "left").select("node", "vector", F.coalesce("component", -1 - F.col("node")).alias("component"))
    mine = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    placed = known.select(mine.alias("mine"), F.size("vector").alias("dims"), other, "node", "component", "vector").select(
        "dims", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "component", "vector"
    )

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dims, p, q = (k.as_py() for k in key)
        flat = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = _unit(flat.reshape(-1, dims))
        mine, node, group = (t.column(c).to_numpy() for c in ("mine", "node", "component"))
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        forest, found = _Forest(), []
        for i in range(0, len(left), TILE):
            for j in range(0, len(right), TILE):
                x, y = left[i : i + TILE], right[j : j + TILE]
                near = m[x] @ m[y].T >= least
                if near.any():
                    near &= group[x][:, None] != group[y]
                    for u, v in _spanning(near):
                        if forest.join(int(node[x[u]]), int(node[y[v]])):
                            found.append((node[x[u]], node[y[v]]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return placed.groupBy("dims", "p", "q").applyInArrow(compare, "a long, b long")


def count_links(members: DataFrame, least: float) -> DataFrame:
    """(node, links): for each member of a group, the weight of the others of its group within reach.

    ``members`` has node, component, size (nodes of the component), weight and
    vector.  A group is cut into blocks whose size grows with the group's (BLOCKS)
    and every pair of blocks is one task's work: exact, in bounded memory, with
    one row for each node and block.
    """
    block = F.lit(BLOCKS[-1][1])
    for most, wide in reversed(BLOCKS[:-1]):
        block = F.when(F.col("size") <= most, wide).otherwise(block)
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    placed = members.select("component", mine.alias("mine"), other, "node", "weight", "vector").select(
        "component",
        F.least("mine", "other").alias("p"),
        F.greatest("mine", "other").alias("q"),
        "mine",
        "node",
        "weight",
        "vector",
    )

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        m = _unit(t.column("vector").to_pylist())
        w = t.column("weight").to_numpy()
        mine = t.column("mine").to_numpy()
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        links = np.zeros(len(w), np.int64)
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            near = m[part] @ m[right].T >= least
            if p == q:
                near[np.arange(len(part)), at + np.arange(len(part))] = False
            else:
                links[right] += near.T @ w[part]
            links[part] = near @ w[right]
        return pa.table({"node": t.column("node"), "links": links})

    return (
        placed.groupBy("component", "p", "q")
        .applyInArrow(count, "node long, links long")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )


def default_passes(nodes: int, window: int, least: float, recall: float = 0.98) -> int:
    """Passes after which a pair at the bound has been neighbours with probability ``recall``, for vectors spread evenly.

    Two vectors at that cosine agree in a sign with probability 1 - angle / pi;
    a window reaches those that share about log2(nodes / window) signs.
    """
    shared = max(1.0, math.log2(max(nodes, 2) / window))
    met = (1 - math.acos(min(least, 1.0)) / math.pi) ** shared
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(met, 0.999))))


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    least: float = 0.9,
    window: int = 64,
    passes: int | None = None,
    seed: int = 17,
    recall: float = 0.98,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of different lengths never link.  Null, empty or all-zero vectors
    and those with null or non-finite components link with nothing and are kept.
    Each row counts: equal vectors link with each other, and rows that repeat a
    vec_id are vectors of their own.  component_id is the smallest vec_id
    reached; it is null only for a row without a vec_id that reaches none, which
    is kept.  Unless ``passes`` is given, an exact check follows the passes, so
    that every link counts, whatever the number of vectors; ``recall`` says only
    how many of them the passes are meant to find.  With ``passes``, links
    between groups that no pass brings together are left out.  An empty table
    gives an empty result.
    """
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    linkable = source.where(usable("vector"))
    # Equal vectors have equal digests; adding 0 makes -0.0 equal to 0.0.
    digest = F.sha2(F.array_join(F.transform("vector", lambda x: (x + F.lit(0)).cast("string")), ","), 256)
    linkable = linkable.withColumn("same", digest)
    distinct = cut(
        linkable.groupBy("same")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    n = distinct.count()
    nodes = distinct.select("node", "vector")
    turns = passes or default_passes(n, window, least, recall)
    links = window_links(nodes, turns, window, least, seed)
    if passes is None:
        # What no pass brought together is found by an exact check of the groups against each other, at any number of vectors.
        links = cut(links)
        roots = components(links)
        longest = distinct.agg(F.max(F.size("vector"))).first()[0] or 0
        more = cut(missed_links(nodes, roots, n, longest, least))
        if not more.isEmpty():
            roots = components(links.union(more))
    else:
        roots = components(links)
    grouped = roots.join(distinct, "node")
    sizes = roots.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    counted = count_links(grouped.join(sizes, "component").select("node", "component", "size", "weight", "vector"), least)
    info = cut(
        distinct.select("node", "same", "least", "weight")
        .join(roots, "node", "left")
        .join(named, "component", "left")
        .join(counted, "node", "left")
        .select(
            "same",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    good = linkable.select("vec_id", "same").join(info, "same").select("vec_id", "n_links", "component_id")
    rest = source.where(~usable("vector")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return good.unionByName(rest).withColumn("kept", F.col("component_id").isNull() | F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and groups of every embedding; see near_duplicates() for nulls, unusable vectors and repeats."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
