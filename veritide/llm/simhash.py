"""SimHash near-duplicates, linked by anchor-point covering.

Two 64-bit fingerprints that differ in at most ``threshold`` bits differ in at
most threshold // 2 of one of their 32-bit halves.  The anchors of a half are
the words of the Hamming code of length 31, a perfect covering code of radius
1: a fingerprint stands at its nearest anchor, and a copy goes to every anchor
within the radius plus the half's threshold.  If two fingerprints differ little
enough in a half, one stands at an anchor that the other is copied to, so
comparing per anchor misses none.  Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, table
from .components import components

#: Rows of one block of comparisons.
_BLOCK = 1024
#: Fingerprints that stand at an anchor in one task; an anchor of more is split.
HOT = 8192
#: Split anchors (16 bytes each) that are sent to every task at most; more are joined by a shuffle.
_SENT = 500_000


def fingerprint_of(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 values of all word shingles, repeats included; no words give zero."""
    import xxhash

    tokens = text.encode("utf-8", "replace").lower().split()
    n = len(tokens)
    if not n:
        return 0
    body = b" ".join(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(body, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    shingles = [body[a:b] for a, b in zip(starts[: n - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    for a in range(0, len(shingles), 65536):
        raw = b"".join([digest(s, seed) for s in shingles[a : a + 65536]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; null texts count as empty."""

    def make():
        def run(texts: list[str]) -> dict[str, list]:
            return {"fp": np.array([fingerprint_of(t, words) for t in texts], np.uint64).view(np.int64)}

        return run

    return map_texts(docs, [doc_id], text, make, "fp long")


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Syndrome of 31-bit words under the Hamming code: the xor of the numbers 1..31 of the bits set."""
    out = np.zeros(len(word), np.int64)
    for bit in range(31):
        out ^= np.where(word >> bit & 1, bit + 1, 0)
    return out


def _nearest(word: np.ndarray) -> np.ndarray:
    """The one anchor within distance 1."""
    s = _syndrome(word)
    return np.where(s > 0, word ^ (np.int64(1) << np.maximum(s - 1, 0)), word)


def _patterns(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All bit patterns of up to ``reach`` of 31 bits, with their syndromes, in order of the syndrome."""
    masks = [sum(1 << b for b in c) for k in range(reach + 1) for c in combinations(range(31), k)]
    mask = np.array(masks, np.int64)
    s = _syndrome(mask)
    order = np.argsort(s, kind="stable")
    return mask[order], s[order]


def anchors(fp: np.ndarray, threshold: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, is home) of every anchor within reach of each fingerprint, over both halves."""
    mask, syndrome = _patterns(1 + threshold // 2)
    first = np.searchsorted(syndrome, np.arange(33))
    rows, keys, homes = [], [], []
    for half in (0, 1):
        word = (fp >> (32 * half)) & 0x7FFFFFFF
        s = _syndrome(word)
        home = _nearest(word)
        # A pattern leads from a word to an anchor if its syndrome is the word's.
        count = first[s + 1] - first[s]
        row = np.repeat(np.arange(len(fp)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        anchor = word[row] ^ mask[first[s[row]] + within]
        rows.append(row)
        keys.append(anchor | np.int64(half) << 31)
        homes.append(anchor == home[row])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def home_anchors(fp: np.ndarray) -> np.ndarray:
    """The anchors at which fingerprints stand, one for each half, end to end."""
    return np.concatenate([_nearest((fp >> (32 * half)) & 0x7FFFFFFF) | np.int64(half) << 31 for half in (0, 1)])


def spanning_links(fps: np.ndarray, owner: np.ndarray, other: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join the same groups as all pairs (owner, other) within ``threshold`` bits do; fewer than len(fps)."""
    parent = np.arange(len(fps))
    value = fps.view(np.uint64)
    out: list[tuple[int, int]] = []
    owners, others = np.flatnonzero(owner), np.flatnonzero(other)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def apart(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        return np.array([root(i) for i in mine])[:, None] != np.array([root(j) for j in theirs])[None, :]

    for a in range(0, len(owners), _BLOCK):
        mine = owners[a : a + _BLOCK]
        for b in range(0, len(others), _BLOCK):
            theirs = others[b : b + _BLOCK]
            near = np.bitwise_count(value[mine][:, None] ^ value[theirs][None, :]) <= threshold
            if near.any():
                near &= apart(mine, theirs)
            while near.any():
                # One link for each later member still apart, then look again at what is left.
                i = near.argmax(axis=0)
                j = np.flatnonzero(near.any(axis=0))
                for x, y in zip(mine[i[j]].tolist(), theirs[j].tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((int(fps[x]), int(fps[y])))
                near &= apart(mine, theirs)
    return out


def _split(copies: DataFrame, hot: DataFrame) -> DataFrame:
    """Copies with the cells in which they are compared: cell 0, or for a hot anchor of n parts the pairs (p, q) of parts.

    Cell (p, q) holds those that stand at the anchor of part p and all copies of part q.
    """
    count = hot.count()
    if not count:
        return copies.select("anchor", F.lit(0).alias("cell"), "fp", F.col("home").alias("owner"), F.lit(True).alias("other"))
    hot = hot.withColumnRenamed("anchor", "hot_anchor")
    joined = copies.join(F.broadcast(hot) if count <= _SENT else hot, F.col("anchor") == F.col("hot_anchor"), "left")
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    each = F.sequence(F.lit(0), parts - 1)
    as_other = F.transform(each, lambda p: F.struct((p * parts + mine).alias("cell"), (F.col("home") & (p == mine)).alias("owner"), F.lit(True).alias("other")))
    away = F.filter(each, lambda q: q != mine)
    as_owner = F.transform(F.when(F.col("home"), away).otherwise(F.slice(each, 1, 0)), lambda q: F.struct((mine * parts + q).alias("cell"), F.lit(True).alias("owner"), F.lit(False).alias("other")))
    return joined.select("anchor", "fp", F.inline(F.concat(as_other, as_owner))).select("anchor", "cell", "fp", "owner", "other")


def link_fingerprints(distinct: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b): fingerprint links that join all fingerprints within ``threshold`` bits; at most one row per copy.

    ``distinct`` has one long column of different fingerprints.  A group is one
    anchor's copies, eight bytes each; an anchor at which more than HOT
    fingerprints stand is split, and every pair of its parts is a group of its
    own.  A group is compared in blocks and its links form a forest, so none
    grows with the square of a group.
    """
    column = distinct.columns[0]

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 20_000):
                part = fp[a : a + 20_000]
                row, key, home = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"]
                )

    def stand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(home_anchors(batch.column(0).to_numpy(zero_copy_only=False)))], names=["anchor"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by anchor and cell: groups may span batches."""

        def emit(anchor, cell, fp, owner, other):
            n = len(anchor)
            starts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])])
            ends = np.r_[starts[1:], n]
            links = []
            counts = np.add.reduceat(owner.astype(np.int64), starts)
            size = ends - starts
            two = (size == 2) & (counts > 0)
            i = starts[two]
            i = i[(owner[i] & other[i + 1]) | (other[i] & owner[i + 1])]
            close = np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + 1].view(np.uint64)) <= threshold
            links.extend(zip(fp[i][close].tolist(), fp[i + 1][close].tolist(), strict=True))
            more = (size > 2) & (counts > 0)
            for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                links.extend(spanning_links(fp[s:e], owner[s:e], other[s:e], threshold))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
            )

        rest: list[list[np.ndarray]] = []
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            edge = int(last[-1]) + 1 if len(last) else 0
            if edge:
                yield emit(*[np.concatenate(x) for x in zip(*rest, [x[:edge] for x in now], strict=True)])
                rest = []
            elif rest and (rest[-1][0][-1], rest[-1][1][-1]) != (now[0][0], now[1][0]):
                yield emit(*[np.concatenate(x) for x in zip(*rest, strict=True)])
                rest = []
            rest.append([x[edge:] for x in now])
        if rest:
            yield emit(*[np.concatenate(x) for x in zip(*rest, strict=True)])

    known = distinct.where(F.col(column).isNotNull())
    hot = known.mapInArrow(stand, "anchor long").groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).where("parts > 1")
    cells = _split(known.mapInArrow(spread, "anchor long, fp long, home boolean"), cut(hot))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 3, words: int = 3
) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (hex), component_id, kept.

    Fingerprints with at most ``threshold`` differing bits are linked;
    component_id is the smallest doc_id that links reach and kept marks its
    rows.  Texts without a word, null ones included, have fingerprint zero and
    are linked like any other.  Rows without a doc_id get a component but are
    never its smallest member; where all members lack one, component_id is
    null and all are kept.  An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, doc_id, text, words).withColumnRenamed(doc_id, "doc_id"))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_fingerprints(nodes.select("fp"), threshold))
    classes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"].alias("fp"), "least", F.coalesce("component", nodes["fp"]).alias("class")
    )
    named = classes.join(
        classes.groupBy("class").agg(F.min("least").alias("component_id")), "class"
    ).select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id",
        "fp",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        (F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document with the smallest doc_id stays.

    Rows that repeat a doc_id count as one document and stay or go together;
    so do those without one.
    """
    stay = near_duplicates(docs, doc_id, text, threshold).where("kept").select(F.col("doc_id").alias("stay_id")).distinct()
    return docs.join(stay, docs[doc_id].eqNullSafe(stay["stay_id"]), "left_semi")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document; see near_duplicates() for nulls, empty texts and repeats."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")
