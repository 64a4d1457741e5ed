"""Removal of repeated byte strings, by suffix arrays built block by block with a difference cover.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere
else.  The suffixes to sort are those that start such a string, a window.

*Buckets.*  A window belongs to the bucket of its minimizer, the k-mer of least
hash in it, so equal windows are in one bucket.  Consecutive windows of one
minimizer are a run; a run's text, of twice the width at most, is all that its
bucket needs of a document, so a bucket is sorted without the rest of the corpus.
Runs with equal texts are counted, not sorted: all their windows repeat.  Only
buckets that hold different texts, one of them found once, are sorted.

*Blocks.*  Buckets are sorted in blocks of bounded size.  First the suffixes at
a block's positions in a difference cover are ranked, as deep as a window is
long.  The windows are then sorted one bucket of leading bytes at a time: by as
many bytes as the cover's period, and what still ties by the ranks of the cover
positions a few bytes on, which some shift below the period reaches for any two
windows at once.  Neighbours with a whole window in common are repeats.

*Unlike runs.*  A first pass counts the keys of runs, and a bitmap of bounded
size of those found twice goes to the tasks of the second, so that most runs
never leave theirs; likewise only texts that a bitmap lets through are shuffled
where a text is wanted.  What shares a bit is told apart by what follows.

*Hot buckets.*  A bucket with more than ``limit`` different texts is split
without comparing them: its runs are cut into short runs at fixed distances from
the minimizer, and bucketed by the bytes that all windows of a short run share;
those still too large are cut into single windows, which need counting only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap_bytes, join_hot, may_be_in, table

#: Residues whose differences are all residues: powers of two modulo 73 (fixed values).
PERIOD, COVER = 73, (1, 2, 4, 8, 16, 32, 37, 55, 64)
#: Bytes by which windows are sorted first: the period in whole words of eight.
DEPTH = PERIOD + -PERIOD % 8
#: Bytes of a k-mer, a power of two; of a piece of text hashed at once; of a block; windows of a bucket of leading bytes.
KMER, PIECE, BLOCK, BUCKET = 32, 1 << 19, 1 << 20, 1 << 16
#: Windows of a run after each split of a hot bucket.
SPLITS = (16, 1)
_RUN = "key long, digest binary, node binary, start int, windows int, lead int"


def shifts() -> np.ndarray:
    """[a, b]: the least shift that takes residues a and b into the cover at once."""
    into = np.isin(np.arange(PERIOD), COVER)
    later = into[(np.arange(PERIOD)[:, None] + np.arange(PERIOD)) % PERIOD]
    return (later[:, None, :] & later[None, :, :]).argmax(axis=2)


def _keys(text: np.ndarray, past: int) -> np.ndarray:
    """At each position, and ``past`` more, the next eight bytes as a number; zeros follow the end."""
    n = len(text) + past
    padded = np.zeros(n + 8, np.uint64)
    padded[: len(text)] = text
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= padded[i : i + n]
    return out


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts, for each row of sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _ties(group: np.ndarray) -> np.ndarray:
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


def _uneven(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rows of those groups, runs of equal ``group``, in which ``key`` differs."""
    new = np.r_[True, group[1:] != group[:-1]]
    run = np.cumsum(new) - 1
    differs = np.zeros(run[-1] + 1, bool)
    differs[run[1:][(key[1:] != key[:-1]) & ~new[1:]]] = True
    return np.flatnonzero(differs[run])


def _refine(order: np.ndarray, group: np.ndarray, key) -> bool:
    """Sort the groups of ``order`` by key(items) in place and split them; whether any group was left."""
    tied = _ties(group)
    if not len(tied):
        return False
    k = key(order[tied])
    # Copies agree in every key; only groups that don't are sorted.
    some = _uneven(group[tied], k)
    tied, k = tied[some], k[some]
    if len(tied):
        items, g = order[tied], group[tied]
        by = np.lexsort((k, g))
        order[tied], g, k = items[by], g[by], k[by]
        group[tied] = tied[_firsts(g, k)]
    return True


def _by_bytes(keys: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of their next ``depth`` bytes, the first place of the group that ties with each)."""
    order = at[np.argsort(keys[at], kind="stable")]
    group = _firsts(keys[order])
    for deep in range(8, depth, 8):
        if not _refine(order, group, lambda p, d=deep: keys[p + d]):
            break
    return order, group


def cover_ranks(keys: np.ndarray, size: int, depth: int) -> np.ndarray:
    """For each position of the cover, its rank by ``depth`` bytes or more; -1 elsewhere, and past the end."""
    at = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER))
    rank = np.full(len(keys) + depth + PERIOD, -1, np.int32)
    order, group = _by_bytes(keys, at, PERIOD)
    reached = step = PERIOD
    while True:
        rank[order] = group
        if reached >= depth or not _refine(order, group, lambda p, s=step: rank[p + s]):
            return rank
        reached, step = reached + step, 2 * step


def repeated(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of the strings of ``width`` bytes at ``starts``, all inside ``text``, equal the string at another of them."""
    keys = _keys(text, width + 2 * DEPTH)
    rank = cover_ranks(keys, len(text), width)
    shift = shifts()
    view = np.lib.stride_tricks.sliding_window_view(text, width)
    out = np.zeros(len(starts), bool)
    lead = keys[starts]
    some = np.sort(lead)[::BUCKET][1:]
    bucket = np.searchsorted(some, lead, side="right")
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by_bucket], np.arange(len(some) + 2))
    rng = np.random.default_rng(len(starts))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            mine = by_bucket[a:b]
            out[mine] = _repeated_in_bucket(keys, rank, shift, view, starts[mine], rng)
    return out


def _repeated_in_bucket(keys, rank, shift, view, starts, rng) -> np.ndarray:
    by = np.argsort(starts, kind="stable")
    order, group = _by_bytes(keys, starts, PERIOD)
    prefix = group.copy()
    # What ties by a period of bytes is split by cover ranks around a member of each group; those that equal it are done.
    open_ = np.ones(len(order), bool)
    while True:
        left = np.flatnonzero(open_)
        g = group[left]
        tied = _ties(g)
        if not len(tied):
            break
        left, g = left[tied], g[tied]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[first, len(g)])
        pivot = np.repeat(order[left[first + rng.integers(0, sizes)]], sizes)
        item = order[left]
        d = shift[item % PERIOD, pivot % PERIOD]
        side = np.sign(rank[item + d] - rank[pivot + d])
        open_[left] = side != 0
        some = _uneven(g, side)
        left, item, g, side = left[some], item[some], g[some], side[some]
        if len(left):
            turn = np.lexsort((side, g))
            order[left], g, side = item[turn], g[turn], side[turn]
            group[left] = left[_firsts(g, side)]
            open_[left] = side != 0
    same = np.zeros(len(order) + 1, bool)
    # Equal ranks say that a whole window is equal; other neighbours are compared.
    same[1:-1] = group[1:] == group[:-1]
    near = np.flatnonzero((prefix[1:] == prefix[:-1]) & ~same[1:-1])
    for at in range(0, len(near), 4096):
        i = near[at : at + 4096]
        same[i + 1] = (view[order[i]] == view[order[i + 1]]).all(axis=1)
    out = np.zeros(len(starts), bool)
    out[by[np.searchsorted(starts[by], order)]] = same[1:] | same[:-1]
    return out


def _mixing() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def runs(text: np.ndarray, ends: np.ndarray, width: int, mixing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, lead, key) of the runs of documents laid end to end, ``ends`` being where they end.

    lead is how far the minimizer lies behind the run's start; among equal hashes
    the leftmost k-mer of a window counts.  At most 2^20 bytes.
    """
    n = len(text) - width + 1
    nothing = np.zeros(0, np.int64)
    if n <= 0:
        return nothing, nothing, nothing, nothing
    h, size = mixing[text], 1
    while size < KMER:
        h = (h[: len(h) - size] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[size:] + (h[size:] >> np.uint64(29)))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        size *= 2
    low = np.uint64((1 << 20) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, size = width - KMER + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[span - size : span - size + n])
    place = (least & low).astype(np.int64)
    at = np.arange(n)
    inside = at + width <= ends[np.searchsorted(ends, at, side="right")]
    at, place = at[inside], place[inside]
    if not len(at):
        return nothing, nothing, nothing, nothing
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    start = at[new]
    return start, np.diff(np.r_[new, len(at)]), place[new] - start, h[place[new]].view(np.int64)


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


_RUN_NAMES = ["key", "digest", "node", "start", "windows", "lead"]
_RUN_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[list[tuple[bytes, int, bytes]]]:
    """Lists of (node, place in its text, bytes), of PIECE bytes at most together; pieces of a longer text overlap by a window."""
    pieces, size = [], 0
    for node, raw in zip(batch.column(0), batch.column(1), strict=True):
        node, raw = node.as_py(), raw.as_py()
        if len(raw) < width:
            continue
        for at in range(0, len(raw) - width + 1, PIECE - width):
            piece = raw[at : at + PIECE - 1]
            if pieces and size + len(piece) > PIECE:
                yield pieces
                pieces, size = [], 0
            pieces.append((node, at, piece))
            size += len(piece)
    if pieces:
        yield pieces


def _laid(pieces: list[tuple[bytes, int, bytes]]) -> tuple[bytes, np.ndarray]:
    return b"".join(p[2] for p in pieces), np.cumsum([len(p[2]) for p in pieces])


def _repeated_keys(source: DataFrame, width: int) -> DataFrame:
    """(key): those of two runs or more."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixing = _mixing()
        for batch in batches:
            for pieces in _pieces(batch, width):
                raw, ends = _laid(pieces)
                key, n = np.unique(runs(np.frombuffer(raw, np.uint8), ends, width, mixing)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return source.select("node", "bytes").mapInArrow(find, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _all_runs(source: DataFrame, width: int, bits: bytes) -> DataFrame:
    """Runs of every text whose key has its bit set."""
    low = 8 * len(bits) - 1

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixing = _mixing()
        marks = np.frombuffer(bits, np.uint8)
        for batch in batches:
            for pieces in _pieces(batch, width):
                raw, ends = _laid(pieces)
                start, windows, lead, key = runs(np.frombuffer(raw, np.uint8), ends, width, mixing)
                place = key & low
                some = (marks[place >> 3] >> (place & 7)) & 1 == 1
                start, windows, lead, key = start[some], windows[some], lead[some], key[some]
                which = np.searchsorted(ends, start, side="right")
                before = np.r_[0, ends][which]
                rows = []
                for k, w, s, c, b, x in zip(key.tolist(), which.tolist(), start.tolist(), windows.tolist(), before.tolist(), lead.tolist(), strict=True):
                    node, offset, _ = pieces[w]
                    rows.append((k, hashlib.blake2b(raw[s : s + c + width - 1], digest_size=16).digest(), node, s - b + offset, c, x))
                if rows:
                    yield _batches(rows, _RUN_NAMES, _RUN_KINDS)

    return source.select("node", "bytes").mapInArrow(find, _RUN)


def _short_runs(texts: DataFrame, width: int, most: int) -> DataFrame:
    """Runs of ``most`` windows at most, cut where the distance of a window from its minimizer is a multiple of that."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = []
                for run in batch.column(2)[i].as_py():
                    start, lead, left = run["start"], run["lead"], run["windows"]
                    while left:
                        step = lead // most
                        take = min(left, lead - step * most + 1)
                        # What all windows of this step have in common, whichever of them are here.
                        common = start + lead - step * most
                        core = raw[common : common + width - most + 1]
                        key = hashlib.blake2b(b"%d:" % step + core, digest_size=8).digest()
                        text = hashlib.blake2b(raw[start : start + take + width - 1], digest_size=16).digest()
                        rows.append((int.from_bytes(key, "little", signed=True), text, node, start, take, lead))
                        start, lead, left = start + take, lead - take, left - take
                if rows:
                    yield _batches(rows, _RUN_NAMES, _RUN_KINDS)

    return texts.mapInArrow(find, _RUN)


def _run_texts(texts: DataFrame, width: int) -> DataFrame:
    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = [(r["key"], node, r["start"], r["single"], raw[r["start"] : r["start"] + r["windows"] + width - 1]) for r in batch.column(2)[i].as_py()]
                yield _batches(rows, ["key", "node", "start", "single", "bytes"], [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()])

    return texts.mapInArrow(cut_out, "key long, node binary, start int, single boolean, bytes binary")


def _sorted_marks(texts: DataFrame, width: int) -> DataFrame:
    """(node, start, windows): windows that repeat, of the runs found once, by suffix sorting of whole buckets."""

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: list[tuple]) -> Iterator[pa.RecordBatch]:
            raw = [b for *_, b in block]
            sizes = np.array([len(b) for b in raw])
            windows = sizes - width + 1
            first = np.cumsum(windows) - windows
            which = np.repeat(np.arange(len(raw)), windows)
            inside = np.arange(windows.sum()) - first[which]
            marks = repeated(np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(sizes) - sizes)[which] + inside, width)
            marks &= np.array([x[3] for x in block])[which]
            at = np.flatnonzero(marks)
            if not len(at):
                return
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])])
            count = np.diff(np.r_[new, len(at)])
            rows = [(block[w][1], block[w][2] + i, c) for w, i, c in zip(which[at[new]].tolist(), inside[at[new]].tolist(), count.tolist(), strict=True)]
            yield _batches(rows, ["node", "start", "windows"], [pa.binary(), pa.int32(), pa.int32()])

        block, size, last = [], 0, None
        seen: set[bytes] = set()
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != last:
                    if size > BLOCK:
                        yield from done(block)
                        block, size = [], 0
                    last, seen = row[0], set()
                # A text sent twice, by equal rows of the corpus, is one.
                if row[4] not in seen:
                    seen.add(row[4])
                    block.append(row)
                    size += len(row[4])
        if block:
            yield from done(block)

    return texts.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "node binary, start int, windows int")


def repeated_windows(source: DataFrame, owners: DataFrame, scratch: Scratch, width: int, limit: int) -> DataFrame:
    """(node, start, windows): runs of windows that start elsewhere too; a run may be told more than once, whole or in parts."""

    def of_texts(wanted: DataFrame, name: str) -> DataFrame:
        """(node, bytes, list of ``wanted``'s rows), one text for each node."""
        listed = scratch.keep(wanted.groupBy("node").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "node"])).alias("list")), name)
        return with_text(source, owners, listed).select("node", "bytes", "list")

    found = []
    # Most runs are like no other; those stay where they are.
    keys = scratch.keep(_repeated_keys(source, width), "keys")
    table_ = scratch.keep(_all_runs(source, width, bitmap_bytes(keys)), "runs")
    for turn, most in enumerate((*SPLITS, 0)):
        one = F.min(F.struct("node", "start", "windows", "lead")).alias("one")
        kinds = scratch.keep(table_.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("weight"), one), f"kinds-{turn}")
        twice = kinds.where("weight > 1").select("digest", "weight")
        found.append(join_hot(table_.select("node", "start", "windows", "digest"), twice, "digest", "weight").select("node", "start", "windows"))
        buckets = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("weight").alias("least")).where("kinds > 1 AND least = 1")
        mixed = scratch.keep(
            join_hot(kinds, buckets, "key", "kinds").select("key", "one.*", (F.col("weight") == 1).alias("single"), (F.col("kinds") > limit).alias("hot")), f"mixed-{turn}"
        )
        found.append(_sorted_marks(_run_texts(of_texts(mixed.where("NOT hot").drop("hot", "lead"), f"sorted-{turn}"), width), width))
        hot = mixed.where("hot")
        if not most or hot.isEmpty():
            break
        table_ = scratch.keep(_short_runs(of_texts(hot.select("node", "start", "windows", "lead"), f"hot-{turn}"), width, most), f"runs-{turn + 1}")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def with_text(source: DataFrame, owners: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``, one row for each node, with the bytes of a row that has the node's text."""
    placed = wanted.join(owners, "node").withColumnRenamed("node", "wanted_node")
    same = (F.col("node") == F.col("wanted_node")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    few = may_be_in(source.withColumn("hash", F.xxhash64("node", "doc_id")), "hash", placed.select(F.xxhash64("wanted_node", "owner")))
    return few.join(placed.hint("shuffle_hash"), same).drop("hash")


def _digest(raw: Column) -> Column:
    return F.sha2(raw, 256)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 400, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty.  Equal texts are one node: each of its windows
    starts once in each of them, so a text of ``width`` bytes or more that is
    found twice goes whole, whether the rows share a doc_id, have none or differ.
    Shorter texts stay.  Long texts are worked on in pieces; periodic ones (one
    character over and over) cost a row for each period.  ``width`` is 80 at
    least; ``limit`` says how many different runs of a bucket are sorted together,
    and changes no result.  An empty table gives an empty result.
    """
    if width < DEPTH:
        raise ValueError(f"width is {DEPTH} bytes at least: so many are sorted before cover ranks decide")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    source = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("bytes")).select("doc_id", "bytes", F.unhex(_digest(F.col("bytes"))).alias("node"))
    rows = scratch.keep(source.select("doc_id", "node", F.octet_length("bytes").cast("long").alias("n_bytes")), "rows")
    owners = scratch.keep(rows.groupBy("node").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("size")), "owners")
    marks = repeated_windows(source, owners.select("node", "owner"), scratch, width, limit)
    # Copies of a text tell the same marks; a set holds them once.
    per_node = marks.groupBy("node").agg(F.collect_set(F.struct("start", "windows")).alias("marks"))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def further(acc: Column, m: Column) -> Column:
        end = m["start"] + m["windows"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], m["start"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    marked = F.aggregate(F.array_sort("marks"), nothing, further)["n"].alias("marked")
    per_node = scratch.keep(per_node.select("node", "marks", marked).join(owners.select("node", "size"), "node"), "marks")
    whole = F.col("marked") == F.col("size") - (width - 1)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, data, marks in zip(*batch.columns, strict=True):
                data, spans, kept, at = data.as_py(), [], hashlib.sha256(), 0
                for m in sorted((m["start"], m["start"] + m["windows"] + width - 1) for m in marks.as_py()):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((node.as_py(), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            if out:
                yield _batches(out, ["node", "n_removed", "n_spans", "kept_sha256"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])

    some = with_text(source, owners.select("node", "owner"), per_node.where(~whole).select("node", "marks")).select("node", "bytes", "marks")
    parts = some.mapInArrow(remove, "node binary, n_removed long, n_spans long, kept_sha256 string").distinct()
    all_ = per_node.where(whole).select("node", F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), _digest(F.lit("").cast("binary")).alias("kept_sha256"))
    outcome = scratch.keep(parts.unionByName(all_).join(owners.select("node", "copies"), "node"), "outcome")
    scratch.drop(*[f"{name}-{i}" for name in ("kinds", "mixed", "runs", "sorted", "hot") for i in range(len(SPLITS) + 1)], "keys", "runs", "marks", "owners")
    return join_hot(rows, outcome, "node", "copies", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("node"))).alias("kept_sha256"),
    )


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated strings of 400 bytes; see dedup() for nulls, short texts and repeats."""
    return dedup(table(spark, sf_dir, "documents"))
