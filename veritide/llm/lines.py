"""Line deduplication by deletion-neighbourhood join.

Lines within one edit of each other become equal once the right character is
deleted from one or both.  To keep the neighbourhoods small, exact filters come
first: a single edit leaves one half of a line alone, and all but one of
``SEGMENTS`` segments; only lines that share such a rest with another line emit
their variants, and only inside the segment that differs.  A variant's key
holds the rest, and for a substitution the place, so equal keys stand for lines
one edit apart; grouping by key yields the earliest line of each group instead
of its pairs, and the edit distance to it is verified.

Which halves occur in two lines is kept in a bitmap of bounded size that goes to
every task, so that most lines never leave theirs; as two halves may share a bit,
what it lets through is then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, marked_by, slices, table

SEGMENTS = 16
#: Buckets of 32,768 bits, 4 KB, of the bitmap; there are at least BITS bits a half up to the most buckets (32 MB).
MOST_BUCKETS, BITS = 8192, 16
_BLANK = " \t\v\f\r"


def _scan(source: DataFrame, min_chars: int, make, schema: str) -> DataFrame:
    """Rows that ``make(line)`` yields for each line of min_chars characters or more that isn't blank, with the line's place in front."""
    fields = [f.strip().split()[0] for f in schema.split(",")]
    kinds = [pa.int64() if f.strip().endswith("long") else pa.binary() if f.strip().endswith("binary") else pa.string() for f in schema.split(",")]
    identity = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in slices(batch, "text"):
                rows: list[int] = []
                numbers: list[int] = []
                found: list[tuple] = []
                for i, text in enumerate(texts, a):
                    for number, line in enumerate(text.split("\n")):
                        if len(line) >= min_chars and line.strip(_BLANK):
                            for item in make(line):
                                rows.append(i)
                                numbers.append(number)
                                found.append(item)
                if not rows:
                    continue
                take = pa.array(rows, pa.int64())
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(numbers, pa.int32()),
                        *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ],
                    names=["doc_id", "mark", "number", *fields],
                )

    return source.mapInArrow(run, f"doc_id {identity}, mark long, number int, {schema}")


def place() -> Column:
    """Order of lines: by doc_id (none last), then by the text's hash, then by line number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "number")


def _halves(line: str) -> list[tuple[int, int]]:
    from xxhash import xxh3_64_intdigest as h

    n = len(line)
    own = h(line)
    keys = []
    for short in (n, n - 1):
        k = short // 2
        keys += [h(line[:k], 2 * short), h(line[n - k :], 2 * short + 1)]
    wrap = 1 << 63
    return [((k ^ wrap) - wrap, (own ^ wrap) - wrap) for k in keys]


def segments(line: str, parts: int = SEGMENTS, longest: int = 128) -> list[tuple[bytes, int, str]]:
    """(key of the rest, 0 or 1 for a line of the class's shorter or longer length, segment), for both classes of its length.

    A line of more than ``parts * longest`` characters has segments of about
    ``longest``, and the hashes of what lies left and right of each are chained,
    so that its work grows with its length.
    """
    from xxhash import xxh3_128_digest as h

    n, out = len(line), []
    for extra in (0, 1):
        short = n - extra
        count = max(parts, short // longest)
        at = [j * short // count for j in range(count + 1)]
        if count == parts:
            rests = [f"{line[: at[j]]}\n{line[at[j + 1] + extra :]}".encode("utf-8", "surrogatepass") for j in range(count)]
        else:
            left, right = [b""], [b""]
            for j in range(count):
                left.append(h(left[-1] + line[at[j] : at[j + 1]].encode("utf-8", "surrogatepass")))
                k = count - 1 - j
                right.append(h(right[-1] + line[at[k] + extra : at[k + 1] + extra].encode("utf-8", "surrogatepass")))
            rests = [left[j] + b"\n" + right[count - 1 - j] for j in range(count)]
        out += [(h(b"%d:%d:" % (short, j) + rest), extra, line[at[j] : at[j + 1] + extra]) for j, rest in enumerate(rests)]
    return out


def variants(key: bytes, longer: int, segment: str) -> list[tuple[bytes, int]]:
    """(key, role) of a segment's deletion neighbourhood.

    Role 0 and 1: lines of which the one's segment is the other's less one
    character.  Role 2: lines whose segments are equal but for the character at
    one place.
    """
    from xxhash import xxh3_128_digest as h

    less = [segment[:i] + segment[i + 1 :] for i in range(len(segment))]
    if longer:
        return [(h(key + b"i" + v.encode()), 1) for v in set(less)]
    same = [(h(key + b"s%d:" % i + v.encode()), 2) for i, v in enumerate(less)]
    return [(h(key + b"i" + segment.encode()), 0), *same]


def _bitmap(halves: DataFrame) -> bytes:
    """Bits of the halves (a column of longs), by their lowest bits; a power of two of bytes, at most MOST_BUCKETS times 4 KB."""
    wanted = max(1, BITS * halves.count())
    buckets = min(MOST_BUCKETS, 1 << (math.ceil(wanted / 32768) - 1).bit_length())
    half = halves.columns[0]
    bucket = F.pmod(F.shiftright(half, 15), F.lit(buckets)).cast("int")
    rows = halves.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(half, F.lit(32768))).alias("bits")).collect()
    out = bytearray(4096 * buckets)
    for r in rows:
        out[4096 * r["bucket"] : 4096 * (r["bucket"] + 1)] = r["bits"]
    return bytes(out)


def _near(source: DataFrame, min_chars: int) -> DataFrame:
    """(line, first): lines, with their first places, that an earlier line is within one edit of."""
    pieces = _scan(source, min_chars, _halves, "piece long, own long").select("piece", "own")
    shared = cut(pieces.groupBy("piece").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("piece"))
    bits = _bitmap(shared)
    low = 8 * len(bits) - 1

    def whole(line: str) -> list[tuple]:
        from xxhash import xxh3_128_digest

        if any(bits[(k & low) >> 3] >> (k & 7) & 1 for k, _ in _halves(line)):
            return [(xxh3_128_digest(line), line)]
        return []

    lines = cut(_scan(source, min_chars, whole, "line binary, body string").groupBy("line").agg(F.min(place()).alias("first"), F.first("body").alias("body")))

    def halves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in slices(batch, "body", 200_000):
                found = [(i, k) for i, t in enumerate(texts, a) for k, _ in _halves(t)]
                take = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([x[1] for x in found], pa.int64())], names=["line", "piece"])

    of_lines = lines.select("line", "body").mapInArrow(halves, "line binary, piece long")
    again = of_lines.groupBy("piece").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("piece")
    lines = lines.join(of_lines.join(again, "piece", "left_semi").select("line"), "line", "left_semi")

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in slices(batch, "body", 200_000):
                found = [(i, *s) for i, t in enumerate(texts, a) for s in segments(t)]
                take = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array([x[1] for x in found], pa.binary()),
                        pa.array([x[2] for x in found], pa.int32()),
                        pa.array([x[3] for x in found], pa.string()),
                    ],
                    names=["line", "first", "rest", "longer", "segment"],
                )

    first = lines.schema["first"].dataType.simpleString()
    parts = lines.select("line", "first", "body").mapInArrow(cut_up, f"line binary, first {first}, rest binary, longer int, segment string")
    rests = parts.groupBy("rest").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("rest")
    close = cut(parts.join(rests, "rest", "left_semi"))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [
                    (i, *v)
                    for i, (r, x, s) in enumerate(zip(*[part.column(c).to_pylist() for c in ("rest", "longer", "segment")], strict=True))
                    for v in variants(r, x, s)
                ]
                take = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).take(take) for c in ("line", "first", "segment")],
                        pa.array([x[1] for x in found], pa.binary()),
                        pa.array([x[2] for x in found], pa.int32()),
                    ],
                    names=["line", "first", "segment", "variant", "role"],
                )

    spread_out = close.select("line", "first", "rest", "longer", "segment").mapInArrow(
        spread, f"line binary, first {first}, segment string, variant binary, role int"
    )
    # A line of role 0 answers to the earliest of role 1 and the reverse; those of role 2 to each other.
    earliest = spread_out.groupBy(
        "variant", F.when(F.col("role") == 2, 2).otherwise(1 - F.col("role")).alias("role")
    ).agg(F.min(F.struct("first", "segment")).alias("early"))
    return (
        spread_out.join(earliest, ["variant", "role"])
        .where((F.col("early.first") < F.col("first")) & (F.levenshtein("early.segment", "segment") <= 1))
        .groupBy("line")
        .agg(F.min("first").alias("first"))
    )


def dropped_lines(docs: DataFrame, max_edits: int = 1, chars_per_edit: int = 20) -> DataFrame:
    """(doc_id, mark, numbers): the line numbers to drop of each text; mark is the text's hash."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1: the number of variants grows with the line's length to that power")
    source = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where(F.col("text").isNotNull())

    def whole(line: str) -> list[tuple]:
        from xxhash import xxh3_128_digest

        return [(xxh3_128_digest(line),)]

    seen = _scan(source, 1, whole, "line binary")
    again = seen.groupBy("line").agg(F.min(place()).alias("first"), F.max(place()).alias("last")).where("first <> last")
    drops = seen.join(cut(again.drop("last")), "line").where(place() != F.col("first")).select("doc_id", "mark", "number")
    if max_edits:
        drops = drops.union(_near(source, chars_per_edit).select("first.doc_id", "first.mark", "first.number"))
    return drops.groupBy("doc_id", "mark").agg(F.collect_set("number").alias("numbers"))


def dedup(
    docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", max_edits: int = 1, chars_per_edit: int = 20
) -> DataFrame:
    """One row per document: doc_id, the columns ``keep``, text without the dropped lines, n_lines, n_removed.

    Lines are what line feeds separate; blank ones (nothing but ASCII white space)
    stay.  Any other line goes if an earlier line, in order of doc_id and line
    number, equals it, whether or not that line goes itself.  One edit is allowed
    for each ``chars_per_edit`` characters of both lines, ``max_edits`` (0 or 1)
    at most: "1." and "2." differ in half of what they say, two long lines hardly.
    A null text stays null with no lines; an empty one has one line.  Rows that repeat both doc_id and text get
    the same result; rows without a doc_id come last.  An empty table gives an
    empty result.
    """
    keep = [c for c in keep or [] if c not in (doc_id, text)]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in keep] or [F.lit(0)]).alias("others"))
    drops = cut(dropped_lines(source.select("doc_id", "text"), max_edits, chars_per_edit)).withColumnsRenamed({"doc_id": "drop_id", "mark": "drop_mark"})
    marked = source.withColumn("mark", F.xxhash64("text")).withColumn("hash", F.xxhash64("mark", "doc_id"))
    # A text that loses nothing stays where it is, but for the few that share a bit with one that does.
    flagged = marked_by(marked, "hash", drops.select(F.xxhash64("drop_mark", "drop_id")), "moves")
    moved = flagged.where("moves")
    # Hashing the drops spares sorting whole texts; both keys together are as good as unique, so no partition grows hot.
    joined = moved.join(drops.hint("shuffle_hash"), (F.col("mark") == F.col("drop_mark")) & F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    columns = ["doc_id", "text", "others", "numbers"]
    joined = joined.select(*columns).unionByName(flagged.where("NOT moves").withColumn("numbers", F.lit(None).cast("array<int>")).select(*columns))
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("numbers"))
    # An array of one, so that a text is split once and not for every line that stays.
    left = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")), 1)
    return joined.select(
        "doc_id",
        *[F.col(f"others.`{c}`").alias(c) for c in keep],
        F.when(F.col("numbers").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document after line deduplication, its text as a digest; see dedup() for nulls, empty texts and repeats."""
    done = dedup(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )
