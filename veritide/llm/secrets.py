"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression yields a Boolean query over trigrams that any
match must contain (of the lower-cased text).  The index holds one posting per
(trigram, document) for the trigrams that rules ask for; intersecting the
postings of each document leaves the candidates of each rule, and only those
are searched with the expression itself.  A rule without a mandatory trigram
searches every document.

Texts never move: candidates are marked in bitmaps of bounded size, which go to
every task and tell there which texts to search.  Two documents may share a bit;
the search itself then finds nothing, so results are exact at every size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Buckets of 32,768 bits, four KB for each rule; there are at least BITS bits a candidate up to the most buckets.
MOST_BUCKETS, BITS = 1024, 16
_EXPAND = 24


@dataclass(frozen=True)
class Rule:
    """One kind of secret: a match counts if the text of ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base rules; a run shorter than the bound inside a longer quantifier can't match at all.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
# Public token formats.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _both(a: Query, b: Query) -> Query:
    return b if a is True else a if b is True else ("and", (a, b))


def _strings_query(strings: set[str]) -> Query:
    """Some string of the set occurs, as far as trigrams tell."""
    if not strings or min(map(len, strings)) < 3:
        return True
    each = [
        reduce(_both, [s[i : i + 3] for i in range(len(s) - 2)], True)
        for s in sorted(strings, key=lambda s: (len(s), s))
    ]
    return each[0] if len(each) == 1 else ("or", tuple(each))


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-case trigrams that holds for every text the pattern matches in."""
    from re import _constants as k
    from re import _parser as parser

    def known(items) -> set[str] | None:
        """All strings the items can match, if they are few."""
        have = {""}
        for op, arg in items:
            if op is k.LITERAL:
                more = {chr(arg).lower()}
            elif op is k.IN and all(x[0] is k.LITERAL for x in arg):
                more = {chr(x[1]).lower() for x in arg}
            elif op is k.SUBPATTERN:
                more = known(arg[-1])
            elif op is k.BRANCH:
                parts = [known(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is k.MAX_REPEAT and tuple(arg[:2]) == (0, 1) and len(arg[2]) == 1 and arg[2][0][0] is k.LITERAL:
                more = {"", chr(arg[2][0][1]).lower()}
            else:
                return None
            if more is None or len(have) * len(more) > _EXPAND:
                return None
            have = {a + b for a in have for b in more}
        return have

    def sequence(items) -> Query:
        query: Query = True
        have = {""}
        for item in items:
            op, arg = item
            more = known([item])
            if more is not None and len(have) * len(more) <= _EXPAND:
                have = {a + b for a in have for b in more}
                continue
            query = _both(query, _strings_query(have))
            have = more if more is not None else {""}
            if more is None:
                query = _both(query, inside(op, arg))
        return _both(query, _strings_query(have))

    def inside(op, arg) -> Query:
        if op is k.SUBPATTERN:
            return sequence(arg[-1])
        if op is k.BRANCH:
            parts = tuple(sequence(b) for b in arg[1])
            return True if True in parts else ("or", parts)
        if op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0] >= 1:
            return sequence(arg[2])
        return True

    return sequence(parser.parse(re.sub(r"\(\?i:", "(?:", pattern)))


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _holds(query: Query, present: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(present, query)
    return reduce(and_ if query[0] == "and" else or_, [_holds(q, present) for q in query[1]])


def index(docs: DataFrame, trigrams: set[str], key: str = "key", text: str = "text") -> DataFrame:
    """Postings (trigram, key): one for each of ``trigrams`` in each document's lower-cased text; null texts have none."""
    low = F.lower(F.col(text))
    asked = F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in sorted(trigrams)])
    return (
        docs.select(F.col(key), low.alias("low"))
        .select(key, F.explode(F.array_compact(asked)).alias("trigram"))
        .select("trigram", key)
    )


def candidates(postings: DataFrame, queries: dict[str, Query], key: str = "key") -> DataFrame:
    """Keys whose postings satisfy at least one query, with one Boolean column for each query.

    A key's list has at most as many entries as the queries have trigrams.
    """
    lists = postings.groupBy(key).agg(F.collect_set("trigram").alias("present"))
    flags = lists.select(key, *[_holds(q, F.col("present")).alias(f"is_{n}") for n, q in queries.items()])
    return flags.where(reduce(or_, [F.col(f"is_{n}") for n in queries]))


def marks(found: DataFrame, names: list[str], buckets: int, key: str = "key") -> DataFrame:
    """(bucket, a bitmap of 32,768 bits for each name): the bits of the keys that are candidates; at most ``buckets`` rows."""
    position = F.pmod(key, F.lit(32768))
    bucket = F.pmod(F.shiftright(key, 15), F.lit(buckets))
    return found.groupBy(bucket.alias("bucket")).agg(*[F.bitmap_construct_agg(F.when(F.col(f"is_{n}"), position)).alias(f"bits_{n}") for n in names])


def _marked(bits: Column, key: str = "key") -> Column:
    position = F.pmod(key, F.lit(32768)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, position % 8) == 1, F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(start: Column, steps: Column, step: Callable[[Column], Column], row: Callable[[Column, Column], Column], kind: str) -> Column:
    """row(total before it, z) of each z of ``steps``, where step(z) adds to the total; for short arrays."""
    nothing = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    walk = F.aggregate(
        steps, nothing, lambda acc, z: F.struct((acc["at"] + step(z)).alias("at"), F.concat(acc["out"], F.array(row(acc["at"], z))).alias("out"))
    )
    return walk["out"]


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Matches of a rule as an array of (start, rank, end, kind), in code points, end exclusive.

    The pieces between the matches and the matches themselves give the positions.
    Running totals are taken in chunks of the square root of the matches, so that
    no fold carries a long array.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else hits

    def sizes(hits: Column) -> Column:
        zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), (parts if rule.group else hits).alias("part"))
        lengths = lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"), F.length(z["part"]).alias("part"))
        return F.transform(F.slice(zipped, 1, F.size(hits)), lengths)

    def chunked(z: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(z))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(z), wide), lambda i: F.slice(z, i, wide))

    step = lambda z: z["gap"] + z["hit"]

    def placed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, z: acc + step(z)))
        before = _running(F.lit(0), totals, lambda n: n, lambda at, n: at, "int")
        row = lambda at, z: F.struct((at + z["gap"]).alias("start"), (at + step(z)).alias("end"), z["part"].alias("part"))
        each = F.transform(
            F.arrays_zip(chunks.alias("chunk"), before.alias("before")),
            lambda x: _running(x["before"], x["chunk"], step, row, "struct<start:int,end:int,part:int>"),
        )
        return F.flatten(each)

    good = F.filter(_let(_let(_let(hits, sizes), chunked), placed), lambda s: s["part"] >= rule.least)
    return F.transform(good, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(rule.kind).alias("kind")))


_ARRAY = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """One row per document: doc_id, spans (array of start, rank, end, kind; sorted by start, then rank of the rule).

    Matches of a rule are leftmost and don't overlap; those that are too short
    are dropped.  Null texts count as empty and have no spans.  Rows with equal
    or null doc_id are searched each by itself; an empty table gives an empty
    result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    if queries:
        wanted = set().union(*map(trigrams_of, queries.values()))
        found = cut(candidates(index(source, wanted), queries))
        bits = max(1, BITS * found.count())
        buckets = min(MOST_BUCKETS, 1 << (math.ceil(bits / 32768) - 1).bit_length())
        bitmaps = F.broadcast(marks(found, list(queries), buckets))
        source = source.join(bitmaps, F.pmod(F.shiftright("key", 15), F.lit(buckets)) == F.col("bucket"), "left")
    each = []
    for rank, rule in enumerate(rules):
        search = F.col("text").rlike(rule.pattern)
        if rule.kind in queries:
            search = _marked(F.col(f"bits_{rule.kind}")) & search
        each.append(F.when(search, _spans(rule, rank, F.col("text"))).otherwise(F.array().cast(_ARRAY)))
    return source.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document; see scan() for nulls, empty texts and repeats."""
    found = scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
