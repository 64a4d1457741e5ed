"""Entity resolution after Fellegi and Sunter: blocking, agreement weights, judgement, estimation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, REVIEW, NON_MATCH = "match", "review", "non_match"


def normalised(c) -> Column:
    """Upper case, without punctuation or common legal forms, single spaces."""
    text = F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", " ")
    text = F.regexp_replace(text, r"\b(LTD|LIMITED|INC|INCORPORATED|CORP|CORPORATION|LLC|PLC|GMBH|AG|SA|SARL|BV|NV|CO|COMPANY)\b", " ")
    return F.trim(F.regexp_replace(text, r" +", " "))


def trigrams(c) -> Column:
    text = F.concat(F.lit("  "), F.col(c) if isinstance(c, str) else c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


@dataclass(frozen=True)
class Field:
    """A compared field: m and u are the agreement rates of true pairs and of others; how is exact, normalised or similar."""

    name: str
    how: str = "exact"
    m: float = 0.9
    u: float = 0.1
    least: float = 0.85

    def agreement(self, a: str, b: str) -> Column:
        """1, 0, or null where either side is unknown."""
        x, y = F.col(f"{a}{self.name}"), F.col(f"{b}{self.name}")
        if self.how == "exact":
            same = x == y
        elif self.how == "normalised":
            same = normalised(x) == normalised(y)
        else:
            same = jaccard(trigrams(normalised(x)), trigrams(normalised(y))) >= self.least
        return F.when(x.isNotNull() & y.isNotNull(), same.cast("int"))

    def weights(self) -> tuple[float, float]:
        """Of agreement and of disagreement."""
        return math.log2(self.m / self.u), math.log2((1 - self.m) / (1 - self.u))

    def weight(self, agreement: Column) -> Column:
        yes, no = self.weights()
        return F.when(agreement == 1, yes).when(agreement == 0, no).otherwise(0.0)


def _met(df: DataFrame, record: str, keys: Mapping[str, Column], largest: int, one_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((rule, a, b) of records a < b that share a key, keys of more than ``largest`` records).

    Every block is compared whole.  One of more than ``largest`` records is cut
    into sub-blocks, and each pair of these is a join key of its own, so that no
    task has more than the pairs of two sub-blocks.  Such keys emit their square
    and are also reported, for a finer key to be chosen.  With ``one_of``, a
    boolean column, at least one record of a pair has it, and others aren't joined.
    """
    long = reduce(DataFrame.union, [df.select(F.lit(n).alias("rule"), k.cast("string").alias("key"), F.col(record).alias("id"), (F.col(one_of) if one_of else F.lit(True)).alias("one")) for n, k in keys.items()])
    long = long.where("key is not null and id is not null")
    sizes = long.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"), F.max("one").alias("any"))
    wide = sizes.where(F.col("n") > largest).drop("any")
    parts = F.ceil(F.col("n") / largest).cast("int")
    # Equal ids fall into one sub-block, so ids of two sub-blocks differ.
    placed = (
        long.join(sizes.where("n > 1 and any"), ["rule", "key"])
        .select("rule", "key", "id", "one", F.pmod(F.xxhash64("id"), parts).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("rule", "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "id", "one")
    )
    group = ["rule", "key", "p", "q"]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        met = left.where("mine = p").select(*group, "id").join(right.where("mine = q").select(*group, F.col("id").alias("other")), group)
        return met.where((F.col("p") < F.col("q")) | (F.col("id") < F.col("other"))).select("rule", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))

    met = joined(placed.where("one"), placed).union(joined(placed.where("NOT one"), placed.where("one"))) if one_of else joined(placed, placed)
    return met, wide


#: Ids of several rows, and the keys that these have, are told by buckets of their hashes, of which at most so many are broadcast.
BUCKETS = 1 << 16


#: Rows of a sub-block, times ``largest``: two lie in a cell, and the more of them, the fewer copies of a row.
SUB_BLOCK = 4


def _bucket(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS))


def _forms(df: DataFrame, record: str, keys: Mapping[str, Column], fields: Sequence[str] = ()) -> DataFrame:
    """(id, k0, k1, ..., f_<field>): each row's keys and what is compared of it."""
    return df.where(F.col(record).isNotNull()).select(F.col(record).alias("id"), *[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys.values())], *[F.col(f).alias(f"f_{f}") for f in fields])


def _long(forms: DataFrame, rules: int, others: Sequence[str] = ()) -> DataFrame:
    """(rule, key, before<j>, others): one row for each key that a row has, with its keys of the rules before."""
    before = lambda i: [F.when(F.lit(j < i), F.col(f"k{j}")).alias(f"before{j}") for j in range(rules - 1)]
    each = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"k{i}").alias("key"), *before(i)) for i in range(rules)])
    return forms.select(*others, F.inline(each)).where("key IS NOT NULL")


def _cells(forms: DataFrame, wide: DataFrame, rules: int, largest: int, others: Sequence[str]) -> DataFrame:
    """Rows dealt out by (rule, key, p, q), where those of one block that are to meet lie together.

    A block of more than SUB_BLOCK times ``largest`` rows is cut into sub-blocks,
    and each two of these have a cell.  A row has a copy for each cell that it lies in.
    """
    parts = F.coalesce(F.ceil(F.col("n") / (SUB_BLOCK * largest)), F.lit(1)).cast("int")
    long = _long(forms, rules, ["id", *others]).join(F.broadcast(wide.where(F.col("n") > SUB_BLOCK * largest)), ["rule", "key"], "left").withColumn("parts", parts)
    # Equal ids fall into one sub-block, so ids of two sub-blocks differ.
    mine = long.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    beside = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("mine")))
    placed = mine.withColumn("other", F.explode(beside)).withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")})
    # By number, as the work in a cell is the square of its rows: few bytes aren't few pairs.
    n = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["rule", "key", "p", "q"]
    return placed.select(*group, "mine", "id", *others, *[f"before{j}" for j in range(rules - 1)]).repartition(n, *group)


def _meet(cells: DataFrame, *only: Column) -> DataFrame:
    """Rows l and r of one block, of which l has the lesser id, and for which all of ``only`` hold."""
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("rule", "key", "p", "q")]
    # The rows of one sub-block meet in its cell with the first, those of the first in its cell with the second.
    here = (F.col("l.mine") != F.col("r.mine")) | ((F.col("l.p") == 0) & ((F.col("l.mine") > 0) | (F.col("l.q") <= 1)))
    return cells.alias("l").hint("merge").join(cells.alias("r"), reduce(lambda x, y: x & y, [*same, F.col("l.id") < F.col("r.id"), here, *only]))


def _paired(df: DataFrame, record: str, keys: Mapping[str, Column], largest: int, fields: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(l and r of pairs whose ids have one row each, other pairs a < b, the rows of those, keys of more than ``largest`` rows).

    Where an id has one row, a pair that shares the key of several rules is left to
    the first of them as the rows meet, so that rows are shuffled but no pairs.
    Pairs of which an id has, or by its bucket may have, several rows are made
    distinct; only the blocks of such rows are formed again for these.
    """
    rules = len(keys)
    forms = _forms(df, record, keys, fields)
    wide = _long(forms, rules).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest)
    again = forms.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(_bucket("id").alias("bucket")).distinct()
    marked = forms.join(F.broadcast(again), _bucket("id") == F.col("bucket"), "left").withColumn("several", F.col("bucket").isNotNull()).drop("bucket")
    compared = [f"f_{f}" for f in fields]

    alone = marked.where("NOT several").drop("several")
    first = [~F.coalesce(F.col(f"l.before{j}") == F.col(f"r.before{j}"), F.lit(False)) for j in range(rules - 1)]
    once = _meet(_cells(alone, wide, rules, largest, compared), *first)

    places = [_bucket(F.lit(i), F.col(f"k{i}")) for i in range(rules)]
    taken = marked.where("several").select(F.explode(F.array(*places)).alias("place")).distinct()
    near = marked
    for i, place in enumerate(places):
        near = near.join(F.broadcast(taken.withColumnRenamed("place", f"place{i}")), place == F.col(f"place{i}"), "left")
    near = near.where(reduce(lambda x, y: x | y, [F.col(f"place{i}").isNotNull() for i in range(rules)], F.col("several"))).select(*marked.columns)
    rest = _meet(_cells(near, wide, rules, largest, ["several"]), F.col("l.several") | F.col("r.several")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    name = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("rule") + 1)
    return once, rest, near, wide.select(name.alias("rule"), "key", "n")


def blocked_pairs(df: DataFrame, record: str, keys: Mapping[str, Column], largest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b that share some key, keys of more than ``largest`` records); every block is compared whole."""
    once, rest, _, wide = _paired(df, record, keys, largest)
    return once.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).union(rest), wide


def blocked_agreements(df: DataFrame, record: str, keys: Mapping[str, Column], fields: Sequence[Field], largest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(``agreements`` of all pairs that share some key, keys of more than ``largest`` records); fields are compared where rows meet, so that pairs aren't joined to rows."""
    names = list(dict.fromkeys(f.name for f in fields))
    once, rest, near, wide = _paired(df, record, keys, largest, names)
    met = once.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), *[f.agreement("l.f_", "r.f_").alias(f"agree_{f.name}") for f in fields])
    rows = near.select(F.col("id").alias(record), *[F.col(f"f_{n}").alias(n) for n in names if n != record])
    return met.union(agreements(rest, rows, record, fields)), wide


#: Rules up to which counts of combined keys stand for pairs: there are 2 to their number less one.
COMBINED = 10


def _shared(forms: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with, for each set of rules (bits), the pairs of records that share the keys of all of them: c<set>.

    The sizes of the blocks of the combined keys tell, so that no pair is formed.
    Blocks of one rule are counted first by all keys.
    """
    sets = [tuple(i for i in range(len(names)) if s >> i & 1) for s in range(1, 1 << len(names))]
    keys = [f"k{i}" for i in range(len(names))]
    classes = forms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(sum(1 << i for i in s)).alias("set"), *[(F.col(k) if i in s else F.lit(None).cast("string")).alias(k) for i, k in enumerate(keys)]) for s in sets]))
    blocks = classes.select("n", each.alias("b")).select("n", "b.*")
    # A record without the key of a rule is in no block of it.
    whole = reduce(lambda x, y: x & y, [(F.col("set").bitwiseAND(F.lit(1 << i)) == 0) | F.col(k).isNotNull() for i, k in enumerate(keys)])
    sizes = blocks.where(whole).groupBy("set", *keys).agg(F.sum("n").alias("n"))
    pairs = F.expr("n * (n - 1) div 2")
    return sizes.agg(*[F.coalesce(F.sum(F.when(F.col("set") == s, pairs)), F.lit(0)).alias(f"c{s}") for s in range(1, 1 << len(names))])


def _counted(by_pair: DataFrame, n: int) -> DataFrame:
    """One row with, for each of ``n`` rules, its pairs p<i> and those that no rule before it brings together f<i>."""
    has = lambda i: F.col("rules").bitwiseAND(F.lit(1 << i)) != 0
    before = lambda i: F.col("rules").bitwiseAND(F.lit((1 << i) - 1)) != 0
    return by_pair.agg(*[c for i in range(n) for c in (F.count_if(has(i)).alias(f"p{i}"), F.count_if(has(i) & ~before(i)).alias(f"f{i}"))])


def rule_yield(df: DataFrame, record: str, keys: Mapping[str, Column], largest: int = 1000) -> DataFrame:
    """(rule, pairs, fresh, verdict): what each blocking rule adds to those before it.

    fresh counts pairs that no rule before it brings together.  A rule without
    pairs is useless, one without fresh pairs redundant: useful if another goes.
    Up to COMBINED rules, records with one set of keys form no pairs: fresh is the
    sum, over all sets of earlier rules, of the pairs that share those keys too,
    added for an even number of rules and subtracted for an odd one.  Records whose
    rows differ in their keys are paired with all they meet.
    """
    order = {name: i for i, name in enumerate(keys)}
    n = len(order)
    if n > 62:
        raise ValueError("at most 62 rules")
    forms = df.select(F.col(record).alias("id"), *[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys.values())]).where("id is not null").distinct()
    by_key = {name: F.col(f"k{i}") for name, i in order.items()}
    bit = reduce(lambda c, kv: c.when(F.col("rule") == kv[0], 1 << kv[1]), order.items(), F.when(F.lit(False), 0)).cast("long")
    if n > COMBINED:
        met, _ = _met(forms, "id", by_key, largest)
        counts = _counted(met.groupBy("a", "b").agg(F.bit_or(bit).alias("rules")), n)
    else:
        several = forms.groupBy("id").agg(F.count(F.lit(1)).alias("forms")).withColumn("several", F.col("forms") > 1).drop("forms")
        marked = forms.join(several, "id")
        met, _ = _met(marked, "id", by_key, largest, "several")
        few = _counted(met.groupBy("a", "b").agg(F.bit_or(bit).alias("rules")), n)
        shared = _shared(marked.where("NOT several"), list(order))
        fresh = lambda i: reduce(lambda x, y: x + y, [F.col(f"c{1 << i | s}") * (-1) ** s.bit_count() for s in range(1 << i)])
        many = shared.select(*[c for i in range(n) for c in (F.col(f"c{1 << i}").alias(f"p{i}"), fresh(i).alias(f"f{i}"))])
        counts = few.unionByName(many).agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(n) for c in "pf"])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"p{i}").alias("pairs"), F.col(f"f{i}").alias("fresh")) for name, i in order.items()])))
    return rows.withColumn("verdict", F.when(F.col("pairs") == 0, "useless").when(F.col("fresh") == 0, "redundant").otherwise("needed"))


def agreements(pairs: DataFrame, df: DataFrame, record: str, fields: Sequence[Field]) -> DataFrame:
    """Pairs with one agreement column for each field."""
    cols = [record, *[f.name for f in fields]]
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    joined = pairs.join(a, F.col("a") == F.col(f"a_{record}")).join(b, F.col("b") == F.col(f"b_{record}"))
    return joined.select("a", "b", *[f.agreement("a_", "b_").alias(f"agree_{f.name}") for f in fields])


#: Patterns of agreement up to which weights are rounded once for each: 3 to the number of fields.
PATTERNS = 729


def score(agreed: DataFrame, fields: Sequence[Field], match: float = 4.0, non_match: float = -2.0, digits: int | None = None) -> DataFrame:
    """Adds the sum of weights and the verdict; with ``digits`` the sum is rounded, after the verdict."""
    given = [F.col(f"agree_{f.name}") for f in fields]
    total = reduce(lambda x, y: x + y, [f.weight(g) for f, g in zip(fields, given, strict=True)])
    out = agreed.withColumn("weight", total).withColumn("verdict", F.when(F.col("weight") >= match, MATCH).when(F.col("weight") <= non_match, NON_MATCH).otherwise(REVIEW))
    if digits is None:
        return out
    if 3 ** len(fields) > PATTERNS:
        return out.withColumn("weight", F.round("weight", digits))
    # To round a double takes longer than all else that is done for a pair, and a pattern has one sum.
    sums = [reduce(lambda x, y: x + y, w) for w in product(*[(0.0, *f.weights()) for f in fields])]
    number = reduce(lambda n, g: n * 3 + F.when(g == 1, 1).when(g == 0, 2).otherwise(0), given, F.lit(0))
    return out.withColumn("weight", F.get(F.array(*[F.round(F.lit(s), digits) for s in sums]), number))


def patterns(agreed: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Counts of agreement patterns: at most 3 to the number of fields rows, all that estimation needs."""
    return agreed.groupBy(*[f"agree_{f.name}" for f in fields]).agg(F.count(F.lit(1)).alias("n"))


def estimate(counts: Sequence[tuple[tuple[int | None, ...], int]], fields: Sequence[Field], share: float = 0.1, rounds: int = 20) -> tuple[list[Field], float]:
    """Expectation-maximisation over pattern counts: fields with fitted m and u, and the share of true pairs."""
    m, u = [f.m for f in fields], [f.u for f in fields]
    clamp = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    for _ in range(rounds):
        weight, total, true = [], 0.0, 0.0
        for pattern, n in counts:
            a, b = share, 1 - share
            for i, g in enumerate(pattern):
                if g is not None:
                    a *= m[i] if g else 1 - m[i]
                    b *= u[i] if g else 1 - u[i]
            p = a / (a + b) if a + b else 0.0
            weight.append(p)
            total += n
            true += p * n
        if not total:
            break
        for i in range(len(fields)):
            known = [(p, n, pat[i]) for p, (pat, n) in zip(weight, counts, strict=True) if pat[i] is not None]
            yes, all_ = sum(p * n for p, n, g in known if g), sum(p * n for p, n, _ in known)
            no, rest = sum((1 - p) * n for p, n, g in known if g), sum((1 - p) * n for p, n, _ in known)
            m[i] = clamp(yes / all_) if all_ else m[i]
            u[i] = clamp(no / rest) if rest else u[i]
        share = clamp(true / total)
    return [Field(f.name, f.how, m[i], u[i], f.least) for i, f in enumerate(fields)], share


def blocking_report(df: DataFrame, record: str, keys: Mapping[str, Column]) -> DataFrame:
    """(rule, blocks, pairs, largest, reduction): what each blocking rule would compare, of all pairs."""
    parts = []
    for name, key in keys.items():
        sizes = df.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(sizes.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"), F.max("n").alias("largest")))
    total = df.agg(F.expr("count(1) * (count(1) - 1) div 2").alias("all_pairs"))
    return reduce(DataFrame.union, parts).join(F.broadcast(total)).withColumn("reduction", 1 - F.try_divide(F.col("pairs").cast("double"), F.col("all_pairs"))).drop("all_pairs")
