"""Constraints that data suggest: keys, dependencies, inclusions, orders and identities of columns.

Candidates of one level are tested together in one aggregation; only the
lattice of column names, which is small, is walked on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType, TimestampType

#: Distinct counts in one aggregation; each multiplies the rows that it handles.
_BATCH = 6
#: Sums and products tried in one aggregation.
_TRIALS = 336


def _floats(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, FloatType | DoubleType)}


def _likely_keys(df: DataFrame, sets: Sequence[tuple[str, ...]], least_unique: float, error: float = 0.02) -> list[tuple[str, ...]]:
    """The sets whose sketched number of distinct values comes near the rows; one aggregation, far outside the sketch's error."""
    if not sets:
        return []
    full = [reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cs]) for cs in sets]
    got = df.agg(
        *[F.approx_count_distinct(F.when(f, F.xxhash64(*cs)), error).alias(f"d{i}") for i, (f, cs) in enumerate(zip(full, sets, strict=True))],
        *[F.count_if(f).alias(f"f{i}") for i, f in enumerate(full)],
    ).first()
    return [cs for i, cs in enumerate(sets) if got[f"d{i}"] >= (1 - 6 * error) * least_unique * got[f"f{i}"]]


def keys(df: DataFrame, columns: Sequence[str] | None = None, most: int = 3, least_unique: float = 0.999, most_null: float = 0.05, least_rows: int = 200) -> DataFrame:
    """(key, unique_rate): minimal column sets that tell rows apart; floating columns take no part.

    Sketches of all sets of a size, in one scan, leave those to count exactly whose
    estimate lies within six standard errors of what a key needs; that holds for
    any number of sets.
    """
    names = [c for c in columns or df.columns if c not in _floats(df)]
    spark, found, rows = df.sparkSession, [], None
    for size in range(1, most + 1):
        todo = [c for c in combinations(names, size) if not any(set(k) <= set(c) for k, _ in found)]
        todo = _likely_keys(df, todo, least_unique)
        for at in range(0, len(todo), _BATCH):
            part = todo[at : at + _BATCH]
            full = [reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cs]) for cs in part]
            got = df.agg(
                F.count(F.lit(1)).alias("n"),
                *[F.count_distinct(*cs).alias(f"d{i}") for i, cs in enumerate(part)],
                *[F.count_if(f).alias(f"f{i}") for i, f in enumerate(full)],
            ).first()
            rows = got["n"]
            if rows < least_rows:
                break
            for i, cs in enumerate(part):
                if got[f"f{i}"] >= (1 - most_null) * rows and got[f"f{i}"] and got[f"d{i}"] >= least_unique * got[f"f{i}"]:
                    found.append((cs, got[f"d{i}"] / got[f"f{i}"]))
    return spark.createDataFrame([(",".join(k), float(r)) for k, r in found], "key string, unique_rate double")


def dependency_support(df: DataFrame, determinant: Sequence[str], dependent: str) -> DataFrame:
    """One row: rows with both sides known, groups, and the share of rows that agree with their group's majority."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*determinant, dependent)])
    pairs = df.where(known).groupBy(*determinant, dependent).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.groupBy(*determinant).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return each.agg(
        F.lit(",".join(determinant)).alias("determinant"), F.lit(dependent).alias("dependent"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups"), F.try_divide(F.sum("top").cast("double"), F.sum("n")).alias("support"),
    )


def _supports(df: DataFrame, determinant: Sequence[str], dependents: Sequence[str]) -> DataFrame:
    """As dependency_support(), for all dependents of one determinant in one scan and one shuffle of counts."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in determinant])
    values = F.explode(F.array(*[F.struct(F.lit(d).alias("dependent"), F.col(d).cast("string").alias("value")) for d in dependents])).alias("x")
    long = df.where(known).select(*determinant, values).select(*determinant, F.col("x.dependent").alias("__dependent"), F.col("x.value").alias("__value")).where("__value is not null")
    pairs = long.groupBy("__dependent", *determinant, "__value").agg(F.count(F.lit(1)).alias("n"))
    each = pairs.groupBy("__dependent", *determinant).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return each.groupBy(F.col("__dependent").alias("dependent")).agg(
        F.lit(",".join(determinant)).alias("determinant"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.try_divide(F.sum("top").cast("double"), F.sum("n")).alias("support")
    ).select("determinant", "dependent", "rows", "groups", "support")


def dependencies(df: DataFrame, columns: Sequence[str] | None = None, most: int = 2, least: float = 0.95, near_key: float = 0.9) -> DataFrame:
    """(determinant, dependent, rows, groups, support) of dependencies that hold for a share ``least`` of rows.

    Determinants that are nearly unique are passed over: they determine
    everything.  Each determinant takes one scan for all its dependents.
    """
    names = [c for c in columns or df.columns if c not in _floats(df)]
    sets = [det for size in range(1, most + 1) for det in combinations(names, size) if len(det) < len(names)]
    out = reduce(DataFrame.unionByName, [_supports(df, det, [c for c in names if c not in det]) for det in sets])
    return out.where((F.col("support") >= least) & (F.col("groups") < near_key * F.col("rows")))


def conditional_dependencies(df: DataFrame, condition: str, determinant: str, dependent: str, least_share: float = 0.05, least_rows: int = 50) -> DataFrame:
    """Values of ``condition`` within which the dependency is exact, for one that is not so globally."""
    known = F.col(condition).isNotNull() & F.col(determinant).isNotNull() & F.col(dependent).isNotNull()
    pairs = df.where(known).groupBy(condition, determinant).agg(F.count_distinct(dependent).alias("d"), F.count(F.lit(1)).alias("n"))
    each = pairs.groupBy(F.col(condition).cast("string").alias("value")).agg(F.max("d").alias("d"), F.sum("n").alias("rows"))
    total = each.agg(F.sum("rows").alias("total"), F.max("d").alias("worst"))
    return each.join(F.broadcast(total)).where(
        (F.col("worst") > 1) & (F.col("d") == 1) & (F.col("rows") >= least_rows) & (F.col("rows") >= least_share * F.col("total"))
    ).select("value", "rows")


def conditional_completeness(df: DataFrame, condition: str, columns: Sequence[str], least_rows: int = 50) -> DataFrame:
    """(value, column, rows): columns always present under a value of ``condition``, though not everywhere."""
    each = df.where(F.col(condition).isNotNull()).groupBy(F.col(condition).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns]
    )
    whole = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__missing") for c in columns])
    long = each.join(F.broadcast(whole)).select(
        "value", "rows",
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("there"), F.col(f"{c}__missing").alias("missing")) for c in columns])),
    )
    return long.where((F.col("there") == F.col("rows")) & (F.col("missing") > 0) & (F.col("rows") >= least_rows)).select("value", "column", "rows")


def inclusions(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], least: float = 0.9, least_unique: float = 0.99) -> DataFrame:
    """(child, parent, containment, orphans): column pairs of which the child's values lie in a nearly unique parent.

    All columns' distinct values are stacked once and joined by value.
    """
    parts = []
    for t in tables:
        for c in columns[t]:
            counted = tables[t].where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(counted.select(F.lit(f"{t}.{c}").alias("name"), "value", "n"))
    values = reduce(DataFrame.union, parts)
    sizes = values.groupBy("name").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"))
    parents = sizes.where(F.col("distinct") >= least_unique * F.col("rows")).select(F.col("name").alias("parent"))
    right = values.join(F.broadcast(parents), F.col("name") == F.col("parent")).select("parent", F.col("value").alias("v"))
    shared = (
        values.join(right, (F.col("value") == F.col("v")) & (F.col("name") != F.col("parent")))
        .groupBy(F.col("name").alias("child"), "parent")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        shared.join(F.broadcast(sizes.select(F.col("name").alias("n"), "distinct")), F.col("child") == F.col("n"))
        .where(F.col("shared") >= least * F.col("distinct"))
        .select("child", "parent", (F.col("shared") / F.col("distinct")).alias("containment"), (F.col("distinct") - F.col("shared")).alias("orphans"))
    )


def orderings(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.97, least_rows: int = 50) -> DataFrame:
    """(low, high, strict, rows, support): column pairs of one family with low <= high nearly always."""
    family = {}
    for f in df.schema:
        family[f.name] = "number" if isinstance(f.dataType, NumericType) else "time" if isinstance(f.dataType, DateType | TimestampType | TimestampNTZType) else None
    names = [c for c in columns or df.columns if family[c]]
    pairs = [(a, b) for a in names for b in names if a != b and family[a] == family[b]]
    one = df.agg(
        *[
            F.struct(
                F.lit(a).alias("low"), F.lit(b).alias("high"),
                F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("rows"),
                F.count_if(F.col(a) <= F.col(b)).alias("le"), F.count_if(F.col(a) < F.col(b)).alias("lt"),
                (F.max(a) < F.min(b)).alias("apart"),
            ).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    long = one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))
    return long.where((F.col("rows") >= least_rows) & (F.col("le") >= least * F.col("rows")) & ~F.col("apart")).select(
        "low", "high", (F.col("lt") >= least * F.col("rows")).alias("strict"), "rows", F.try_divide(F.col("le").cast("double"), F.col("rows")).alias("support")
    )


def identities(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.97, least_rows: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(a, op, b, c, rows, support): a + b = c and a * b = c among numeric columns, each stated once.

    All columns are tried, _TRIALS sums and products in a scan: one scan for eight
    columns, nine for sixteen; name ``columns`` where a table has many.
    """
    names = list(columns or [f.name for f in df.schema if isinstance(f.dataType, NumericType)])
    trials = [(a, op, b, c) for a, b in combinations(names, 2) for op in "+*" for c in names if c not in (a, b)]

    def support(a: str, op: str, b: str, c: str):
        x, y, z = (F.col(k).cast("double") for k in (a, b, c))
        value = x + y if op == "+" else x * y
        known = value.isNotNull() & z.isNotNull()
        return F.struct(
            F.lit(a).alias("a"), F.lit(op).alias("op"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.count_if(known).alias("rows"),
            F.count_if(F.abs(value - z) <= tolerance * F.greatest(F.abs(z), F.lit(1.0))).alias("hold"),
        )

    if not trials:
        return df.sparkSession.createDataFrame([], "a string, op string, b string, c string, rows long, support double")
    parts = []
    for at in range(0, len(trials), _TRIALS):
        part = trials[at : at + _TRIALS]
        one = df.agg(*[support(*t).alias(f"t{i}") for i, t in enumerate(part)])
        parts.append(one.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(part))]))))
    long = reduce(DataFrame.unionByName, parts)
    return long.where((F.col("rows") >= least_rows) & (F.col("hold") >= least * F.col("rows"))).select(
        "a", "op", "b", "c", "rows", F.try_divide(F.col("hold").cast("double"), F.col("rows")).alias("support")
    )


def column_types(df: DataFrame, columns: Sequence[str], validators: Mapping[str, object], least: float = 0.5, least_values: int = 8) -> DataFrame:
    """(column, type, values, rate): semantic types that a share of a column's values satisfies; one aggregation."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    pairs = [(c, v) for c in texts for v in validators]
    one = df.agg(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(v).alias("type"), F.count(c).alias("values"), F.count_if(validators[v](c)).alias("hits")).alias(f"p{i}")
            for i, (c, v) in enumerate(pairs)
        ]
    )
    long = one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))
    return long.where((F.col("values") >= least_values) & (F.col("hits") >= least * F.col("values"))).select(
        "column", "type", "values", F.try_divide(F.col("hits").cast("double"), F.col("values")).alias("rate")
    )


def not_entailed(df: DataFrame, found_orderings: DataFrame, found_identities: DataFrame) -> DataFrame:
    """Orderings that don't follow from an identity: of a + b = c with b never negative, a <= c does; of a * b = c, with b at least one."""
    facts = [(r["a"], r["op"], r["b"], r["c"]) for r in found_identities.select("a", "op", "b", "c").collect()]
    others = sorted({x for a, _, b, _ in facts for x in (a, b)})
    if not facts:
        return found_orderings
    # One row for each identity of a table's columns.
    least = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in others]).first()
    enough = lambda c, op: least[c] is not None and least[c] >= (0.0 if op == "+" else 1.0)
    entailed = {(x, c) for a, op, b, c in facts for x, y in ((a, b), (b, a)) if enough(y, op)}
    if not entailed:
        return found_orderings
    known = df.sparkSession.createDataFrame(sorted(entailed), "__low string, __high string")
    return found_orderings.join(F.broadcast(known), (F.col("low") == F.col("__low")) & (F.col("high") == F.col("__high")), "left_anti")


def caveats(sample: DataFrame, total_rows: int | None = None, partition: str | None = None, representative: float = 0.1, small: int = 1000) -> list[str]:
    """What to discount a sample's findings by."""
    got = sample.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(partition) if partition else F.lit(2)).alias("p")).first()
    out = []
    if partition and got["p"] == 1:
        out.append(f"all rows have one {partition}: findings hold within it and may not hold across")
    if total_rows is None:
        out.append("the table's size is unknown")
    elif total_rows and got["n"] < representative * total_rows:
        out.append(f"{got['n']} of {total_rows} rows were looked at")
    if got["n"] < small:
        out.append(f"{got['n']} rows are few")
    return out


def meaning_groups(attributes: DataFrame) -> DataFrame:
    """(meaning, by, attribute): attributes of two datasets or more that share a concept, else a term, else a semantic type.

    attributes: dataset, attribute, concept, term, semantic_type.  Each attribute
    is placed once, by its strongest sign.
    """
    rest, parts = attributes, []
    for by in ("concept", "term", "semantic_type"):
        known = rest.where(F.col(by).isNotNull())
        shared = known.groupBy(F.col(by).alias("__m")).agg(F.count_distinct("dataset").alias("d")).where("d >= 2").select("__m")
        placed = known.join(shared, F.col(by) == F.col("__m")).select(F.col("__m").alias("meaning"), F.lit(by).alias("by"), F.concat_ws(".", "dataset", "attribute").alias("attribute"))
        parts.append(placed)
        rest = rest.join(shared, F.col(by) == F.col("__m"), "left_anti")
    return reduce(DataFrame.union, parts)
