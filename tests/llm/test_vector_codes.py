import math
import random

import numpy as np

from veritide.llm import vector_codes


def plain(rows, parts, entries, rounds):
    """Lloyd's rounds with every distance computed, on Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = parts * math.ceil(max((len(r[1]) for r in rows), default=0) / parts)
    d = dims // parts
    ints = [[math.floor(1024 * x) for x in r[1]] + [0] * (dims - len(r[1])) for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))[:entries]
    cut = [[v[p * d : (p + 1) * d] for v in ints] for p in range(parts)]
    books = [[list(cut[p][i]) for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        code = [[min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e)) for v in cut[p]] for p in range(parts)]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v for v, c in zip(cut[p], code[p], strict=True) if c == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    error = [sum(far(cut[p][i], books[p][code[p][i]]) for p in range(parts)) for i in range(len(rows))]
    sums = {}
    for r, e in zip(rows, error, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    return [(r[0], bytes(code[p][i] for p in range(parts)), error[i], sums[r[2]]) for i, r in enumerate(rows)], books


def order(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_codes_against_comparing_all(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 1e-4, 2.0]) * rng.choice([1, 1, 3]) for _ in range(8)], rng.choice(["a", "b", None])) for i in range(120)]
    # Ties: equal vectors, entries that start equal, parts of zeros.
    rows += [(200 + i, rows[3][1], "a") for i in range(5)] + [(2, [0.0] * 8, None), (None, [0.5] * 8, ""), (500, [9.0] * 5, "b"), (501, [], "b")]
    rows += [(600, None, "a"), (601, [1.0, None] * 4, "a"), (602, [float("nan")] * 8, "a"), (603, [float("inf")] + [0.0] * 7, None), (604, [1e30] * 8, "c")]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label string, error int, same string")
    for entries, rounds in ((7, 4), (40, 2)):
        got, books = vector_codes.encode(frame.where("vec_id IS NULL OR vec_id <> 604"), entries=entries, rounds=rounds)
        want, plain_books = plain(rows[:-1], 4, entries, rounds)
        assert books.tolist() == plain_books
        assert sorted(((r.vec_id, bytes(r.code), r.error, r.label_error) for r in got.collect()), key=order) == sorted(want, key=order)
    # A component that 64 bits can't square counts as the bound, and nothing fails.
    assert vector_codes.encode(frame, entries=7, rounds=1)[0].count() == 130


def test_bounds_prune_and_never_change_the_nearest():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-900, 900, (400, 6)) + c for c in rng.integers(-9000, 9000, (20, 1, 6))]).astype(np.int64)
    books = [x[:64].copy()]
    for _ in range(3):
        books.append(books[-1] + rng.integers(-40, 40, books[-1].shape))
    code, upper, lower = vector_codes.assign(x, vector_codes.Entries(books[0]), None, None, None)
    for before, now in zip(books, books[1:], strict=False):
        code, upper, lower = vector_codes.assign(x, vector_codes.Entries(now, before), code, upper.astype(np.float64), lower.astype(np.float64))
        d = vector_codes.squares(x, now)
        assert (code == d.argmin(axis=1)).all()
        true = np.sqrt(d)
        assert (upper >= true[np.arange(len(x)), code]).all() and (lower <= true).all()
    # Far more entries are ruled out than not.
    assert (upper[:, None] < lower).mean() > 0.9


def test_few_rows_and_empty_table(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.encode(spark.createDataFrame([], kind))[0].count() == 0
    assert vector_codes.encode(spark.createDataFrame([(1, None, 2)], kind))[0].count() == 0
    one = vector_codes.encode(spark.createDataFrame([(1, [0.5, 0.25], 2)], kind))[0].collect()
    assert [(r.vec_id, bytes(r.code), r.error) for r in one] == [(1, bytes(4), 0)]
    assert [tuple(r)[2:] for r in vector_codes.encode(spark.createDataFrame([(1, [], None)], kind))[0].collect()] == [(bytes(4), 0, 0)]
