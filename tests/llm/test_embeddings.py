import math

import numpy as np

from veritide.llm import embeddings


def plain(rows, least=0.9):
    good = {}
    for i, (v, e) in enumerate(rows):
        if e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            a = np.array(e, np.float64)
            good[i] = a / np.linalg.norm(a)
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component[i] = min(rows[j][0] for j in seen)
    return sorted((rows[i][0], len(links[i]), component[i]) for i in range(len(rows)))


def test_groups_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCKS", ((10, 7), (None, 11)))
    rng = np.random.default_rng(1)
    rows = []
    for size in (1, 1, 1, 2, 3, 30):
        centre = rng.standard_normal(24)
        for _ in range(size):
            rows.append((len(rows) * 7 % 101, (centre + 0.15 * rng.standard_normal(24)).astype("f4").tolist()))
    rows += [(1000 + i, e) for i, e in enumerate([None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23,
                                                   [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [-0.0, 1.0], [0.0, 1.0]])]
    rows += [(5000 + i, rows[3][1]) for i in range(40)]
    df = spark.createDataFrame([(v, e, "clash") for v, e in rows], "vec_id long, embedding array<float>, node string")
    got = embeddings.near_duplicates(df, passes=8, window=16).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_more_vectors_take_more_passes():
    few, many = (embeddings.default_passes(n, 64, 0.9) for n in (10**4, 10**8))
    assert 4 <= few < many < 100


def test_recall_of_isolated_pairs_with_default_settings(spark):
    """Pairs at cosine 0.90 to 0.92 among random vectors; no group helps to find them."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    m = unit(rng.standard_normal((8000, 64)))
    c = rng.uniform(0.9005, 0.92, 600)[:, None]
    side = rng.standard_normal((600, 64))
    side -= (side * m[:600]).sum(axis=1, keepdims=True) * m[:600]
    m = np.concatenate([m, c * m[:600] + np.sqrt(1 - c * c) * unit(side)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    assert all(got[i].n_links <= want[i] for i in got)
    queries = list(range(0, len(m), 50))
    assert sum(got[i].n_links for i in range(len(m))) >= 0.95 * want.sum()
    assert sum(got[i].n_links for i in queries) >= 0.9 * want[queries].sum()


def test_ties_at_the_bound_no_ids_and_long_vectors(spark):
    # (3, 4) and (4, 3) have cosine 24/25; rows without a vec_id link like others.
    long = np.random.default_rng(7).standard_normal(20_000)
    rows = [(5, [3.0, 4.0]), (None, [4.0, 3.0]), (6, [-3.0, -4.0]), (None, [-4.0, 4.0]), (None, None), (7, long.tolist()), (8, (long + 0.1).tolist()), (9, (-long).tolist())]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    seen = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got)
    assert seen == sorted([("5", 1, "5", True), ("None", 1, "5", False), ("6", 0, "6", True), ("None", 0, "None", True), ("None", 0, "None", True), ("7", 1, "7", True), ("8", 1, "7", False), ("9", 0, "9", True)])
    same = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(3)] + [(9, [4.0, 3.0])], "vec_id long, embedding array<double>")
    exact = embeddings.near_duplicates(same, least=float(np.dot(np.array([3.0, 4.0]) / 5, np.array([4.0, 3.0]) / 5))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in exact) == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (9, 3, 0)]


def test_partitions_do_not_change_the_links(spark):
    # Each row links with the next ones along an arc only, so a link lost at a boundary splits the group.
    turns = np.arange(600) * 0.004
    rows = [(i, [math.cos(a), math.sin(a)] + [0.0] * 6) for i, a in enumerate(turns)]
    np.random.default_rng(2).shuffle(rows)
    df = spark.createDataFrame([(int(i), e) for i, e in rows], "vec_id long, embedding array<double>")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = embeddings.near_duplicates(df, least=0.99999, window=64, passes=4).collect()
            results.append(sorted((r.vec_id, r.n_links, r.component_id) for r in got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    assert results[0] == plain([(i, e) for i, e in sorted(rows)], least=0.99999)


def test_narrow_cone_with_outliers_reaches_the_recall(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    cone = unit(np.eye(64)[0] * 2 + unit(np.c_[np.zeros(4000), rng.standard_normal((4000, 63))]))
    # Outliers linked to one member of the cone: at cosine 0.905 of it, away from the axis.
    away = rng.standard_normal((200, 64))
    away[:, 0] = -4
    away -= (away * cone[:200]).sum(axis=1, keepdims=True) * cone[:200]
    far = 0.905 * cone[:200] + math.sqrt(1 - 0.905**2) * unit(away)
    m = np.concatenate([cone, far])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    assert near[4000:].sum() >= 200
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    want = near.sum(axis=1)
    queries = [i for i in range(0, len(m), 50)] + list(range(4000, 4200))
    assert sum(got[i] for i in queries) >= 0.98 * want[queries].sum()
    assert all(got[i] <= want[i] for i in got)


def test_every_link_is_found_whatever_the_number_of_vectors(spark, monkeypatch):
    """Few passes find nearly all links of tight pairs, hardly any of three loose pairs; small blocks stand for many vectors."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    m = unit(rng.standard_normal((1203, 32)))
    side = rng.standard_normal((603, 32))
    side = unit(side - (side * m[:603]).sum(axis=1, keepdims=True) * m[:603])
    c = np.r_[np.full(600, 0.99999), np.full(3, 0.901)][:, None]
    m = np.concatenate([m, c * m[:603] + np.sqrt(1 - c * c) * side])
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(3000, [1.0, 2.0]), (3001, [2.0, 3.9]), (3002, [0.0, 0.0])]
    near = np.triu(m @ m.T >= 0.9, 1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)} | {(3000, 3001)}
    assert {(i, 1203 + i) for i in range(603)} <= want
    ends = [x for pair in want for x in pair]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "default_passes", lambda *a: 2)
    for wide, tile in ((16_384, 1024), (200, 64)):
        monkeypatch.setattr(embeddings, "WIDE", wide)
        monkeypatch.setattr(embeddings, "TILE", tile, raising=False)
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, window=1).collect()}
        assert all(got[a].component_id == got[b].component_id for a, b in want)
        assert {i: r.n_links for i, r in got.items()} == {i: ends.count(i) for i, _ in rows}
