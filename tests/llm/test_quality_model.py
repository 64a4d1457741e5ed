import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.llm import quality_model as q


def made(n=240, seed=1):
    rng = random.Random(seed)
    words = ["the", "river", "was", "cold", "and", "wide", "Stone", "walked", "home,", "again."]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 3 == 0
        if bad:
            kind = rng.choice(["shout", "signs", "again"])
            text = [w.upper() + "!!" if kind == "shout" else w + "$$$" if kind == "signs" else "spam" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(*r, "clash") for r in rows] + [(1000, None, "x"), (None, "", "x")], "doc_id long, text string, score string")
    frame = spark.createDataFrame([*labels, (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, frame)
    got = q.score(docs, model).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {d: y for d, y, _ in labels}
    out = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 20
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) >= 0.95


def test_labels_of_the_held_out_fold_do_not_count(spark):
    rows, labels = made()
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y, t) for d, y, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [q.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert models[0] == models[1]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in q.score(docs, model).collect()] == [0.5, 0.5]
    assert q.score(docs.limit(0), model).count() == 0


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    scale = rng.standard_normal(12)
    w = q.descend(rows, scale, y, 0.1, 400, 1)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    x[:, 12] = 1
    loss = lambda v: 0.5 * v @ v + 0.1 * np.maximum(0, 1 - y * (x @ v)).sum()
    best = loss(w)
    for _ in range(300):
        assert loss(w + 0.05 * rng.standard_normal(13)) >= best - 1e-3


@pytest.mark.parametrize(("word", "shape"), [("hello", "a"), ("Hello", "Aa"), ("ABC!!", "A!!"), ("x&&&&", "a&&"), ("12a", "9a")])
def test_shapes(word, shape):
    assert q.shape(word) == shape


def test_fit_against_a_plain_version():
    """Ratios from their definition, the optimum by projected gradient on the dual, scores by hand."""
    rows, labels = made(90, 4)
    extract = q.Features()
    sets, y = [extract(t) for _, t in rows], np.array([k for _, k, _ in labels])
    model = q.fit(sets, y.tolist(), min_count=5, c=0.1, epochs=3000)
    grams = sorted({g for s in sets for g in s if sum(g in t for t in sets) >= 5}, key=repr)
    x = np.array([[g in s for g in grams] for s in sets], float)
    p1, p0 = 1 + x[y == 1].sum(axis=0), 1 + x[y == 0].sum(axis=0)
    ratio = np.log(p1 / p1.sum()) - np.log(p0 / p0.sum())
    full = np.c_[x * ratio, np.ones(len(x))] * (2 * y - 1)[:, None]
    gram = full @ full.T
    alpha = np.zeros(len(x))
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        new = np.clip(alpha + step * (1 - gram @ alpha), 0, 0.1)
        if np.abs(new - alpha).max() < 1e-12:
            break
        alpha = new
    w = alpha @ full
    assert set(model.weights) <= set(grams) and abs(model.bias - w[-1]) < 0.02
    want = dict(zip(grams, w[:-1] * ratio, strict=True))
    assert max(abs(model.weights.get(g, 0) - v) for g, v in want.items()) < 0.02
    for s in sets[:20]:
        margin = model.bias + sum(model.weights.get(g, 0) for g in s)
        assert abs(model.score(s) - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-12


def test_repeated_ids_ties_and_long_texts(spark):
    rows, labels = made(60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = q.train(docs, frame)
    assert q.train(docs.union(docs).union(docs), frame) == plain
    assert q.train(docs, frame.union(frame)) == plain
    assert q.train(docs.limit(0), frame) == q.Model()
    some = q.train(docs, frame, rows_per_class=7)
    assert some == q.train(docs.orderBy(F.desc("doc_id")), frame, rows_per_class=7)
    long = spark.createDataFrame([(1, "word " * 400_000), (1, "x" * 2_000_000), (2, "Aa9!" * 300_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in q.score(long, plain).collect())


def test_query_is_the_model_over_every_row(spark, tmp_path):
    rows, labels = made(120, 6)
    rows += [(None, "x"), (500, None), (3, "another text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op1_quality_nbsvm(spark, str(tmp_path)).collect()
    learn, seen = [], set()
    import xxhash

    signed = lambda t: (xxhash.xxh64_intdigest(t, 42) ^ 1 << 63) - (1 << 63)
    for d, y, _ in labels:
        if zlib.crc32(str(d).encode()) % 5 and d not in seen:
            seen.add(d)
            learn.append((y, min((t for i, t in rows if i == d), key=signed)))
    extract = q.Features()
    import json

    learn.sort(key=lambda r: (r[0], json.dumps(sorted(extract(r[1]), key=repr))))
    model = q.fit([extract(t) for _, t in learn], [y for y, _ in learn])
    want = sorted((str(d), d is not None and zlib.crc32(str(d).encode()) % 5 == 0, round(model.score(extract(t or "")), 9)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 9)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.3) for r in got)
