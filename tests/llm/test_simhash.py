import random

import numpy as np
import pytest
import xxhash

from veritide.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_fingerprints_and_groups(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "GAMMA", "é", "漢", "delta,", "x"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 7))) for _ in range(120)]
    long = [rng.choice(vocabulary) + str(rng.randrange(500)) for _ in range(3000)]
    texts += [None, "", " \n", "a\x0bb c d"] + [" ".join(long[:-k] + ["zz"] * k) for k in range(12)]
    rows = [(i * 3 % 1009, t, "clash") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    got = {r.doc_id: r for r in got}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i, _, _ in rows] == [f"{f:016x}" for f in fps]
    roots = plain_components(fps)
    least = {}
    for (i, _, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    assert [got[i].component_id for i, _, _ in rows] == [least[r] for r in roots]
    assert all(got[i].kept == (got[i].component_id == i) for i, _, _ in rows)


@pytest.mark.parametrize(("hot", "sent"), [(8192, 500_000), (3, 500_000), (3, 0)])
def test_links_of_random_fingerprints(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "_SENT", sent)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = set(base.tolist())
    for v in base.tolist():
        for _ in range(8):
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    where = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert (values[where[a]] ^ values[where[b]]).bit_count() <= 3
        parent[root(where[a])] = root(where[b])
    want = plain_components(values)
    assert len({(w, root(i)) for i, w in enumerate(want)}) == len(set(want)) == len({root(i) for i in range(len(values))})


def test_one_anchor_of_many_fingerprints(spark, monkeypatch):
    """All stand at one anchor of a half; groups span batches."""
    monkeypatch.setattr(simhash, "HOT", 1500)
    rng = np.random.default_rng(8)
    values = np.unique((rng.integers(0, 2**31, 6000, dtype=np.uint64) << np.uint64(32)) | np.uint64(12345))
    near = values[:300] ^ (np.uint64(1) << rng.integers(32, 63, 300).astype(np.uint64))
    values = np.unique(np.concatenate([values, near]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = simhash.link_fingerprints(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parent = {int(v): int(v) for v in values}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in rows:
        assert (a ^ b).bit_count() <= 3
        parent[root(a)] = root(b)
    for i, v in enumerate(values):
        close = values[:i][np.bitwise_count(values[:i] ^ v) <= 3]
        assert all(root(int(c)) == root(int(v)) for c in close)


def test_every_anchor_is_reached():
    fp = np.random.default_rng(5).integers(-(2**62), 2**62, 200)
    row, key, home = simhash.anchors(fp)
    assert home.sum() == 2 * len(fp)
    assert sorted(key[home].tolist()) == sorted(simhash.home_anchors(fp).tolist())
    assert not simhash._syndrome(key & 0x7FFFFFFF).any()


def test_no_rows_and_no_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "one two three"), (None, "one two three"), (7, "four five six seven"), (7, "four five six seven")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("7", "7", True), ("7", "7", True), ("None", "None", True), ("None", "None", True)]
