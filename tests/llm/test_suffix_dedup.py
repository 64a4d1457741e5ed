import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from veritide.llm import suffix_dedup


def test_cover_reaches_every_pair():
    shift = suffix_dedup.shifts()
    for a in range(suffix_dedup.PERIOD):
        for b in range(suffix_dedup.PERIOD):
            assert (a + shift[a, b]) % suffix_dedup.PERIOD in suffix_dedup.COVER
            assert (b + shift[a, b]) % suffix_dedup.PERIOD in suffix_dedup.COVER


def mixed(rng, pieces):
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([10, 300]))) for _ in range(6)]
    return b"".join(rng.choice(parts) if rng.random() < 0.7 else bytes(rng.randrange(256) for _ in range(50)) for _ in range(pieces))


def test_cover_ranks_sort_deep_ties():
    rng = np.random.default_rng(3)
    half = rng.integers(97, 99, 700).astype(np.uint8)
    text = np.concatenate([half, half, half])
    keys = suffix_dedup._keys(text, 1000)
    rank = suffix_dedup.cover_ranks(keys, len(text), 400)
    raw = text.tobytes()
    cover = [i for i in range(len(text)) if i % suffix_dedup.PERIOD in suffix_dedup.COVER]
    for i, j in zip(cover, cover[1:], strict=False):
        if max(i, j) + 600 <= len(text):
            a, b = raw[i : i + 400], raw[j : j + 400]
            assert (a < b) <= (rank[i] <= rank[j]) and (a > b) <= (rank[i] >= rank[j])


@pytest.mark.parametrize("bucket", [1 << 16, 50])
def test_repeats_of_a_block_against_counting(monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = random.Random(1)
    for trial in range(40):
        width = rng.choice([80, 100, 200])
        text = mixed(rng, rng.randrange(6, 40))
        if len(text) <= width:
            continue
        starts = np.array(sorted(rng.sample(range(len(text) - width + 1), rng.randrange(1, len(text) - width + 2))))
        if trial % 2:
            np.random.default_rng(trial).shuffle(starts)
        times = Counter(text[i : i + width] for i in starts.tolist())
        got = suffix_dedup.repeated(np.frombuffer(text, np.uint8), starts, width)
        assert got.tolist() == [times[text[i : i + width]] > 1 for i in starts.tolist()]


def test_runs_put_equal_windows_in_one_bucket():
    rng = random.Random(2)
    docs = [mixed(rng, 20) for _ in range(8)]
    raw, ends = b"".join(docs), np.cumsum([len(d) for d in docs])
    start, windows, lead, key = suffix_dedup.runs(np.frombuffer(raw, np.uint8), ends, 100, suffix_dedup._mixing())
    bucket = {}
    for s, n, x, k in zip(start.tolist(), windows.tolist(), lead.tolist(), key.tolist(), strict=True):
        for i in range(n):
            where = bucket.setdefault(raw[s + i : s + i + 100], (k, x - i))
            assert where == (k, x - i) and 0 <= x - i <= 100 - suffix_dedup.KMER
    assert sum(windows) == sum(max(0, len(d) - 99) for d in docs)


def plain(texts, width):
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - width + 1):
            if times[r[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(r) else 0
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes() if r else b""
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "é", "漢字", "x", "omega"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(n))
    passage, common = say(30), say(40)
    texts = [None, "", "short", "a" * 3000, "ab" * 900, say(300), say(2000)]
    texts += [f"{say(20)} {passage} {say(20)}" for _ in range(12)] + [f"{say(15)}{common}{say(3)}" for _ in range(60)]
    texts += [texts[6]] * 4 + [texts[6][:4000] + say(30) + texts[6][4200:], texts[5] * 3, say(5)]
    return texts


@pytest.mark.parametrize("limit", [4096, 3])
def test_dedup_against_plain_counting(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "PIECE", 6000)
    texts = corpus()
    # Extra columns, one of a name that the operator uses itself; a repeated and a missing doc_id.
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(4, texts[8], "n"), (None, texts[9], "n"), (None, texts[9], "n")]
    want = plain([r[1] for r in rows], 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = suffix_dedup.dedup(docs, width=120, limit=limit).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    # 57 words of six letters with a blank between make 398 bytes; the last word is longer by one or two.
    short, long = (" ".join([say(6) for _ in range(56)] + [say(7 + more)]) for more in (0, 1))
    assert (len(short), len(long), len(short.split())) == (399, 400, 57)
    # The digit on either side differs from document to document, so that no longer string repeats.
    texts = [f"{say(200)}{i}{passage}{i}{say(300)}" for i, passage in enumerate([short] * 4 + [long] * 4)]
    texts += [say(900) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs).collect()}
    assert got == {i: (len(t), 400 if long in t else 0, int(long in t)) for i, t in enumerate(texts)}


def test_a_passage_of_51_words_goes_at_its_own_width(spark):
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = " ".join([say(4) for _ in range(34)] + [say(5) for _ in range(17)])
    assert (len(passage), len(passage.split())) == (271, 51)
    texts = [f"{say(200)}{i}{passage}{i}{say(300)}" for i in range(4)] + [say(900) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, gone in ((271, 271), (272, 0), (400, 0)):
        got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs, width=width).collect()}
        assert got == {i: gone if passage in t else 0 for i, t in enumerate(texts)}


def test_empty_table_and_narrow_windows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(docs).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, width=79)
