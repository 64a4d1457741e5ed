import random
import zlib

import numpy as np
import pytest

from veritide.llm import packing
from veritide.llm.common import tokenizer_file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def texts():
    rng = random.Random(1)
    fixed = ["", " ", "a  b", "\n\n x", "a\n", "it's  \t b c ", "x \x1c y", "　a b  c", "<|endoftext|> x", "ab" * 5000, " " * 300]
    odd = ["".join(rng.choice(" \n\tab's1.é漢🙂 　") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    return fixed + odd


def test_ids_are_those_of_the_library(library):
    enc = packing.encoder(tokenizer_file("byte_bpe_50k.json"))
    t = texts()
    want = library.encode_batch(t, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(t)] == [e.ids for e in want]


def test_piece_lengths():
    for n in range(1, 5000, 7):
        p = packing.piece_lengths(n)
        assert sum(p) == n and all(x & (x - 1) == 0 and x <= 2048 for x in p)
        assert len([x for x in p if x < 2048]) == len({x for x in p if x < 2048})
    with pytest.raises(ValueError):
        packing.pack(None, max_len=1000)


def test_round_trip(spark, library):
    rows = [(1, "hello world " * 900), (2, None), (None, "x"), (1, "hello world " * 900), (3, "")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, start string, length int")
    got = packing.pack(df, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by_doc = {}
    for r in got:
        assert r.offset == 0 and r.length == r.bucket == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in ((2, ""), (3, ""), (None, "x")):
        ids = [i for r in sorted(by_doc[doc_id], key=lambda r: r.start) for i in r.ids]
        assert ids == library.encode(text, add_special_tokens=False).ids + [1]
    want = library.encode(rows[0][1], add_special_tokens=False).ids + [1]
    assert {r.doc_tokens for r in by_doc[1]} == {len(want)}
    assert sum(r.length for r in by_doc[1]) == 2 * len(want)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_runs(spark, library):
    n = 2_000_000
    long = [" " * n + "x", "a" * n, "é\n" + " \n\t" * (n // 3) + "y", "<|endoftext|>" + "\u3000" * 600_000, "!" * 300_000 + " " * 50_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {}
    for r in packing.pack(df).select("doc_id", "start", "length", "ids_crc32").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(long):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert sum(r.length for r in got[i]) == len(ids)
        for r in got[i]:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_query_shows_the_buckets(spark, tmp_path):
    spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op7_pack(spark, str(tmp_path)).collect()
    assert rows and all(r.bucket == r.length and r.bucket & (r.bucket - 1) == 0 and r.offset == 0 for r in rows)


def test_added_tokens_have_the_ids_of_the_unmodified_library(spark, library):
    plain = library
    marked = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "it's<|endoftext|>'s  ", " <|ENDOFTEXT|>"]
    t = texts() + marked + [a + b for a, b in zip(texts()[50:1050], marked * 200)]
    want = [e.ids for e in plain.encode_batch(t, add_special_tokens=False)]
    assert [50256 in x for x in want[-len(marked) - 1000 :][: len(marked)]] == [True, True, True, False, True, False]
    enc = packing.encoder(tokenizer_file("byte_bpe_50k.json"))
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(t)] == want
    df = spark.createDataFrame([(i, x) for i, x in enumerate(marked)], "doc_id long, text string")
    by_doc = {}
    for r in sorted(packing.pack(df, with_ids=True).collect(), key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).extend(r.ids)
    assert [by_doc[i] for i in range(len(marked))] == [plain.encode(x, add_special_tokens=False).ids + [1] for x in marked]
