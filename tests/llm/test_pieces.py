import hashlib
import random
import time

import pytest

from veritide.llm import pieces
from veritide.llm.common import tokenizer_file


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def texts(codec):
    rng = random.Random(5)
    fixed = ["", "a", "  a  b ", "\ta\n", "x▁y", "<s>", "\x00a", " " * 50, "a" * 500, "ab" * 3000, "the" * 999, " " * 33 + "x" + " " * 17, "é̀ﬁ①漢字🙂", "<0x0A>"]
    parts = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "in", "ing", "é", "漢", "🙂", "1", "0", ".", "==", "--"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    drawn = ["".join(rng.choice(codec.pieces[300:]) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    return fixed + mixed + drawn


def test_against_the_library(library):
    codec = pieces.codec(tokenizer_file("piece_bpe_32k.model"))
    for t, want in zip(texts(codec), library.encode(texts(codec), num_threads=1), strict=True):
        assert [int(i) for i in ",".join(w[0] for w in codec.encode_words([t])[0]).split(",") if i] == want, t
        assert codec.decode(want) == library.decode(want), t


def test_query_columns(spark, library):
    rows = [(1, "Hello  world"), (2, None), (None, "x"), (1, "Hello  world"), (3, ""), (4, "word " * 30000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    got = pieces.encode(df, with_ids=True).collect()
    assert len(got) == len(rows)
    text = {1: "Hello  world", 2: "", None: "x", 3: "", 4: "word " * 30000}
    for r in got:
        ids = library.encode(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == library.decode(ids)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode(df.limit(0)).count() == 0


def test_very_long_words(library):
    codec = pieces.codec(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(9)
    letters = lambda kinds, n: "".join(rng.choice(kinds) for _ in range(n))
    many = [letters("abcdefghijklmnopqrstuvwxyz", 1_000_000), "a" * 1_000_000, "th" * 200_000, letters("ab", 200_000), letters(["the", "re", "in", "t", "h", "e", "é", "🙂"], 100_000)]
    began = time.time()
    got = [codec.encode(t) for t in many]
    assert time.time() - began < 60
    assert got == library.encode(many)


def test_short_words_of_many_ambiguous_merges(library):
    codec = pieces.codec(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(10)
    unsafe = [p for p, i in codec.ids.items() if len(p) > 1 and not codec.safe[i]]
    many = ["".join(rng.choice(unsafe) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert [codec.encode(t) for t in many] == library.encode(many)


def test_cuts_are_where_no_piece_reaches_across():
    codec = pieces.codec(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(11)
    word = "".join(rng.choice("abqzxk9é漢=") for _ in range(300))
    spans = [(i, i + n) for i in range(len(word)) for n in range(2, 17) if i + n <= len(word) and word[i : i + n] in codec.ids]
    want = [not any(a < i < b for a, b in spans) for i in range(len(word))]
    assert codec.cuts(word).tolist() == want and sum(want) > 20
