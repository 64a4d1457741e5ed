import hashlib
import itertools
import random
import re
import time

import numpy as np

from veritide.llm import pii


def plain(t):
    t = t or ""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_against_plain_search():
    rng = random.Random(4)
    parts = ["a", "b@", "@", ".", "1", "25", "256", "0", "00", "+", "-", " ", "(", ")", "4242 4242 4242 4242", "x.y", "c.", "%", "\n", "é", "1.2.3.4"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert pii.base_spans(t) == plain(t), t


def test_field_on_sentences_it_has_not_seen():
    hit = wrong = missed = 0
    field = pii.trained()
    for text, spans in pii.labelled_sentences(150, 99):
        got, want = set(field.decode(text)), set(spans)
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) >= 0.95 and hit / (hit + missed) >= 0.9


def test_decoding_is_the_best_segmentation():
    field = pii.trained()
    for text, _ in pii.labelled_sentences(40, 7):
        toks, segments = pii.lattice(text)
        scores = field.scores(segments)
        best = [0.0] * (len(toks) + 1)
        for j in range(1, len(toks) + 1):
            best[j] = max([best[j - 1], *[best[i] + scores[s].max() for s, (i, e, _) in enumerate(segments) if e == j]])
        want = best[-1]
        where = {(toks[i][0], toks[j - 1][1]): s for s, (i, j, _) in enumerate(segments)}
        got = sum(scores[where[a, b]][pii.KINDS.index(k)] for a, b, k in field.decode(text))
        assert abs(got - want) < 1e-9


def test_query_and_redaction(spark, tmp_path):
    texts = [None, "", "Mail a.b@x.org or +1 (918) 555-2191, ip 10.0.0.1; card 4242 4242 4242 4242.", "call 918-555-2191 or jo12 [at] example [dot] com now", "é" * 5000 + " a@b.co"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[2], "x"), (2, texts[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.detect(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ",".join(f"{k}:{a}:{b}" for a, b, k in plain(texts[2 if r.doc_id is None else r.doc_id]))
        assert r.base_spans == want and {*want.split(",")} - {""} <= {*r.spans.split(",")}
    assert "phone" in next(r.spans for r in got if r.doc_id == 3)
    red = {r.doc_id: r.redacted for r in pii.redact(df.where("doc_id is not null"), ["doc_id"]).collect()}
    assert red[2] == "Mail [EMAIL] or [PHONE], ip [IP]; card [CARD]." and red[0] is None and red[1] == ""
    assert pii.detect(df.limit(0)).count() == 0
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        spans = plain(texts[2 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert r.n_phone == sum(k == "phone" for _, _, k in spans) and r.n_ip == sum(k == "ip" for _, _, k in spans)


def test_lines_decode_as_the_whole_text_does():
    field = pii.trained()
    rng = random.Random(12)
    parts = ["a", "1", "22", "4242 4242 4242 4242", "call 918-555-2191", "jo12 [at] example [dot] com", "(at)", "@", ".", "-", " ", "\n", "\n", "\r", "\u00a0", "x1y2z3w4v5u6t7", "+49 171 5552191", "é", "phone", ",", "1 a 2 b 3 c 4 d 5 e 6 f 7"]
    texts = ["".join(t for t, _ in pii.labelled_sentences(12, seed)) for seed in range(20)]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    for t in texts:
        assert pii.field_spans(t, field) == field.decode(t), t


def all_runs(text):
    """Candidates by looking at every run of tokens."""
    toks = [m.span() for m in pii._TOKEN.finditer(text)]
    out = []
    for i in range(len(toks)):
        for j in range(i + 1, min(i + pii.MAX_SEGMENT, len(toks)) + 1):
            if text[toks[j - 1][0]] == "\n":
                break
            if (f := pii.segment_features(text, toks, i, j)) is not None:
                out.append((i, j, f))
    return toks, out


def test_sums_and_best_segmentation_against_enumeration():
    """All sets of segments that don't overlap, with all kinds, of short texts."""
    rng = random.Random(13)
    field = pii.trained()
    checked = 0
    for text, _ in pii.labelled_sentences(200, 31):
        toks, segments = all_runs(text)
        assert pii.lattice(text) == (toks, segments)
        if not 1 <= len(segments) <= 7:
            continue
        checked += 1
        scores = field.scores(segments) + np.array([[rng.gauss(0, 1) for _ in pii.KINDS] for _ in segments])
        total, weight, best = 0.0, np.zeros_like(scores), 0.0
        for chosen in itertools.product(range(-1, len(pii.KINDS)), repeat=len(segments)):
            taken = sorted((segments[s][0], segments[s][1]) for s, k in enumerate(chosen) if k >= 0)
            if any(a[1] > b[0] for a, b in zip(taken, taken[1:], strict=False)):
                continue
            value = sum(scores[s][k] for s, k in enumerate(chosen) if k >= 0)
            total += np.exp(value)
            best = max(best, sum(field.scores(segments)[s][k] for s, k in enumerate(chosen) if k >= 0)) if checked <= 5 else best
            for s, k in enumerate(chosen):
                if k >= 0:
                    weight[s, k] += np.exp(value)
        partition, marginal = pii.expectations(len(toks), segments, scores)
        assert abs(partition - np.log(total)) < 1e-6 * max(1, abs(partition))
        assert np.allclose(marginal, weight / total, atol=1e-6)
        if checked <= 5:
            where = {(toks[i][0], toks[j - 1][1]): s for s, (i, j, _) in enumerate(segments)}
            plain_scores = field.scores(segments)
            assert abs(sum(plain_scores[where[a, b]][pii.KINDS.index(k)] for a, b, k in field.decode(text)) - best) < 1e-9
        if checked == 25:
            break
    assert checked >= 10


def test_dense_and_very_long_texts():
    field = pii.trained()
    dense = "mail a.b@x.org or +1 (918) 555-2191\n" * 20_000
    long = "7" * 1_000_000 + " call 918-555-2191 " + "ab" * 500_000 + "@x.org"
    began = time.time()
    base, spans = pii.find(dense, field)
    assert len(base) == 40_000 and set(base) <= set(spans)
    assert any(k == "phone" for _, _, k in pii.find(long, field)[1])
    assert time.time() - began < 60


#: Sentences written by hand; what is between double angle brackets is personal data that the base patterns miss.
HAND = """
bob.smith and <<bob.smith [at] mail [dot] com>> are one
<<anna (at) web (dot) de>>
ask <<jo12 [at] example [dot] com>> for it
Schreib an <<lena.k(at)posteo.de>> bitte
write to <<info [at] shop.co.uk>> today
escribe a <<maria_lopez (at) correo (dot) es>>, gracias
courriel <<j-p.martin[at]laposte[dot]net>>
Handy <<0171/5552191>> abends
Tel: <<030/555 21 91>>
call <<918-555-2191>> now
ring <<(918) 555-2191>> after six
tel <<555.219.1877>>
téléphone <<01 55 52 19 11>>
meet (at) noon, bring 12 apples
score 3 [at] 15 minutes
look (at) home. now
room 12/34/2024 order 20231231
the ratio 100/200 3000 is fine
invoice 918-555-2191
uid 4242424242424243
born 12.04.1987, paid 1,250,300
version 2.14.7 build 20240102
sizes 10, 20, 30, 40, 50, 60
prices (at) 12.50 each
"""


def test_what_the_field_adds_to_sentences_written_by_hand():
    field = pii.trained()
    hit = wrong = missed = 0
    for line in HAND.strip().split("\n"):
        want, text = set(), ""
        for i, part in enumerate(re.split("<<|>>", line)):
            if i % 2:
                want.add((len(text), len(text) + len(part)))
            text += part
        base, spans = pii.find(text, field)
        assert base == []
        got = {(a, b) for a, b, _ in spans}
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.9, (hit, wrong, missed)
