import random
import re
from itertools import permutations

from veritide.llm import filter_audit


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, t, part in docs:
        f = failed(t or "")
        f["E"] = d is not None and any(e is not None and e < d and (u or "") == (t or "") for e, u, _ in docs)
        rows.append((part or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [r for r in mine if f in r[0] and not r[0] & before]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not r[0] & (before | {f}) for r in mine), len(removed), sum(f in r[0] and bool(r[0] & before) for r in mine),
                    sum(r[0] == {f} for r in mine), sum(r[1] for r in removed), sum(r[2] for r in removed),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_walking_every_order(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)] + ["BIG", "é漢", "Mixed", "#tag"]
    texts = [" ".join(rng.choice(words[: rng.choice([60, 150, 154])]) for _ in range(rng.choice([3, 99, 100, 140, 300]))) for _ in range(40)]
    texts += [None, "", "\x0b\t ", "A", "x " * 5000, " ".join(words[:120]), " ".join(words[:100]), "ABCDEFGHIJ" + "a" * 90, "ABCDEFGHIJ" + "a" * 89]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [(100 + i, t, "en") for i, t in enumerate(texts[:12])] + [(3, texts[3], "en"), (None, texts[3], "en"), (None, texts[3], "de"), (0, texts[7], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(30)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 0, "n", 1) for d in docs], "doc_id long, text string, lang string, mask int, words string, n int")
    got = filter_audit.audit(filter_audit.failures(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == len({r.part for r in got}) * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(docs, labels)


def test_edges_of_three_filters_and_empty_table(spark):
    counted = spark.createDataFrame([("p", m, False, m == 1, m + 1) for m in range(8)], "part string, mask int, good boolean, toxic boolean, n long")
    assert filter_audit.edges(counted, "XYZ").count() == 12
    got = filter_audit.audit(counted, "XYZ").collect()
    assert len(got) == 18 and all(r.kept == 1 for r in got if r.step == 3)
    assert sum(r.removed for r in got if r.filter_order == "ZXY") == 35
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(docs, labels)).count() == 0
