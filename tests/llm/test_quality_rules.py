import random
import re

import numpy as np

from veritide.llm import quality_rules


def plain_repeats(d):
    out = []
    for i in range(len(d)):
        best = 0
        for j in range(len(d)):
            k = 0
            while i != j and i + k < len(d) and j + k < len(d) and d[i + k] == d[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_suffix_arrays_against_all_pairs():
    rng = random.Random(3)
    for _ in range(200):
        docs = [[rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(1, 6))]
        flat = np.array([w for d in docs for w in d], np.int64)
        got = quality_rules.longest_repeats(flat, np.array([len(d) for d in docs]))
        assert got.tolist() == [x for d in docs for x in plain_repeats(d)]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    marked = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = plain_repeats(words)
    covered = {p + k for p, m in enumerate(repeats) if m >= 3 for k in range(m)}
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked), "covered_words": len(covered), "longest_repeat": max(repeats, default=0),
        "base_failed": failed, "kept": not failed and len(covered) <= 0.6 * len(words) and max(repeats, default=0) <= 100,
    }


def test_rules_against_plain_counting(spark):
    rng = random.Random(4)
    texts = [None, "", "\n\n", "# $%\x0b<b>\x0c é漢 x", "a b c\na b c\n  \nq"]
    texts += ["".join(rng.choice(["one ", "two ", "three ", "#", "\n", "four five six seven eight "]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[3], 0), (3, texts[3], 0)]
    got = quality_rules.rules(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append({k: v for k, v in r.asDict().items() if k != "doc_id"})
    for i, t, _ in rows:
        assert plain(t) in by[i]
    assert len(by[3]) == 2
    assert quality_rules.rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
