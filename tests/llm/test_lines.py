import random

import pytest

from veritide.llm import lines


def one_edit(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows, near, chars_per_edit=20):
    import xxhash

    mark = lambda t: (xxhash.xxh64_intdigest(t, 42) ^ 1 << 63) - (1 << 63)
    flat = sorted(
        {((d is None, d or 0, mark(t), i), line) for d, t in rows if t is not None for i, line in enumerate(t.split("\n")) if line.strip(" \t\v\f\r")}
    )
    gone = set()
    for j, (p, line) in enumerate(flat):
        for _, other in flat[:j]:
            if other == line or (near and min(len(other), len(line)) >= chars_per_edit and one_edit(other, line)):
                gone.add(p)
                break
    out = []
    for d, t in rows:
        if t is None:
            out.append((str(d), None, 0))
            continue
        parts = t.split("\n")
        kept = [x for i, x in enumerate(parts) if (d is None, d or 0, mark(t), i) not in gone]
        out.append((str(d), "\n".join(kept), len(parts) - len(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    base = ["".join(rng.choice("ab é漢") for _ in range(rng.randrange(15, 40))) for _ in range(12)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(s))
                s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abq") + s[i:], s[:i] + rng.choice("abq") + s[i + 1 :]])
            parts.append(s)
            parts += rng.choice([[], ["Read more"], ["1.", "2."], [" ", "\t"], [""]])
        rows.append((d, "\n".join(parts)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, base[-1]), (None, base[-1] + "\n" + base[0]), (3, rows[3][1]), (7, base[1])]


def test_segments_of_long_lines_meet_within_one_edit():
    rng = random.Random(5)
    for n in (2047, 2048, 2049, 2500, 5001):
        line = "".join(rng.choice("abc") for _ in range(n))
        for other in (line[:700] + line[701:], line[:1999] + "z" + line[2000:], line[:3] + "z" + line[3:], line + "z"):
            shared = {k for k, _, _ in lines.segments(line)} & {k for k, _, _ in lines.segments(other)}
            assert shared
        assert not {k for k, _, _ in lines.segments(line)} & {k for k, _, _ in lines.segments("q" + line[1:-1] + "q")}


@pytest.mark.parametrize("edits", [0, 1])
def test_against_all_pairs(spark, edits):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c", d) for d, t in rows], "doc_id long, text string, line string, first long")
    got = lines.dedup(df, keep=["line", "first"], max_edits=edits).collect()
    assert sorted([(str(r.doc_id), r.text, r.n_removed) for r in got], key=str) == plain(rows, edits)
    assert all(r.line == "c" and r.first == r.doc_id for r in got)


def test_with_a_bitmap_that_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(lines, "MOST_BUCKETS", 1)
    monkeypatch.setattr(lines, "BITS", 10**6)
    rows = corpus()[:30]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(str(r.doc_id), r.text, r.n_removed) for r in got], key=str) == plain(rows, 1)


def test_bits_of_halves(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 32768, 99]
    bits = lines._bitmap(spark.createDataFrame([(k,) for k in keys], "piece long"))
    low = 8 * len(bits) - 1
    on = {k & low for k in keys}
    assert {i for i in range(8 * len(bits)) if bits[i >> 3] >> (i & 7) & 1} == on


def test_very_long_text_and_line(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    at = 1_234_567
    near = [long[:-1] + "y", long[:at] + long[at + 1 :], long[:at] + "qq" + long[at:]]
    rows = [(1, long), *[(5 + i, t) for i, t in enumerate(near)], (2, "x" * 300_000), (8, "x" * 300_001), (3, "\n".join(f"line {i % 5000} of a long text" for i in range(20_000))), (4, "\n" * 5000)]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 5, 6, 7, 8)] == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 0), (1, 1)]
    assert got[4] == (5001, 0) and got[3][0] == 20_000 and got[3][1] >= 15_000


def test_bound_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup(empty).count() == 0
    with pytest.raises(ValueError):
        lines.dedup(empty, max_edits=2)
