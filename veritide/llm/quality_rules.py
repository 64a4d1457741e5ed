"""Quality rules: counts over words and lines, and repetition found with suffix arrays.

The words of a slice of documents are ranked together: prefix doubling sorts
the suffixes of every document (a suffix never reads past its own document),
each doubling touching only the suffixes that still tie.  The ranks kept of all
doublings give the longest common prefix of neighbours in the suffix array.
The larger of a suffix's two prefixes is the longest substring that starts
there and occurs again, so the union of those spans is the union of all
maximal repeated substrings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, table

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def longest_repeats(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word of documents laid end to end, the length of the longest run from it that its document has again."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    key = doc * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = _regroup(key[order], order, np.zeros(n, np.int64))
    levels, k = [rank], 1
    position = np.arange(n)
    while True:
        tied = np.flatnonzero(_tied(rank[order]))
        if not len(tied):
            break
        at = order[tied]
        after = at + k
        second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[at]
        sort = np.lexsort((second, first))
        at, first, second = at[sort], first[sort], second[sort]
        order[tied] = at
        rank = rank.copy()
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = tied[np.maximum.accumulate(np.where(new, position[: len(at)], 0))]
        k *= 2
        levels.append(rank)
    common = np.zeros(n + 1, np.int64)
    left = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    i, j = order[left], order[left + 1]
    shared = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + shared, j + shared
        same = (a < end[i]) & (b < end[j])
        same[same] = levels[level][a[same]] == levels[level][b[same]]
        shared += np.where(same, 1 << level, 0)
    # Ranks of a level may tie only where that many words remain, so shared never passes an end.
    common[left + 1] = shared
    out = np.empty(n, np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


def _tied(sorted_rank: np.ndarray) -> np.ndarray:
    same = np.zeros(len(sorted_rank) + 1, bool)
    same[1:-1] = sorted_rank[1:] == sorted_rank[:-1]
    return same[1:] | same[:-1]


def _regroup(sorted_key: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def _covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Marks the words in spans of repeats of ``least`` words or more."""
    n = len(repeat)
    at = np.flatnonzero(repeat >= least)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + repeat[at], -1)
    return np.cumsum(edges[:-1]) > 0


def rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 5,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_repeat: int = 3,
    max_covered: float = 0.6,
    max_longest: int = 100,
) -> DataFrame:
    """One row per document: counts, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` per cent of them in ``window``-word runs found twice
    or more.  kept is false if base_failed, if repeated substrings of
    ``min_repeat`` words or more cover over ``max_covered`` of the words, or if
    one is longer than ``max_longest`` words.  A null text counts as empty: all
    counts 0, base_failed.  Equal rows give equal rows; an empty table gives an
    empty result.
    """

    def make():
        def count(texts: list[str]) -> dict[str, list]:
            ids: dict[bytes, int] = {}
            flat: list[int] = []
            lengths, chars, symbols, dup = [], [], [], []
            for t in texts:
                raw = t.encode("utf-8", "surrogatepass")
                words = raw.split()
                lengths.append(len(words))
                flat.extend([ids.setdefault(w, len(ids)) for w in words])
                chars.append(len(t) - (len(raw) - len(raw.translate(None, _SPACE))))
                symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
                lines = [x for x in raw.split(b"\n") if x.strip()]
                dup.append(len(lines) - len(set(lines)))
            lens = np.asarray(lengths, np.int64)
            repeat = longest_repeats(np.asarray(flat, np.int64), lens)
            ends = np.cumsum(lens)

            def per_doc(mark: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0], np.cumsum(mark)))
                return sums[ends] - sums[ends - lens]

            doc = np.repeat(np.arange(len(lens)), lens)
            longest = np.zeros(len(lens), np.int64)
            np.maximum.at(longest, doc, repeat)
            repeated = per_doc(_covered(repeat, window))
            covered = per_doc(_covered(repeat, min_repeat))
            failed = (lens < min_words) | (100 * repeated > max_repeat_percent * lens)
            kept = ~failed & (covered <= max_covered * lens) & (longest <= max_longest)
            return {
                "n_words": lens,
                "word_chars": chars,
                "n_symbols": symbols,
                "n_dup_lines": dup,
                "n_repeat_words": repeated,
                "covered_words": covered,
                "longest_repeat": longest,
                "base_failed": failed,
                "kept": kept,
            }

        return count

    return map_texts(docs, [doc_id], text, make, _SCHEMA)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality rules over every document."""
    return rules(table(spark, sf_dir, "documents"))
