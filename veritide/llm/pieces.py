"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of such a model has white space after another character, so merges
never cross from one word (its leading spaces included) to the next and each
distinct word is encoded once.  All new words of a slice lie end to end in one
flat array of symbols.  A round looks up the rank of every adjacent pair, takes
the smallest rank in each word, merges its occurrences from the left at once,
and compacts the array; words without a pair leave it.  Where a merged piece
opens a pair of no larger rank than its own with a neighbour, its word merges up
to that occurrence in a round, so that the order is always that of the library.
Long words are first cut where no piece spans: no merge can cross such a place.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, table, tokenizer_file

_MARK = "▁"
_NONE = np.iinfo(np.int64).max
_CACHED_WORD, _CACHE_SIZE = 48, 200_000
#: What shows whether a model normalises texts in another way than this module takes for granted.
_PROBES = ("a b", " a", "  a  b ", "\u3000x\ta\nb\r", "ﬁ Å e\u0301 ½", "\u200b\ufeffa", "A\x00b", "▁a▁▁b", "1234", "漢字🙂")


class PieceCodec:
    """Tables of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(_MARK in p.lstrip(_MARK) for p in self.ids):
            raise ValueError("this model has pieces with white space inside a word")
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.shown = [p.replace(_MARK, " ") for p in self.pieces]
        self.number = [str(i) for i in range(n)]
        #: Code points without a piece of their own have -1 - code point.
        self.first = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.byte_id = [0] * 256
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        keys, values = [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    values.append(i)
        order = np.argsort(keys)
        self.n = n
        self.keys = np.asarray(keys, np.int64)[order]
        self.values = np.asarray(values, np.int64)[order]
        self.rank = rank.astype(np.int64)
        first_after = np.full(n, _NONE)
        for side in (self.keys // n, self.keys % n):
            np.minimum.at(first_after, side, self.rank[self.values])
        self.safe = first_after > self.rank
        self.known: dict[str, tuple[str, str]] = {}
        self.finder = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.finder.add_word(p, len(p))
        self.finder.make_automaton()
        if any(self.encode(t) != sp.encode(t) for t in _PROBES):
            raise ValueError(f"{path}: the model normalises texts, cuts words or falls back otherwise than this encoder")

    def words(self, text: str) -> list[str]:
        """Words of a text, each with the marks before it; a text that isn't empty gets one mark more in front."""
        if not text:
            return []
        head, *rest = (" " + text.replace(_MARK, " ")).split(" ")
        out, marks = [], _MARK
        for w in rest:
            if w:
                out.append(marks + w)
                marks = _MARK
            else:
                marks += _MARK
        if len(marks) > 1:
            out.append(marks[:-1])
        return out

    def cuts(self, word: str) -> np.ndarray:
        """Marks the characters before which no piece that occurs in the word reaches across."""
        edge = np.zeros(len(word) + 1, np.int64)
        found = np.array([(end, n) for end, n in self.finder.iter(word)], np.int64).reshape(-1, 2)
        np.add.at(edge, found[:, 0] - found[:, 1] + 2, 1)
        np.add.at(edge, found[:, 0] + 1, -1)
        return np.cumsum(edge[:-1]) == 0

    def pairs(self, a: np.ndarray, b: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair that is ``joined``; rank _NONE where there is no such piece."""
        key = np.where(joined & (a >= 0) & (b >= 0), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.values[at]
        found = self.keys[at] == key
        return np.where(found, piece, 0), np.where(found, self.rank[piece], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, with -1 - code point for characters that have no piece, and where each word ends."""
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        symbol = self.first[points].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        begin = np.ones(len(owner), bool)
        begin[1:] = owner[1:] != owner[:-1]
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(lengths > _CACHED_WORD).tolist():
            begin[ends[i] - lengths[i] : ends[i]] |= self.cuts(words[i])
        word = np.cumsum(begin) - 1
        owner = owner[begin]
        done_symbol, done_word = [], []
        while len(symbol):
            piece, rank = self.pairs(symbol[:-1], symbol[1:], word[:-1] == word[1:])
            piece, rank = np.append(piece, 0), np.append(rank, _NONE)
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            starts = np.flatnonzero(new)
            segment = np.cumsum(new) - 1
            least = np.minimum.reduceat(rank, starts)[segment]
            over = least == _NONE
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
            hit = (rank == least) & ~over
            where = np.flatnonzero(hit)
            if not len(where):
                break
            head = np.ones(len(where), bool)
            head[1:] = where[1:] != where[:-1] + 1
            run = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            if not self.safe[piece[where]].all():
                where = where[self.in_order(where, symbol, word, piece, least, segment)]
            symbol[where] = piece[where]
            keep = ~over
            keep[where + 1] = False
            symbol, word = symbol[keep], word[keep]
        flat = np.concatenate(done_symbol) if done_symbol else np.zeros(0, np.int64)
        place = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(place, kind="stable")
        counts = np.bincount(owner[place], minlength=len(words))
        return flat[order], np.cumsum(counts)

    def in_order(self, where: np.ndarray, symbol: np.ndarray, word: np.ndarray, piece: np.ndarray, least: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Marks the merges that come before any merge that this round opens: up to the first in each word that opens one.

        When a merge is made, those to its left are made and those to its right are not.
        """
        made, own = piece[where], word[where]
        before, after = np.maximum(where - 1, 0), np.minimum(where + 2, len(symbol) - 1)
        left = symbol[before]
        follows = np.zeros(len(where), bool)
        follows[1:] = where[1:] == where[:-1] + 2
        left[1:] = np.where(follows[1:], made[:-1], left[1:])
        opened = np.minimum(
            self.pairs(left, made, (where > 0) & (word[before] == own))[1],
            self.pairs(made, symbol[after], (where + 2 < len(symbol)) & (word[after] == own))[1],
        )
        opens = opened <= least[where]
        seg = segment[where]
        first = np.full(int(seg.max()) + 1, len(where))
        np.minimum.at(first, seg[opens], np.flatnonzero(opens))
        return np.arange(len(where)) <= first[seg]

    def finish(self, symbols: list[int]) -> list[int]:
        """Ids, with characters that have no piece as their bytes."""
        if min(symbols) >= 0:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out.extend(self.byte_id[b] for b in chr(-1 - s).encode("utf-8", "replace"))
        return out

    def surface(self, ids: list[int]) -> str:
        """What the ids of whole words stand for, marks as spaces."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.shown[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def encode_words(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """For each text, its words as (ids joined by commas, decoded surface)."""
        split = [self.words(t) for t in texts]
        if len(self.known) > _CACHE_SIZE:
            self.known.clear()
        known, long = self.known, {}
        new = list({w for s in split for w in s}.difference(known))
        if new:
            flat, ends = self.merge(new)
            symbols, at, number = flat.tolist(), 0, self.number
            for w, end in zip(new, ends.tolist(), strict=True):
                ids = self.finish(symbols[at:end])
                at = end
                (known if len(w) <= _CACHED_WORD else long)[w] = (",".join([number[i] for i in ids]), self.surface(ids))
        if long:
            return [[known[w] if w in known else long[w] for w in s] for s in split]
        return [[known[w] for w in s] for s in split]

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        return [int(i) for ids, _ in self.encode_words([text])[0] for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    model_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256[, ids, decoded].

    Null texts count as empty: no ids, an empty decoded text.  Whole texts are
    encoded; repeated rows give repeated results, an empty table an empty one.
    """
    path = tokenizer_file("piece_bpe_32k.model", model_path)

    def make():
        c = codec(path)

        def run(texts: list[str]) -> dict[str, list]:
            n, ids_sha, decoded_sha, all_ids, all_text = [], [], [], [], []
            for words in c.encode_words(texts):
                joined = ",".join([w[0] for w in words])
                decoded = "".join([w[1] for w in words])
                decoded = decoded[1:] if decoded.startswith(" ") else decoded
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                if with_ids:
                    all_ids.append([int(x) for x in joined.split(",")] if joined else [])
                    all_text.append(decoded)
            out = {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}
            if with_ids:
                import pyarrow as pa

                out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_text, pa.string())}
            return out

        return run

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, [doc_id], text, make, schema + (", ids array<int>, decoded string" if with_ids else ""))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; see encode() for nulls, empty texts and repeats."""
    return encode(table(spark, sf_dir, "documents"))
