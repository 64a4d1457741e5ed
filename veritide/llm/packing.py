"""Packing of token sequences by power-of-two decomposition.

A document of n tokens is cut into whole pieces of ``max_len`` tokens and, for
the rest, into one piece for each one-bit of its length.  Every piece is a
sequence of its own: no sequence crosses documents and, as all lengths are
powers of two, none is padded.  Pieces of equal length form a bucket, from
which batches of one shape are drawn; the plan needs no shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import slices, tokenizer_file

# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of white space from this length on go to the tokenizers library, as the faster one's stack is too small for very long ones.
LONG_RUN = 20_000
_LONG = re.compile(r"\s{%d}" % LONG_RUN)


class ByteEncoder:
    """Encodes with the vocabulary of a tokenizers file of the byte-level BPE kind, as that library does by default.

    The merges of such a file make its ids in order, which is checked, so the ids
    serve as ranks for the faster of the two libraries.  The file's added tokens
    have their own ids wherever they stand in a text.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", ())
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in or need what stands around them are not supported")
        marked = {t["content"]: t["id"] for t in added}
        special = set(marked.values())
        vocabulary = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: its merges do not make its ids in order, so ids can't serve as ranks")
        # Printable bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())}
        ranks = {bytes(map(byte_of.__getitem__, p)): i for p, i in vocabulary.items() if i not in special}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marked)
        self.quick = partial(encoding.encode, allowed_special="all")
        self.library = Tokenizer.from_file(path)

    def ids(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and _LONG.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.quick(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        return [np.array(self.ids(t), "<u4").tobytes() for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def piece_lengths(n: int, max_len: int = 2048) -> list[int]:
    """Lengths of the pieces of n tokens: powers of two up to max_len, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    max_len: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids].

    ``max_len`` must be a power of two.  Strings of the tokenizer file's added
    tokens have those tokens' ids wherever they stand in a text.  Each document's ids are followed by
    ``end_id``; a null or empty text has that id alone, so every row yields at
    least one piece.  Rows with equal or null doc_id are packed each by itself.
    sequence_id is unique (a sequence holds one piece, offset is 0); bucket is
    the piece's length.  An empty table gives an empty result.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer_file("byte_bpe_50k.json", tokenizer_path)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [
        source.schema["doc_id"],
        *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")],
        *([StructField("ids", ArrayType(IntegerType()))] if with_ids else []),
    ]
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, _, texts in slices(batch, "text"):
                row: list[int] = []
                start: list[int] = []
                length: list[int] = []
                crc: list[int] = []
                total: list[int] = []
                ids: list[np.ndarray] = []
                for i, body in enumerate(enc.encode(texts), a):
                    body += end
                    view, n, at = memoryview(body), len(body) // 4, 0
                    for k in piece_lengths(n, max_len):
                        piece = view[4 * at : 4 * (at + k)]
                        row.append(i)
                        start.append(at)
                        length.append(k)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                        at += k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                        *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                    ],
                    names=[f.name for f in fields],
                )

    return source.mapInArrow(run, StructType(fields)).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
        *(["ids"] if with_ids else []),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write one folder for each sequence length; a trainer draws batches of one shape from each."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def op7_pack(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens; see pack() for nulls, empty texts and repeats."""
    from .common import table

    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"
    )
