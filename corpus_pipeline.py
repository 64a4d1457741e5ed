"""Corpus pipeline: quality, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage reads no other columns, so extra
ones of any name do no harm; an empty table gives an empty result; rows that
repeat others are treated each like its equals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm import lines, packing, pii, quality_model, simhash
from veritide.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it learns outside the held-out fold.

    Only the text counts: a null one is kept or dropped as an empty one is, and
    lang, source and ids may be null.  Without labels of both classes all stay.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated and nearly repeated lines out of the texts; every document stays.

    A null text stays null; rows that repeat both doc_id and text get the same
    result, of other repeats of a text the one with the smallest doc_id keeps it.
    """
    return _with_length(lines.dedup(docs, keep=["lang", "source"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates.

    Texts without a word, null ones included, are one group.  Rows that repeat a
    doc_id stay or go together, and so do those without one.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays, and a null text stays null."""
    redacted = pii.redact(docs, ["doc_id", "lang", "source"])
    return _with_length(redacted.withColumnRenamed("redacted", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left; a null or empty text is one sequence of the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer decide what the rows hold, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    What no later stage reads is removed; the input of the last stage stays, as
    its result is read from there.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
