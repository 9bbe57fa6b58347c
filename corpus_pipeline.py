"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; the next stage
reads what the one before kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, prepare, release, table
from gridloom.llm.language import identify
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.packing import pack
from gridloom.llm.substring import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted again."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that fit no language model go."""
    prepare(spark)
    return identify(docs.select(*COLUMNS)).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents share stay in one of them."""
    return _documents(dedup_lines(docs, min_chars=40, min_docs=5))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    prepare(spark)
    copies = near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of thirteen words or more stay in the first document that holds them."""
    prepare(spark)
    return _documents(dedup_substrings(docs, window=13))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths up to 2048 tokens."""
    prepare(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, max_tokens=2048)


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Trained models, similarity components and tokenizers are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages lies in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
