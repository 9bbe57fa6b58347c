"""Line dedup: drop lines that many documents share. Built-in functions only.

Lines are exploded, normalised and hashed; distinct documents are counted per
hash; every line whose key reaches the threshold goes, except in the document
with the largest id; what stays is joined again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Blanks [\\x20\\x09-\\x0D] stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, drop_at): per document the positions of the lines to drop.

    Keys are told apart by two chained 64-bit hashes; they are taken once and
    written to the shared folder, as both the count and the join need them. The count runs in two
    steps, by key and document and then by key, both combined before their
    shuffle, so a line that a third of all rows hold is no hot task; the join
    back to the lines is a sort-merge join whose hot partitions Spark splits.
    """
    line = F.col("line")
    # the blanks count towards a raw line's length, so shorter ones can't have a long key
    long_lines = materialize(
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .where(F.char_length(line) >= min_chars)
        .select("doc_id", "pos", line_key(line).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key", F.lit(1)).alias("h2")),
        "lines",
    )
    common = (
        long_lines.groupBy("h1", "h2")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # one more join key makes both sides exchange anew, so Spark may split a hot partition
    again = F.pmod("h1", F.lit(1024)).alias("h3")
    return (
        long_lines.select("*", again)
        .join(common.select("*", again), ["h1", "h2", "h3"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id")
        .agg(F.collect_set("pos").alias("drop_at"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines except those in the largest doc_id.

    Null or empty text: one empty line, the result is empty text. Null doc_id:
    takes no part, keeps all lines. Rows that repeat a doc_id count as one
    document and lose the same positions, those of all such rows together.
    Empty table: empty result. Other columns pass through; columns named
    n_lines or n_dropped are replaced.
    """
    drops = repeated_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("__doc"), F.col("drop_at").alias("__at"))
    passed = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    # lines is used twice, so Spark keeps it as a column and splits a text once
    joined = docs.join(drops, docs["doc_id"] == drops["__doc"], "left").select(
        *[docs[c] for c in passed], docs["text"], "__at", _lines(docs["text"]).alias("__lines")
    )
    lines, at = F.col("__lines"), F.col("__at")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at)
    return joined.select(
        *[F.col(f"`{c}`") for c in passed],
        F.when(at.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
    )
