"""Packing by power-of-two decomposition.

Every document's ids are cut into pieces whose lengths are powers of two:
as many of the full sequence length as fit, then one for each set bit of the
rest. Pieces of equal length form a bucket; a sequence is one piece, so no
sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import BYTE_LEVEL_PATTERN, unstable_chars

#: Pieces that go into one Arrow batch.
BATCH_PIECES = 4096


class ByteBpe:
    """Ids of a byte-level BPE file in the tokenizers JSON format.

    Ordinary text goes through tiktoken with the same ranks; text that holds a
    special token, or characters that Unicode versions class differently, goes
    through the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        from gridloom.llm.bpe import byte_symbols

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self._library.get_vocab(with_added_tokens=False).items()}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self._special) or (not text.isascii() and unstable_chars().search(text)) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def _byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def piece_lengths(n: int, largest: int) -> list[int]:
    """Powers of two that sum to n: ``largest`` as often as it fits, then the bits of the rest."""
    rest = n % largest
    return [largest] * (n // largest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids binary, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers; ``length`` is also the
    bucket. ``sequence_id`` is unique, not dense: the position of the piece in
    its input partition, below the partition's number; nothing is shuffled.

    Null or empty text: one piece that holds ``end_id`` alone. Null doc_id and
    repeated rows are packed like any other. Empty table: empty result. Other
    columns are not read.
    """
    largest = 1 << (max_tokens.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _byte_bpe(tokenizer_path)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "offset"]
        for batch in batches:
            cols = [[], [], [], [], [], []]

            def flush(cols=cols, kind=batch.schema.field(0).type):
                types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*bpe.ids(text.as_py() or ""), end_id], "<u4")
                lengths = piece_lengths(len(ids), largest)
                start = 0
                for n in lengths:
                    for c, v in zip(cols, (doc.as_py(), start, n, ids[start : start + n].tobytes(), len(ids), 0), strict=True):
                        c.append(v)
                    start += n
                    if len(cols[0]) >= BATCH_PIECES:
                        yield flush()
                        for c in cols:
                            c.clear()
            if cols[0]:
                yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, offset long")
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), "offset")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences with one folder for each length, as training reads them."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
