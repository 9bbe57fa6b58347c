"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.shared import importable, materialize, new_path, release, shuffles_removed

__all__ = ["SPACES", "materialize", "new_path", "prepare", "release", "shuffles_removed", "table", "whole_groups"]

#: Bytes that separate words; the class [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch; what a task holds off-heap and in Python grows with it.
ARROW_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Let Python workers find the package, and keep Arrow batches small."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], gather: int, most_bytes: int = 1 << 62) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' bounds, of about ``gather`` rows or ``most_bytes`` bytes, whatever is less.

    The rows of ``batches`` must stand sorted by the integer columns ``keys``.
    """

    def changes(rows: pa.Table) -> np.ndarray:
        key = np.stack([rows[c].to_numpy() for c in keys])
        return np.flatnonzero((np.diff(key) != 0).any(0)) + 1

    held: pa.Table | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, gather):
            part = pa.Table.from_batches([batch.slice(start, gather)])
            held = part if held is None else pa.concat_tables([held, part])
            if (held.num_rows >= gather or held.nbytes >= most_bytes) and len(cuts := changes(held)):
                yield held.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
                held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield held, np.concatenate([[0], changes(held), [held.num_rows]])
