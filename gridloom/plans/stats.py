"""Timed runs in the usual units: edges, operations and bytes per second."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

#: Bytes of a value and of an index, as the usual bandwidth formula counts them.
VALUE_BYTES, INDEX_BYTES = 8, 8


@dataclass(frozen=True)
class Timing:
    name: str
    seconds: float
    nnz: int
    iterations: int = 1

    @property
    def mteps(self) -> float:
        """Millions of edges traversed per second."""
        return self.iterations * self.nnz / self.seconds / 1e6

    @property
    def gflops(self) -> float:
        """A multiplication and an addition for each entry."""
        return 2 * self.iterations * self.nnz / self.seconds / 1e9

    @property
    def gbytes(self) -> float:
        """A matrix value, a vector value and an index for each entry."""
        return self.iterations * self.nnz * (2 * VALUE_BYTES + INDEX_BYTES) / self.seconds / 1e9

    def row(self) -> dict:
        return asdict(self) | {"mteps": self.mteps, "gflops": self.gflops, "gbytes": self.gbytes}


def timed(name: str, df: DataFrame, nnz: int, iterations: int = 1) -> Timing:
    """Run a plan to its end without keeping the rows."""
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return Timing(name, time.perf_counter() - start, nnz, iterations)
