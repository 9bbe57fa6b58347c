"""Vectors: a table of (idx, val) and a size. Immutable; every change is a new vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import DimensionMismatch, IndexOutOfBounds, NoValue, NullPointer

#: Share of stored values up to which a vector counts as sparse.
SPARSE_SHARE = 0.3
#: How far two equal values may lie apart.
TOLERANCE = 1e-3


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    size: int

    @staticmethod
    def from_table(df: DataFrame, idx: str, val, size: int) -> Vector:
        value = F.col(val) if isinstance(val, str) else val
        return Vector(df.select(F.col(idx).cast("long").alias("idx"), value.alias("val")), size)

    @staticmethod
    def from_pairs(spark: SparkSession, indices: Sequence[int] | None, values: Sequence | None, size: int, kind: str = "double") -> Vector:
        """A sparse vector of the given positions."""
        if indices is None or values is None:
            raise NullPointer("indices and values must be given")
        if len(indices) != len(values):
            raise DimensionMismatch(f"{len(indices)} indices and {len(values)} values")
        if any(not 0 <= i < size for i in indices):
            raise IndexOutOfBounds(f"an index is outside 0 to {size - 1}")
        return Vector(spark.createDataFrame(list(zip(map(int, indices), values, strict=True)), f"idx long, val {kind}"), size)

    @staticmethod
    def from_dense(spark: SparkSession, values: Sequence | None, size: int | None = None, kind: str = "double") -> Vector:
        """A vector of the first ``size`` values."""
        if values is None:
            raise NullPointer("values must be given")
        size = len(values) if size is None else size
        if size > len(values):
            raise IndexOutOfBounds(f"{len(values)} values for size {size}")
        return Vector.from_pairs(spark, range(size), values[:size], size, kind)

    @staticmethod
    def filled(spark: SparkSession, size: int, value) -> Vector:
        """``value`` everywhere; absent everywhere if it is 0."""
        df = spark.range(size).select(F.col("id").alias("idx"), F.lit(value).alias("val"))
        return Vector(df.where(F.lit(value != 0)), size)

    @staticmethod
    def ascending(spark: SparkSession, size: int) -> Vector:
        """Each position holds itself."""
        return Vector(spark.range(size).select(F.col("id").alias("idx"), F.col("id").alias("val")), size)

    @staticmethod
    def random(spark: SparkSession, size: int, seed: int, low: float = 0.0, high: float = 1.0) -> Vector:
        return Vector(spark.range(size).select(F.col("id").alias("idx"), (F.lit(low) + F.rand(seed) * (high - low)).alias("val")), size)

    def with_df(self, df: DataFrame) -> Vector:
        return Vector(df.select("idx", "val"), self.size)

    def dense(self, fill=0) -> Vector:
        """Every position stored; ``fill`` where none was."""
        every = self.df.sparkSession.range(self.size).select(F.col("id").alias("idx"))
        kind = self.df.schema["val"].dataType
        return Vector(every.join(self.df, "idx", "left").select("idx", F.coalesce("val", F.lit(fill).cast(kind)).alias("val")), self.size)

    def sparse(self) -> Vector:
        """Stored zeros dropped."""
        return self.with_df(self.df.where(F.col("val") != 0))

    def set_element(self, value, idx: int) -> Vector:
        if not 0 <= idx < self.size:
            raise IndexOutOfBounds(f"{idx} is outside 0 to {self.size - 1}")
        kind = self.df.schema["val"].dataType
        one = self.df.sparkSession.range(1).select(F.lit(idx).cast("long").alias("idx"), F.lit(value).cast(kind).alias("val"))
        return self.with_df(self.df.where(F.col("idx") != idx).union(one))

    def fill(self, value) -> Vector:
        return Vector.filled(self.df.sparkSession, self.size, value)

    def clear(self) -> Vector:
        return self.with_df(self.df.limit(0))

    def dup(self) -> Vector:
        return self

    def get(self, idx: int):
        """The value at a position."""
        if not 0 <= idx < self.size:
            raise IndexOutOfBounds(f"{idx} is outside 0 to {self.size - 1}")
        row = self.df.where(F.col("idx") == idx).head()
        if row is None:
            raise NoValue(f"nothing is stored at {idx}")
        return row["val"]

    def __iter__(self) -> Iterator:
        """Stored values by position, a partition at a time."""
        return (row["val"] for row in self.df.orderBy("idx").toLocalIterator())

    def nvals(self) -> int:
        """Values that are not zero."""
        return self.df.where(F.col("val") != 0).count()

    def is_sparse(self) -> bool:
        """Whether so few values are stored that it is worth going from them."""
        return self.nvals() <= SPARSE_SHARE * self.size

    def diff(self, other: Vector, tolerance: float = TOLERANCE) -> DataFrame:
        """(idx, left, right) where two vectors differ; absent counts as 0."""
        both = self.df.withColumnRenamed("val", "left").join(other.df.withColumnRenamed("val", "right"), "idx", "full_outer").na.fill(0, ["left", "right"])
        return both.where(F.abs(F.col("left") - F.col("right")) > tolerance).select("idx", "left", "right")

    def equals(self, other: Vector, tolerance: float = TOLERANCE) -> bool:
        return self.size == other.size and self.diff(other, tolerance).isEmpty()

    def show_diff(self, other: Vector, most: int = 10) -> str:
        """The first differences, as text that ends in their number."""
        rows = self.diff(other)
        shown = [f"{r['idx']}: {r['left']} != {r['right']}" for r in rows.orderBy("idx").limit(most).collect()]
        return "\n".join([*shown, f"error_count: {rows.count()}/{self.size}"])

    def show(self, most: int = 100) -> str:
        """The first values as text."""
        return " ".join(str(r["val"]) for r in self.dense().df.orderBy("idx").limit(most).collect())

    def storage(self) -> str:
        return "sparse" if self.is_sparse() else "dense"
