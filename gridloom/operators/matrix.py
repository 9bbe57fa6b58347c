"""Matrices: a table of (row, col, val) and two sizes. Immutable.

The table is one logical format. What native engines store as row, column,
blocked or degree-ordered formats is a choice of partitioning here, see
``partitioned`` and ``degree_order``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.errors import DimensionMismatch, IndexOutOfBounds, NullPointer
from gridloom.operators.scan import ranked
from gridloom.operators.vector import Vector

#: Positions of a row-compressed matrix that are put together at once, as a power of two.
CHUNK_BITS = 16


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    nrows: int
    ncols: int
    name: str = "matrix"

    @staticmethod
    def from_table(df: DataFrame, row: str, col: str, val: str | Column, nrows: int, ncols: int, dup: Column | None = None) -> Matrix:
        """Entries from columns of a table; ``dup`` aggregates ``val`` over repeated positions, else they all stay."""
        value = F.col(val) if isinstance(val, str) else val
        entries = df.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), value.alias("val"))
        if dup is not None:
            entries = entries.groupBy("row", "col").agg(dup.alias("val"))
        return Matrix(entries, nrows, ncols)

    @staticmethod
    def build(spark: SparkSession, rows: Sequence[int] | None, cols: Sequence[int] | None, vals: Sequence | None, kind: str = "double", dup: Column | None = None) -> Matrix:
        """A square matrix just large enough for its largest index."""
        if rows is None or cols is None or vals is None:
            raise NullPointer("rows, cols and vals must be given")
        if not len(rows) == len(cols) == len(vals):
            raise DimensionMismatch("rows, cols and vals differ in length")
        if any(i < 0 for i in (*rows, *cols)):
            raise IndexOutOfBounds("an index is negative")
        n = max((*rows, *cols), default=-1) + 1
        df = spark.createDataFrame([(int(r), int(c), v) for r, c, v in zip(rows, cols, vals, strict=True)], f"row long, col long, val {kind}")
        return Matrix.from_table(df, "row", "col", "val", n, n, dup)

    @staticmethod
    def from_csr(row_ptr: DataFrame, entries: DataFrame, nrows: int, ncols: int) -> Matrix:
        """From (row, ptr) with nrows + 1 rows and entries (pos, col, val): row r holds positions ptr[r] to ptr[r + 1] - 1."""
        # rows and entries meet by chunks of positions, where each entry takes the row that began last
        start, end = row_ptr.select("row", F.col("ptr").alias("start")), row_ptr.select((F.col("row") - 1).alias("row"), F.col("ptr").alias("end"))
        spans = start.join(end, "row").where(F.col("end") > F.col("start"))
        chunks = spans.withColumn("chunk", F.explode(F.sequence(F.shiftright("start", CHUNK_BITS), F.shiftright(F.col("end") - 1, CHUNK_BITS))))
        kind = entries.schema["col"].dataType, entries.schema["val"].dataType
        begins = chunks.select("chunk", F.greatest("start", F.shiftleft("chunk", CHUNK_BITS)).alias("pos"), "row", F.lit(None).cast(kind[0]).alias("col"), F.lit(None).cast(kind[1]).alias("val"), F.lit(0).alias("kind"))
        held = entries.select(F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", F.lit(None).cast("long").alias("row"), "col", "val", F.lit(1).alias("kind"))
        so_far = Window.partitionBy("chunk").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
        placed = begins.union(held).withColumn("row", F.last("row", ignorenulls=True).over(so_far)).where("kind = 1")
        return Matrix(placed.select("row", "col", "val"), nrows, ncols)

    @staticmethod
    def from_lists(spark: SparkSession, lists: Sequence[Sequence[tuple[int, object]]], kind: str = "double") -> Matrix:
        """From the (col, val) pairs of each row."""
        triples = [(r, c, v) for r, row in enumerate(lists) for c, v in row]
        rows, cols, vals = ([t[i] for t in triples] for i in range(3))
        a = Matrix.build(spark, rows, cols, vals, kind)
        n = max(len(lists), a.nrows)
        return Matrix(a.df, n, n)

    def lists(self) -> DataFrame:
        """(row, entries): the (col, val) pairs of each row that has any, by col."""
        return self.df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("entries"))

    @property
    def T(self) -> Matrix:
        """The transpose: columns renamed, nothing moved."""
        return Matrix(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.ncols, self.nrows, self.name)

    def with_df(self, df: DataFrame) -> Matrix:
        return Matrix(df.select("row", "col", "val"), self.nrows, self.ncols, self.name)

    def named(self, name: str) -> Matrix:
        return Matrix(self.df, self.nrows, self.ncols, name)

    def nnz(self) -> int:
        return self.df.count()

    def nvals(self) -> int:
        return self.df.where(F.col("val") != 0).count()

    def get(self, row: int, col: int):
        """The stored value, 0 where there is none."""
        found = self.df.where((F.col("row") == row) & (F.col("col") == col)).head()
        return 0 if found is None else found["val"]

    def is_non_zero(self, row: int, col: int) -> bool:
        return self.get(row, col) != 0

    def degrees(self, axis: str = "row") -> Vector:
        """Stored entries of each row (or col), 0 where there are none."""
        n = self.nrows if axis == "row" else self.ncols
        counted = self.df.groupBy(F.col(axis).alias("idx")).agg(F.count(F.lit(1)).alias("val"))
        return Vector(counted, n).dense()

    def self_loops(self) -> Vector:
        """How many entries of each row are on the diagonal; rows without are absent."""
        loops = self.df.where(F.col("row") == F.col("col")).groupBy(F.col("row").alias("idx")).agg(F.count(F.lit(1)).alias("val"))
        return Vector(loops, self.nrows)

    def tril(self, k: int = -1) -> Matrix:
        """Entries on and below the k-th diagonal."""
        return self.with_df(self.df.where(F.col("col") - F.col("row") <= k))

    def triu(self, k: int = 1) -> Matrix:
        """Entries on and above the k-th diagonal."""
        return self.with_df(self.df.where(F.col("col") - F.col("row") >= k))

    def dedup(self, loops: bool = False) -> Matrix:
        """One entry (the least value) for each position; the diagonal goes unless ``loops``."""
        df = self.df if loops else self.df.where(F.col("row") != F.col("col"))
        return self.with_df(df.groupBy("row", "col").agg(F.min("val").alias("val")))

    def symmetrize(self) -> Matrix:
        """Entries of either direction; where both are stored, and differ, a position keeps its own value."""
        if self.nrows != self.ncols:
            raise DimensionMismatch("only square matrices can be made symmetric")
        # a position and its mirror are dealt to one task, where each is turned around: entries move once
        ends = [F.least("row", "col"), F.greatest("row", "col")]
        dealt = self.df.withColumn("low", ends[0]).withColumn("high", ends[1]).repartition("low", "high")
        both = dealt.select("low", "high", "val", F.expr("stack(2, row, col, 0, col, row, 1) as (row, col, own)"))
        return self.with_df(both.groupBy("low", "high", "row", "col").agg(F.min(F.struct("own", "val")).alias("best")).select("row", "col", F.col("best.val").alias("val")))

    def is_symmetric(self) -> bool:
        """Whether every stored position has its mirror."""
        return self.nrows == self.ncols and self.df.join(self.T.df, ["row", "col"], "left_anti").isEmpty()

    def diff(self, other: Matrix) -> DataFrame:
        """(row, col, side) of positions that are stored on one side only; values are not compared."""
        a, b = (m.df.select("row", "col").distinct() for m in (self, other))
        left = a.join(b, ["row", "col"], "left_anti").withColumn("side", F.lit("left"))
        return left.union(b.join(a, ["row", "col"], "left_anti").withColumn("side", F.lit("right")))

    def same_structure(self, other: Matrix) -> bool:
        return (self.nrows, self.ncols) == (other.nrows, other.ncols) and self.diff(other).isEmpty()

    def partitioned(self, by: str = "row", parts: int | None = None) -> Matrix:
        """Entries dealt by ``row`` or ``col`` and sorted inside, as products along that side want them."""
        keys = ["row", "col"] if by == "row" else ["col", "row"]
        dealt = self.df.repartition(parts, by) if parts else self.df.repartition(by)
        return self.with_df(dealt.sortWithinPartitions(*keys))

    def sorted(self, by: str = "row") -> DataFrame:
        """(pos, row, col, val): entries numbered in row (or col) order."""
        keys = ["row", "col"] if by == "row" else ["col", "row"]
        return ranked(self.df, keys, "pos")

    def row_pointers(self) -> DataFrame:
        """(row, ptr): where each row starts among the sorted entries, nrows + 1 rows."""
        from gridloom.operators.scan import exclusive_scan

        return exclusive_scan(self.degrees("row")).df.select(F.col("idx").alias("row"), F.col("val").alias("ptr"))

    def degree_order(self, axis: str = "row") -> DataFrame:
        """(idx, degree, rank): vertices numbered by falling degree, ties by index."""
        degrees = self.degrees(axis).df.withColumnRenamed("val", "degree")
        return ranked(degrees.withColumn("less", -F.col("degree")), ["less", "idx"], "rank").select("idx", "degree", "rank")

    def relabel(self, order: DataFrame) -> Matrix:
        """Both ends renamed by ``order`` (idx, rank)."""
        row, col = (order.select(F.col("idx").alias(end), F.col("rank").alias(f"new_{end}")) for end in ("row", "col"))
        moved = self.df.join(row, "row").join(col, "col")
        return self.with_df(moved.select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val"))

    def shuffled(self, seed: int) -> Matrix:
        """Vertices renamed at random, the same way for a seed."""
        spark = self.df.sparkSession
        order = ranked(spark.range(max(self.nrows, self.ncols)).select(F.col("id").alias("idx"), F.xxhash64("id", F.lit(seed)).alias("key")), ["key", "idx"], "rank")
        return self.relabel(order.select("idx", "rank"))

    def non_trivial_vertex(self) -> int:
        """The smallest vertex with edges both out and in."""
        both = self.df.select(F.col("row").alias("idx")).join(self.df.select(F.col("col").alias("idx")), "idx", "left_semi")
        least = both.agg(F.min("idx")).head()[0]
        if least is None:
            from gridloom.errors import NoValue

            raise NoValue("no vertex has edges both out and in")
        return least

    def show(self, most: int = 50) -> str:
        """The top left corner written out densely."""
        n, m = min(self.nrows, most), min(self.ncols, most)
        stored = {(r["row"], r["col"]): r["val"] for r in self.df.where((F.col("row") < n) & (F.col("col") < m)).collect()}
        return "\n".join(" ".join(str(stored.get((i, j), 0)) for j in range(m)) for i in range(n))
