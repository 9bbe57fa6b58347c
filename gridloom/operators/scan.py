"""Prefix sums and global numbering without putting all rows in one task.

Rows are range-partitioned by the order; each partition scans its own rows and
is shifted by the totals of the partitions before it. Only those totals, one
row for each partition, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.vector import Vector
from gridloom.shared import materialize, release, spread


def _scanned(df: DataFrame, order: list[str], value: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the sum of ``value`` over all rows before each one; and (part, before, total) by partition."""
    # written once: a partition's number has to be the same for both uses
    dealt = materialize(df.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "scan")
    totals = dealt.groupBy("__part").agg(F.sum("__value").alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0).cast("long")))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum("__value").over(inside), F.lit(0).cast("long")))
    out = own.join(offsets.select("__part", "__before"), "__part").withColumn(name, F.col("__own") + F.col("__before"))
    return out.drop("__value", "__part", "__own", "__before"), offsets


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the number of each row in ``order``, from 0."""
    dealt, before = numbered(df, order, name)
    shift = F.element_at(F.lit(before).cast("array<bigint>"), F.shiftright(name, 33).cast("int") + 1)
    return dealt.withColumn(name, shift + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, list[int]]:
    """``df`` written in ``order``, with the part of each row in the upper bits of ``name`` and its place there in the lower 33; and the rows before each part.

    Rows are written before they are dealt out, since finding the ranges reads
    them too. A sorted part numbers its own rows as they pass.
    """
    rows = materialize(df, "scan-rows", rows=F.count(F.lit(1)))
    parts = spread(df.sparkSession, rows.metrics["rows"])
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    dealt = materialize(sorted_rows, "scan")
    release(rows)
    counts = {r["part"]: r["count"] for r in dealt.groupBy(F.shiftright(name, 33).alias("part")).count().collect()}
    before = [0]
    for part in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(part, 0))
    return dealt, before


def exclusive_scan(v: Vector) -> Vector:
    """Sums of all values before each position; one position more than ``v``, with the sum of all."""
    dense = v.dense().df
    kind = dense.schema["val"].dataType.typeName()
    total_kind = "double" if kind in ("float", "double") else "long"
    scanned, offsets = _scanned(dense, ["idx"], F.col("val").cast(total_kind), "sum")
    last = offsets.agg(F.coalesce(F.sum("__total"), F.lit(0)).cast(total_kind).alias("val")).select(F.lit(v.size).cast("long").alias("idx"), "val")
    return Vector(scanned.select("idx", F.col("sum").cast(total_kind).alias("val")).union(last), v.size + 1)


def count_if(v: Vector, value) -> int:
    """Stored values equal to ``value``."""
    return v.df.where(F.col("val") == value).count()


def copy_if(v: Vector, condition) -> DataFrame:
    """(pos, idx, val): values that meet ``condition(idx, val)``, numbered in order."""
    return ranked(v.df.where(condition(F.col("idx"), F.col("val"))), ["idx"], "pos").select("pos", "idx", "val")


def reorder(v: Vector, order: DataFrame) -> Vector:
    """Values moved: position ``rank`` gets what ``idx`` held, by ``order`` (idx, rank)."""
    return v.with_df(v.df.join(order, "idx").select(F.col("rank").alias("idx"), "val"))
