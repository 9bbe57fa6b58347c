"""Masks, accumulators and what becomes of the old output: one place for all operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.algebra import BinaryOp
from gridloom.operators.descriptor import Descriptor
from gridloom.operators.vector import Vector


@dataclass(frozen=True)
class Alike:
    """A matrix mask by structure, not written out: the positions whose row and column have the same value."""

    rows: Vector
    cols: Vector

    @property
    def df(self) -> DataFrame:
        rows, cols = self.rows.df.withColumnRenamed("idx", "row"), self.cols.df.withColumnRenamed("idx", "col")
        return rows.join(cols, "val").select("row", "col", F.lit(1).alias("val"))


def positions(mask: DataFrame, keys: list[str], desc: Descriptor) -> DataFrame:
    """The positions a mask names, before any complement."""
    chosen = mask if desc.structural else mask.where(F.col("val").cast("boolean"))
    return chosen.select(*keys)


def inside(df: DataFrame, keys: list[str], mask: DataFrame | None, desc: Descriptor) -> DataFrame:
    """Rows whose position the mask lets through."""
    if mask is None:
        return df
    return df.join(positions(mask, keys, desc), keys, "left_anti" if desc.complemented else "left_semi")


def outside(df: DataFrame, keys: list[str], mask: DataFrame, desc: Descriptor) -> DataFrame:
    """Rows whose position the mask holds back."""
    return df.join(positions(mask, keys, desc), keys, "left_semi" if desc.complemented else "left_anti")


def restricted(edges: DataFrame, axis: str, mask: DataFrame | None, desc: Descriptor) -> DataFrame:
    """Entries of a matrix whose ``axis`` is a position that a vector mask lets through: the others need not be multiplied."""
    return edges if mask is None else inside(edges, [axis], mask.withColumnRenamed("idx", axis), desc)


def written(new: DataFrame, keys: list[str], mask: DataFrame | None, accum: BinaryOp | None, old: DataFrame | None, desc: Descriptor, masked: bool = False) -> DataFrame:
    """The output: ``new`` inside the mask, accumulated with the old values there; old values outside unless replaced.

    ``masked``: ``new`` holds nothing outside the mask.
    """
    new = new if masked else inside(new, keys, mask, desc)
    if old is None:
        return new.select(*keys, "val")
    if accum is not None:
        both = new.withColumnRenamed("val", "new").join(inside(old, keys, mask, desc).withColumnRenamed("val", "old"), keys, "full_outer")
        merged = F.when(F.col("new").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("new")).otherwise(accum(F.col("old"), F.col("new")))
        new = both.select(*keys, merged.alias("val"))
    if mask is None or desc.replace:
        return new.select(*keys, "val")
    return new.select(*keys, "val").union(outside(old, keys, mask, desc).select(*keys, "val"))
