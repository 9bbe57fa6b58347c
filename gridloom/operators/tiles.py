"""Masked products in tiles, so that no product is ever moved.

A tile is a block of rows met with a block of columns. The rows and columns of
the factors travel as lists to the tiles that the mask has positions in; there
both lists of a position are intersected. What moves is the mask once and each
list once for each tile of its block, whatever the number of products.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shared import materialize, release, spread

#: Ranges of indices that blocks are put together from.
FINE = 512
#: Positions of a mask, and entries of its rows or columns, that one tile should hold at most.
TILE_POSITIONS, TILE_ENTRIES = 1 << 22, 1 << 25
#: Products without a mask that one tile should make at most, and results up to which sums are combined instead.
TILE_PRODUCTS, FEW = 1 << 25, 1 << 18
#: Entries of factors and mask together up to which tiles are not worth while.
SMALL = 1 << 18
#: Lists longer than HUB meet others only if at most RATIO times as long; lists longer than GIANT are not made.
HUB, RATIO, GIANT = 1 << 10, 8, 1 << 22


def _fine(index: str, n: int) -> Column:
    """The range of indices that an index below ``n`` lies in."""
    return F.least(F.lit(FINE - 1), F.greatest(F.lit(0), F.floor(F.col(index) * F.lit(FINE / max(n, 1))))).cast("int")


def _even(weights: np.ndarray, p: int) -> np.ndarray:
    """Ranges in ``p`` blocks of like weight."""
    middle = np.cumsum(weights) - weights / 2
    return np.minimum(middle * p // max(weights.sum(), 1), p - 1).astype(int)


def _sums(counts: np.ndarray, blocks: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, *counts.shape[1:]), counts.dtype)
    np.add.at(out, blocks, counts)
    return out


def _labels(spark: SparkSession, n: int) -> list[int]:
    """Numbers that a hash deals to ``n`` partitions, one to each."""
    found: dict[int, int] = {}
    tried = spark.range(n * (math.ceil(math.log(n + 1)) + 8)).select(F.col("id").cast("int").alias("id"))
    for label, part in tried.select("id", F.pmod(F.hash("id"), F.lit(n))).toPandas().itertuples(index=False):
        found.setdefault(int(part), int(label))
    free = iter(range(10**9, 10**9 + n))
    return [found.get(k) if k in found else next(free) for k in range(n)]


@dataclass(frozen=True)
class Tiling:
    """Which block a row and a column are in, and the tile (a number) of each pair of blocks that is in use."""

    nrows: int
    ncols: int
    row_blocks: list[int]
    col_blocks: list[int]
    tiles: DataFrame
    n: int

    def block(self, axis: str) -> Column:
        n, blocks = (self.nrows, self.row_blocks) if axis == "row" else (self.ncols, self.col_blocks)
        return F.element_at(F.lit(blocks).cast("array<int>"), _fine(axis, n) + 1)

    def positions(self, at: DataFrame) -> DataFrame:
        """Each position in its tile."""
        placed = at.withColumn("__r", self.block("row")).withColumn("__c", self.block("col"))
        return placed.join(F.broadcast(self.tiles), ["__r", "__c"]).drop("__r", "__c").repartition(self.n, "tile")

    def copies(self, df: DataFrame, axis: str) -> DataFrame:
        """Rows of ``df`` in all tiles of the block that their ``axis`` is in."""
        key = "__r" if axis == "row" else "__c"
        tiles = self.tiles.groupBy(key).agg(F.collect_list("tile").alias("__tiles"))
        placed = df.withColumn(key, self.block(axis)).join(F.broadcast(tiles), key).drop(key)
        return placed.withColumn("tile", F.explode("__tiles")).drop("__tiles").repartition(self.n, "tile")


def _counted(df: DataFrame, first: str, n: int, second: str, m: int) -> np.ndarray:
    """Rows of ``df`` by the ranges that both indices lie in."""
    counts = np.zeros((FINE, FINE), np.int64)
    found = df.groupBy(_fine(first, n).alias("r"), _fine(second, m).alias("c")).count().toPandas()
    counts[found["r"].to_numpy(int), found["c"].to_numpy(int)] = found["count"].to_numpy(np.int64)
    return counts


def _along(df: DataFrame | None, axis: str, n: int) -> np.ndarray:
    out = np.zeros(FINE, np.int64)
    if df is not None:
        held = df.groupBy(_fine(axis, n).alias("at")).count().toPandas()
        out[held["at"].to_numpy(int)] = held["count"].to_numpy(np.int64)
    return out


def tiling(at: DataFrame, nrows: int, ncols: int, rows: DataFrame | None = None, cols: DataFrame | None = None, positions: int | None = None, entries: int | None = None) -> Tiling:
    """Few tiles of at most ``positions`` positions of ``at`` (row, col), and ``entries`` of ``rows`` and of ``cols``, that keep all cores busy.

    Blocks are ranges of indices: where a graph's vertices lie near their
    neighbours most tiles are empty, and blocks cost nothing.
    """
    counts = _counted(at, "row", nrows, "col", ncols)
    return _cut(at.sparkSession, counts, nrows, ncols, _along(rows, "row", nrows), _along(cols, "col", ncols), positions or TILE_POSITIONS, entries or TILE_ENTRIES)


def _cut(spark: SparkSession, counts: np.ndarray, nrows: int, ncols: int, in_rows: np.ndarray, in_cols: np.ndarray, most: int, entries: int) -> Tiling:
    by_row, by_col = counts.sum(1) + in_rows, counts.sum(0) + in_cols
    if nrows == ncols:  # the same ranges on both sides, so that what lies near the diagonal stays there
        by_row = by_col = by_row + by_col
    busy = min(2 * spark.sparkContext.defaultParallelism, 1 + int(counts.sum()) // 10_000)
    p = 1
    while True:
        r, c = _even(by_row, p), _even(by_col, p)
        cells = _sums(_sums(counts, r, p).T, c, p).T
        if p == FINE or (cells.max() <= most and _sums(in_rows, r, p).max() <= entries and _sums(in_cols, c, p).max() <= entries and (cells > 0).sum() >= busy):
            break
        p = min(FINE, max(p + 1, p * 5 // 4))
    used = np.argwhere(cells > 0)
    labels = _labels(spark, len(used)) if len(used) else []
    tiles = spark.createDataFrame([(int(i), int(j), t) for (i, j), t in zip(used, labels, strict=True)], "__r int, __c int, tile int")
    return Tiling(nrows, ncols, r.tolist(), c.tolist(), tiles, max(1, len(used)))


def ranges(df: DataFrame, axis: str, n: int, rows: int) -> tuple[Column, int] | None:
    """A number for the block of ``axis`` that a row is in, which a hash deals to a bucket of its own, and how many there are; None if one block outweighs others by far."""
    spark = df.sparkSession
    p = min(FINE, spread(spark, rows))
    counts = _along(df, axis, n)
    blocks = _even(counts, p)
    if _sums(counts, blocks, p).max() * p > 4 * max(rows, 1):
        return None
    labels = np.array(_labels(spark, p))[blocks]
    return F.element_at(F.lit(labels.tolist()).cast("array<int>"), _fine(axis, n) + 1), p


def multiplied(left: DataFrame, right: DataFrame, shape: tuple[int, int, int], where: Column | None, finish: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """``finish`` of (tile, row, col, k, a, b) for all left (row, k, a) and right (k, col, b) that meet, written; None if that is not worth while.

    Tiles are cut by the products that the entries in each range of ks let
    expect. Other columns of both sides are there for ``where``. Where results
    are few sums are combined before they move, and products may be made anywhere.
    """
    nrows, nk, ncols = shape
    first, second = _counted(left, "row", nrows, "k", nk), _counted(right, "k", nk, "col", ncols)
    expected = first.astype(float) @ second / max(nk / FINE, 1)
    if nrows * ncols <= FEW or expected.sum() <= TILE_PRODUCTS / 8:
        return None
    products = np.ceil(expected).astype(np.int64)
    tiles = _cut(left.sparkSession, products, nrows, ncols, first.sum(1), second.sum(0), TILE_PRODUCTS, TILE_ENTRIES)
    # where both sides of a join are bare exchanges Spark plans new ones; a filter that it cannot move keeps them
    there = tiles.copies(left, "row").where(F.spark_partition_id() >= 0)
    both = there.join(tiles.copies(right, "col").hint("shuffle_hash"), ["tile", "k"])
    return materialize(finish(both if where is None else both.where(where)), "mxm-tiles", together=True)


def _lists(entries: DataFrame, rows: int, key: str, value: str | None, nk: int, name: str) -> DataFrame:
    """(key, ks, vs) of each row or column; ``metrics``: whether any holds an index twice."""
    k = F.col("k").cast("int") if nk < 1 << 31 else F.col("k")
    kept = entries.select(key, F.struct(k.alias("k"), *([F.col(value).alias("v")] if value else [])).alias("e"))
    gathered = kept.repartition(spread(entries.sparkSession, rows), key).groupBy(key).agg(F.collect_list("e").alias("e"))
    lists = gathered.select(key, F.col("e.k").alias(f"{key}_ks"), *([F.col("e.v").alias(f"{key}_vs")] if value else []))
    return materialize(lists, name, twice=F.max(F.size(f"{key}_ks") - F.size(F.array_distinct(f"{key}_ks"))))


def _longest(entries: DataFrame, key: str, more: int) -> DataFrame:
    """(key, its entries) where there are more than ``more``; ``most``: the most there are."""
    lengths = entries.groupBy(key).count().where(F.col("count") > more)
    lengths.most = lengths.agg(F.max("count")).head()[0] or 0
    return lengths


def split(left: DataFrame, right: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Factors without giant rows and columns, the positions whose lists may meet, and the others (None: no others).

    A hub that meets a much smaller vertex would be read to its end for each
    of them; such positions are left to lookups of the smaller one.
    """
    rows, cols = _longest(left, "row", HUB), _longest(right, "col", HUB)
    if max(rows.most, cols.most) <= HUB:
        return left, right, at, None
    sized = at.join(rows.withColumnRenamed("count", "__r"), "row", "left").join(cols.withColumnRenamed("count", "__c"), "col", "left")
    r, c = F.col("__r"), F.col("__c")
    meets = F.coalesce((r.isNull() & c.isNull()) | ((F.greatest(r, c) <= RATIO * F.least(r, c)) & (F.greatest(r, c) <= GIANT) & r.isNotNull() & c.isNotNull()), F.lit(False))
    sized = materialize(sized.select("row", "col", meets.alias("__meets")), "mxm-positions")
    if rows.most > GIANT:
        left = left.join(rows.where(F.col("count") > GIANT).select("row"), "row", "left_anti")
    if cols.most > GIANT:
        right = right.join(cols.where(F.col("count") > GIANT).select("col"), "col", "left_anti")
    return left, right, sized.where("__meets").select("row", "col"), sized.where("not __meets").select("row", "col")


def _values(ks: Column, vs: Column, k: Column) -> Column:
    """All of ``vs`` whose index is ``k``."""
    places = F.filter(F.sequence(F.lit(1), F.size(ks)), lambda i: F.element_at(ks, i) == k)
    return F.transform(places, lambda i: F.element_at(vs, i))


def met(left: DataFrame, right: DataFrame, at: DataFrame, shape: tuple[int, int, int], sizes: tuple[int, int], finish: Callable[[DataFrame], DataFrame], a: bool = True, b: bool = True) -> DataFrame:
    """``finish`` of (tile, row, col, k, a, b): the factors at positions ``at`` of left (row, k, a) and right (k, col, b), written.

    All factors of a position are in its tile, and sums by tile, row and col
    are made there. ``shape`` holds the numbers of rows, of ks and of columns,
    ``sizes`` the entries of both factors. ``a`` and ``b`` tell whether the
    values are wanted; else they are null.
    """
    nrows, nk, ncols = shape
    tiles = tiling(at, nrows, ncols, left, right)
    by_row = _lists(left, sizes[0], "row", "a" if a else None, nk, "mxm-rows")
    by_col = _lists(right, sizes[1], "col", "b" if b else None, nk, "mxm-cols")
    there = tiles.positions(at).distinct()
    both = there.join(tiles.copies(by_row, "row").hint("shuffle_hash"), ["tile", "row"]).join(tiles.copies(by_col, "col").hint("shuffle_hash"), ["tile", "col"])
    # outer, so that the lists are not intersected once more to drop empty ones first
    out = both.withColumn("k", F.explode_outer(F.array_intersect("row_ks", "col_ks"))).where("k is not null")
    for name, key, wanted, lists in (("a", "row", a, by_row), ("b", "col", b, by_col)):
        ks, k, vs = F.col(f"{key}_ks"), F.col("k"), F.col(f"{key}_vs" if wanted else f"{key}_ks")
        if lists.metrics["twice"]:
            # an index that a list holds twice stands for two factors
            out = out.withColumn(name, F.explode(_values(ks, vs, k)))
        elif wanted:
            out = out.withColumn(name, F.element_at(vs, F.array_position(ks, k).cast("int")))
        if not wanted:
            out = out.withColumn(name, F.lit(None).cast("long"))
    done = materialize(finish(out.select("tile", "row", "col", F.col("k").cast("long").alias("k"), "a", "b")), "mxm-tiles", together=True)
    release(by_row)
    release(by_col)
    return done
