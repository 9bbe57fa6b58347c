"""Seeded graph generators. The same seed gives the same graph, however it is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import InvalidValue
from gridloom.operators.matrix import Matrix

# What such graphs and stencils are known by.
#: Chances in percent of the four quadrants of an RMAT step.
RMAT_CHANCES = (57, 19, 19, 5)
#: Value on the diagonal of the stencil matrix, and off it.
STENCIL_VALUES = (26, -1)


def _uniform(seed: int, key: Column, what: int | Column, below: int) -> Column:
    """A number in 0 to below - 1 that depends on the seed, the edge and what it is for."""
    return F.pmod(F.xxhash64(F.lit(seed), key, what if isinstance(what, Column) else F.lit(what)), F.lit(below))


def _finished(spark: SparkSession, edges, n: int, seed: int, undirected: bool, shuffle: bool) -> Matrix:
    if undirected:
        edges = edges.union(edges.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    a = Matrix(edges, n, n)
    return a.shuffled(seed) if shuffle else a


def random_uniform(spark: SparkSession, scale: int, degree: int, seed: int = 0, undirected: bool = False, shuffle: bool = False) -> Matrix:
    """2**scale vertices and degree * 2**scale edges with ends drawn evenly."""
    n = 1 << scale
    edges = spark.range(n * degree).select(_uniform(seed, F.col("id"), 0, n).alias("row"), _uniform(seed, F.col("id"), 1, n).alias("col"), F.lit(1).cast("long").alias("val"))
    return _finished(spark, edges, n, seed, undirected, shuffle)


def rmat(spark: SparkSession, scale: int, degree: int, seed: int = 0, chances: tuple[int, int, int, int] = RMAT_CHANCES, undirected: bool = False, shuffle: bool = True) -> Matrix:
    """2**scale vertices and degree * 2**scale edges; each bit of an edge's ends is drawn from four quadrants."""
    if sum(chances) != 100:
        raise InvalidValue("the chances of the quadrants must add up to 100")
    n = 1 << scale
    top, left, right = chances[0], chances[0] + chances[1], chances[0] + chances[1] + chances[2]

    def step(ends: Column, bit: Column) -> Column:
        draw = _uniform(seed, F.col("id"), bit, 100)
        down = (draw >= left).cast("long")
        across = ((draw >= top) & (draw < left) | (draw >= right)).cast("long")
        return F.struct((ends["row"] * 2 + down).alias("row"), (ends["col"] * 2 + across).alias("col"))

    start = F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"))
    ends = F.aggregate(F.sequence(F.lit(2), F.lit(scale + 1)), start, step) if scale else start
    edges = spark.range(n * degree).select(ends.alias("e")).select("e.row", "e.col", F.lit(1).cast("long").alias("val"))
    return _finished(spark, edges, n, seed, undirected, shuffle)


def stencil(spark: SparkSession, nx: int, ny: int, nz: int) -> Matrix:
    """The 27-point stencil on a grid: 26 on the diagonal, -1 for each neighbour inside the grid."""
    n = nx * ny * nz
    i = F.col("id")
    x, y, z = i % nx, F.floor(i / nx) % ny, F.floor(i / (nx * ny))
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)])
    cells = spark.range(n).select("id", x.alias("x"), y.alias("y"), z.alias("z"), F.explode(offsets).alias("o"))
    to = [F.col(axis) + F.col(f"o.d{axis}") for axis in "xyz"]
    within = [c.between(0, size - 1) for c, size in zip(to, (nx, ny, nz), strict=True)]
    col = to[0] + to[1] * nx + to[2] * (nx * ny)
    kept = cells.where(within[0] & within[1] & within[2]).select(F.col("id").alias("row"), col.cast("long").alias("col"))
    diagonal, beside = STENCIL_VALUES
    return Matrix(kept.withColumn("val", F.when(F.col("row") == F.col("col"), diagonal).otherwise(beside).cast("long")), n, n)


def load_graph(spark: SparkSession, kind: str, **options) -> Matrix:
    """A graph from a file or a generator; ``simple=True`` drops loops and repeated edges."""
    from gridloom.sources import files

    simple = options.pop("simple", False)
    makers = {
        "mtx": files.read_mtx,
        "edges": files.read_edge_list,
        "raw": files.convert_raw,
        "ru": random_uniform,
        "rmat": rmat,
        "hpcg": stencil,
    }
    if kind not in makers:
        raise InvalidValue(f"kind must be one of {sorted(makers)}")
    a = makers[kind](spark, **options)
    return a.dedup() if simple else a


def generate_file(spark: SparkSession, path: str, kind: str, **options) -> Matrix:
    """Generate a graph and write it as a coordinate file."""
    from gridloom.sources.files import write_mtx

    a = load_graph(spark, kind, **options)
    write_mtx(a, path)
    return a
