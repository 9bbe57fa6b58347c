"""Graph algorithms as loops over the operators."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, LongType

from gridloom.errors import InvalidValue
from gridloom.functions.algebra import MIN, PLUS_MONOID, PLUS_PAIR
from gridloom.operators import ops
from gridloom.operators.descriptor import DEFAULT, S
from gridloom.operators.matrix import Matrix
from gridloom.operators.vector import Vector
from gridloom.plans.iterate import fixpoint, near, near_edges
from gridloom.shared import materialize, release

#: Frontiers that are kept apart before they are put together.
COMPACT = 8


def _all(parts: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, parts)


def _compacted(parts: list[DataFrame], name: str) -> list[DataFrame]:
    """One table in place of many, so that plans stay short in deep graphs."""
    if len(parts) < COMPACT:
        return parts
    one = materialize(_all(parts), name)
    for p in parts:
        release(p)
    return [one]


def bfs(a: Matrix, source: int, parents: bool = False, depth: int | None = None) -> DataFrame:
    """(idx, level) of all vertices that out-edges reach from ``source``, which has level 1; with ``parents`` also parent.

    A level is one join from the frontier and an anti join with what was
    visited; frontiers known to be small are broadcast, so the edges stay put.
    The parent is the smallest one of the level before; the source is its own.
    """
    edges = near_edges(a.df.select("row", "col").distinct(), "row", a.nrows, "bfs-edges")
    spark = a.df.sparkSession
    start = spark.range(1).select(F.lit(source).cast("long").alias("idx"), F.lit(1).cast("long").alias("level"), F.lit(source).cast("long").alias("parent"))
    frontier = materialize(start, "bfs")
    visited, rows, level, held = [frontier], 1, 1, None
    while rows and (depth is None or level < depth):
        level += 1
        step = edges.meet(near(frontier.select(F.col("idx").alias("row")), rows)).groupBy(F.col("col").alias("idx")).agg(F.min("row").alias("parent"))
        fresh = step.join(_all(visited).select("idx"), "idx", "left_anti").select("idx", F.lit(level).cast("long").alias("level"), "parent")
        frontier = materialize(fresh, "bfs", together=True, rows=F.count(F.lit(1)))
        rows = frontier.metrics["rows"]
        visited.append(frontier)
        if len(visited) >= COMPACT:
            before, frontier = held, materialize(frontier, "bfs")
            visited, held = _compacted(visited, "bfs"), frontier
            if before is not None:
                release(before)
    release(edges.df)
    return _all(visited).select("idx", "level", *(["parent"] if parents else []))


#: Names of the ways to relax; all have the same distances.
SSSP_METHODS = ("frontier", "bellman_ford")


def _wide(kind: DataType) -> DataType:
    """What distances of such weights are kept in: sums of decimals stay decimals, of whole numbers long."""
    if isinstance(kind, DecimalType):
        return DecimalType(38, kind.scale)
    return kind if kind.typeName() in ("double", "float") else LongType()


def sssp(a: Matrix, source: int, most: int | None = None, method: str = "frontier") -> DataFrame:
    """(idx, dist): least sum of weights along out-edges from ``source``; unreachable vertices are absent.

    Only vertices that got closer are relaxed in the next round; with
    ``method="bellman_ford"`` all vertices reached are. Distances have the
    weights' own type, decimals included. Negative weights are allowed, negative cycles are not: after as many rounds as there
    are vertices they raise an error.
    """
    if method not in SSSP_METHODS:
        raise InvalidValue(f"method must be one of {SSSP_METHODS}")
    edges = near_edges(a.df.groupBy("row", "col").agg(F.min("val").alias("val")), "row", a.nrows, "sssp-edges")
    kind = _wide(edges.df.schema["val"].dataType)
    spark = a.df.sparkSession
    frontier = materialize(spark.range(1).select(F.lit(source).cast("long").alias("idx"), F.lit(0).cast(kind).alias("dist")), "sssp")
    found, rows, rounds, held = [frontier], 1, 0, None
    while rows:
        rounds += 1
        if rounds > (most or a.nrows + 1):
            raise InvalidValue("the graph has a cycle of negative weight")
        known = _all(found).groupBy("idx").agg(F.min("dist").alias("dist"))
        relaxed = near(frontier.withColumnRenamed("idx", "row"), rows) if method == "frontier" else known.withColumnRenamed("idx", "row")
        step = edges.meet(relaxed).groupBy(F.col("col").alias("idx")).agg(F.min((F.col("dist") + F.col("val")).cast(kind)).alias("new"))
        closer = step.join(known, "idx", "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("idx", F.col("new").cast(kind).alias("dist"))
        frontier = materialize(closer, "sssp", together=True, rows=F.count(F.lit(1)))
        rows = frontier.metrics["rows"]
        found.append(frontier)
        if len(found) >= COMPACT:
            before, frontier = held, materialize(frontier, "sssp")
            found, held = _compacted(found, "sssp"), frontier
            if before is not None:
                release(before)
    release(edges.df)
    return _all(found).groupBy("idx").agg(F.min("dist").alias("dist"))


def connected_components(a: Matrix, most: int | None = None) -> DataFrame:
    """(idx, label) of all vertices 0 to n - 1; the label is the smallest vertex of the component.

    Rounds of min-label hooking with shortcuts: every vertex learns the least
    grandparent around it, hooks its parent there, and halves its path. If
    ``most`` is given and so many rounds do not suffice, that is an error.
    """
    n = max(a.nrows, a.ncols)
    spark = a.df.sparkSession
    once = a.df.where("row != col").select(F.least("row", "col").alias("low"), F.greatest("row", "col").alias("high")).distinct()
    sym = near_edges(once.select(F.expr("stack(2, low, high, high, low) as (row, col)")), "col", n, "cc-edges")
    start = spark.range(n).select(F.col("id").alias("idx"), F.col("id").alias("val"))

    def step(state: DataFrame, _: int) -> DataFrame:
        parent = Vector(state, n)
        around = sym.meet(state.select(F.col("idx").alias("col"), "val")).groupBy(F.col("row").alias("idx"))
        least = Vector(around.agg(F.min("val").alias("val")), n)
        hooked = ops.scatter(parent, least, parent, accum=MIN)
        lowered = ops.ewise_add(hooked, least, MIN)
        # the parent's parent: paths halve
        return ops.extract(lowered, lowered).df.select("idx", "val")

    labels = fixpoint(start, step, None, most or n + 1, "cc", settle=True)
    release(sym.df)
    return labels.select("idx", F.col("val").alias("label"))


def pagerank(a: Matrix, iterations: int = 10, damping: float = 0.85, direction: str = "reference", tolerance: float | None = None) -> DataFrame:
    """(idx, rank) of all vertices.

    ``direction="reference"``: rank flows from column to row and is shared
    among a column's entries; ``"standard"``: from row to col along out-edges.
    Vertices that pass nothing on spread their rank evenly. All iterations run
    unless ``tolerance`` is given (largest sum of changes at which to stop).
    """
    if direction not in ("reference", "standard"):
        raise InvalidValue("direction must be reference or standard")
    a = a if direction == "reference" else a.T
    n = max(a.nrows, a.ncols)
    if not n:
        return a.df.select(F.col("row").alias("idx"), F.lit(0.0).alias("rank")).limit(0)
    spark = a.df.sparkSession
    edges = near_edges(a.df.select("row", "col"), "col", n, "pr-edges")
    # what a vertex passes to each neighbour is its rank over its degree: the share is worked out once
    degree = Matrix(edges.df.select("row", "col", F.lit(1).alias("val")), n, n).degrees("col").df.withColumnRenamed("val", "degree")

    def step(state: DataFrame, _: int) -> DataFrame:
        lost = state.metrics["lost"] or 0.0
        passed = state.where("degree > 0").select(F.col("idx").alias("col"), (F.col("rank") * damping / F.col("degree")).alias("val"))
        gained = edges.meet(passed).groupBy(F.col("row").alias("idx")).agg(F.sum("val").alias("val"))
        teleport = (1 - damping) / n + damping / n * lost
        return state.select("idx", "degree").join(gained, "idx", "left").select("idx", (F.lit(teleport) + F.coalesce("val", F.lit(0.0))).alias("rank"), "degree")

    def done(old: DataFrame, new: DataFrame) -> bool:
        if tolerance is None:
            return False
        both = old.select("idx", F.col("rank").alias("old")).join(new, "idx")
        return both.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0] <= tolerance

    start = degree.select("idx", F.lit(1.0 / n).alias("rank"), "degree")
    ranks = fixpoint(start, step, done, iterations, "pr", lost=F.sum(F.when(F.col("degree") == 0, F.col("rank"))))
    release(edges.df)
    return ranks.select("idx", "rank")


def triangle_table(a: Matrix) -> DataFrame:
    """(x, y, z): each triangle of an undirected graph once.

    Edges point from the end of smaller degree (ties: index) to the other, so
    no vertex has more than a root of all edges going out, and hubs close
    wedges instead of making them.
    """
    simple = materialize(_simple(a).df.select("row", "col"), "tc-edges")
    degree = simple.groupBy("row").agg(F.count(F.lit(1)).alias("d"))
    sized = simple.where("row < col").join(degree, "row").join(degree.select(F.col("row").alias("col"), F.col("d").alias("e")), "col")
    up = F.col("d") <= F.col("e")
    ends = sized.select(F.when(up, F.col("row")).otherwise(F.col("col")).alias("row"), F.when(up, F.col("col")).otherwise(F.col("row")).alias("col"), F.lit(1).alias("val"))
    out = Matrix(materialize(ends, "tc-out"), a.nrows, a.ncols)
    release(simple)
    # the third corner is where both ends of an edge point to
    corners = ops.paths_inside(out, out.T, out, S, lambda t: t.select(F.col("row").alias("x"), F.col("col").alias("y"), F.col("k").alias("z")), (False, False))
    return corners.select("x", "y", "z")


def _simple(a: Matrix) -> Matrix:
    """Both directions of every edge once, without loops."""
    both = a.symmetrize()
    return both.with_df(both.df.where("row != col"))


def triangles_per_vertex(a: Matrix) -> DataFrame:
    """(idx, triangles) of vertices that are in one."""
    corners = triangle_table(a).select(F.explode(F.array("x", "y", "z")).alias("idx"))
    return corners.groupBy("idx").agg(F.count(F.lit(1)).alias("triangles"))


#: Which products count triangles: left factor, right factor, mask, times each triangle is counted.
TRIANGLE_METHODS = {
    "burkhardt": ("A", "A", "A", 6),
    "cohen": ("L", "U", "A", 2),
    "sandia": ("L", "L", "L", 1),
    "sandia2": ("U", "U", "U", 1),
    "sandiadot": ("L", "UT", "L", 1),
    "sandiadot2": ("U", "LT", "U", 1),
}


def triangle_count(a: Matrix, method: str = "sandia", presort: bool = False) -> DataFrame:
    """One row (triangles): paths of two edges that an edge closes, by a masked product.

    ``presort`` renames vertices by falling degree first, which evens out the
    rows of the triangular factors.
    """
    if method not in TRIANGLE_METHODS:
        raise InvalidValue(f"method must be one of {sorted(TRIANGLE_METHODS)}")
    simple = _simple(a)
    if presort:
        simple = simple.with_df(materialize(simple.df, "tc-unsorted"))
        simple = simple.relabel(simple.degree_order().select("idx", "rank"))
    simple = simple.with_df(materialize(simple.df, "tc-edges"))
    factors = {"A": simple, "L": simple.tril(-1), "U": simple.triu(1)}
    factors |= {"UT": factors["U"].T, "LT": factors["L"].T}
    left, right, mask, times = TRIANGLE_METHODS[method]
    closed = ops.mxm(factors[left], factors[right], PLUS_PAIR, mask=factors[mask], desc=DEFAULT)
    total = ops.reduce_table(closed, PLUS_MONOID)
    return total.select((F.col("val") / times).cast("long").alias("triangles"))


def trace_cubed(a: Matrix) -> int:
    """Six times the triangles of a simple graph: the diagonal of the third power.

    The diagonal needs the square only where the transpose has an entry.
    """
    a = a.with_df(materialize(a.df, "trace"))
    back = a.T
    square = ops.mxm(a, a, mask=back, desc=S).df.withColumnRenamed("val", "walks")
    return square.join(back.df, ["row", "col"]).agg(F.coalesce(F.sum(F.col("walks") * F.col("val")), F.lit(0))).head()[0]


def label_bijection(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether two labelings (idx, label) are equal up to renaming, as 1 or 0."""
    pairs = a.withColumnRenamed("label", "a").join(b.withColumnRenamed("label", "b"), "idx", "full_outer").select("a", "b").distinct()
    split = pairs.groupBy("a").count().where("count > 1").limit(1).select(F.lit(1).alias("bad"))
    joined = pairs.groupBy("b").count().where("count > 1").limit(1).select(F.lit(1).alias("bad"))
    missing = pairs.where("a is null or b is null").limit(1).select(F.lit(1).alias("bad"))
    bad = split.union(joined).union(missing)
    return bad.agg((F.count("bad") == 0).cast("long").alias("same"))


def component_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("label").alias("components"))


def reached(distances: DataFrame) -> DataFrame:
    return distances.agg(F.count(F.lit(1)).alias("reached"))
