"""Products in tiles, with their limits lowered so that small graphs are large ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import algebra as al
from gridloom.operators import ops, scan, tiles
from gridloom.operators.descriptor import SC, S
from gridloom.operators.masks import Alike
from gridloom.operators.matrix import Matrix
from gridloom.operators.vector import Vector
from gridloom.plans import algorithms as alg
from gridloom.plans import fixtures as fx
from gridloom.plans.iterate import near_edges
from gridloom.shared import materialize
from gridloom.sources import files


@pytest.fixture
def tiled(monkeypatch):
    monkeypatch.setattr(tiles, "SMALL", 0)
    return monkeypatch


def shuffled(spark):
    """Bytes that all shuffles so far have written."""
    summaries = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))


def built(spark, cells, n, m):
    return Matrix(spark.createDataFrame([(r, c, v) for r, c, v in cells], "row long, col long, val long"), n, m)


def cells(df):
    return {(r["row"], r["col"]): r["val"] for r in df.collect()}


@pytest.mark.parametrize("hub, giant, twice", [(1 << 10, 1 << 22, True), (3, 1 << 22, False), (2, 4, True)])
def test_masked_products_in_tiles_are_whole(spark, tiled, hub, giant, twice):
    tiled.setattr(tiles, "HUB", hub)
    tiled.setattr(tiles, "GIANT", giant)
    tiled.setattr(tiles, "RATIO", 2)
    draw = random.Random(7)
    n, m, q = 30, 20, 25
    left = {(draw.randrange(n) if draw.random() < 0.7 else 3, draw.randrange(m)): draw.randrange(1, 9) for _ in range(150)}
    right = {(draw.randrange(m), draw.randrange(q) if draw.random() < 0.7 else 4): draw.randrange(1, 9) for _ in range(150)}
    a, b = [[(*p, v) for p, v in x.items()] for x in (left, right)]
    if twice:
        a, b = a + a[:20], b + b[10:30]
    mask = [(r, c, 1) for r in range(n) for c in range(q) if draw.random() < 0.6]
    named = {(r, c) for r, c, _ in mask}
    want = {}
    for (r, k, x), (j, c, y) in itertools.product(a, b):
        if k == j and (r, c) in named:
            want.setdefault((r, c), []).append((x, y))
    x, y, at = built(spark, a, n, m), built(spark, b, m, q), built(spark, mask + mask[:5], n, q)
    for ring, value in ((al.PLUS_TIMES, lambda t: sum(p * r for p, r in t)), (al.PLUS_SECOND, lambda t: sum(r for _, r in t))):
        assert cells(ops.mxm(x, y, ring, mask=at, desc=S).df) == {p: value(t) for p, t in want.items()}


def test_tiles_stay_within_their_limits(spark):
    at = spark.range(40_000).select((F.col("id") % 200).alias("row"), F.floor(F.col("id") / 200).alias("col"))
    found = tiles.tiling(at, 200, 200, positions=3000)
    sizes = [r["count"] for r in found.positions(at).groupBy("tile").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 3000 and len(sizes) == found.n
    # a graph whose edges lie near the diagonal leaves most tiles empty
    band = at.where("abs(row - col) < 3")
    assert tiles.tiling(band, 200, 200, positions=20).n < 4 * band.count() // 20


def test_triangles_in_tiles(spark, sf, tiled):
    a = fx.co_purchase(spark, sf)
    assert {alg.triangle_count(a, m).head()[0] for m in ("sandia", "cohen", "sandiadot", "burkhardt")} == {125968}
    assert alg.triangle_table(a).count() == 125968 and alg.trace_cubed(a) == 6 * 125968


def test_products_do_not_move(spark, tiled):
    """What is shuffled grows with the entries, not with the products."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 160
        full = spark.range(n * n).select((F.col("id") % n).alias("row"), F.floor(F.col("id") / n).alias("col")).where("row != col").withColumn("val", F.lit(1).cast("long"))
        a = Matrix(full, n, n)
        start = shuffled(spark)
        assert alg.triangle_count(a).head()[0] == n * (n - 1) * (n - 2) // 6
        assert alg.triangle_table(a).count() == n * (n - 1) * (n - 2) // 6
        assert shuffled(spark) - start < 40 * n * n * 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exchanges_of_the_graph_are_sized_by_its_lines(spark, sf, monkeypatch):
    """However few partitions a session asks for, a task gets no more lines than it should hold."""
    monkeypatch.setattr("gridloom.shared.TASK_ROWS", 200)
    text = fx.co_purchase(spark, sf).df._jdf.queryExecution().executedPlan().toString()
    lines = fx.table(spark, sf, "lineitem").count()
    assert "hashpartitioning(low#" in text and text.count(f", {-(-lines // 200)}), REPARTITION_BY_NUM") >= 2


def test_whole_products_in_tiles(spark, tiled):
    tiled.setattr(tiles, "FEW", 0)
    tiled.setattr(tiles, "TILE_PRODUCTS", 200)
    draw = random.Random(8)
    n, m, q = 30, 20, 25
    a, b = ([(draw.randrange(x), draw.randrange(y), draw.randrange(1, 9)) for _ in range(150)] for x, y in ((n, m), (m, q)))
    rows, cols = [(i, i % 4) for i in range(n - 3)], [(i, i % 3) for i in range(q)]
    of_row, of_col = dict(rows), dict(cols)
    every, unlike = {}, {}
    for (r, k, x), (j, c, y) in itertools.product(a, b):
        if k == j:
            every[r, c] = every.get((r, c), 0) + x * y
            if of_row.get(r) != of_col[c]:
                unlike[r, c] = unlike.get((r, c), 0) + x * y
    x, y = built(spark, a, n, m), built(spark, b, m, q)
    assert cells(ops.mxm(x, y).df) == every
    mask = Alike(Vector(spark.createDataFrame(rows, "idx long, val long"), n), Vector(spark.createDataFrame(cols, "idx long, val long"), q))
    assert cells(ops.mxm(x, y, mask=mask, desc=SC).df) == unlike
    assert cells(ops.mxm(x, y, mask=mask, desc=S).df) == {p: v for p, v in every.items() if p not in unlike}
    # the mask's pairs are never written out: they grow with the square of the tables
    plan = ops.mxm(x, y, mask=mask, desc=SC).df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    wide = built(spark, [(i, i % 5, 1) for i in range(1000)], 1000, 5)
    tiled.setattr(tiles, "TILE_PRODUCTS", 50_000)
    start = shuffled(spark)
    assert ops.mxm(wide, wide.T).df.count() == 200_000
    assert shuffled(spark) - start < 600_000


def test_small_files_need_few_tasks(spark, tmp_path):
    """What tasks report to the driver grows with the edges, not with the files."""
    a = Matrix(spark.range(3000).select("id", (F.col("id") + 1).alias("col"), F.lit(1).cast("long").alias("val")).toDF("row", "col", "val"), 3001, 3001)
    tracker, known = spark.sparkContext.statusTracker(), {}
    group = "small-files"
    spark.sparkContext.setJobGroup(group, group)
    try:
        files.write_mtxbin(a, f"file://{tmp_path}/a.mtxbin", part_edges=10)
        for job in tracker.getJobIdsForGroup(group):
            for stage in tracker.getJobInfo(job).stageIds:
                if (info := tracker.getStageInfo(stage)) is not None:
                    known[stage] = info.numTasks
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(list((tmp_path / "a.mtxbin").iterdir())) >= 300 and max(known.values()) < 100
    assert cells(files.read_mtx(spark, f"file://{tmp_path}/a.mtxbin").df) == {(i, i + 1): 1 for i in range(3000)}


def test_numbering_sorts_once(spark, monkeypatch):
    """Rows are numbered where they were sorted: no exchange after the table is written."""
    monkeypatch.setattr("gridloom.shared.TASK_ROWS", 50)
    draw = random.Random(3)
    rows = [(draw.randrange(40), i) for i in range(1000)]
    out = scan.ranked(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "pos")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[:2] for r in sorted(out.select("a", "b", "pos").collect(), key=lambda r: r["pos"])] == sorted(rows)
    assert sorted(r["pos"] for r in out.collect()) == list(range(1000))


def test_loop_edges_lie_by_near_indices(spark):
    """Edges to near vertices are in one bucket, so that sums of a round are few before they move."""
    band = spark.range(4000).select(F.col("id").alias("row"), ((F.col("id") + 1) % 4000).alias("col"))
    edges = near_edges(band, "col", 4000, "near")
    assert edges.part is not None and hasattr(edges.df, "shared_table")
    ends = edges.df.groupBy("part").agg(F.max("col") - F.min("col")).collect()
    assert len(ends) > 1 and all(r[1] < 4000 * 2 / len(ends) for r in ends)
    met = materialize(edges.meet(band.select("col").distinct()), "met", together=True)
    assert sorted(tuple(r) for r in met.select("row", "col").collect()) == sorted(tuple(r) for r in band.collect())
