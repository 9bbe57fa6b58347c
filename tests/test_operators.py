"""Small literal graphs, algebraic properties, errors and plans."""

import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.errors import DimensionMismatch, IndexOutOfBounds, InvalidValue, NoValue, NullPointer
from gridloom.functions import algebra as al
from gridloom.operators import ops, scan
from gridloom.operators.descriptor import RSC, SC, C, Descriptor, S
from gridloom.operators.matrix import Matrix
from gridloom.operators.vector import Vector
from gridloom.plans import algorithms as alg
from gridloom.plans import fixtures as fx


def matrix(spark, rows, cols, value=10, dup=None):
    return Matrix.build(spark, rows, cols, [value] * len(rows), "long", dup)


def cells(a):
    return {(r["row"], r["col"]): r["val"] for r in a.df.collect()}


def values(v):
    return {r["idx"]: r["val"] for r in v.df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    return matrix(spark, [0, 1, 1, 2, 3, 3, 4, 5, 5], [5, 0, 4, 2, 1, 5, 3, 0, 4])


def test_transpose_small(small):
    assert (small.nrows, small.ncols) == (6, 6)
    by_col = {}
    for row, col in cells(small.T):
        by_col.setdefault(row, set()).add(col)
    assert by_col == {0: {1, 5}, 1: {3}, 2: {2}, 3: {4}, 4: {1, 5}, 5: {0, 3}}


def test_symmetric_small(spark, small):
    a = matrix(spark, [0, 5, 1, 1, 4, 3, 2, 3], [5, 0, 1, 4, 1, 2, 3, 3])
    assert a.is_symmetric() and not small.is_symmetric()
    # same degrees everywhere, still not symmetric
    assert not matrix(spark, [0, 1, 2], [1, 2, 0]).is_symmetric()
    assert small.symmetrize().is_symmetric()
    with pytest.raises(DimensionMismatch):
        Matrix(small.df, 6, 7).symmetrize()


def test_symmetrize_keeps_a_positions_own_value(spark):
    a = Matrix.build(spark, [0, 1], [1, 0], [5, 7], "long")
    assert cells(a.symmetrize()) == {(0, 1): 5, (1, 0): 7}


def test_scan_of_ten_thousand(spark):
    import random

    rng = random.Random(1)
    numbers = [rng.randrange(10) for _ in range(10_000)]
    got = values(scan.exclusive_scan(Vector.from_dense(spark, numbers, kind="long")))
    assert got == dict(enumerate([0, *itertools.accumulate(numbers)]))


def test_scan_of_nothing(spark):
    assert values(scan.exclusive_scan(Vector.from_pairs(spark, [], [], 0, "long"))) == {0: 0}


def test_build_keeps_or_folds_repeated_entries(spark):
    from pyspark.sql import functions as F

    assert matrix(spark, [0, 0], [1, 1]).nnz() == 2
    assert cells(matrix(spark, [0, 0], [1, 1], dup=F.sum("val"))) == {(0, 1): 20}


def test_errors(spark, small):
    v = Vector.filled(spark, 5, 1)
    with pytest.raises(DimensionMismatch):
        ops.mxv(small, v)
    with pytest.raises(NullPointer):
        ops.mxv(None, v)
    with pytest.raises(NullPointer):
        Matrix.build(spark, None, [], [])
    with pytest.raises(IndexOutOfBounds):
        Vector.from_pairs(spark, [5], [1.0], 5)
    with pytest.raises(IndexOutOfBounds):
        Vector.from_dense(spark, [1.0], 2)
    with pytest.raises(IndexOutOfBounds):
        v.set_element(1, 9)
    with pytest.raises(NoValue):
        Vector.from_pairs(spark, [0], [1.0], 5).get(3)
    with pytest.raises(InvalidValue):
        Descriptor(mask="sometimes")
    with pytest.raises(InvalidValue):
        alg.triangle_count(small, "guess")
    with pytest.raises(InvalidValue):
        alg.sssp(Matrix.build(spark, [0, 1], [1, 0], [-1, -1], "long"), 0)


def test_descriptor_toggles():
    assert Descriptor().toggle("mask") == C and S.toggle("mask") == SC == RSC
    assert Descriptor().toggle("replace").get("replace") is False


def test_sparse_build_holds_its_values(spark):
    v = Vector.from_pairs(spark, [1, 3], [2.0, 0.0], 5)
    assert v.nvals() == 1 and values(v) == {1: 2.0, 3: 0.0} and values(v.sparse()) == {1: 2.0}
    assert v.storage() == "sparse" and v.show() == "0.0 2.0 0.0 0.0 0.0"
    assert list(v) == [2.0, 0.0]
    assert Vector.filled(spark, 5, 1).storage() == "dense" and Vector.filled(spark, 5, 0).nvals() == 0


def test_vector_equality_has_a_tolerance(spark):
    a = Vector.from_dense(spark, [1.0, 2.0])
    assert a.equals(Vector.from_dense(spark, [1.0005, 2.0])) and not a.equals(Vector.from_dense(spark, [1.01, 2.0]))
    assert a.show_diff(Vector.from_dense(spark, [3.0, 2.0])).endswith("error_count: 1/2")


def test_matrix_lookup_and_text(small):
    assert small.get(0, 5) == 10 and small.get(0, 0) == 0 and small.is_non_zero(5, 0)
    assert small.show().splitlines()[0] == "0 0 0 0 0 10"
    assert small.same_structure(small.partitioned("col")) and not small.same_structure(small.T)


entries = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(-3, 3)), min_size=1, max_size=12)
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _of(spark, triples):
    df = spark.createDataFrame(triples, "row long, col long, val long")
    return Matrix.from_table(df, "row", "col", "val", 5, 5)


@few
@given(a=entries, b=entries)
def test_product_of_transposes(spark, a, b):
    x, y = _of(spark, a), _of(spark, b)
    left = cells(ops.mxm(x, y).T)
    assert left == cells(ops.mxm(y.T, x.T))
    dense = {(i, j): sum(p * q for r, k, p in a if r == i for m, c, q in b if m == k and c == j) for i in range(5) for j in range(5)}
    assert {(j, i): v for (j, i), v in left.items()} == {(j, i): v for (i, j), v in dense.items() if v}


@few
@given(a=entries, mask=st.sets(st.integers(0, 4)))
def test_mask_and_complement_make_the_whole(spark, a, mask):
    x, u = _of(spark, a), Vector.ascending(spark, 5)
    m = Vector.from_pairs(spark, sorted(mask), [1] * len(mask), 5, "long")
    inside, outside = values(ops.mxv(x, u, mask=m, desc=S)), values(ops.mxv(x, u, mask=m, desc=SC))
    assert not inside.keys() & outside.keys() and inside | outside == values(ops.mxv(x, u))


@few
@given(a=entries)
def test_vxm_is_mxv_of_the_transpose(spark, a):
    x, u = _of(spark, a), Vector.ascending(spark, 5)
    assert values(ops.vxm(u, x)) == values(ops.mxv(x.T, u))


@few
@given(a=st.dictionaries(st.integers(0, 9), st.integers(-5, 5)), b=st.dictionaries(st.integers(0, 9), st.integers(-5, 5)))
def test_addition_commutes(spark, a, b):
    u, v = (Vector.from_pairs(spark, list(x), list(x.values()), 10, "long") for x in (a, b))
    assert values(ops.ewise_add(u, v, al.PLUS)) == values(ops.ewise_add(v, u, al.PLUS))


def test_triangle_methods_agree(spark, sf):
    a = fx.co_purchase(spark, sf)
    counts = {m: alg.triangle_count(a, m).head()[0] for m in alg.TRIANGLE_METHODS}
    assert set(counts.values()) == {125968}


def test_bfs_is_unit_distance_plus_one(spark, sf):
    a = fx.co_purchase(spark, sf)
    levels = {r["idx"]: r["level"] for r in alg.bfs(a, 0).collect()}
    assert levels == {r["idx"]: r["dist"] + 1 for r in alg.sssp(a, 0).collect()}
    assert len(levels) == a.nrows


def test_deep_graph(spark):
    n = 40
    a = matrix(spark, list(range(n - 1)), list(range(1, n)), 1)
    assert {r["idx"]: r["level"] for r in alg.bfs(a, 0).collect()} == {i: i + 1 for i in range(n)}
    assert {r["label"] for r in alg.connected_components(a).collect()} == {0}


def test_pagerank_sums_to_one(spark, sf):
    for direction in ("reference", "standard"):
        ranks = alg.pagerank(fx.co_purchase(spark, sf), 10, direction=direction)
        assert abs(ranks.agg({"rank": "sum"}).head()[0] - 1) < 1e-9
    assert alg.pagerank(fx.co_purchase(spark, sf), 100, tolerance=1.0).count() == 200


def test_label_bijection(spark):
    a = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "idx long, label long")
    b = spark.createDataFrame([(0, 5), (1, 5), (2, 9)], "idx long, label long")
    c = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "idx long, label long")
    assert alg.label_bijection(a, b).head()[0] == 1 and alg.label_bijection(a, c).head()[0] == 0


def test_empty_graph(spark):
    a = Matrix.build(spark, [], [], [], "long")
    assert alg.triangle_count(a).head()[0] in (None, 0)
    assert alg.connected_components(a).count() == 0 and alg.pagerank(a).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_reach_below_the_aggregate(spark, sf):
    u = fx.part_size(spark, sf)
    mask = fx.supplier_nation(spark, sf)
    text = plan(ops.mxv(fx.supplier_part(spark, sf), u, mask=mask).df)
    assert text.index("Aggregate") < text.index("LeftSemi")


@pytest.mark.parametrize("desc", [S, SC])
def test_masks_lie_below_the_product_without_broadcasts(spark, sf, desc):
    """What a mask holds back is not multiplied, however large the mask is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kind = "LeftAnti" if desc.complemented else "LeftSemi"
    try:
        a, u, mask = fx.supplier_part(spark, sf), fx.part_size(spark, sf), fx.supplier_nation(spark, sf)
        edges = Matrix(a.df.where("val > 1"), a.nrows, a.ncols)
        for product in (ops.mxv(edges, u, mask=mask, desc=desc), ops.vxm(u, edges.T, mask=mask, desc=desc)):
            text = plan(product.df)
            assert text.index("Aggregate") < text.index("Inner") < text.index(kind)
        b = fx.co_purchase(spark, sf)
        text = plan(ops.mxm(b, b, mask=b, desc=S).df)
        # no join on k alone: every product is looked up at a position of the mask
        assert not re.search(r"Join Inner, \(k#\d+L = k#\d+L\)", text) and "LeftSemi" not in text
        assert len(re.findall(r"Join Inner, \(\(k#\d+L = k#\d+L\) AND", text)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_zeros_of_products(spark):
    """Under min-plus 0 is a value; under plus-times it is what is absent, unless asked for."""
    a = Matrix.build(spark, [0, 1, 1], [1, 0, 1], [0, 0, 2], "long")
    assert cells(ops.mxm(a, a, al.MIN_PLUS)) == {(0, 0): 0, (0, 1): 2, (1, 0): 2, (1, 1): 0}
    assert cells(ops.mxm(a, a)) == {(1, 1): 4}
    assert cells(ops.mxm(a, a, keep_zeros=True)) == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 4}


def test_distances_keep_the_type_of_weights(spark):
    a = Matrix.build(spark, [0, 1, 0], [1, 2, 2], [0.4, 0.4, 0.9], "double")
    tenths = a.with_df(a.df.withColumn("val", F.col("val").cast("decimal(10,2)")))
    for method in alg.SSSP_METHODS:
        assert {r["idx"]: str(r["dist"]) for r in alg.sssp(tenths, 0, method=method).collect()} == {0: "0.00", 1: "0.40", 2: "0.80"}
    with pytest.raises(InvalidValue):
        alg.sssp(a, 0, method="guess")


def test_unfinished_components_are_an_error(spark):
    path = Matrix.build(spark, list(range(40)), list(range(1, 41)), [1] * 40, "long")
    with pytest.raises(InvalidValue):
        alg.connected_components(path, most=1)
    assert {r["label"] for r in alg.connected_components(path).collect()} == {0}


def test_unread_values_are_pruned(spark, sf):
    text = ops.mxv(Matrix.from_table(fx.table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", 10, 200), fx.part_size(spark, sf), al.PLUS_PAIR).df
    assert "l_quantity" not in text._jdf.queryExecution().executedPlan().toString()


def test_products_stay_in_generated_code(spark, sf):
    text = ops.mxv(fx.supplier_part(spark, sf), fx.part_size(spark, sf)).df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "ArrowEval" not in text


def test_standard_names(spark, small):
    from gridloom.operators import standard as grb

    u = Vector.ascending(spark, 6)
    w = grb.GrB_mxv(None, None, None, al.PLUS_TIMES, small, u)
    assert values(w) == {0: 50, 1: 40, 2: 20, 3: 60, 4: 30, 5: 40}
    assert values(grb.GrB_vxm(None, None, None, al.PLUS_TIMES, u, small.T)) == values(w)
    assert values(grb.GrB_eWiseAdd(w, None, al.PLUS, al.MIN, u, u)) == {i: v + i for i, v in values(w).items()}
    assert values(grb.GrB_assign(u, None, None, 9, [1])) == {0: 0, 1: 9, 2: 2, 3: 3, 4: 4, 5: 5}
    assert values(grb.GrB_assign(u, None, None, u, [5, 4, 3, 2, 1, 0])) == {i: 5 - i for i in range(6)}
    assert values(grb.GrB_extract(None, None, None, u, [4, 4])) == {0: 4, 1: 4}
    assert grb.GrB_reduce(100, al.PLUS, al.PLUS_MONOID, u) == 115
    assert cells(grb.GrB_select(None, None, None, lambda x, i, j, t: j > i, small, 0)) == {(0, 5): 10, (1, 4): 10, (3, 5): 10}
    assert grb.GrB_Vector_nvals(grb.GrB_Vector_new(spark, 3)) == 0 and grb.GrB_Matrix_nvals(grb.GrB_Matrix_new(spark, 2, 3)) == 0
    assert al.TYPED_NAMES["LAGraph_plus_one_int64"] is al.PLUS_PAIR


def test_lists_and_random_values(spark):
    a = Matrix.from_lists(spark, [[(1, 5), (0, 2)], [], [(2, 7)]], "long")
    assert cells(a) == {(0, 1): 5, (0, 0): 2, (2, 2): 7} and a.nrows == 3
    assert [tuple(e) for e in a.lists().where("row = 0").head()["entries"]] == [(0, 2), (1, 5)]
    v = ops.apply(al.set_random(4), Vector.ascending(spark, 50))
    assert all(0 <= x < 1 for x in values(v).values())
    assert all(2 <= x < 3 for x in values(Vector.random(spark, 50, 1, 2, 3)).values())


def test_timing_units(spark):
    from gridloom.plans.stats import Timing, timed

    t = Timing("x", 2.0, 4_000_000, 10)
    assert (t.mteps, t.gflops, t.gbytes) == (20.0, 0.04, 0.48)
    assert timed("count", spark.range(10), 10).row()["nnz"] == 10


def test_settled_edges_do_not_move(spark, sf):
    from gridloom.plans.iterate import settled

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = fx.co_purchase(spark, sf)
        edges = a.with_df(settled(a.df, "col", "settled"))
        text = ops.mxv(edges, fx.part_size(spark, sf), al.PLUS_SECOND).df._jdf.queryExecution().executedPlan().toString()
        join = text[text.index("Join") :]
        assert join.count("Exchange hashpartitioning(col") == 1 and "Bucketed: true" in text
        # a hub outweighs a bucket: its edges stay a plain table that Spark may split
        star = matrix(spark, list(range(1, 60)), [0] * 59, 1)
        assert not hasattr(settled(star.df, "col", "settled"), "shared_table")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
