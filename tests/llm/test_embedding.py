"""Vector links against all pairs, and exact top-k on odd rows."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from plain import components
from pyspark.sql import functions as F

from gridloom.llm import embedding, topk
from gridloom.llm.embedding import _pairs_at, distance, fit_tables, flips, learn_rotations, near_vectors, plan_tables
from gridloom.llm.topk import exact_top_k


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'c' as key", "1 as id", "2 as t", "3 as label")


def brute(x):
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    linked = np.triu(x @ x.T >= 0.95, 1)
    return linked.sum(0) + linked.sum(1), components(range(len(x)), list(zip(*np.nonzero(linked), strict=True)))


def clustered(n=400, d=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for c in range(10):
        x[20 * c : 20 * c + 20] = x[20 * c] + rng.standard_normal((20, d)) * rng.uniform(0.01, 0.3)
    return x


@pytest.mark.parametrize("block", [3, 1024])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    """Recall at least 0.9 of the links, none too many; blocks cut buckets or hold them whole."""
    monkeypatch.setattr(embedding, "BLOCK", block)
    monkeypatch.setattr(embedding, "SMALL", 4)
    x = clustered()
    degree, component = brute(x)
    got = {r["vec_id"]: r for r in near_vectors(frame(spark, x)).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= degree).all() and found.sum() >= 0.9 * degree.sum()
    same = sum(got[i]["component_id"] == component[i] for i in range(len(x)))
    assert same >= 0.95 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_query_recall(spark, sf):
    import pyarrow.parquet as pq

    x = np.array(pq.read_table(f"{sf}/embeddings.parquet")["embedding"].to_pylist())
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    # the table itself holds no link, so copies turned by a little stand beside it
    rng = np.random.default_rng(8)
    near = np.concatenate([x + rng.standard_normal(x.shape) * np.linalg.norm(x, axis=1)[:, None] * e for e in (0.02, 0.036)])
    beside = spark.createDataFrame([(10**6 + i, v) for i, v in enumerate(near.tolist())], "vec_id long, embedding array<float>")
    for df, rows, links in ((table, x, 0), (table.select("vec_id", F.col("embedding").cast("array<float>")).union(beside), np.concatenate([x, near]), 2 * len(x))):
        degree, _ = brute(rows)
        got = near_vectors(df).toPandas()
        assert degree.sum() >= links and len(got) == len(rows)
        assert 0.94 * degree.sum() <= got.n_links.sum() <= degree.sum()


@pytest.mark.parametrize("share", [0.0, 0.7, 0.9])
def test_recall_at_the_threshold_with_a_shared_mean(spark, share):
    """Pairs of cosine 0.95 to 0.97 whose vectors all share a direction are found as planned."""
    x, y = pairs(3000, 64, share)
    got = near_vectors(frame(spark, np.concatenate([x, y]))).toPandas().set_index("vec_id")
    degree, _ = brute(np.concatenate([x, y]))
    assert (got.n_links.sort_index().to_numpy() <= degree).all()
    assert got.n_links.sum() >= 0.94 * degree.sum()


def pairs(n, d, share, seed=3):
    """Two rows of n unit vectors around a mean of norm ``share``, at cosine 0.951 to 0.97 from each other."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.sqrt((1 - share**2) / d)
    x[:, 0] += share
    x /= np.linalg.norm(x, axis=1)[:, None]
    step = rng.standard_normal((n, d))
    step -= (step * x).sum(1)[:, None] * x
    step /= np.linalg.norm(step, axis=1)[:, None]
    cosine = rng.uniform(0.951, 0.97, n)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * step


def met(plan, a, b):
    """Which pairs meet in a table and are near by the code."""
    within = np.bitwise_count(plan.keys(a) ^ plan.keys(b)) <= plan.radius
    return within.any(1) & (distance(plan.codes(a), plan.codes(b)) <= plan.most)


@pytest.mark.parametrize("dims", [64, 384])
@pytest.mark.parametrize("shared", [0.0, 0.3, 0.5, 0.7, 0.8, 0.9])
def test_tables_reach_the_recall_measured(monkeypatch, shared, dims):
    """Pairs at the threshold that the plan has not seen meet as often as wanted; ``shared`` is the cosine of unrelated vectors."""
    monkeypatch.setattr(embedding, "SAMPLE_ROWS", 2000)
    x, _ = pairs(8000, dims, np.sqrt(shared))
    for n in (10_000, 1_000_000):
        plan = fit_tables(x[:4000], n, 0.95, iterations=5)
        (a, b), *_ = _pairs_at(x[4000:], 0.95, seed=11)
        assert met(plan, a, b).mean() >= embedding.RECALL - 0.02 and plan.width >= 4


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_a_wider_radius_finds_the_same_links(spark, monkeypatch, radius):
    """Every pair is counted once, whatever the tables and buckets it meets in."""
    x = clustered()
    degree, component = brute(x)
    plan = fit_tables(embedding._matrix(pa.array(list(x.astype(np.float32)))), 400, 0.95)
    assert set(flips(5, radius)) == {k for k in range(32) if k.bit_count() <= radius}
    monkeypatch.setattr(embedding, "fit_tables", lambda *_: replace(plan, radius=radius))
    got = near_vectors(frame(spark, x)).toPandas().set_index("vec_id").n_links.sort_index().to_numpy()
    assert (got <= degree).all() and got.sum() >= 0.95 * degree.sum()


def test_every_length_is_searched(spark):
    """A third of the rows with another length, and rows of one component, link as the rest do."""
    rng = np.random.default_rng(4)
    groups = [[x + rng.standard_normal(d) * 0.01 for x in rng.standard_normal((n, d)) for _ in (0, 1)] for d, n in ((16, 20), (12, 10))]
    vectors = [v for g in groups for v in g] + [[1.0], [2.0], [-1.0], [-3.0], [5.0], [1.0, 0.0, 0.0]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(frame(spark, vectors)).collect()}
    assert [got[i] for i in range(60)] == [(1, i - i % 2) for i in range(60)]
    assert [got[i] for i in range(60, 66)] == [(2, 60), (2, 60), (1, 62), (1, 62), (2, 60), (0, 65)]


def test_odd_vectors(spark):
    one = np.eye(8)[0]
    vectors = [one, one, None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], one * 3e38, one * 1e-40, [1.0, 0.0]]
    df = frame(spark, vectors)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    for i in (0, 1, 8, 9):
        assert got[i] == (3, 0, i == 0)
    for i in (2, 3, 4, 5, 6, 7, 10):
        assert got[i] == (0, i, True)
    assert near_vectors(df.where("false")).count() == 0
    twice = {(r["vec_id"], r["n_links"]) for r in near_vectors(frame(spark, [one, one, one], [5, 5, None or 7])).collect()}
    assert twice == {(5, 2), (7, 2)}


def test_copies_are_not_compared(spark):
    got = near_vectors(frame(spark, [[1.0, 2.0, 3.0, 4.0]] * 3000)).agg({"n_links": "min", "component_id": "max"}).head()
    assert got[:] == (2999, 0) or got[:] == (0, 2999)


def test_rotations_balance_bits():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16)) * np.linspace(0.2, 3, 16)
    mean, projection = learn_rotations(x, 2)
    assert projection.shape == (16, 32)
    assert abs(((x - mean) @ projection >= 0).mean(0) - 0.5).max() < 0.1
    assert np.allclose(projection[:, :16].T @ projection[:, :16], np.eye(16))


def test_tables_follow_the_recall():
    for n in (500, 10**5, 10**9):
        width, tables, codes = plan_tables(n, 64, 0.95)
        agree = (1 - np.arccos(0.95) / np.pi) ** width
        assert 1 - (1 - agree) ** tables >= embedding.RECALL and codes * (64 // width) >= tables


def scores(x):
    return np.floor(x.astype(np.float32).astype(np.float64) * 64).astype(np.int64)


@pytest.mark.parametrize("sparse", [0.0, 0.97])
def test_top_k_equals_sorting(spark, monkeypatch, sparse):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 11)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (150, 12)) / 8  # many ties
    x[rng.random(x.shape) < sparse] = 0
    df = frame(spark, x).repartition(3)
    got = {}
    for r in exact_top_k(df.where("vec_id % 5 = 0"), df, 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    s = scores(x) @ scores(x).T
    for q in range(0, 150, 5):
        want = sorted((i for i in range(150) if i != q), key=lambda i: (-s[q, i], i))[:7]
        assert got[q] == {n + 1: (i, s[q, i]) for n, i in enumerate(want)}


def test_top_k_odd_rows(spark):
    df = frame(spark, [[1, 2], None, [float("nan"), 1], [None, 1], [3], [0, 0], []])
    rows = exact_top_k(df, df, 20).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in rows} == {(a, b, s) for a, b, s in [(0, 4, 192 * 64), (0, 5, 0), (0, 6, 0), (4, 0, 192 * 64), (4, 5, 0), (4, 6, 0), (5, 0, 0), (5, 4, 0), (5, 6, 0), (6, 0, 0), (6, 4, 0), (6, 5, 0)]}
    assert exact_top_k(df.where("false"), df).count() == 0 and exact_top_k(df, df.where("false")).count() == 0
    repeated = frame(spark, [[1, 1], [2, 2], [2, 2]], [0, 1, 1])
    assert [(r["rank"], r["vec_id"]) for r in exact_top_k(repeated.where("vec_id = 0"), repeated, 5).orderBy("rank").collect()] == [(1, 1), (2, 1)]
