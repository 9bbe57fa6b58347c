"""SetSketch near-dedup against all pairs."""

import random

import numpy as np
import pytest
from plain import near_components

from gridloom.llm import minhash
from gridloom.llm.minhash import SketchConfig, estimate, may_pass, near_duplicates, sketch


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_documents_equal_all_pairs(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    for k in (2, 5):
        got = near_duplicates(df, words=k, percent=80)
        assert result(got) == near_components(documents, k, 80)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_edited_copies_equal_all_pairs(spark):
    """Groups around a base with more and more edits: pairs on both sides of the threshold, chains, exact copies."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for group in range(4):
        base = rng.choices(vocabulary, k=120)
        for n in range(60):
            copy = list(base)
            for _ in range(rng.randrange(0, 14)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((1000 * group + n, " ".join(copy)))
        docs += [(1000 * group + 500 + n, " ".join(base)) for n in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert result(near_duplicates(df, words=2, percent=80)) == near_components(docs, 2, 80)


@pytest.mark.parametrize("rows, shingles, size", [(4, 1 << 20, 1 << 25), (128, 400, 100)])
def test_blocks_of_strangers(spark, monkeypatch, rows, shingles, size):
    """Small blocks, by rows or by shingles and bytes: strangers and members of a bucket fall into several."""
    monkeypatch.setattr(minhash, "BLOCK", rows)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for n in range(60):
        copy = list(base)
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
        docs.append((n, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(near_duplicates(df, words=2, percent=80)) == near_components(docs, 2, 80)


def test_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in near_duplicates(odd_docs, words=5).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 6, 5, True), (6, 3, 1, False), (6, 3, 1, False), (None, 3, None, False), (7, 1, 7, True)], key=repr
    )
    assert near_duplicates(no_docs).count() == 0


def sets_of(similarity, n, rng):
    shared = int(similarity * n)
    rest = (n - shared) // 2
    values = rng.integers(0, 2**63, shared + 2 * rest, dtype=np.int64).view(np.uint64)
    return np.unique(np.concatenate([values[:shared], values[shared : shared + rest]])), np.unique(np.concatenate([values[:shared], values[shared + rest :]]))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    config = SketchConfig()
    for similarity in (0.2, 0.5, 0.8, 0.95):
        pairs = [sets_of(similarity, 800, rng) for _ in range(30)]
        k = [sketch([p[i] for p in pairs], config).astype(int) for i in (0, 1)]
        n = [np.array([len(p[i]) for p in pairs], float) for i in (0, 1)]
        best = estimate(*k, *n, config.base)[2]
        assert abs(best.mean() - similarity) < 0.03
        passed = may_pass(*k, *n, config.base, 0.8)
        assert passed.all() if similarity >= 0.8 else True
        assert not passed.any() if similarity <= 0.2 else True


def test_sketches_merge_by_maximum():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)) for _ in range(2))
    config = SketchConfig()
    union = sketch([np.union1d(a, b)], config)
    assert (np.maximum(*sketch([a, b], config)) == union[0]).all()
    # a set that spans several pieces of work
    big = np.unique(rng.integers(0, 2**63, 200_000, dtype=np.int64).view(np.uint64))
    halves = sketch([big[:100_000], big[100_000:]], config)
    assert (np.maximum(*halves) == sketch([big], config)[0]).all()


def test_registers_are_exponentially_spaced():
    """Ten times the elements move a register up by log_b(10) on average."""
    rng = np.random.default_rng(3)
    config = SketchConfig(base=1.2, bands=100, rows=5)
    small, large = (sketch([rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)], config).mean() for n in (1000, 10_000))
    assert abs((large - small) - np.log(10) / np.log(1.2)) < 1.5
