"""FM-index substring dedup against a plain version."""

import random

import numpy as np
import plain
import pytest

from gridloom.llm import substring
from gridloom.llm.fm_index import Bits, FmIndex, WaveletMatrix
from gridloom.llm.substring import dedup_substrings, first_documents, window_anchors


def result(df):
    return {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in df.collect()}


def test_documents_equal_the_plain_version(spark, documents):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert result(dedup_substrings(df, 13)) == plain.dedup_substrings(documents, 13)


@pytest.mark.parametrize("hot", [0, 5, 10**9])
def test_shared_passages(spark, monkeypatch, hot):
    """Passages in many documents, near copies, tiny vocabularies, texts around the window's length; hot homes split or not."""
    monkeypatch.setattr(substring, "HOT_ANCHORS", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for n in range(60):
        own = [f"d{n}x{i}" for i in range(rng.randrange(0, 60))]
        cut = rng.randrange(0, 30)
        docs.append((rng.randrange(10**6), " ".join(own[:20] + passage[cut : cut + rng.randrange(5, 30)] + own[20:])))
    docs += [(2_000_000 + n, " ".join(rng.choices(["a", "b"], k=rng.randrange(8, 60)))) for n in range(30)]
    docs += [(3_000_000 + n, " ".join(passage[:n])) for n in range(10, 16)]
    docs = list(dict(docs).items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for window in (13, 5):
        assert result(dedup_substrings(df, window)) == plain.dedup_substrings(docs, window)


def test_long_passages_are_cut(spark, monkeypatch):
    """Copies of long texts, of one word again and again too, whose windows all lie in one passage."""
    monkeypatch.setattr(substring, "PASSAGE_WINDOWS", 7)
    rng = random.Random(6)
    own = [f"w{i}" for i in range(300)]
    docs = [(5, " ".join(own)), (3, " ".join(own[40:250])), (9, " ".join(own[100:] + own[:50])), (7, "same " * 200), (4, "same " * 90), (8, " ".join(rng.choices("ab", k=200)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(dedup_substrings(df, 13)) == plain.dedup_substrings(docs, 13)


def test_odd_rows(odd_docs, no_docs):
    got = dedup_substrings(odd_docs, 5)
    assert got.columns == [c for c in odd_docs.columns if c not in ("text", "n_words")] + ["text", "n_words", "n_removed"]
    rows = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()), key=repr)
    assert rows == sorted([(1, 7, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 120_000, 0), (6, 7, 7), (6, 7, 7), (None, 7, 0), (7, 3, 0)], key=repr)
    assert dedup_substrings(no_docs).count() == 0


@pytest.mark.parametrize("chance", [0.0, 0.01, 0.5, 1.0])
def test_bits_rank_and_select(chance):
    """Sparse, dense, mixed bits, with runs that fill words and superblocks."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        bits = rng.random(n) < chance
        bits[n // 3 : n // 2] = True
        packed = Bits(bits)
        assert (packed.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (packed.select(np.arange(packed.ones)) == np.flatnonzero(bits)).all()


def test_wavelet_rank_and_least():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 37, 500)
    matrix = WaveletMatrix(values, 36)
    symbols, ends = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    assert (matrix.rank(symbols, ends) == [(values[:e] == s).sum() for s, e in zip(symbols, ends, strict=True)]).all()
    lo = rng.integers(0, 500, 200)
    hi = np.minimum(lo + rng.integers(1, 20, 200), 500)
    assert (matrix.least(lo, hi) == [values[a:b].min() for a, b in zip(lo, hi, strict=True)]).all()


@pytest.mark.parametrize("letters", [2, 4, 30])
def test_matching_statistics(letters):
    """Lengths, intervals and least owners of texts that the index holds, holds in part, and does not know."""
    rng = np.random.default_rng(letters)
    parts = [rng.integers(1, letters, n) for n in (300, 200, 5, 1, 60)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    owner = np.repeat(np.arange(len(parts))[::-1], [len(p) + 1 for p in parts])
    depth = 6
    index = FmIndex(text, owner, depth)
    query = np.concatenate([text[40:90], rng.integers(0, letters + 3, 200), parts[1]])
    starts = np.array([0, 30, 150, 300])
    counts = np.array([30, 120, 150, len(query) - 300])
    length, lo, hi = index.matching_statistics(query, starts, counts)
    held = {}
    for i in range(len(text)):
        for n in range(1, depth + 1):
            piece = tuple(text[i : i + n])
            if len(piece) == n and 0 not in piece:
                held.setdefault(piece, []).append(owner[i])
    for i in range(len(query)):
        end = min(starts[starts <= i][-1] + counts[starts <= i][-1] + depth - 1, len(query))
        longest = max((n for n in range(1, depth + 1) if i + n <= end and tuple(query[i : i + n]) in held), default=0)
        assert length[i] == longest
        if longest == depth:
            owners = held[tuple(query[i : i + depth])]
            assert hi[i] - lo[i] == len(owners)
            assert index.least_owner(lo[i : i + 1], hi[i : i + 1]) == min(owners)


def test_index_is_smaller_than_its_text():
    """Repeated passages cost little: the transform's runs are not stored."""
    rng = np.random.default_rng(5)
    passage = rng.integers(1, 5000, 2000)
    text = np.concatenate([np.append(passage, 0) for _ in range(40)])
    index = FmIndex(text, np.repeat(np.arange(40), 2001), 13)
    assert index.nbytes() < text.nbytes


def test_first_documents_of_one_passage():
    h = np.arange(20, dtype=np.uint64)
    assert first_documents([h, h[3:]], np.array([7, 4]), 13) == [[(0, 2, 7), (3, 7, 4)], [(0, 4, 4)]]


def test_anchor_of_a_window_depends_on_its_words_alone():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 60, dtype=np.int64).view(np.uint64) for _ in range(2))
    joined = np.concatenate([b[:17], a])
    assert (window_anchors(joined, 13)[17:] == window_anchors(a, 13)).all()
    assert len(window_anchors(a[:12], 13)) == 0 and len(window_anchors(a[:3], 2)) == 2
