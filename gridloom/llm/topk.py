"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer term weights. Candidates form blocks with a postings
list per term; in a block every nonzero term of a query row scatters its
weighted postings into a dense score array; the k best of each block are
selected by partition and the blocks' lists are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates and of queries: they bound a task's memory.
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 2048
#: Query rows scored at once: with a block's scores they fit a core's cache.
SCORED_ROWS = 16
#: A postings list with this share of a block's candidates is kept with its zeros and added without a scatter.
DENSE = 0.1


def usable(vector: Column) -> Column:
    """Not null, no null and no non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _blocked(df: DataFrame, n: int, block: str, other: int, other_block: str) -> DataFrame:
    """Rows dealt evenly to n blocks, each copied for every block of the other side."""
    at = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    return df.withColumn(block, at).withColumn(other_block, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))


def _weights(col: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) as a matrix; shorter vectors end in zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    out = np.zeros((len(col), width), np.int64)
    flat = np.floor(np.asarray(col.flatten()).astype(np.float64) * scale).astype(np.int64)
    lengths = np.diff(np.asarray(col.offsets))
    rows = np.repeat(np.arange(len(col)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of query rows against a block, one term at a time."""
    scores = np.zeros((len(queries), n), postings[0][1].dtype if postings else np.int64)
    add = np.empty_like(scores)
    for t, (at, weights) in enumerate(postings):
        rows = np.flatnonzero(queries[:, t])
        if not len(rows) or not len(at):
            continue
        if len(at) == n:
            # a zero weight adds nothing, so rows and candidates that lack the term may go along
            np.multiply(queries[:, t].astype(scores.dtype)[:, None], weights[None, :], out=add)
            scores += add
        else:
            scores[np.ix_(rows, at)] += queries[rows, t].astype(scores.dtype)[:, None] * weights[None, :]
    return scores


def _best_in_block(query_ids, query_rows, q, ids, c, k: int):
    """(query row, query id, vec_id, score) of the k best of the block for each query row."""
    order = np.argsort(ids, kind="stable")
    ids, c = ids[order], c[order]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.int32 if bound < 2**31 - 1 else np.int64
    postings = []
    for column in c.T.astype(kind):
        at = np.flatnonzero(column)
        postings.append((at, column[at]) if len(at) < DENSE * len(column) else (np.arange(len(column)), np.ascontiguousarray(column)))
    found = []
    for lo in range(0, len(q), SCORED_ROWS):
        scores = _accumulate(q[lo : lo + SCORED_ROWS], postings, len(ids))
        for i, row in enumerate(scores):
            own = slice(np.searchsorted(ids, query_ids[lo + i]), np.searchsorted(ids, query_ids[lo + i], "right"))
            others = np.ones(len(ids), bool)
            others[own] = False
            n = int(others.sum())
            if n > k:
                rest = row[others]
                others &= row >= np.partition(rest, n - k)[n - k]
            at = np.flatnonzero(others)
            at = at[np.lexsort((ids[at], -row[at].astype(np.int64)))[:k]]
            found.append((np.full(len(at), query_rows[lo + i]), np.full(len(at), query_ids[lo + i]), ids[at], row[at].astype(np.int64)))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products.

    Both tables hold vec_id and embedding; a candidate with the query's own
    vec_id is left out; ties go to the smaller vec_id; fewer candidates than k
    give all. Vectors (or vec_ids) that are null, or hold null or non-finite
    components, take no part; shorter vectors end in zeros. A repeated query
    row gets its own k rows, repeated candidates rank one after another. Empty
    tables give an empty result; other columns are not read.

    Both sides are dealt to blocks of bounded size and every pair of blocks is
    one group, so a task's memory does not depend on the input.
    """
    q, c = (df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding") for df in (queries, candidates))
    n_q, width_q = q.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).head()
    n_c, width_c = c.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).head()
    blocks_q, blocks_c = max(1, math.ceil(n_q / QUERY_BLOCK)), max(1, math.ceil(n_c / CANDIDATE_BLOCK))
    width = max(width_q, width_c)
    q = _blocked(q.withColumn("qrow", F.monotonically_increasing_id()), blocks_q, "bq", blocks_c, "bc")
    c = _blocked(c, blocks_c, "bc", blocks_q, "bq")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qrow", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        best = _best_in_block(
            left["vec_id"].to_numpy(), left["qrow"].to_numpy(), _weights(left["embedding"], width, scale), right["vec_id"].to_numpy(), _weights(right["embedding"], width, scale), k
        )
        return pa.table(dict(zip(names, map(pa.array, best), strict=True)))

    partial = q.groupBy("bq", "bc").cogroup(c.groupBy("bq", "bc")).applyInArrow(cell, "qrow long, query_id long, vec_id long, score long")
    place = Window.partitionBy("qrow", "query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
