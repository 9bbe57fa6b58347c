"""Near-duplicate vectors by iterative quantisation.

A rotation learned for balanced binary codes (several, from different starts)
turns each vector into bits. Substrings of the codes index Hamming tables, which
are searched within a radius of differing bits; who meets there and is near by
the whole code is reranked by the cosine of the original vectors. Radius, width,
number of tables and the code's limit follow from pairs at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, release, whole_groups
from gridloom.llm.components import connected_components, local_roots
from gridloom.llm.topk import usable

#: Rows that the rotations are learned from, and as many more that their recall is measured on; every row is indexed.
SAMPLE_ROWS = 8192
#: Wanted chance that a pair at the threshold shares a bucket.
RECALL = 0.95
#: Sample pairs at the threshold on which the recall of the tables is measured.
PAIRS = 8192
#: With more tables than this the substrings get shorter, down to LEAST_WIDTH bits; the recall stays.
MOST_TABLES = 64
LEAST_WIDTH = 4
#: Differing bits within which a substring is searched, at most.
MOST_RADIUS = 2
#: Bits of the code by which candidates are judged before their vectors are read.
CODE_BITS = 256
#: Share of pairs at the threshold that the code's limit lets through; the tables make up for the rest.
CODE_PASS = 0.998
#: Bucket rows compared at once; larger buckets are cut to pairs of blocks.
BLOCK = 1024
#: Rows gathered before their groups are compared.
GATHER = 8192
#: Groups up to this size are compared together.
SMALL = 32


def _rotations(centred: np.ndarray, iterations: int, seed: int) -> Iterator[np.ndarray]:
    """Rotations of d x d without end, MOST_TABLES of them learned, then random ones.

    Iterative quantisation: from a random rotation of the principal axes,
    alternately take the signs and the rotation that fits them best.
    """
    d = centred.shape[1]
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1] if len(centred) else np.eye(d)
    v = centred @ axes
    rng = np.random.default_rng(seed)
    for code in count():
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(iterations if len(centred) and code < MOST_TABLES else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        yield axes @ r


def learn_rotations(sample: np.ndarray, codes: int, iterations: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): one projection of d x (codes * d) whose signs are the bits."""
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    return mean, np.concatenate(list(islice(_rotations(sample - mean, iterations, seed), codes)), 1)


def plan_tables(n: int, dims: int, threshold: float, width: int | None = None, radius: int = 0) -> tuple[int, int, int]:
    """(width, tables, codes): bits of a substring, how many substrings, codes they are cut from.

    The width follows the logarithm of the rows, so buckets stay small; the
    number of tables follows from the chance that a pair at the threshold
    differs in at most ``radius`` of that many bits of a random rotation. These
    are the fewest tables; fit_tables() adds those that centring costs.
    """
    width = width or min(max(LEAST_WIDTH, math.ceil(math.log2(max(n, 2)))), 31, dims)
    differ = math.acos(threshold) / math.pi
    meet = sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(min(radius, width) + 1))
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1 - meet, 1e-9))))
    return width, tables, math.ceil(tables / (dims // width))


def flips(width: int, radius: int) -> list[int]:
    """Every pattern of at most ``radius`` of ``width`` bits, none first."""
    return [sum(1 << b for b in bits) for k in range(min(radius, width) + 1) for bits in combinations(range(width), k)]


@dataclass(frozen=True)
class Tables:
    """Hamming tables: ``tables`` substrings of ``width`` bits, searched within ``radius`` bits, of codes whose limit is ``most`` bits."""

    width: int
    tables: int
    radius: int
    mean: np.ndarray
    projection: np.ndarray  # its signs are the substrings' bits, side by side
    code: np.ndarray  # its signs are the bits of the code
    most: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Substrings of unit rows, one column for each table."""
        places = 1 << np.arange(self.width, dtype=np.int64)
        return ((((x - self.mean) @ self.projection) >= 0).reshape(len(x), self.tables, self.width) @ places).astype(np.int32)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Packed codes of unit rows."""
        bits = np.packbits((x - self.mean) @ self.code >= 0, axis=1, bitorder="little")
        return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view("<i8")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of packed codes."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(-1, dtype=np.int64)


def _pairs_at(sample: np.ndarray, threshold: float, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of the sample, and others at cosine ``threshold`` from them.

    One kind differs in any direction, the other in directions in which vectors
    of the sample differ. Copies in the sample count once.
    """
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    x = sample[rng.permutation(max(len(sample), PAIRS))[:PAIRS] % len(sample)]
    found = []
    for step in (rng.standard_normal(x.shape), np.subtract(*sample[rng.integers(0, len(sample), (2, len(x)))])):
        step -= (step * x).sum(1, keepdims=True) * x
        norm = np.sqrt((step * step).sum(1))
        ok = norm > 1e-9
        if ok.any():
            found.append((x[ok], threshold * x[ok] + math.sqrt(1 - threshold * threshold) * step[ok] / norm[ok, None]))
    return found or [(x, x)]


def fit_tables(sample: np.ndarray, n: int, threshold: float, iterations: int = 50, seed: int = 5) -> Tables:
    """The Hamming tables of least work that find RECALL of sample pairs at the threshold.

    plan_tables() knows the angle of the vectors, but bits are those of centred
    vectors, whose angle is wider where all share a direction. So tables are
    added until enough pairs meet in one and are near by the code; rotations
    fit the SAMPLE_ROWS that they are learned from better than others, so where
    the sample has more rows those must reach it too. A wider radius needs
    fewer tables but more entries and candidates in each; of the radii for which
    MOST_TABLES suffice that with the fewest entries and candidates is taken,
    and only where there is none the substrings get shorter.
    """
    learned, others = sample[:SAMPLE_ROWS], sample[SAMPLE_ROWS:]
    dims = sample.shape[1]
    mean = learned.mean(0)
    pairs = [pair for part in (learned, others) if len(part) for pair in _pairs_at(part, threshold)]
    more = _rotations(learned - mean, iterations, seed)
    rotations: list[np.ndarray] = []
    differ: list[list[np.ndarray]] = []  # by code and kind of pairs: bits that differ

    def bits(code: int) -> list[np.ndarray]:
        while code >= len(rotations):
            r = next(more)
            rotations.append(r)
            differ.append([((x - mean) @ r >= 0) != ((y - mean) @ r >= 0) for x, y in pairs])
        return differ[code]

    apart = [d[:, :CODE_BITS].sum(1) for d in bits(0)]
    most = int(max(np.quantile(d, CODE_PASS, method="higher") for d in apart))
    widest = plan_tables(n, dims, threshold)[0]
    for width in range(widest, 0, -1):
        per_code, least_wide = dims // width, width <= min(LEAST_WIDTH, widest)
        plans = []
        for radius in range(MOST_RADIUS + 1):
            least, volume = plan_tables(n, dims, threshold, width, radius)[1], len(flips(width, radius))
            met = [np.zeros(len(x), bool) for x, _ in pairs]
            for tables in count(1):
                if tables > max(least, MOST_TABLES) and not (least_wide and not radius):
                    break
                code, place = divmod(tables - 1, per_code)
                for kind, d in zip(met, bits(code), strict=True):
                    kind |= d[:, place * width : (place + 1) * width].sum(1) <= radius
                if tables >= least and min((kind & (d <= most)).mean() for kind, d in zip(met, apart, strict=True)) >= min(RECALL, CODE_PASS):
                    plans.append((tables * volume * (1 + n / 2**width), tables, radius))
                    break
        if plans:
            _, tables, radius = min(plans)
            columns = [r[:, : per_code * width] for r in rotations[: math.ceil(tables / per_code)]]
            return Tables(width, tables, radius, mean, np.concatenate(columns, 1)[:, : tables * width], rotations[0][:, :CODE_BITS], most)
    raise AssertionError("unreachable: the least width takes as many tables as it needs")


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.asarray(col.flatten()).astype(np.float64).reshape(len(col), -1)
    x /= np.abs(x).max(1, keepdims=True)  # else squares of very large or small components over- or underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near_codes(codes: np.ndarray, bounds: np.ndarray, cross: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs whose codes differ in at most ``most`` bits within each group; in ``cross`` groups between its two sides only."""
    size, pairs = np.diff(bounds), []
    for k in np.unique(size[(size > 1) & (size <= SMALL)]):
        firsts = bounds[:-1][size == k]
        for some in np.array_split(firsts, max(1, len(firsts) * k * k * codes.shape[1] // 500_000)):
            at = some[:, None] + np.arange(k)
            c = codes[at]
            g, i, j = np.nonzero(np.triu(distance(c[:, :, None], c[:, None]) <= most, 1))
            pairs.append((at[g, i], at[g, j]))
    for a, b in zip(bounds[:-1][size > SMALL], bounds[1:][size > SMALL], strict=True):
        left, right = (a + np.flatnonzero(side[a:b] == s) for s in (0, 1)) if cross[a] else (np.arange(a, b),) * 2
        for some in np.array_split(left, max(1, len(left) * len(right) * codes.shape[1] // 2_000_000)):
            i, j = np.nonzero(distance(codes[some][:, None], codes[right][None]) <= most)
            i, j = some[i], right[j]
            pairs.append((i, j) if cross[a] else (i[i < j], j[i < j]))
    empty = np.zeros(0, np.int64)
    i, j = (np.concatenate([empty, *(p[s] for p in pairs)]) for s in (0, 1))
    keep = ~cross[i] | (side[i] != side[j])  # small groups were compared whole
    return i[keep], j[keep]


def _candidates(batch: pa.Table, bounds: np.ndarray, plan: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that are near by the code and that this group answers for.

    A pair belongs to the first table in which it is within the radius, and
    there to the bucket of its smaller id's own substring.
    """
    t, sub, i, j = (batch[c].to_numpy() for c in ("t", "sub", "i", "j"))
    ids = batch["id"].to_numpy()
    keys, codes = (np.asarray(batch[c].combine_chunks().flatten()).reshape(batch.num_rows, -1) for c in ("keys", "code"))
    a, b = _near_codes(codes, bounds, i != j, batch["block"].to_numpy() == j, plan.most)
    keep = np.zeros(len(a), bool)
    step = max(1, 4_000_000 // plan.tables)
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step], b[lo : lo + step]
        within = np.bitwise_count(keys[x] ^ keys[y]) <= plan.radius
        owner = np.where(ids[x] < ids[y], x, y)
        keep[lo : lo + step] = within.any(1) & (within.argmax(1) == t[x]) & (keys[owner, t[x]] == sub[x])
    return a[keep], b[keep]


def _sift(batch: pa.Table, bounds: np.ndarray, plan: Tables) -> pa.Table:
    """The rows of whole groups that have a candidate there."""
    i, j = _candidates(batch, bounds, plan)
    some = np.unique(np.concatenate([i, j]))
    return batch.select(["t", "sub", "i", "j", "block", "id"]).take(pa.array(some))


def _compare(batch: pa.Table, bounds: np.ndarray, plan: Tables, threshold: float) -> pa.RecordBatch:
    """(id, n, root) for the rows of whole groups: links to candidates, and a link that joins."""
    i, j = _candidates(batch, bounds, plan)
    x = _matrix(batch["embedding"].combine_chunks())
    group = np.searchsorted(bounds, i, "right") - 1
    cosine, size = np.zeros(len(i)), np.diff(bounds)
    order = np.argsort(group, kind="stable")
    i, j, group = i[order], j[order], group[order]
    dense = np.bincount(group, minlength=len(size)) * 8 > size * size
    for g in np.unique(group[dense[group] & (size[group] > SMALL)]):
        at = slice(*np.searchsorted(group, [g, g + 1]))
        a, b = bounds[g], bounds[g + 1]
        cosine[at] = (x[a:b] @ x[a:b].T)[i[at] - a, j[at] - a]
    rest = np.flatnonzero(~(dense[group] & (size[group] > SMALL)))
    step = max(1, 1_000_000 // x.shape[1])
    for lo in range(0, len(rest), step):
        at = rest[lo : lo + step]
        cosine[at] = (x[i[at]] * x[j[at]]).sum(1)
    i, j = i[cosine >= threshold], j[cosine >= threshold]
    ids, weight = batch["id"].to_numpy(), batch["weight"].to_numpy()
    count = np.zeros(batch.num_rows, np.int64)
    np.add.at(count, i, weight[j])
    np.add.at(count, j, weight[i])
    root = local_roots(batch.num_rows, i, j)
    tell = count > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[tell]), pa.array(count[tell]), pa.array(ids[root[tell]])], ["id", "n", "root"])


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs of cosine at least ``threshold`` that meet in a Hamming table.

    n_links counts the other rows linked directly, component_id is the
    smallest vec_id reachable by links, kept means it is one's own.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows of null vec_id, link with nothing (n_links 0, component_id their
    own). Vectors of different lengths have no cosine and do not link; each
    length is searched on its own. Equal vectors form one class before anything is compared, so
    copies are never expanded into pairs; rows that repeat a vec_id count as
    rows. Empty table: empty result; other columns are not read.
    """
    x = F.col("embedding")
    good = F.coalesce(usable(x) & F.col("vec_id").isNotNull() & F.exists(x, lambda v: v != 0), F.lit(False))
    again = F.pmod("e1", F.lit(1024)).alias("again")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("good", good)
    rows = rows.withColumns({"e1": F.when(F.col("good"), F.xxhash64("embedding")), "e2": F.when(F.col("good"), F.xxhash64(F.lit(7), "embedding"))})
    classes = rows.where("good").groupBy("e1", "e2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # lengths that only copies of one vector have hold nothing to search
    differ = (F.min("e1") != F.max("e1")) | (F.min("e2") != F.max("e2"))
    sizes = rows.where("good").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), differ.alias("differ")).where("differ").orderBy("dims").collect()
    named = classes.select("e1", "e2", "id", "weight", again)
    found = [_search(rows.where(F.col("good") & (F.size("embedding") == s["dims"])), classes, s["n"], threshold) for s in sizes]
    linked = reduce(DataFrame.unionAll, found) if found else None
    out = rows.select("vec_id", "e1", "e2", again).join(named, ["e1", "e2", "again"], "left")
    if linked is None:
        out = out.withColumns({"n": F.lit(0).cast("long"), "component": F.col("id")})
    else:
        counts = linked.groupBy("id").agg(F.sum("n").alias("n"))
        parts = connected_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
        out = out.join(counts, "id", "left").join(parts, "id", "left")
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    return out.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component", "id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def _search(rows: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, n, root) of class representatives, written to the shared folder."""
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE_ROWS).toArrow()["embedding"]
    plan = fit_tables(_matrix(sample.combine_chunks()), n, threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in (plan.keys(x), plan.codes(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], ["id", "weight", "embedding", "keys", "code"])

    kind = rows.schema["embedding"].dataType.simpleString()
    reps = rows.join(classes.withColumnRenamed("id", "vec_id"), ["e1", "e2", "vec_id"]).dropDuplicates(["vec_id", "e1", "e2"])
    coded = materialize(reps.select(F.col("vec_id").alias("id"), "weight", "embedding").mapInArrow(code, f"id long, weight long, embedding {kind}, keys array<int>, code array<long>"), "coded")
    again = F.pmod(F.xxhash64("t", "sub"), F.lit(1024)).alias("again")
    around = F.explode(F.array(*[F.lit(f) for f in flips(plan.width, plan.radius)])).alias("flip")
    posted = coded.select("id", F.posexplode("keys").alias("t", "key")).select("id", "t", "key", around).select("id", "t", F.col("key").bitwiseXOR(F.col("flip")).alias("sub"), (F.col("flip") == 0).alias("own"))
    # a bucket that is no row's own substring is never answered for
    sizes = posted.groupBy("t", "sub").agg(F.count("*").alias("size"), F.max("own").alias("own")).where("size > 1 and own")
    buckets = sizes.select("t", "sub", F.ceil(F.col("size") / BLOCK).alias("blocks"), again)
    placed = posted.select("id", "t", "sub", again).join(buckets, ["t", "sub", "again"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    cells = placed.select("id", "t", "sub", "block", other).select("id", "t", "sub", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cell = ["t", "sub", "i", "j"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, tuple(cell), GATHER):
            yield from _sift(rows, bounds, plan).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, tuple(cell), GATHER):
            yield _compare(rows, bounds, plan, threshold)

    # codes alone are sent to the buckets; vectors only to where they have a candidate
    met = cells.join(coded.select("id", "keys", "code"), "id").repartition(*cell).sortWithinPartitions(*cell)
    near = materialize(met.select(*cell, "block", "id", "keys", "code").mapInArrow(sift, "t int, sub int, i long, j long, block long, id long"), "near")
    full = near.join(coded, "id").repartition(*cell).sortWithinPartitions(*cell)
    linked = materialize(full.select(*cell, "block", "id", "weight", "embedding", "keys", "code").mapInArrow(compare, "id long, n long, root long"), "linked")
    release(near)
    release(coded)
    return linked
