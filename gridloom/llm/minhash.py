"""Near-duplicate documents by SetSketch registers.

Each distinct shingle set gets registers that hold exponentially spaced,
truncated minima. Bands of register values bring candidates together, the
similarity of a pair is estimated from all registers by maximum likelihood,
and whatever could pass is verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, release, whole_groups
from gridloom.llm.components import connected_components, local_roots
from gridloom.llm.words import chunks, mix, seeds, shingle_sets


@dataclass(frozen=True)
class SketchConfig:
    """Registers: ``bands`` x ``rows`` of them, base ``base``, rate ``rate``, values 0 to ``limit`` + 1.

    A pair of similarity 0.8 misses every band of 30 x 5 with probability 7e-6.
    """

    bands: int = 30
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65534

    @property
    def size(self) -> int:
        return self.bands * self.rows


#: Sketched elements that are worked on at once.
_ELEMENTS = 1 << 16
#: A pair is verified unless its likelihood at the threshold is below the best by more than this (five sigma).
LIKELIHOOD_SLACK = 12.5
#: Members and strangers of a bucket that are compared at once, and the shingles that either side has on average at most.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Text bytes that are gathered before cells are compared.
BLOCK_BYTES = 32 << 20
#: Shingles whose counts are taken at once.
SLAB = 8192


@lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    return (seeds(2 * n, 0x5E7) >> np.uint64(32)).astype(np.uint32).reshape(n, 2) | np.uint32(1)


def sketch(sets: list[np.ndarray], config: SketchConfig) -> np.ndarray:
    """Registers (one row per set) of nonempty sets of 64-bit hashes.

    A register is floor(1 - log_base(h)) of the least of exponential variables
    h of the given rate, one per element, truncated to [0, limit + 1]. The
    maximum of two sketches' registers is the sketch of the union.
    """
    least = np.full((len(sets), config.size), np.uint32(0xFFFFFFFF))
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    ends = np.cumsum(sizes)
    lo, hi = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(flat), _ELEMENTS):
        stop = min(start + _ELEMENTS, len(flat))
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
        cuts = np.maximum(ends[first : last + 1] - sizes[first : last + 1] - start, 0)
        a, b = lo[start:stop], hi[start:stop]
        for r, (p, q) in enumerate(_multipliers(config.size)):
            y = a * p
            y += b * q
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            low = np.minimum.reduceat(y, cuts)
            np.minimum(least[first : last + 1, r], low, out=least[first : last + 1, r])
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    h = -np.log1p(-uniform) / config.rate
    registers = np.floor(1 - np.log(h) / math.log(config.base))
    return np.clip(registers, 0, config.limit + 1).astype(np.uint16)


def estimate(k_u: np.ndarray, k_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, base: float, grid: int = 201) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(likelihoods, similarities, best similarity) of pairs of register rows with known set sizes.

    Log-likelihoods on a grid of similarities up to the largest that the sizes
    allow, from how often either register is larger and how often both agree.
    """
    plus, minus = (k_u > k_v).sum(1)[:, None], (k_u < k_v).sum(1)[:, None]
    same = k_u.shape[1] - plus - minus
    u = (n_u / (n_u + n_v))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)

    def larger(x: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(1 - x * (base - 1) / base, 1e-300)) / math.log(base)

    p, q = np.clip(larger(u - v * j), 1e-12, 1), np.clip(larger(v - u * j), 1e-12, 1)
    log = plus * np.log(p) + minus * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))
    best = np.take_along_axis(j, log.argmax(1)[:, None], 1)[:, 0]
    return log, j, best


def may_pass(k_u: np.ndarray, k_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, base: float, threshold: float) -> np.ndarray:
    """Pairs whose likelihood at the threshold is not far below their best."""
    log, j, best = estimate(k_u, k_v, n_u, n_v, base)
    at = np.minimum((j < threshold).sum(1), j.shape[1] - 1)
    there = np.take_along_axis(log, at[:, None], 1)[:, 0]
    return (best >= threshold) | (there >= log.max(1) - LIKELIHOOD_SLACK)


def sketches(docs: DataFrame, words: int, config: SketchConfig) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): set size, two hashes of the set, register bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column(1), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = [None] * len(sets)
                d = np.zeros((2, len(sets)), np.int64)
                if full:
                    registers = sketch([sets[i] for i in full], config)
                    for i, row in zip(full, registers, strict=True):
                        sig[i] = row.astype("<u2").tobytes()
                        d[:, i] = [np.bitwise_xor.reduce(mix(sets[i] ^ s)).view(np.int64) for s in seeds(2, 0xD16)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[0]), pa.array(d[1]), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, d1 long, d2 long, sig binary")


def _again(column: str):
    """One more join key, so that both sides exchange anew and Spark may split a hot partition."""
    return F.pmod(F.col(column), F.lit(1024)).alias("again")


def _bands(reps: DataFrame, config: SketchConfig) -> DataFrame:
    width = 2 * config.rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(config.bands)])
    return reps.select(F.posexplode(keys).alias("band", "key"), "doc_id", "n_shingles")


def _verified(pairs: DataFrame, members: DataFrame, words: int, percent: int, config: SketchConfig) -> DataFrame:
    """(a, b) of the candidate pairs whose full sets have 100 * intersection >= percent * union."""

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                k = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(part.num_rows, -1) for c in (4, 5)]
                n = [part.column(c).to_numpy().astype(np.float64) for c in (2, 3)]
                keep = may_pass(*k, *n, config.base, percent / 100)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in chunks(batch, "text_a"):
                for part in chunks(half, "text_b"):
                    keep = []
                    for x, y in zip(shingle_sets(part.column(2), words), shingle_sets(part.column(3), words), strict=True):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                    yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def of(side: str, *columns: str) -> DataFrame:
        return members.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    sized = pairs.join(of("a", "n_shingles", "sig"), "a").join(of("b", "n_shingles", "sig"), "b")
    likely = sized.select("a", "b", "n_shingles_a", "n_shingles_b", "sig_a", "sig_b").mapInArrow(plausible, "a long, b long")
    texts = likely.join(of("a", "text"), "a").join(of("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return texts.mapInArrow(full, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    for start in range(0, len(shared), SLAB):
        slab = shared[start : start + SLAB]
        dense = []
        for side, values, row in zip((left, right), flat, rows, strict=True):
            at = np.minimum(np.searchsorted(slab, values), len(slab) - 1)
            hit = slab[at] == values
            part = np.zeros((len(side), len(slab)), np.float32)
            part[row[hit], at[hit]] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def _plausible(group: pa.Table, percent: int, config: SketchConfig) -> np.ndarray:
    """Rows of a cell that may be linked across its sides: another component, this the first band they share, registers that may pass."""
    side, component, band = group["side"].to_numpy(), group["component"].to_numpy(), group["band"][0].as_py()
    n = group["n_shingles"].to_numpy().astype(np.float64)
    k = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u2").reshape(group.num_rows, -1)
    left, right = (np.flatnonzero(side == s) for s in (0, 1))
    small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    open_ = (component[left][:, None] != component[right]) & (100 * small >= percent * large)
    for b in range(band):
        values = np.unique(np.ascontiguousarray(k[:, b * config.rows : (b + 1) * config.rows]).view(f"V{2 * config.rows}")[:, 0], return_inverse=True)[1]
        open_ &= values[left][:, None] != values[right]
    i, j = np.nonzero(open_)
    i, j = left[i], right[j]
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 2048):
        x, y = i[lo : lo + 2048], j[lo : lo + 2048]
        keep[lo : lo + 2048] = may_pass(k[x], k[y], n[x], n[y], config.base, percent / 100)
    return np.unique(np.concatenate([i[keep], j[keep]]))


def _candidate_links(docs: DataFrame, reps: DataFrame, words: int, percent: int, config: SketchConfig) -> DataFrame | None:
    """(node, component) by verified links among all that share a band.

    A bucket is never expanded into its pairs. First everyone is compared with
    the one centre (the smallest member of a bucket) that it shares most
    buckets with. Where a bucket then still holds several components, all but
    its main one are strangers there. In each such bucket strangers meet all
    members in blocks of bounded size, by registers alone: a pair of different
    components is looked at in the first band it shares and stays if it may
    pass. Only documents with such a pair fetch their texts, and the cells they
    met in are compared by counting common shingles, so no pair that shares a
    bucket across components stays untested.
    """
    bands = _bands(reps, config)
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).where("n > 1").select("key", "centre", _again("key"))
    bucket = materialize(bands.select("*", _again("key")).join(shared, ["key", "again"]).select("key", "band", "doc_id", "n_shingles", "centre"), "bucket")
    if bucket.isEmpty():
        return None
    inside = bucket.select("doc_id").distinct()
    members = materialize(docs.select("doc_id", "text").join(reps.select("doc_id", "n_shingles", "sig").join(inside, "doc_id", "left_semi"), "doc_id"), "members")
    often = bucket.where("doc_id != centre").groupBy("doc_id", "centre").count()
    nearest = often.groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("centre")).alias("less"))).alias("top")).select("doc_id", (-F.col("top.less")).alias("centre"))
    pairs = nearest.select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct()
    links = materialize(_verified(pairs, members, words, percent, config), "links")
    component = connected_components(links)

    placed = bucket.select("key", "band", "doc_id", "n_shingles").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("main"), F.count("*").alias("parts"))
    mixed = parts.where("parts > 1").select("key", F.col("main.component").alias("host"), _again("key"))
    met = placed.select("*", _again("key")).join(mixed, ["key", "again"]).select("key", "band", "doc_id", "n_shingles", "component", (F.col("component") != F.col("host")).alias("strange"))
    met = materialize(met, "met")

    def blocks(only: Column) -> Column:
        shingles = F.sum(F.when(only, F.col("n_shingles")))
        return F.greatest(F.ceil(F.count_if(only) / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))

    sizes = met.groupBy("key").agg(blocks(F.lit(True)).alias("blocks"), blocks(F.col("strange")).alias("strange_blocks")).select("*", _again("key"))
    block = [F.pmod(F.xxhash64("doc_id"), n) for n in (F.col("blocks"), F.col("strange_blocks"))]
    dealt = met.select("*", _again("key")).join(sizes, ["key", "again"])
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = dealt.select("key", "band", "doc_id", "n_shingles", "component", block[0].alias("i"), many("strange_blocks").alias("j"), F.lit(0).cast("long").alias("side"))
    strange = dealt.where("strange").select("key", "band", "doc_id", "n_shingles", "component", block[1].alias("j"), many("blocks").alias("i"), F.lit(1).cast("long").alias("side"))
    cell = ["key", "i", "j"]
    sketched = every.unionByName(strange).join(members.select("doc_id", "sig"), "doc_id").repartition(*cell).sortWithinPartitions(*cell)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, tuple(cell), 2 * BLOCK):
            keep = [np.zeros(0, np.int64)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                group = rows.slice(lo, hi - lo)
                keep.append(lo + _plausible(group, percent, config))
            yield from rows.select(["key", "i", "j", "side", "doc_id"]).take(pa.array(np.concatenate(keep))).to_batches()

    likely = sketched.select(*cell, "band", "side", "doc_id", "component", "n_shingles", "sig").mapInArrow(sift, "key long, i long, j long, side long, doc_id long")
    likely = materialize(likely, "likely")
    full = likely.join(members.select("doc_id", "text"), "doc_id").repartition(*cell).sortWithinPartitions(*cell)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, tuple(cell), BLOCK, BLOCK_BYTES):
            a, b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                group = rows.slice(lo, hi - lo)
                side, ids = group["side"].to_numpy(), group["doc_id"].to_numpy()
                sets = shingle_sets(group["text"], words)
                at = [np.flatnonzero(side == s) for s in (0, 1)]
                if not len(at[0]) or not len(at[1]):
                    continue
                members, strangers = ([sets[i] for i in x] for x in at)
                both = common_counts(members, strangers).astype(np.int64)
                sizes = [np.array([len(s) for s in x]) for x in (members, strangers)]
                i, j = np.nonzero((both > 0) & (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)))
                # as many links as join what hangs together here
                root = local_roots(len(ids), at[0][i], at[1][j])
                hung = np.flatnonzero(root != np.arange(len(ids)))
                a.append(ids[hung])
                b.append(ids[root[hung]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    found = full.select(*cell, "side", "doc_id", "text").mapInArrow(compare, "a long, b long")
    renamed = found.join(component.withColumnRenamed("node", "a"), "a", "left").select("b", F.coalesce("component", "a").alias("a")).distinct()
    component = connected_components(links.union(renamed.select("a", "b")))
    for table in (bucket, members, placed, met, likely):
        release(table)
    return component


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, config: SketchConfig | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Shingles are runs of ``words`` words of the text with A-Z lower-cased
    (fewer words: the whole sequence as one). Documents are linked where
    100 * intersection >= ``percent`` * union of their full sets; component_id
    is the smallest doc_id reachable by links, kept means it is one's own.

    Null, empty or blank text: an empty set, linked with nothing. Null doc_id:
    component_id null, kept false. Equal sets form one class before anything
    is compared; rows that repeat a doc_id share its component, and all of
    them are kept if it is. Empty table: empty result; other columns are not
    read. doc_id must be an integer.
    """
    config = config or SketchConfig()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(sketches(docs, words, config), "sketches")
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = materialize(known.join(classes.select("d1", "d2", F.col("rep").alias("doc_id"), _again("d1")), ["d1", "d2", "doc_id"], "left_semi"), "reps")
    component = _candidate_links(docs, reps, words, percent, config)
    named = classes.select("d1", "d2", "rep", _again("d1"))
    if component is not None:
        named = named.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        named = named.withColumn("component", F.col("rep"))
    out = sketched.select("doc_id", "n_shingles", "d1", "d2", _again("d1")).join(named, ["d1", "d2", "again"], "left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
