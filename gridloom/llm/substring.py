"""Substring dedup by compressed FM-indexes over shards.

Each window of words has an anchor, the least hash of the shorter runs in it.
Anchors that stand in one document alone end the matter for their windows.
The rest is cut into passages: consecutive windows whose anchors share a home
(the smallest document with the anchor), so equal windows meet in one shard
and passages stay long; what very many documents share is routed by anchor or
by window, which spreads it. A shard's distinct passages form a compressed
FM-index. Streamed through it, backward search gives their matching statistics;
the interval of every match as long as a window holds the smallest document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, release
from gridloom.llm.fm_index import FmIndex
from gridloom.llm.words import Words, chunks, mix, shingles

#: Words in an anchor's run.
ANCHOR_WORDS = 5
#: Words of distinct passages that an index shard holds on average.
SHARD_WORDS = 200_000
#: A home with more anchor occurrences is split by anchor, an anchor that recurs more often by window.
HOT_ANCHORS = 20_000
#: Windows of a passage; longer ones are cut, each part with the words that its last window needs.
PASSAGE_WINDOWS = 4096
#: The route of anchors whose windows each go their own way.
BY_WINDOW = 0
#: Windows in a stream through the index.
STREAM_WINDOWS = 64


def _again(column: str):
    """One more join key, so that both sides exchange anew and Spark may split a hot partition."""
    return F.pmod(F.col(column), F.lit(1024)).alias("again")


def window_anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each window start of a sequence of word hashes the least hash of the anchor runs in it.

    Sequences that follow one another may be given as one; windows across them
    have to be ignored.
    """
    k = min(ANCHOR_WORDS, window)
    if len(h) < window:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        low = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            low = mix(low ^ h[j : len(h) - k + 1 + j])
    width, want = 1, window - k + 1
    while width < want:
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def _changes(values: np.ndarray, first: int, last: int) -> np.ndarray:
    part = values[first:last]
    return part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, anchors): the anchors of every document with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(1))
                low = window_anchors(words.hashes(), window).view(np.int64)
                lists = [_changes(low, a, max(a, b - window + 1)) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "anchors"])

    return docs.mapInArrow(run, "doc_id long, anchors array<long>").where(F.size("anchors") > 0)


def _passages(docs: DataFrame, window: int) -> DataFrame:
    """(route, d1, d2, passage, n_words, doc_id, start) of documents with ``hits`` (anchor, route)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["route", "d1", "d2", "passage", "n_words", "doc_id", "start"]
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(1))
                low = window_anchors(words.hashes(), window).view(np.int64)
                hits = part.column(2)
                at = np.asarray(hits.offsets)
                flat = hits.values
                anchors, routes = np.asarray(flat.field(0)), np.asarray(flat.field(1))
                own_ways = shingles(words.hashes(), window).view(np.int64) if (routes == BY_WINDOW).any() else None
                rows = []
                for i, doc in enumerate(part.column(0).to_pylist()):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    own = low[a : max(a, b - window + 1)]
                    order = np.argsort(anchors[at[i] : at[i + 1]], kind="stable")
                    known, route = anchors[at[i] : at[i + 1]][order], routes[at[i] : at[i + 1]][order]
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[place] == own
                    of = route[place]
                    if own_ways is not None:
                        of = np.where(of == BY_WINDOW, own_ways[a : a + len(own)], of)
                    cut = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1]) | (of[1:] != of[:-1])])) if len(own) else np.zeros(0, np.int64)
                    runs = zip(cut, [*cut[1:], len(own)], strict=True)
                    for s, e in ((s, min(s + PASSAGE_WINDOWS, e)) for s0, e in runs if hit[s0] for s in range(s0, e, PASSAGE_WINDOWS)):
                        first, last = a + s, a + e + window - 2
                        text = b" ".join(words.data[words.starts[first] : words.ends[last]].tobytes().split())
                        d = np.frombuffer(xxhash.xxh3_128_digest(text), "<i8")
                        rows.append((of[s], d[0], d[1], text.decode(), e - s + window - 1, doc, s))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)

    return docs.mapInArrow(run, "route long, d1 long, d2 long, passage string, n_words long, doc_id long, start long")


def first_documents(passages: list[np.ndarray], owners: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """For each passage (word hashes) the runs (first window, last window, smallest owner of a passage that holds it).

    The passages are streamed through their index: the matching statistics
    tell which windows it holds, and the interval of such a window its owner.
    """
    lengths = np.array([len(p) for p in passages])
    ids = np.unique(np.concatenate(passages), return_inverse=True)[1] + 1
    text = np.zeros(len(ids) + len(passages), np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    inside = np.ones(len(text), bool)
    inside[start + lengths] = False
    text[inside] = ids
    known, rank = np.unique(owners, return_inverse=True)
    index = FmIndex(text, np.repeat(rank, lengths + 1), window)
    windows = np.maximum(lengths - window + 1, 0)
    pieces = -(-windows // STREAM_WINDOWS)
    offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STREAM_WINDOWS
    begin, count = np.repeat(start, pieces) + offset, np.minimum(STREAM_WINDOWS, np.repeat(windows, pieces) - offset)
    length, lo, hi = index.matching_statistics(text, begin, count)
    held = np.flatnonzero(length == window)
    first = np.full(len(text), -1, np.int64)
    first[held] = index.least_owner(lo[held], hi[held])
    out = []
    for s, n in zip(start, windows, strict=True):
        of = first[s : s + n]
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if n else []
        out.append([(int(a), int(b) - 1, int(known[of[a]])) for a, b in zip(cut, [*cut[1:], n], strict=True) if of[a] >= 0])
    return out


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, spans): word intervals (first, last) covered by windows that a smaller document holds too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    anchors = materialize(_anchors(docs, window), "anchors")
    each = anchors.select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = materialize(
        each.groupBy("anchor").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("home < last").select("anchor", "home", "n"), "recurring"
    )
    hot = recurring.groupBy("home").agg(F.sum("n").alias("all")).where(F.col("all") > HOT_ANCHORS).select("home", F.lit(True).alias("hot"))
    route = F.when(F.col("n") > HOT_ANCHORS, F.lit(BY_WINDOW)).when(F.col("hot"), F.xxhash64("home", "anchor")).otherwise(F.xxhash64("home"))
    routed = recurring.join(hot, "home", "left").select("anchor", route.alias("route"), _again("anchor"))
    # written before the texts join, so their shuffles do not lie on disk together
    hits = materialize(each.select("*", _again("anchor")).join(routed, ["anchor", "again"]).groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "route")).alias("hits")), "hits")
    release(anchors)
    release(recurring)
    passages = materialize(_passages(docs.join(hits, "doc_id").select("doc_id", "text", "hits"), window), "passages")
    release(hits)
    # copies of a passage collapse before anything is gathered
    distinct = passages.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("d1", "d2", "at.doc_id", "at.start", _again("d1"))
    distinct = materialize(passages.select("*", _again("d1")).join(distinct, ["d1", "d2", "doc_id", "start", "again"]).drop("again"), "distinct")
    total = distinct.agg(F.coalesce(F.sum("n_words"), F.lit(0))).head()[0]
    shards = max(1, math.ceil(total / SHARD_WORDS))

    def search(shard: pa.Table) -> pa.Table:
        words = Words(shard["passage"])
        h = words.hashes()
        found = first_documents([h[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)], shard["doc_id"].to_numpy(), window)
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("first", pa.int64())]))
        return pa.table({"d1": shard["d1"], "d2": shard["d2"], "runs": pa.array([[dict(zip(("low", "high", "first"), r, strict=True)) for r in f] for f in found], kind)})

    sharded = distinct.select(F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard"), "d1", "d2", "passage", "doc_id")
    found = sharded.groupBy("shard").applyInArrow(search, "d1 long, d2 long, runs array<struct<low: long, high: long, first: long>>")
    held = passages.select("d1", "d2", "doc_id", "start", _again("d1")).join(found.select("*", _again("d1")).dropDuplicates(["d1", "d2"]), ["d1", "d2", "again"])
    earlier = F.filter("runs", lambda r: r["first"] < F.col("doc_id"))
    spans = F.transform(earlier, lambda r: F.struct((F.col("start") + r["low"]).alias("first"), (F.col("start") + r["high"] + window - 1).alias("last")))
    return held.select("doc_id", spans.alias("spans")).where(F.size("spans") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with ``text`` the words that stay, joined by one space, plus ``n_words`` and ``n_removed``.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the
    input. Words are runs of anything but [\\x20\\x09-\\x0D], unchanged.

    Null, empty or blank text and texts of fewer words than a window: nothing
    goes. Null doc_id: takes no part, keeps all words. Rows that repeat a
    doc_id are one document for the comparison; the spans found for either are
    removed from both. Empty table: empty result. Other columns pass through;
    columns named n_words or n_removed are replaced. doc_id must be an integer.
    """
    spans = repeated_spans(docs, window).select(F.col("doc_id").alias("__doc"), F.col("spans").alias("__spans"))
    passed = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    joined = docs.join(spans, docs["doc_id"] == spans["__doc"], "left").select(*[docs[c] for c in passed], docs["text"], "__spans")
    n_passed = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts, totals, removed = [], [], []
                for text, cut in zip(part.column(n_passed), part.column(n_passed + 1).to_pylist(), strict=True):
                    words = (text.as_py() or "").encode().split()
                    totals.append(len(words))
                    if cut:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.minimum([s["first"] for s in cut], len(words)), 1)
                        np.add.at(edge, np.minimum([s["last"] + 1 for s in cut], len(words)), -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                    removed.append(totals[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                own = [part.column(i) for i in range(n_passed)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], [*passed, "text", "n_words", "n_removed"])

    schema = joined.select(*passed, "text").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(run, schema)
