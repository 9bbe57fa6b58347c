"""Connected components of a link table, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, release


def _hung(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Each edge's far end hung on the smallest node its near end reaches.

    One join key more than the aggregate has makes both sides exchange anew,
    so Spark may split the edges of a node that very many others touch.
    """
    again = F.pmod("near", F.lit(1024)).alias("again")
    least = reach.groupBy("near").agg(F.min("far").alias("least")).select("near", F.least("near", "least").alias("least"), again)
    return edges.select("near", "far", again).join(least, ["near", "again"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node.

    Large-star and small-star steps alternate until the edges are stars; a
    round's edges are written to the shared folder, and only their number and
    checksum reach the driver. Self links and repeated links change nothing;
    null ends are ignored. Empty table: empty result.
    """
    edges = materialize(
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("near"), F.least("a", "b").alias("far"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = edges.select("near", "far").union(edges.select(F.col("far").alias("near"), F.col("near").alias("far")))
        large = _hung(both, both).where(F.col("far") > F.col("near")).select(F.col("far").alias("near"), F.col("least").alias("far"))
        large = large.where(F.col("near") != F.col("far")).distinct()
        hung = _hung(large, large).select(F.explode(F.array(F.struct(F.col("far").alias("near"), F.col("least").alias("far")), F.struct("near", F.col("least").alias("far")))).alias("e"))
        stars = hung.select("e.near", "e.far").where(F.col("near") != F.col("far")).distinct()
        new = materialize(stars, "edges", rows=F.count(F.lit(1)), hash=F.sum(F.xxhash64("near", "far").cast("decimal(20,0)")))
        release(edges)
        edges = new
        if edges.metrics == seen:
            break
        seen = edges.metrics
    return edges.select(F.col("near").alias("node"), F.col("far").alias("component")).union(edges.select(F.col("far").alias("node"), F.col("far").alias("component")).distinct())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
