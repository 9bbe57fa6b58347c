"""An incremental feed of edges: degrees and components kept up to date.

An extension; batch operators do not need it. Each micro-batch is folded into
a table in the shared folder, under its number, so a batch that is replayed
after a failure is not counted twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.matrix import Matrix
from gridloom.plans.algorithms import connected_components
from gridloom.shared import new_path


@dataclass
class EdgeFeed:
    """Degrees (and on demand components) of all edges a stream of (row, col, val) has brought."""

    spark: SparkSession
    path: str = field(default="")

    def __post_init__(self):
        self.path = self.path or new_path(self.spark, "edge-feed")

    def fold(self, batch: DataFrame, number: int) -> None:
        """Write one micro-batch, its repeated edges added up; a replay overwrites itself."""
        edges = batch.groupBy("row", "col").agg(F.sum("val").alias("val"))
        edges.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Fold a streaming DataFrame of edges, by default all that is there."""
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def edges(self) -> DataFrame:
        """All edges so far, one row for each position."""
        return self.spark.read.parquet(self.path).groupBy("row", "col").agg(F.sum("val").alias("val"))

    def degrees(self) -> DataFrame:
        return self.edges().groupBy(F.col("row").alias("idx")).agg(F.count("*").alias("degree"), F.sum("val").alias("weight"))

    def components(self, size: int) -> DataFrame:
        return connected_components(Matrix(self.edges(), size, size))
