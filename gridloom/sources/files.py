"""Graph files: Matrix Market text, its binary form, edge lists, DOT.

Files are read and written by Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import IndexOutOfBounds, InvalidValue
from gridloom.operators.matrix import Matrix
from gridloom.operators.scan import ranked
from gridloom.operators.vector import Vector
from gridloom.shared import TASK_ROWS, importable, materialize, release, spread

# Fixed values of the formats.
#: Weight of an edge in files that hold none.
EDGE_WEIGHT = 1
STRICT_BANNER = "%%MatrixMarket matrix coordinate pattern general"
#: Lines before the edges of a plain edge list.
EDGE_LIST_HEADER = 6
#: Edges of a binary file that one task turns into rows at once.
BINARY_EDGES = 1 << 20


#: Edges in a file that write_mtxbin writes.
BINARY_PART_EDGES = 1 << 24


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at): lines with what puts them in order, however the files are dealt to tasks."""
    meta = F.col("_metadata")
    return spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))


def _is_at(place: Row) -> Column:
    return (F.col("file") == place["file"]) & (F.col("block") == place["block"]) & (F.col("at") == place["at"])


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_mtx(spark: SparkSession, path: str, strict: bool = False) -> Matrix:
    """A matrix from a ``.mtx`` or ``.mtxbin`` file, by its suffix."""
    if path.endswith(".mtxbin"):
        return read_mtxbin(spark, path)
    if path.endswith(".mtx"):
        return read_mtx_text(spark, path, strict)
    raise InvalidValue("a matrix file ends in .mtx or .mtxbin")


def read_mtx_text(spark: SparkSession, path: str, strict: bool = False) -> Matrix:
    """A coordinate file: comments, one line ``rows cols entries``, then 1-based ``row col``.

    Values are ignored; every edge weighs 1; symmetric files are not expanded.
    ``path`` may be a folder of parts; the sizes stand in the first by name.
    ``strict`` asks for the pattern general banner and a square matrix.
    """
    lines = _placed(spark, path).withColumn("value", F.trim("value")).where(F.col("value") != "")
    if strict:
        banner = lines.where(F.col("value").startswith("%%")).head()
        if banner is None or " ".join(banner["value"].split()) != STRICT_BANNER:
            raise InvalidValue("not a pattern general coordinate file")
    body = lines.where(~F.col("value").startswith("%"))
    first = body.agg(F.min(F.struct("file", "block", "at", "value")).alias("first")).head()["first"]
    if first is None or len(first["value"].split()) < 3:
        raise InvalidValue("the file has no size line")
    nrows, ncols, nnz = map(int, first["value"].split()[:3])
    if strict and nrows != ncols:
        raise InvalidValue("the matrix is not square")
    parts = _fields(F.col("value"))
    edges = body.where(~_is_at(first)).select((parts[0].cast("long") - 1).alias("row"), (parts[1].cast("long") - 1).alias("col"), F.lit(EDGE_WEIGHT).cast("long").alias("val"))
    return Matrix(edges, nrows, ncols)


def read_mtxbin(spark: SparkSession, path: str) -> Matrix:
    """The binary form: little-endian 64-bit rows, cols, entries, then 1-based pairs.

    Spark hands over a file whole, up to 2 GB; a larger graph comes as a folder
    of such files that repeat the header.
    """
    importable(spark)
    files = spark.read.format("binaryFile").load(path)
    header = files.where(F.length("content") >= 24).select(F.substring("content", 1, 24).alias("head")).head()
    if header is None or len(header["head"]) < 24:
        raise InvalidValue("the file has no header")
    nrows, ncols, _ = struct.unpack("<3q", bytes(header["head"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                pairs = np.frombuffer(content.as_buffer(), "<i8", offset=24)
                pairs = pairs[: len(pairs) // 2 * 2].reshape(-1, 2) - 1
                for lo in range(0, len(pairs), BINARY_EDGES):
                    part = pairs[lo : lo + BINARY_EDGES]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(np.full(len(part), EDGE_WEIGHT))], ["row", "col", "val"])

    return Matrix(files.select("content").mapInArrow(run, "row long, col long, val long"), nrows, ncols)


def read_edge_list(spark: SparkSession, path: str, undirected: bool = False, header: int = EDGE_LIST_HEADER) -> Matrix:
    """Lines of 0-based ``src dst`` after ``header`` lines of the first file by name; square, just large enough."""
    lines = _placed(spark, path)
    for place in lines.orderBy("file", "block", "at").limit(header).drop("value").collect():
        lines = lines.where(~_is_at(place))
    parts = _fields(F.col("value"))
    edges = lines.where(F.trim("value") != "").select(parts[0].cast("long").alias("row"), parts[1].cast("long").alias("col"), F.lit(EDGE_WEIGHT).cast("long").alias("val"))
    low, high = edges.agg(F.min(F.least("row", "col")), F.max(F.greatest("row", "col"))).head()
    if low is not None and low < 0:
        raise IndexOutOfBounds("an edge has a negative end")
    if undirected:
        edges = edges.select(F.expr("stack(2, row, col, col, row) as (row, col)"), "val")  # lines are read once for both directions
    n = 0 if high is None else high + 1
    return Matrix(edges, n, n)


def convert_raw(spark: SparkSession, path: str) -> Matrix:
    """Raw lines of two numbers, comments skipped: distinct edges, moved to start at 0."""
    parts = _fields(F.col("value"))
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+\d+"))
    edges = lines.select(parts[0].cast("long").alias("row"), parts[1].cast("long").alias("col")).distinct()
    low, high = edges.agg(F.min(F.least("row", "col")), F.max(F.greatest("row", "col"))).head()
    shift = 0 if low is None or low == 0 else 1
    n = 0 if high is None else high + 1 - shift
    moved = edges.select((F.col("row") - shift).alias("row"), (F.col("col") - shift).alias("col"), F.lit(EDGE_WEIGHT).cast("long").alias("val"))
    return Matrix(moved, n, n)


def mtx_lines(a: Matrix) -> DataFrame:
    """(pos, value): the lines of a coordinate file: banner, sizes, distinct edges without loops in order."""
    edges = ranked(a.df.where(F.col("row") != F.col("col")).select("row", "col").distinct(), ["row", "col"], "pos")
    nnz = edges.count()
    spark = a.df.sparkSession
    head = spark.createDataFrame([(-2, STRICT_BANNER), (-1, f"{a.nrows} {a.ncols} {nnz}")], "pos long, value string")
    return head.union(edges.select("pos", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1).alias("value")))


def write_mtx(a: Matrix, path: str) -> None:
    """A coordinate file (a folder of parts in order) of distinct edges without loops: the head is a part before the sorted ones."""
    edges = materialize(a.df.where(F.col("row") != F.col("col")).select("row", "col").distinct(), "mtx", rows=F.count(F.lit(1)))
    nnz, spark = edges.metrics["rows"], a.df.sparkSession
    head = spark.createDataFrame([(f"{STRICT_BANNER}\n{a.nrows} {a.ncols} {nnz}",)], "value string").coalesce(1)
    dealt = edges.repartitionByRange(spread(spark, nnz), "row", "col").sortWithinPartitions("row", "col")
    head.union(dealt.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1).alias("value"))).write.text(path)
    release(edges)


def write_mtxbin(a: Matrix, path: str, part_edges: int = BINARY_PART_EDGES) -> None:
    """The binary form as a folder of files of at most ``part_edges`` edges, each with the header.

    Tasks write their files themselves, to any store that pyarrow reaches; a
    task that is run again writes the same names. What the folder held goes.
    """
    importable(a.df.sparkSession)
    edges = materialize(a.df.select("row", "col"), "mtxbin", rows=F.count(F.lit(1)))
    nnz = edges.metrics["rows"]
    head = struct.pack("<3q", a.nrows, a.ncols, nnz)
    # a task writes many files if they are small: what a task reports to the driver does not depend on their size
    tasks = max(1, math.ceil(nnz / max(part_edges, TASK_ROWS)))
    ends = edges.repartitionByRange(tasks, "row", "col").sortWithinPartitions("row", "col")
    store, root = FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    store.delete_dir_contents(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = FileSystem.from_uri(path)
        held, rows, part = [], 0, 0

        def flush() -> None:
            name = f"{root}/part-{task.partitionId():05d}-{part:05d}.mtxbin"
            unfinished = f"{root}/_{task.taskAttemptId()}-{part}"
            with store.open_output_stream(unfinished) as out:
                out.write(head)
                for pairs in held:
                    out.write(pairs)
            store.move(unfinished, name)

        for batch in batches:
            pairs = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1).astype("<i8") + 1
            while len(pairs):
                some, pairs = pairs[: part_edges - rows], pairs[part_edges - rows :]
                held.append(some.tobytes())
                rows += len(some)
                if rows == part_edges:
                    flush()
                    held, rows, part = [], 0, part + 1
        if rows:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], ["parts"])

    if not nnz:  # no task need run
        with store.open_output_stream(f"{root}/part-00000-00000.mtxbin") as out:
            out.write(head)
        return
    ends.mapInArrow(run, "parts long").agg(F.sum("parts")).collect()
    release(edges)


def mtxbin_bytes(a: Matrix) -> bytes:
    """The binary form of a small matrix: its edges meet on the driver, so they are counted first; see write_mtxbin()."""
    edges = a.df.select("row", "col")
    nnz = edges.count()
    if nnz > BINARY_EDGES:
        raise InvalidValue(f"{nnz} edges; the binary form is written for at most {BINARY_EDGES}, use write_mtxbin")
    rows = edges.orderBy("row", "col").toPandas().to_numpy(np.int64) + 1
    return struct.pack("<3q", a.nrows, a.ncols, nnz) + rows.astype("<i8").tobytes()


def dot_lines(a: Matrix, labels: Vector | None = None, directed: bool = True) -> DataFrame:
    """(part, row, col, value): the lines of a DOT file, to be written in that order."""
    arrow, kind = ("->", "digraph") if directed else ("--", "graph")
    spark = a.df.sparkSession
    kinds = "part int, row long, col long, value string"
    ends = spark.createDataFrame([(0, 0, 0, f"{kind} G {{"), (3, 0, 0, "}")], kinds)
    edges = a.df if directed else a.df.where(F.col("row") <= F.col("col"))
    lines = edges.select(F.lit(2).alias("part"), "row", "col", F.concat(F.col("row"), F.lit(f" {arrow} "), F.col("col"), F.lit(' [label = "'), F.col("val").cast("string"), F.lit('"];')).alias("value"))
    out = ends.union(lines)
    if labels is not None:
        named = labels.df.select(F.lit(1).alias("part"), F.col("idx").alias("row"), F.lit(0).cast("long").alias("col"), F.concat(F.col("idx"), F.lit(' [label = "'), F.col("val").cast("string"), F.lit('"];')).alias("value"))
        out = out.union(named)
    return out


def write_dot(a: Matrix, path: str, labels: Vector | None = None, directed: bool = True) -> None:
    dot_lines(a, labels, directed).orderBy("part", "row", "col").select("value").write.text(path)
