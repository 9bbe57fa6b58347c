"""Tables in the folder that driver and executors share.

Loops cut their lineage with tables written there, so that a lost executor
costs a re-read and not the loop.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from gridloom.errors import InvalidValue

#: Rows that one task of a sized exchange gets.
TASK_ROWS = 1 << 19

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (single-machine tests) a temporary
    folder is made and set as the session's checkpoint folder; a cluster's
    executors would not see it, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise InvalidValue("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gridloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where they see the driver's folders; elsewhere it is installed."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses; what is there at exit is removed."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_remove_all, spark, app)
    _written[app].append(path)
    return path


def spread(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows, so that a task's memory does not grow with the table, however few the session asks for."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


@contextlib.contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it the shuffle files of a write go when the write ends."""
    return _set(spark, **{_CLEANUP: "true"})


def materialize(df: DataFrame, name: str, together: bool = False, **metrics: Column) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The shuffle files of the write are removed when it ends; the table is
    removed at exit, or by ``release``. Aggregates given as ``metrics`` are
    taken while writing and stand in the result's ``metrics``. ``together``:
    tables that are partitioned alike by one join key are joined where they
    are, without an exchange by all keys.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    seen = Observation()
    if metrics:
        df = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    with _set(spark, **{_CLEANUP: "true", _ALL_KEYS: "false"} if together else {_CLEANUP: "true"}):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.shared_path, written.metrics = path, seen.get if metrics else {}
    return written


def bucketed(df: DataFrame, key: str, name: str, n: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder in one bucket of ``key`` for each shuffle partition, or in ``n``.

    Joins on ``key`` then exchange the other side alone, however often they
    are repeated. A key must not outweigh a bucket: buckets are not split.
    """
    spark = df.sparkSession
    n, path = n or int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    written = spark.table(table)
    written.shared_path, written.shared_table = path, table
    return written


def release(df: DataFrame) -> None:
    """Remove a table that ``materialize`` or ``bucketed`` wrote and nothing will read again."""
    spark, path = df.sparkSession, df.shared_path
    if getattr(df, "shared_table", None):
        spark.sql(f"drop table if exists {df.shared_table}")
    _written[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def _remove_all(spark: SparkSession, app: str) -> None:
    with contextlib.suppress(Exception):  # a session that has ended removes nothing
        for path in _written.pop(app, []):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
