"""Graphs and vectors taken from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.matrix import Matrix
from gridloom.operators.vector import Vector
from gridloom.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(df: DataFrame, key: str) -> int:
    """One more than the largest key."""
    largest = df.agg(F.max(key)).head()[0]
    return 0 if largest is None else largest + 1


def supplier_part(spark: SparkSession, sf_dir: str) -> Matrix:
    """How much of each part each supplier sold."""
    lines = table(spark, sf_dir, "lineitem")
    rows, cols = size_of(table(spark, sf_dir, "supplier"), "s_suppkey"), size_of(table(spark, sf_dir, "part"), "p_partkey")
    return Matrix.from_table(lines, "l_suppkey", "l_partkey", "l_quantity", rows, cols, F.sum("val"))


def customer_part(spark: SparkSession, sf_dir: str) -> Matrix:
    """How many order lines of each part each customer has."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    rows, cols = size_of(table(spark, sf_dir, "customer"), "c_custkey"), size_of(table(spark, sf_dir, "part"), "p_partkey")
    return Matrix.from_table(lines, "o_custkey", "l_partkey", F.lit(1), rows, cols, F.count("val"))


def co_purchase(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Matrix:
    """Parts that stand in one order, in both directions, without loops; ``weighted`` by the orders shared.

    Each pair is counted in one direction and then turned around. Exchanges
    are sized by the lines: orders make more pairs than they have lines, which
    a task whose input was only just small enough could not hold.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = spread(spark, lines.count())
    bought = lines.repartition(tasks, "l_orderkey").distinct()
    pairs = bought.withColumnRenamed("l_partkey", "low").join(bought.withColumnRenamed("l_partkey", "high"), "l_orderkey").where("low < high").select("low", "high")
    counted = pairs.repartition(tasks, "low", "high").groupBy("low", "high").agg(F.count(F.lit(1)).alias("val"))
    n = size_of(table(spark, sf_dir, "part"), "p_partkey")
    val = F.col("val") if weighted else F.lit(1).cast("long").alias("val")
    return Matrix(counted.select(F.expr("stack(2, low, high, high, low) as (row, col)"), val), n, n)


def event_transitions(spark: SparkSession, sf_dir: str) -> Matrix:
    """How often one kind of event follows another of the same user; kinds numbered by name."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kinds = event_kinds(events)
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("event_type").alias("a"), following.alias("b")).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("val"))
    named = [F.create_map(*[F.lit(x) for k in kinds.items() for x in k])[F.col(c)] for c in ("a", "b")]
    return Matrix(pairs.select(named[0].cast("long").alias("row"), named[1].cast("long").alias("col"), "val"), len(kinds), len(kinds))


def event_kinds(events: DataFrame) -> dict[str, int]:
    return {r[0]: i for i, r in enumerate(events.select("event_type").distinct().orderBy("event_type").collect())}


def user_key(spark: SparkSession, sf_dir: str) -> Matrix:
    """How often each user's events hold each value of k."""
    events = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")
    return Matrix.from_table(events, "user_id", "k", F.lit(1), size_of(events, "user_id"), size_of(events, "k"), F.count("val"))


def part_size(spark: SparkSession, sf_dir: str) -> Vector:
    parts = table(spark, sf_dir, "part")
    return Vector.from_table(parts, "p_partkey", F.col("p_size").cast("long"), size_of(parts, "p_partkey"))


def part_price(spark: SparkSession, sf_dir: str) -> Vector:
    parts = table(spark, sf_dir, "part")
    return Vector.from_table(parts, "p_partkey", "p_retailprice", size_of(parts, "p_partkey"))


def supplier_nation(spark: SparkSession, sf_dir: str) -> Vector:
    suppliers = table(spark, sf_dir, "supplier")
    return Vector.from_table(suppliers, "s_suppkey", F.col("s_nationkey").cast("long"), size_of(suppliers, "s_suppkey"))


def customer_nation(spark: SparkSession, sf_dir: str) -> Vector:
    customers = table(spark, sf_dir, "customer")
    return Vector.from_table(customers, "c_custkey", F.col("c_nationkey").cast("long"), size_of(customers, "c_custkey"))


def nation_region(spark: SparkSession, sf_dir: str) -> Vector:
    nations = table(spark, sf_dir, "nation")
    return Vector.from_table(nations, "n_nationkey", F.col("n_regionkey").cast("long"), size_of(nations, "n_nationkey"))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    """One row for each vector, one column for each component, in double precision."""
    vectors = table(spark, sf_dir, "embeddings")
    cells = vectors.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val"))
    dims = vectors.agg(F.max(F.size("embedding"))).head()[0] or 0
    return Matrix(cells.select("row", F.col("col").cast("long"), F.col("val").cast("double").alias("val")), size_of(vectors, "vec_id"), dims)
