import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.fixture(scope="session")
def same_rows(spark, sf, duck):
    """Compares a query with its SQL: names, and rows in any order."""

    def rounded(row, at):
        return tuple(float(f"{row[i]:.12g}") if isinstance(row[i], float) else row[i] for i in at)

    def rows(data, columns):
        at = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((rounded(r, at) for r in data), key=repr)

    def check(query, sql):
        df = query(spark, sf)
        relation = duck.sql(sql)
        assert sorted(df.columns) == sorted(relation.columns)
        assert rows([tuple(r) for r in df.collect()], df.columns) == rows(relation.fetchall(), relation.columns)

    return check
