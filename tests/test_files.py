"""Files, generators and the edge feed."""

import pytest
from pyspark.sql import functions as F

from gridloom.errors import InvalidValue
from gridloom.operators.matrix import Matrix
from gridloom.operators.vector import Vector
from gridloom.sources import files, generate
from gridloom.streaming.edges import EdgeFeed


def cells(a):
    return sorted((r["row"], r["col"], r["val"]) for r in a.df.collect())


def test_text_and_binary_files_agree(spark, tmp_path):
    a = Matrix.build(spark, [0, 0, 1, 2, 3], [1, 2, 2, 0, 3], [1] * 5, "long")
    files.write_mtx(a, f"file://{tmp_path}/a.mtx")
    (tmp_path / "b.mtxbin").write_bytes(files.mtxbin_bytes(Matrix(a.df.where("row != col"), 4, 4)))
    text, binary = files.read_mtx(spark, f"file://{tmp_path}/a.mtx", strict=True), files.read_mtx(spark, f"file://{tmp_path}/b.mtxbin")
    # the first edge is kept; loops are not written
    assert cells(text) == cells(binary) == [(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 0, 1)]
    assert (text.nrows, text.ncols) == (binary.nrows, binary.ncols) == (4, 4)


def test_folders_of_parts_come_back_whole(spark, tmp_path):
    """The part with the sizes need not be the largest or the first that Spark deals."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = generate.random_uniform(spark, 9, 6, seed=2)
        kept = sorted({(r, c, 1) for r, c, _ in cells(a) if r != c})
        files.write_mtx(a, f"file://{tmp_path}/a.mtx")
        assert len(list((tmp_path / "a.mtx").glob("part-*"))) > 4
        text = files.read_mtx(spark, f"file://{tmp_path}/a.mtx", strict=True)
        assert cells(text) == kept and (text.nrows, text.ncols) == (512, 512)
        for _ in range(2):  # a second time over what is there
            files.write_mtxbin(text, f"file://{tmp_path}/b.mtxbin", part_edges=100)
        assert len(list((tmp_path / "b.mtxbin").iterdir())) >= len(kept) / 100
        binary = files.read_mtx(spark, f"file://{tmp_path}/b.mtxbin")
        assert cells(binary) == kept and (binary.nrows, binary.ncols) == (512, 512)
        files.write_mtxbin(Matrix(a.df.where("false"), 3, 4), f"file://{tmp_path}/c.mtxbin")
        empty = files.read_mtx(spark, f"file://{tmp_path}/c.mtxbin")
        assert cells(empty) == [] and (empty.nrows, empty.ncols) == (3, 4)
        (tmp_path / "list").mkdir()
        (tmp_path / "list" / "a.txt").write_text("9 9\n" * 6 + "0 1\n")
        (tmp_path / "list" / "b.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(1, 2000)))
        assert cells(files.read_edge_list(spark, f"file://{tmp_path}/list")) == [(i, i + 1, 1) for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from gridloom.shared import shared_dir

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(InvalidValue):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_coordinate_file_with_comments_values_and_an_edge_like_its_sizes(spark, tmp_path):
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 4\n3 3 4\n1 2 0.5\n2 1 7\n\n1 1 1\n")
    a = files.read_mtx(spark, f"file://{tmp_path}/c.mtx")
    assert cells(a) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (2, 2, 1)]
    with pytest.raises(InvalidValue):
        files.read_mtx(spark, f"file://{tmp_path}/c.mtx", strict=True)
    with pytest.raises(InvalidValue):
        files.read_mtx(spark, "graph.csv")


def test_edge_list_and_raw_lines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("#\n" * 6 + "0 1\n1 2\n2 2\n")
    a = files.read_edge_list(spark, f"file://{tmp_path}/e.txt")
    assert cells(a) == [(0, 1, 1), (1, 2, 1), (2, 2, 1)] and a.nrows == 3
    assert files.read_edge_list(spark, f"file://{tmp_path}/e.txt", undirected=True).nnz() == 6
    (tmp_path / "raw.tsv").write_text("% c\n1\t2\n1 2\n2 3 0.5\nx y\n")
    raw = files.convert_raw(spark, f"file://{tmp_path}/raw.tsv")
    assert cells(raw) == [(0, 1, 1), (1, 2, 1)] and raw.nrows == 3


def test_dot_file(spark, tmp_path):
    a = Matrix.build(spark, [0, 1], [1, 0], [5, 5], "long")
    files.write_dot(a, f"file://{tmp_path}/g", Vector.ascending(spark, 2), directed=False)
    lines = [r[0] for r in spark.read.text(f"file://{tmp_path}/g").collect()]
    assert sorted(lines) == sorted(["graph G {", '0 [label = "0"];', '1 [label = "1"];', '0 -- 1 [label = "5"];', "}"])


def test_generators_repeat_themselves(spark):
    for make in (generate.random_uniform, generate.rmat):
        a = make(spark, 8, 4, seed=3)
        assert cells(a) == cells(make(spark, 8, 4, seed=3)) != cells(make(spark, 8, 4, seed=4))
        assert a.nnz() == 1024 and a.df.where((F.col("row") >= 256) | (F.col("col") >= 256)).isEmpty()
    assert generate.random_uniform(spark, 4, 2, undirected=True).nnz() == 64
    with pytest.raises(InvalidValue):
        generate.rmat(spark, 3, 2, chances=(50, 20, 20, 5))


def test_rmat_is_skewed_as_asked(spark):
    a = generate.rmat(spark, 10, 16, seed=1, shuffle=False)
    top = a.df.where("row < 512 and col < 512").count() / a.nnz()
    assert abs(top - 0.57) < 0.03
    degrees = a.degrees().df.agg(F.max("val")).head()[0]
    assert degrees > 5 * 16


def test_shuffle_renames_vertices(spark):
    a = generate.rmat(spark, 6, 4, seed=1, shuffle=False)
    b = a.shuffled(9)
    assert sorted(r["val"] for r in a.degrees().df.collect()) == sorted(r["val"] for r in b.degrees().df.collect())


def test_stencil(spark):
    a = generate.stencil(spark, 4, 4, 4)
    assert a.degrees().df.agg(F.max("val"), F.min("val")).head()[:] == (27, 8)
    assert a.is_symmetric() and a.get(0, 0) == 26 and a.get(0, 1) == -1


def test_load_graph_and_generate_file(spark, tmp_path):
    a = generate.generate_file(spark, f"file://{tmp_path}/g.mtx", "hpcg", nx=2, ny=2, nz=2)
    assert generate.load_graph(spark, "mtx", path=f"file://{tmp_path}/g.mtx", simple=True).nnz() == a.nnz() - 8
    with pytest.raises(InvalidValue):
        generate.load_graph(spark, "ssca2")


def test_edge_feed_counts_a_replayed_batch_once(spark, tmp_path):
    feed = EdgeFeed(spark)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(0, 1, 1), (0, 1, 2), (2, 3, 1)], "row long, col long, val long").write.parquet(f"file://{tmp_path}/in/a")
    stream = spark.readStream.schema("row long, col long, val long").parquet(f"file://{tmp_path}/in/*")
    feed.start(stream, f"file://{tmp_path}/state").awaitTermination()
    spark.createDataFrame([(1, 2, 1)], "row long, col long, val long").write.parquet(f"file://{tmp_path}/in/b")
    feed.start(stream, f"file://{tmp_path}/state").awaitTermination()
    feed.fold(spark.createDataFrame([(1, 2, 1)], "row long, col long, val long"), 1)
    assert {tuple(r) for r in feed.degrees().collect()} == {(0, 1, 3), (2, 1, 1), (1, 1, 1)}
    assert {r["label"] for r in feed.components(4).collect()} == {0}
