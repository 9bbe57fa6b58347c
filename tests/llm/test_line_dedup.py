"""Line dedup on odd rows; the query has SQL."""

import plain

from gridloom.llm.line_dedup import dedup_lines

SHARED = "This Line is long enough to be counted as shared"


def test_against_a_plain_version(spark):
    docs = [(i, f"start {i}\n  {SHARED if i % 2 else SHARED.upper()}\t\nshort\n{SHARED}\nend") for i in range(6)]
    docs += [(10, f"{SHARED}x"), (11, "É" * 40), (12, "É" * 40), (13, "é" * 40), (14, "\n\n"), (15, f"{SHARED}\r")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(df).collect()}
    assert got == plain.dedup_lines(docs, 40, 5)
    assert got[15][2] == 0 and got[0] == ("start 0\nshort\nend", 5, 2)


def test_odd_rows(odd_docs, no_docs):
    got = dedup_lines(odd_docs)
    assert got.columns == [c for c in odd_docs.columns if c not in ("text", "n_lines")] + ["text", "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == 9 and all(r["n_dropped"] == 0 for r in rows)
    assert {r["doc_id"]: r["text"] for r in rows}[2] == ""
    assert dedup_lines(no_docs).count() == 0


def test_a_repeated_row_is_one_document(spark):
    docs = spark.createDataFrame([(1, SHARED)] * 5 + [(2, SHARED)], "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in dedup_lines(docs).collect())
    assert sum(r["n_dropped"] for r in dedup_lines(docs, min_docs=2).collect()) == 5


def test_plan_is_native(spark, documents):
    df = dedup_lines(spark.createDataFrame(documents, "doc_id long, text string"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))


def test_many_dropped_lines_in_one_text(spark):
    long = "\n".join([SHARED] * 20_000)
    docs = spark.createDataFrame([(i, long) for i in range(5)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in dedup_lines(docs).collect()) == [0] + [20_000] * 4
