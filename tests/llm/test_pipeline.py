"""The corpus pipeline against a plain version of its stages."""

import plain
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm.language import identify


def test_run_equals_plain_stages(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    kept = identify(source).where(~F.col("rejected")).select("doc_id", "text").collect()
    docs = [(r["doc_id"], r["text"]) for r in kept]
    docs = [(i, t) for i, (t, _, _) in plain.dedup_lines(docs, 40, 5).items()]
    near = plain.near_components(docs, 5, 80)
    docs = [(i, t) for i, t in docs if near[i][1] == i]
    docs = {i: t for i, (t, _, _) in plain.dedup_substrings(docs, 13).items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want


def test_stages_return_documents(spark, sf, odd_docs):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() >= table.count()


def test_stages_decide(spark, sf, odd_docs):
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    ids = lambda name: sorted((r["doc_id"] for r in dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect()), key=repr)
    # texts without letters go; of equal texts the first stays, with rows that have no id
    assert ids("language id") == sorted([1, 5, 6, 6, 7, None], key=repr)
    assert ids("near dedup") == sorted([1, 2, 3, 4, 5, 7, None], key=repr)
