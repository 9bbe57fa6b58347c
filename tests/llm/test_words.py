"""The numpy word splitter against a regular expression."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import words

from gridloom.llm.components import connected_components
from gridloom.llm.words import Words, chunks, shingle_sets

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x85é漢", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(column):
    found = Words(pa.array(column, pa.string()))
    h = found.hashes()
    seen = {}
    for i, text in enumerate(column):
        own = range(found.bounds[i], found.bounds[i + 1])
        assert [bytes(found.data[found.starts[j] : found.ends[j]]).decode() for j in own] == words(text)
        for j, w in zip(own, words(text), strict=True):
            assert seen.setdefault(w, h[j]) == h[j]
    assert len(set(seen.values())) == len(seen)
    assert (np.bincount(found.rows(), minlength=len(column)) == np.diff(found.bounds)).all()


def test_hashes_do_not_depend_on_the_place():
    long = "x" * 3000
    a, b = (Words(pa.array(c)).hashes() for c in ([f"one {long} three"], ["zero", f"{long} one three"]))
    assert set(a) <= set(b)


def test_shingles_of_short_texts():
    sets = shingle_sets(pa.array(["A b", "a", "", None, "a b c", "b a"]), 2)
    assert [len(s) for s in sets] == [1, 1, 0, 0, 2, 1]
    assert set(sets[0]) < set(sets[4]) and not set(sets[1]) & set(sets[0])


def test_chunks_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["aaa", None, "bbbbbb", "c"]})
    parts = list(chunks(batch, "text", 4))
    assert [p.num_rows for p in parts] == [2, 1, 1]


@pytest.mark.parametrize("size", [1, 50])
def test_components(spark, size):
    chain = [(i, i + 1) for i in range(size)] + [(100, 101), (102, 101), (7, 7), (200, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(size + 1)} | {100: 100, 101: 100, 102: 100}


def test_components_of_a_hub(spark):
    links = spark.range(1, 3000).selectExpr("id as a", "0L as b")
    assert connected_components(links).groupBy("component").count().collect()[0][:] == (0, 3000)
