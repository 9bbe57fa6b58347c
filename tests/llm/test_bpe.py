"""Forced-boundary BPE and packing against the tokenizers library."""

import random
import zlib
from sys import getsizeof

import numpy as np
import public_tokenizers
import pytest
from plain import sha256
from tokenizers import Tokenizer

from gridloom.llm.bpe import ForcedBoundaryBpe, encode_decode
from gridloom.llm.packing import ByteBpe, pack, piece_lengths, write_buckets
from gridloom.llm.registry import queries

ODD = ["", "  ", "Don't STOP's <|endoftext|> ok <|startoftext|>", "ΑΣ σΣ İstanbul", "á é Ǆ ﬁ 漢字かな 😀 x\x1cy\x85z w", "a" * 500 + "ab" * 300, "１２３ ²½ ٣", "ẞΩÅ ͅ", "​ x  \n\n y", "w" * 5000]


def odd_texts():
    rng = random.Random(1)
    alphabet = [chr(i) for i in [*range(1, 0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x30FF)]]
    return ODD + ["".join(rng.choices(alphabet, k=150)) for _ in range(60)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_text_equal_the_library(name, documents):
    theirs, ours = Tokenizer.from_file(public_tokenizers.path(name)), ForcedBoundaryBpe(public_tokenizers.path(name), cache_entries=500)
    for text in [*odd_texts(), *(t for _, t in documents[:60])]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids, text[:80]
        assert ours.decode(np.array(ids, "<u4").tobytes()) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_characters_equal_the_library(name):
    """Special tokens, characters beyond the basic plane, combining marks and odd blanks, in any order."""
    rng = random.Random(9)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "😀", "𝒳", "é", "e\u0301", "Σας", "İ", "ß", "\x1c", "\x85", "\u00a0", "\n", " ", "§", "ª", "Hello", " world", "'LL", "12", "३", "漢字", "\u200d", "…"]
    theirs = Tokenizer.from_file(public_tokenizers.path(name))
    theirs.no_truncation()
    theirs.no_padding()
    ours = ForcedBoundaryBpe(public_tokenizers.path(name))
    for _ in range(1500):
        text = "".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(0x20, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(1, 25)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == np.array(ids, "<u4").tobytes()


def test_no_merge_crosses_a_cut():
    bpe = ForcedBoundaryBpe(public_tokenizers.path("word_bpe_49k.json"))
    cut = [w for w in ("xqzjv", "qwxzkj", "ñqé") if len(bpe.fragments(w)) > 1]
    assert cut
    for w in cut:
        whole = [s for f in bpe.fragments(w) for s in f]
        assert bpe._encode_fragment(tuple(whole)) == bpe._encode_word(w)


def test_long_and_short_merging_agree():
    bpe = ForcedBoundaryBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(50):
        symbols = rng.choices("aethinosĠ", k=rng.randrange(1, 60))
        assert bpe._merge_long(list(symbols)) == bpe._merge_short(list(symbols))


def held_bytes(remembered):
    return sum(getsizeof(k) + getsizeof(v) for m in (remembered, remembered.before) for k, v in m.items())


def test_memory_does_not_grow_with_long_words():
    words = ForcedBoundaryBpe(public_tokenizers.path("word_bpe_49k.json"))._words
    words.compute = str.encode
    assert all(words[w] == w.encode() for w in (f"{i:01000d}" for i in range(60_000)))
    assert held_bytes(words) <= 48 << 20


def test_maps_of_few_bytes_give_the_same_ids(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    ample, scarce = ForcedBoundaryBpe(path), ForcedBoundaryBpe(path, cache_bytes=20_000)
    for text in [*odd_texts(), *(t for _, t in documents[:60])] * 2:
        assert scarce.encode(text) == ample.encode(text)
    for remembered in (scarce._words, scarce._fragments, scarce._pieces):
        assert held_bytes(remembered) <= 40_000 and "w" * 5000 not in remembered


def test_query(spark, sf, documents):
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries()["op3_bpe"](spark, sf).collect()}
    for i, text in documents:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()), sha256(theirs.decode(ids, skip_special_tokens=False)))


def test_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = encode_decode(odd_docs, path).collect()
    assert len(rows) == 9 and {r["doc_id"]: r["decoded"] for r in rows}[2] == ""
    assert encode_decode(no_docs, path).count() == 0
    byte = public_tokenizers.path("byte_bpe_50k.json")
    packed = pack(odd_docs, byte).collect()
    assert [(r["start"], r["length"], bytes(r["ids"])) for r in packed if r["doc_id"] == 2] == [(0, 1, b"\1\0\0\0")]
    assert sum(r["doc_id"] is None for r in packed) and pack(no_docs, byte).count() == 0


def test_packed_documents_come_back(spark, sf, documents):
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*theirs.encode(t, add_special_tokens=False).ids, 1] for i, t in documents}
    got = queries()["op4_packing"](spark, sf).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    pieces = {}
    for r in got:
        assert r["offset"] == 0 and r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        part = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, ids in want.items():
        ends = 0
        for start, length in sorted(pieces[i]):
            assert start == ends
            ends += length
        assert ends == len(ids)


def test_piece_lengths():
    assert piece_lengths(1, 2048) == [1] and piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 200):
        lengths = piece_lengths(n, 32)
        assert sum(lengths) == n and len(set(x for x in lengths if x < 32)) == len([x for x in lengths if x < 32])


def test_buckets_are_written_apart(spark, documents, tmp_path):
    packed = pack(spark.createDataFrame(documents[:20], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=100)
    write_buckets(packed, f"file://{tmp_path}/b")
    back = spark.read.parquet(f"file://{tmp_path}/b")
    assert back.where("bucket != length or length > 64").count() == 0 and back.count() == packed.count()


def test_byte_ids_equal_the_library():
    theirs, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for text in odd_texts():
        assert list(ours.ids(text)) == theirs.encode(text, add_special_tokens=False).ids
