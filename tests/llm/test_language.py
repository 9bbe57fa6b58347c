"""Language identification: held-out accuracy, proper distributions, odd rows; token counts."""

import pickle

import numpy as np
import plain
import public_tokenizers
import pytest
from plain import words
from pyspark.sql import functions as F

from gridloom.llm.language import ORDER, _kneser_ney, identify, letter_words, score_texts, train, training_sample
from gridloom.llm.registry import queries
from gridloom.llm.token_counts import MARK, Vocabulary, count_tokens, load_vocabulary


def test_held_out_accuracy(spark, sf):
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries()["op6_language"](spark, sf).join(truth, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.lang == got.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_predictions_do_not_read_the_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    columns = ["doc_id", "lang_pred", "score"]
    assert sorted(identify(docs).select(columns).collect()) == sorted(identify(hidden).select(columns).collect())


TEXTS = ["abab abba baba", "bab aab abab", "cab abacus", "a b c"]


def test_probabilities_equal_a_plain_model():
    """Tables to 1e-9; scores of words, in whole, to what single precision keeps; all symbols after a context add up to one."""
    letters = sorted({c for t in TEXTS for c in t if c != " "})
    p, grams = plain.kneser_ney([w for t in TEXTS for w in t.split()], ORDER, len(letters) + 2)
    tables, _ = _kneser_ney(TEXTS, len(letters) + 2)
    for k in range(ORDER):
        want = sorted(p(c, x) for c, x in grams[k])
        assert np.allclose(sorted(np.exp(tables[k]["log"])), want, rtol=0, atol=1e-9)
    model = train({"x": TEXTS, "y": ["other words", "abacus"]})
    at = model.languages.index("x")
    p, _ = plain.kneser_ney([w for t in TEXTS for w in t.split()], ORDER, len({c for t in [*TEXTS, "other words"] for c in t if c != " "}) + 2)
    for word in ("abab", "abacus", "z", "babz", "cc", "abzab"):
        symbols, starts, ends, _ = letter_words([word])
        padded = f"\n{word}\n"
        want = sum(np.log(p(padded[max(0, i - ORDER + 1) : i], padded[i])) for i in range(1, len(padded)))
        assert model.word_scores(symbols, starts, ends)[0, at] == pytest.approx(want, abs=1e-4)
    symbols = sorted({c for t in [*TEXTS, "other words"] for c in t if c != " "}) + ["\n", "z"]
    for context in ("", "\n", "a", "ab", "\nab", "abab", "zz", "cus", "q"):
        assert sum(p(context, x) for x in symbols) == pytest.approx(1, abs=1e-9)


def test_the_model_grows_with_its_languages_and_no_faster():
    """No cap on languages; what is broadcast grows with them in proportion."""
    rng = np.random.default_rng(1)

    def model(n):
        texts = {f"l{i}": [" ".join("".join(chr(0x4E00 + 13 * i + c) for c in rng.integers(0, 13, 6)) for _ in range(120)) for _ in range(6)] for i in range(n)}
        return train(texts), texts

    size = {}
    for n in (8, 70):
        trained, texts = model(n)
        size[n] = len(pickle.dumps(trained))
        best = score_texts(trained, [t[0] for t in texts.values()])[0].argmax(1)
        assert [trained.languages[b] for b in best] == list(texts)
    assert size[70] < 9.5 * size[8]


def test_languages_of_long_texts_only_are_learned(spark):
    """Texts beyond the sample's characters give a piece of whole words."""
    long = {l: [" ".join(rng_words(l, i)) for i in range(12)] for l in ("xx", "yy")}
    rows = [(3 * i + j, t, l) for j, (l, ts) in enumerate(long.items()) for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = training_sample(docs, sample_docs=5, sample_chars=300)
    assert {l: len(t) for l, t in sample.items()} == {"xx": 5, "yy": 5}
    for l, ts in sample.items():
        assert all(150 < len(t) <= 300 and set(t.split()) <= {w for x in long[l] for w in x.split()} for t in ts)
    got = identify(docs, sample_docs=5, sample_chars=300).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def rng_words(language, seed):
    rng = np.random.default_rng(seed)
    letters = {"xx": "abcdefg", "yy": "qrstuvw"}[language]
    return ["".join(rng.choice(list(letters), 5)) for _ in range(400)]


def test_other_scripts_are_rejected_and_mixtures_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("lang is not null and length(text) > 500").limit(150)
    rows = docs.collect()
    en, fr = (next(r["text"] for r in rows if r["lang"] == l)[:400] for l in ("en", "fr"))
    odd = [(10_000, "Щедрик щебетав, прилетіла ластівочка"), (10_001, "12345 !!! ###"), (10_002, f"{en} {fr}")]
    more = docs.union(spark.createDataFrame([(i, t, None) for i, t in odd], docs.schema))
    got = {r["doc_id"]: r for r in identify(more).collect()}
    assert got[10_000]["rejected"] and got[10_001]["rejected"] and got[10_001]["lang_pred"] == "und" and not got[10_002]["rejected"]
    assert sum(got[r["doc_id"]]["rejected"] for r in rows) == 0


def test_unlearned_languages_are_rejected_and_mixtures_stay(spark):
    """Each language of the same script in turn has no label; its texts go, clean and mixed texts of the others stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 600 and 8000").select("doc_id", "text", "lang")
    rows = [r for r in table.orderBy("doc_id").collect() if r["lang"]]
    by = {l: [r["text"] for r in rows if r["lang"] == l] for l in sorted({r["lang"] for r in rows})}
    for unlearned in by:
        known = [l for l in by if l != unlearned]
        model = train({l: by[l][30:] for l in known})
        rejected = lambda texts: _rejected(model, texts).mean()
        assert rejected(by[unlearned][:30]) >= 0.9
        assert rejected([t for l in known for t in by[l][:30]]) <= 0.04
        assert rejected([f"{a[:400]} {b[:400]}" for l, m in zip(known, known[1:], strict=False) for a, b in zip(by[l][:30], by[m][:30], strict=False)]) <= 0.04


def _rejected(model, texts):
    scores, n, loose = score_texts(model, texts)
    return -loose / n > model.limit(scores.argmax(1), n)


def test_odd_rows(odd_docs, no_docs):
    got = identify(odd_docs)
    assert set(odd_docs.columns) | {"held_out", "lang_pred", "entropy", "rejected"} == set(got.columns)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == by_id[4]["lang_pred"] == "und" and by_id[2]["rejected"]
    assert identify(no_docs).count() == 0
    nothing = identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in nothing)


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_trie_equals_one_by_one_and_the_library(vocabulary, documents):
    from tokenizers import Tokenizer, models

    tokens = [MARK + w for w in sorted({w for _, t in documents for w in words(t)})[:3000]] + [MARK + "漢字x😀", MARK + "a" * 60, MARK + "é" * 20, MARK, MARK + "<0x41>"]
    counts = vocabulary.counts(tokens)
    assert counts.tolist() == [vocabulary.count(t) for t in tokens]
    theirs = Tokenizer(models.Unigram([("<unk>", vocabulary.unknown), *vocabulary.scores.items()], 0, False))
    known = [(t, n) for t, n in zip(tokens, counts, strict=True) if all(c in vocabulary.scores for c in t)]
    assert all(len(theirs.encode(t).ids) == n for t, n in known) and len(known) > 2000


def test_best_score_not_longest_piece():
    v = Vocabulary({"a": -1.0, "b": -1.0, "ab": -5.0, "abc": -9.0, "bc": -1.0, "c": -3.0})
    assert v.counts(["abc", "ab", "abz", ""]).tolist() == [2, 2, 3, 0]


def test_token_count_query(spark, sf, documents, vocabulary):
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in queries()["op9_token_counts"](spark, sf).collect()}
    for i, text in documents[:40]:
        own = words(text)
        assert got[i] == (len(own), sum(vocabulary.count(MARK + w) for w in own))


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in count_tokens(odd_docs, path).collect()}
    assert got[2] == got[3] == got[4] == (0, 0) and got[5][0] == 120_000 and got[1] == got[6] == got[None]
    assert count_tokens(no_docs, path).count() == 0
