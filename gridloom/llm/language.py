"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of words, all held in sorted hash
arrays; a text gets the language of the lowest cross-entropy per symbol. What
fits no model as well as texts set aside in training did is rejected.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.words import chunks, mix

#: Bounds of the training sample: documents for each language, and characters of a document; longer ones give a piece.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 8_000
ORDER = 5
#: Symbols at which the score of a text stops growing more certain.
EVIDENCE = 200
#: A text is rejected if its cross-entropy, each word under the model that fits it best, is this many deviations
#: (for its length) above what held-aside texts of its language have, and has gone this share of the way from
#: there to what texts of a language that no model knows have; words of documents that mix languages fit one model
#: each, so these documents, and such as hold keys and numbers, lie below and stay.
REJECT_SIGMAS = 8.0
REJECT_SHARE = 0.7
#: With fewer held-aside texts nothing is rejected for its cross-entropy.
LEAST_CALIBRATION = 20
#: Bytes of word scores remembered by a Python worker.
REMEMBERED_BYTES = 16 << 20
#: Words times languages that are scored at once.
SCORED = 80_000
UNDETERMINED = "und"

_EDGE = np.uint32(0x110000)  # the symbol at both ends of a word


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends, row): maximal runs of letters, lower-cased, of each text."""
    joined = np.frombuffer(" ".join(texts).encode("utf-32-le", "replace"), "<u4")
    symbols = _letters()[joined] if len(joined) else np.zeros(0, np.uint32)
    inside = np.concatenate([[False], symbols > 0, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return symbols, starts, ends, np.searchsorted(first, starts, "right") - 1


def _word_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - starts
    h = mix(length.astype(np.uint64))
    live, done = np.arange(len(starts)), 0
    while len(live):
        h[live] = mix(h[live] ^ symbols[starts[live] + done].astype(np.uint64))
        done += 1
        live = live[length[live] > done]
    return h


def _grams(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(place of each predicted symbol in its word from 1, keys of the grams that end there by order, word).

    Words are padded with one edge symbol at either end; the first is never
    predicted. Grams reach back to it at most; grams[k] has order k + 1.
    """
    length = ends - starts
    size = length + 2
    flat = np.full(int(size.sum()), _EDGE, np.uint32)
    at = np.cumsum(size) - size
    word = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(flat)) - at[word]
    letters = (place > 0) & (place <= length[word])
    flat[letters] = symbols[(starts[word] + place - 1)[letters]]
    predicted = place > 0
    grams = []
    with np.errstate(over="ignore"):
        for order in range(1, ORDER + 1):
            key = np.full(len(flat), order, np.uint64)
            for back in reversed(range(order)):
                key = mix(key * np.uint64(31) ^ np.roll(flat, back).astype(np.uint64))
            grams.append(key[predicted])
    return place[predicted], grams, word[predicted]


@dataclass
class Sparse:
    """A sorted hash array whose keys have a value in some languages: those of key i stand from bounds[i] to bounds[i + 1]."""

    keys: np.ndarray
    bounds: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(keys: list[np.ndarray], values: list[np.ndarray]) -> Sparse:
        """From sorted keys and their values by language."""
        flat = np.concatenate([np.zeros(0, np.uint64), *keys])
        language = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        every, first = np.unique(flat[order], return_index=True)
        value = np.concatenate([np.zeros(0), *values])[order]
        return Sparse(every, np.append(first, len(flat)).astype(np.int64), language[order], value.astype(np.float32))

    def lookup(self, wanted: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, value) of all values of the keys wanted in ``some`` rows."""
        at = _find(self.keys, wanted)
        rows = np.flatnonzero(some & (at >= 0))
        start = self.bounds[at[rows]]
        n = self.bounds[at[rows] + 1] - start
        flat = np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)
        return np.repeat(rows, n), self.language[flat], self.value[flat]


@dataclass
class Model:
    """Sorted hash arrays of all orders; what a gram is worth is stored for the languages that know it."""

    languages: list[str]
    logs: list[Sparse]  # by order: log probability of grams
    back: list[Sparse]  # by order: log weight of the next shorter order after a context
    empty: np.ndarray  # the weight that precedes the floor, by language
    floor: float  # log probability of a symbol that no order knows
    mean: np.ndarray  # of the cross-entropy of held-aside texts, each word under its best model
    spread: np.ndarray  # of the same, times the root of the symbols
    foreign: np.ndarray  # the same under the other models only, of the nearest language left out

    def limit(self, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The highest cross-entropy of texts of n symbols that are not rejected."""
        mean = self.mean[language]
        deviation = self.spread[language] / np.sqrt(np.clip(n, 1, EVIDENCE))
        return mean + np.maximum(REJECT_SIGMAS * deviation, REJECT_SHARE * (self.foreign[language] - mean))

    def word_scores(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        place, grams, word = _grams(symbols, starts, ends)
        contexts = _contexts(symbols, starts, ends)
        total = np.zeros((len(place), len(self.languages)))
        open_ = np.ones_like(total, bool)
        for k in reversed(range(ORDER)):
            row, language, value = self.logs[k].lookup(grams[k], (place >= k) & open_.any(1))
            still = open_[row, language]
            row, language, value = row[still], language[still], value[still]
            total[row, language] += value
            open_[row, language] = False
            if k:
                row, language, value = self.back[k].lookup(contexts[k], (place >= k) & open_.any(1))
                still = open_[row, language]
                total[row[still], language[still]] += value[still]
        total += np.where(open_, self.empty + self.floor, 0.0)
        out = np.zeros((len(starts), len(self.languages)))
        np.add.at(out, word, total)
        return out


def _contexts(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Keys of the symbols before each predicted one, by the order of the gram they start."""
    length = ends - starts
    size = length + 2
    flat = np.full(int(size.sum()), _EDGE, np.uint32)
    at = np.cumsum(size) - size
    word = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(flat)) - at[word]
    letters = (place > 0) & (place <= length[word])
    flat[letters] = symbols[(starts[word] + place - 1)[letters]]
    predicted = place > 0
    out = [np.zeros(int(predicted.sum()), np.uint64)]
    with np.errstate(over="ignore"):
        for order in range(2, ORDER + 1):
            key = np.full(len(flat), order + 100, np.uint64)
            for back in reversed(range(1, order)):
                key = mix(key * np.uint64(31) ^ np.roll(flat, back).astype(np.uint64))
            out.append(key[predicted])
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in a sorted array, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _kneser_ney(texts: list[str], alphabet: int) -> tuple[list[dict[str, np.ndarray]], float]:
    """By order the gram keys, their probabilities, the context keys and their back-off weights, of one language."""
    symbols, starts, ends, _ = letter_words(texts)
    place, grams, _ = _grams(symbols, starts, ends)
    contexts = _contexts(symbols, starts, ends)
    tables: list[dict[str, np.ndarray]] = []
    probability: list[np.ndarray] = []
    for k in range(ORDER):
        valid = place >= k
        keys, first, count = np.unique(grams[k][valid], return_index=True, return_counts=True)
        count = count.astype(np.float64)
        if k < ORDER - 1:
            # lower orders count the different symbols that precede a gram, except at a word's start, where none does
            longer = place >= k + 1
            wide, at = np.unique(grams[k + 1][longer], return_index=True)
            suffix, n = np.unique(grams[k][longer][at], return_counts=True)
            found = _find(suffix, keys)
            at_start = (place[valid][first] == k) & (k > 0)
            count = np.where(at_start, count, np.where(found >= 0, n[found], count))
        ctx_of = contexts[k][valid][first]
        ctx, of = np.unique(ctx_of, return_inverse=True)
        total = np.bincount(of, count)
        kinds = np.bincount(of)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        lower = 1.0 / alphabet if k == 0 else probability[k - 1][_find(tables[k - 1]["keys"], grams[k - 1][valid][first])]
        p = np.maximum(count - discount, 0) / total[of] + discount * kinds[of] / total[of] * lower
        probability.append(p)
        tables.append({"keys": keys, "log": np.log(p), "contexts": ctx, "back": np.log(discount * kinds / total)})
    return tables, -math.log(alphabet)


def train(samples: dict[str, list[str]]) -> Model:
    """A model of texts by language. Every fourth text is held aside to calibrate the rejection."""
    languages = sorted(samples)
    fit = {l: [t for i, t in enumerate(samples[l]) if i % 4 or len(samples[l]) < 8] for l in languages}
    alphabet = len(np.unique(np.concatenate([np.zeros(1, np.uint32), *(letter_words(fit[l])[0] for l in languages)]))) + 1
    tables = {l: _kneser_ney(fit[l], alphabet) for l in languages}
    logs, back = ([Sparse.of([tables[l][0][k][keys] for l in languages], [tables[l][0][k][values] for l in languages]) for k in range(ORDER)] for keys, values in (("keys", "log"), ("contexts", "back")))
    empty = np.array([tables[l][0][0]["back"][0] if len(tables[l][0][0]["back"]) else 0.0 for l in languages])
    model = Model(languages, logs, back, empty, -math.log(max(2, alphabet)), np.zeros(len(languages)), np.ones(len(languages)), np.zeros(len(languages)))
    aside_count, left_out = 0, []
    for c, l in enumerate(languages):
        aside = [t for i, t in enumerate(samples[l]) if not i % 4] or samples[l]
        _, n, loose = score_texts(model, aside)
        ok = n > 0
        aside_count += int(ok.sum())
        entropy = -loose[ok] / n[ok]
        model.mean[c] = entropy.mean() if len(entropy) else math.log(max(2, alphabet))
        wide = np.sqrt(np.mean((entropy - model.mean[c]) ** 2 * np.minimum(n[ok], EVIDENCE))) if len(entropy) > 1 else 1.0
        model.spread[c] = max(wide, 0.5)
        if len(languages) > 1 and ok.any():  # as if the language were not learned
            left_out.append(np.mean(-score_texts(model, aside, without=c)[2][ok] / n[ok]))
    calibrated = aside_count >= LEAST_CALIBRATION
    for c in range(len(languages)):
        # languages that the models do not tell apart say nothing of unknown ones; an alphabet of evenly likely symbols stands in where none is left
        apart = [e for e in left_out if e > model.mean[c] + REJECT_SIGMAS * model.spread[c] / math.sqrt(EVIDENCE)]
        model.foreign[c] = min(apart, default=math.log(max(2, alphabet))) if calibrated else np.inf
    return model


class _Memory:
    """Scores of words met before, in sorted arrays of bounded size."""

    def __init__(self):
        self.keys, self.scores = np.zeros(0, np.uint64), None


def score_texts(model: Model, texts: list[str], memory: _Memory | None = None, without: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability of each text by language, its predicted symbols, log probability with each word under its best model but ``without``)."""
    memory = memory or _Memory()
    symbols, starts, ends, row = letter_words(texts)
    total, n, loose = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts)), np.zeros(len(texts))
    if not len(starts):
        return total, n, loose
    h = _word_hashes(symbols, starts, ends)
    keys, first, of, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if memory.scores is None:
        memory.scores = np.zeros((0, len(model.languages)))
    at = _find(memory.keys, keys)
    scores = np.zeros((len(keys), len(model.languages)))
    scores[at >= 0] = memory.scores[at[at >= 0]]
    new = np.flatnonzero(at < 0)
    step = max(256, SCORED // len(model.languages))
    for lo in range(0, len(new), step):
        some = new[lo : lo + step]
        scores[some] = model.word_scores(symbols, starts[first[some]], ends[first[some]])
    again = new[times[new] > 1]  # words met once are seldom met again
    if len(again):
        if len(memory.keys) + len(again) > REMEMBERED_BYTES // (8 * len(model.languages) + 8):
            memory.keys, memory.scores = memory.keys[:0], memory.scores[:0]
        merged = np.concatenate([memory.keys, keys[again]])
        order = np.argsort(merged)
        memory.keys, memory.scores = merged[order], np.concatenate([memory.scores, scores[again]])[order]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    full = np.flatnonzero(np.diff(bounds))
    total[full] = np.add.reduceat(scores[of], bounds[:-1][full], 0)
    n[full] = np.add.reduceat(ends - starts + 1, bounds[:-1][full])
    best = (scores if without is None else np.delete(scores, without, 1)).max(1)
    loose[full] = np.add.reduceat(best[of], bounds[:-1][full])
    return total, n, loose


def _piece(text: str, most: int) -> str:
    """A text of one character more than ``most`` was cut from a longer one: without the words at its ends, which may be cut."""
    if len(text) <= most:
        return text
    inner = text.partition(" ")[2].rpartition(" ")[0]
    return inner or text[:most]


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """At most ``sample_docs`` texts for each language, those whose doc_id has the least hash.

    Every language counts, and texts of any length: of more than
    ``sample_chars`` characters a piece at a place that the hash names is
    taken. From the number of a language's documents follows the hash below
    which some three times as many as wanted are expected; only those are
    sorted, so no task's rows grow with the corpus. What the driver holds grows
    with the number of languages alone.
    """
    h = F.xxhash64("doc_id")
    long = F.char_length("text") > sample_chars
    piece = F.when(long, F.substring("text", (F.pmod(h, F.char_length("text") - sample_chars) + 1).cast("int"), F.lit(sample_chars + 1))).otherwise(F.col("text"))
    eligible = docs.where(F.col("lang").isNotNull() & (F.char_length("text") > 0)).select("lang", piece.alias("text"), h.alias("h"))
    counts = eligible.groupBy("lang").count().collect()
    if not counts:
        return {}
    parts = 1 << 30
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(parts, math.ceil(3 * sample_docs / r["count"] * parts)))])
    place = Window.partitionBy("lang").orderBy("h", "text")
    few = eligible.where(F.pmod("h", F.lit(parts)) < F.try_element_at(below, F.col("lang")))
    chosen = few.withColumn("n", F.row_number().over(place)).where(F.col("n") <= sample_docs).select("lang", "n", "text")
    samples: dict[str, list[str]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["n"])):
        samples.setdefault(row["lang"], []).append(_piece(row["text"], sample_chars))
    return samples


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, keep: list[str] | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` (or its columns in ``keep``, doc_id among them) with held_out, lang_pred, score, entropy and rejected, learned from ``docs`` itself.

    Training reads text and lang of a bounded sample of documents that are not
    held out: ``sample_docs`` of each language, ``sample_chars`` characters of each; predictions read whole texts and nothing else. ``score`` is the
    winner's share of the likelihoods, for at most EVIDENCE symbols.
    ``rejected``: no letters, or a cross-entropy (each word under the model
    that fits it best) above the limit that texts held aside in training
    calibrate, those of each language also as if it were not learned. With
    fewer than LEAST_CALIBRATION such texts only texts without letters are
    rejected, so a few more labelled rows can change that of other rows.

    Null text, no letters, or nothing to learn from: ``und`` with score 0,
    rejected. Null doc_id: not held out. Repeated rows count as rows; ties go
    to the language first in order. Empty table: empty result. Other columns
    pass through; columns with the new names are replaced.
    """
    new = ["held_out", "lang_pred", "score", "entropy", "rejected"]
    docs = docs.select(*[c for c in docs.columns if c not in new])
    samples = training_sample(docs.where(~held_out(F.col("doc_id"))), sample_docs, sample_chars)
    model = train(samples) if samples else None
    names = docs.columns if keep is None else list(keep)
    places, at_text = [docs.columns.index(c) for c in names], docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memories: dict[int, _Memory] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, memories.setdefault(0, _Memory())
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column(at_text).to_pylist()]
                if model is None:
                    columns = [[UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)]
                else:
                    scores, n, loose = score_texts(model, texts, memory)
                    best = scores.argmax(1)
                    some = n > 0
                    top = scores[np.arange(len(texts)), best]
                    entropy = -top / np.maximum(n, 1)
                    trust = np.minimum(n, EVIDENCE) / np.maximum(n, 1)
                    share = 1 / np.exp((scores - top[:, None]) * trust[:, None]).sum(1)
                    odd = -loose / np.maximum(n, 1) > model.limit(best, n)
                    columns = [
                        [model.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)],
                        np.where(some, share, 0.0),
                        pa.array(entropy, mask=~some),
                        odd | ~some,
                    ]
                kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                added = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *added], [*names, *new[1:]])

    schema = docs.select(*names).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "entropy": F.lit(None).cast("double"), "rejected": F.lit(True)}).schema
    return docs.mapInArrow(run, schema).withColumn("held_out", held_out(F.col("doc_id")))
