"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of many texts form a trie. The best unigram score of
every prefix is computed once, at its node, from the scores of the nodes above
it, and a word's token count is what its last node stores.

The vocabulary's file holds merge ranks and no probabilities, and tokenizers
are not trained here. So a piece's score is its log probability by Zipf's law
for its place in the order of those ranks.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.words import Words, chunks

#: Text bytes whose words share a trie.
TRIE_BYTES = 4 << 20
#: Characters of a pre-token that the trie takes; longer ones, which share no prefix worth keeping, are scored alone.
TRIE_DEPTH = 48
#: What precedes each word in the vocabulary.
MARK = "▁"
#: How much worse than the worst piece a character outside the vocabulary is.
UNKNOWN = 10.0

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Vocabulary:
    """Pieces with unigram scores, by length in sorted arrays of hashes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.reach: dict[str, int] = {}  # the longest piece that ends in a character
        for piece in scores:
            self.reach[piece[-1]] = max(self.reach.get(piece[-1], 0), len(piece))
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.keys, self.values = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for n in range(1, self.longest + 1):
            pieces = [p for p in scores if len(p) == n]
            h = np.zeros(len(pieces), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    h = h * _BASE + np.array([ord(p[i]) + 1 for p in pieces], np.uint64)
            order = np.argsort(h)
            self.keys.append(h[order])
            self.values.append(np.array([scores[p] for p in pieces])[order])

    def lookup(self, length: int, h: np.ndarray) -> np.ndarray:
        """Scores of pieces of a length; minus infinity where there is none."""
        keys = self.keys[length]
        if not len(keys):
            return np.full(len(h), -np.inf)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, self.values[length][at], -np.inf)

    def count(self, word: str) -> int:
        """Tokens of one pre-token without a trie: the best score, of equals the fewest tokens.

        Of the prefixes only as many scores are held as the longest piece has
        characters, whatever the length of the word.
        """
        best = deque([(0.0, 0)], self.longest)  # of the last prefixes
        for end, last in enumerate(word, 1):
            options = []
            for n in range(1, min(end, self.reach.get(last, 0)) + 1):
                score = self.scores.get(word[end - n : end])
                if score is not None:
                    options.append((best[-n][0] + score, best[-n][1] - 1))
            if last not in self.scores:
                options.append((best[-1][0] + self.unknown, best[-1][1] - len(last.encode())))
            best.append(max(options))
        return -best[-1][1]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, the scores of shared prefixes computed once."""
        out = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words])
        for i in np.flatnonzero(lengths > TRIE_DEPTH):
            out[i] = self.count(words[i])
        short = np.flatnonzero((lengths <= TRIE_DEPTH) & (lengths > 0))
        if not len(short):
            return out
        table = np.array([words[i] for i in short])
        order = np.argsort(table)
        table, size = table[order], lengths[short][order]
        chars = table.view(np.uint32).reshape(len(table), -1)
        same = np.ones(len(table) - 1, bool)  # does a word share the prefix with the one before
        root = np.zeros(1)
        # by depth: each word's node, each node's score, tokens (negative) and prefix hash
        node, score, tokens, prefix = [np.zeros(len(table), np.int64)], [root], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        power = [np.uint64(1)]
        ends = np.zeros(len(table), np.int64)
        with np.errstate(over="ignore"):
            for depth in range(1, chars.shape[1] + 1):
                reach = size >= depth
                same &= (chars[1:, depth - 1] == chars[:-1, depth - 1]) & reach[1:] & reach[:-1]
                new = reach & np.concatenate([[True], ~same])
                node.append(np.cumsum(new) - 1)
                of = np.flatnonzero(new)  # the first word of each node speaks for it
                last = chars[of, depth - 1].astype(np.uint64)
                above = node[depth - 1][of]
                prefix.append(prefix[depth - 1][above] * _BASE + last + np.uint64(1))
                power.append(power[-1] * _BASE)
                known = self.lookup(1, last + np.uint64(1))
                unknown = np.isinf(known)
                bytes_ = 1 + (last > 0x7F) + (last > 0x7FF) + (last > 0xFFFF)
                best = score[depth - 1][above] + np.where(unknown, self.unknown, known)
                least = tokens[depth - 1][above] - np.where(unknown, bytes_, 1).astype(np.int64)
                for n in range(2, min(depth, self.longest) + 1):
                    start = node[depth - n][of]
                    value = score[depth - n][start] + self.lookup(n, prefix[depth] - prefix[depth - n][start] * power[n])
                    fewer = tokens[depth - n][start] - 1
                    better = (value > best) | ((value == best) & (fewer > least))
                    best, least = np.where(better, value, best), np.where(better, fewer, least)
                score.append(best)
                tokens.append(least)
                done = size == depth
                ends[done] = -tokens[depth][node[depth][done]]
        out[short[order]] = ends
        return out


@lru_cache(maxsize=2)
def load_vocabulary(model_path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model, scored by Zipf's law for the order of the scores stored there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ordinary.sort(key=lambda i: (-model.get_score(i), i))
    total = sum(1 / r for r in range(1, len(ordinary) + 1))
    return Vocabulary({model.id_to_piece(i): -math.log(r * total) for r, i in enumerate(ordinary, 1)})


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every whole text of ``docs``.

    Pre-tokens are runs of anything but [\\x20\\x09-\\x0D] with the mark for a
    word's start before them. Each is split into the pieces whose scores add
    up to most (of equals, the fewest), the likeliest split of a unigram model; a character outside the vocabulary
    counts as its UTF-8 bytes.

    Null, empty or blank text: no tokens. Null doc_ids and repeated rows are
    counted like others; an empty table gives an empty result; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(model_path)
        for batch in batches:
            for part in chunks(batch, "text", TRIE_BYTES):
                words = Words(part.column(1))
                _, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
                distinct = [MARK + words.data[words.starts[i] : words.ends[i]].tobytes().decode() for i in first]
                sums = np.concatenate([[0], np.cumsum(vocabulary.counts(distinct)[of])]) if len(of) else np.zeros(1, np.int64)
                n = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.bounds)), pa.array(n)], ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
