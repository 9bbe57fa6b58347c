"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring symbols that occurs inside no vocabulary token can
never be bridged by a merge, so it marks a certain cut. Pre-tokens are cut
there, fragments are encoded on their own (and remembered), and their ids are
concatenated.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-tokens, and fragments of cut ones, that a Python worker remembers; up to twice as many are held.
CACHE_ENTRIES = 300_000
#: Bytes that one such map may take, whatever the length of its keys; up to twice as many are held.
CACHE_BYTES = 24 << 20
#: What an entry takes besides key and value: its slot in the table, and a symbol with the suffix.
ENTRY_BYTES = 120
#: Text bytes whose results go into one Arrow batch.
BATCH_BYTES = 1 << 20

# Fixed pattern of byte-level pre-tokenizers that name no pattern of their own.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(moved)) for b in range(256)]


@lru_cache(maxsize=1)
def unstable_chars() -> re.Pattern:
    """Characters whose class may differ between Unicode versions, and odd controls.

    A text that holds one is normalised and cut to pre-tokens by the tokenizers
    library, which has classes of its own.
    """
    old = unicodedata.ucd_3_2_0
    odd = {*range(0x1C, 0x20), 0x85}
    bad = [c in odd or old.category(chr(c)) in ("Cn", "Cs") or old.category(chr(c)) != unicodedata.category(chr(c)) for c in range(0x10000)]
    parts, start = [], None
    for c, is_bad in enumerate([*bad, False]):
        if is_bad and start is None:
            start = c
        elif not is_bad and start is not None:
            parts.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return re.compile(f"[{''.join(parts)}\\U00010000-\\U0010ffff]")


class _Remembered(dict):
    """A map that computes what it misses, bounded in entries and bytes; when full, only what is asked for again is carried over."""

    def __init__(self, compute, entries: int, most_bytes: int):
        super().__init__()
        self.compute, self.entries, self.most_bytes, self.bytes, self.before = compute, entries, most_bytes, 0, {}

    def __missing__(self, key):
        if (value := self.before.get(key)) is None:
            value = self.compute(key)
        size = getsizeof(key) + getsizeof(value) + ENTRY_BYTES
        if size > self.most_bytes // 16:  # a few of those would drive out all others
            return value
        if len(self) >= self.entries or self.bytes + size > self.most_bytes:
            self.before, self.bytes = dict(self), 0
            self.clear()
        self[key] = value
        self.bytes += size
        return value


class ForcedBoundaryBpe:
    """Encoder and decoder for a byte-level BPE file in the tokenizers JSON format."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._path, self._library = path, None
        self._suffix = model["end_of_word_suffix"] or ""
        self._vocab = model["vocab"]
        self._id_bytes = {token: i.to_bytes(4, "little") for token, i in self._vocab.items()}
        self._ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self._inside = {pair for token in self._vocab for pair in self._pairs(self._symbols_of(token))}
        self._bytes = byte_symbols()
        self._special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")").split
        names = {i: t for t, i in self._vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._names = [names.get(i, "") for i in range(max(names) + 1)]
        self._byte_of = {s: b for b, s in enumerate(self._bytes)}
        self._joined = spec["decoder"] is None
        self._lower, self._nfc, pattern = False, False, BYTE_LEVEL_PATTERN
        for step in (spec["normalizer"] or {}).get("normalizers", []):
            self._nfc |= step["type"] == "NFC"
            self._lower |= step["type"] == "Lowercase"
        for step in spec["pre_tokenizer"].get("pretokenizers", []):
            if step["type"] == "Split":
                pattern = step["pattern"]["Regex"]
        self._find = regex.compile(pattern).findall
        self._fragments = _Remembered(self._encode_fragment, cache_entries, cache_bytes)
        self._words = _Remembered(self._encode_word, cache_entries, cache_bytes)
        self._pieces = _Remembered(lambda piece: self._encode_symbols(list(piece)), cache_entries, cache_bytes)

    @staticmethod
    def _pairs(symbols: list[str]) -> list[tuple[str, str]]:
        return list(zip(symbols, symbols[1:], strict=False))

    def _symbols_of(self, token: str) -> list[str]:
        stem = token.removesuffix(self._suffix) if self._suffix else token
        if stem != token and stem:
            return [*stem[:-1], stem[-1] + self._suffix]
        return list(token)

    def fragments(self, word: str) -> list[tuple[str, ...]]:
        """The symbols of a pre-token, cut at every pair that is inside no token."""
        return self._cut([self._bytes[b] for b in word.encode()])

    def _cut(self, symbols: list[str]) -> list[tuple[str, ...]]:
        if symbols:
            symbols[-1] += self._suffix
        inside = self._inside
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1) if pair not in inside]
        if not cuts:
            return [tuple(symbols)] if symbols else []
        return [tuple(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True) if a < b]

    def _encode_word(self, word: str) -> bytes:
        return self._encode_symbols([self._bytes[b] for b in word.encode()])

    def _encode_symbols(self, symbols: list[str]) -> bytes:
        cut = self._cut(symbols)
        return self._encode_fragment(cut[0]) if len(cut) == 1 else b"".join([self._fragments[f] for f in cut])

    def _encode_fragment(self, symbols: tuple[str, ...]) -> bytes:
        merged = self._merge_short(list(symbols)) if len(symbols) <= 32 else self._merge_long(list(symbols))
        return b"".join([self._id_bytes[s] for s in merged])

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The lowest-ranked pair first, the leftmost among equals."""
        get, none = self._ranks.get, len(self._ranks)
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            symbols[i] += symbols.pop(i + 1)  # only the last symbol ends in the suffix
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """As _merge_short, in n log n steps."""
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self._ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self._ranks.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [s for s in symbols if s]

    def _by_library(self, text: str) -> bytes:
        """As encode(), special tokens apart, with pre-tokens that the library cuts; what is in them is still encoded here."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        out = []
        for part in self._split_special(text) if self._special else [text]:
            if part in self._special:
                out.append(self._special[part])
            elif part:
                plain = self._library.normalizer.normalize_str(part) if self._library.normalizer else part
                out += [self._pieces[piece] for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self._special) or (not text.isascii() and unstable_chars().search(text)) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._by_library(text)
        if self._nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self._lower:
            text = text.replace("Σ", "σ").lower()  # the final sigma has no rule of its own
        return b"".join(map(self._words.__getitem__, self._find(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; special tokens are kept."""
        names = map(self._names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self._joined:
            return " ".join(names)
        raw = bytearray()
        for name in names:
            known = [self._byte_of.get(c) for c in name]
            raw += name.encode() if None in known else bytes(known)
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _bpe(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids binary, decoded string) for every whole text of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers. Null or empty text: no
    ids and empty decoded text. Null keys and repeated rows are kept as they
    are; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            keys, ids, decoded, size = [], [], [], 0
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                keys.append(k)
                ids.append(bpe.encode(text))
                decoded.append(bpe.decode(ids[-1]))
                size += len(text)
                if size >= BATCH_BYTES:
                    yield _batch(keys, ids, decoded, batch)
                    keys, ids, decoded, size = [], [], [], 0
            if keys:
                yield _batch(keys, ids, decoded, batch)

    def _batch(keys, ids, decoded, like):
        keys = pa.array([k.as_py() for k in keys], like.schema.field(0).type)
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, ids binary, decoded string")
