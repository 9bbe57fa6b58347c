"""Words of whole text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gridloom.llm.common import SPACES

#: Text bytes that are worked on at once.
CHUNK_BYTES = 2 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 512

_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most that many text bytes, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    large = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """All words of a column: where each starts and ends, and its row."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = text_bytes(column)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~_SEPARATES[data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True  # a row's first byte ends what stands before it
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # of each row's words

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same on every machine."""
        return hash_spans(self.data, self.starts, self.ends)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    length = ends - starts
    with np.errstate(over="ignore"):
        h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live, done = np.flatnonzero(length <= LONG_WORD), 0
        while len(live):
            rest = length[live] - done
            word = eight[starts[live] + done]
            short = rest < 8
            word[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[live] = mix(h[live] ^ word)
            done += 8
            live = live[rest > 8]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one row's word hashes; fewer words make one."""
    if not len(h):
        return h
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            s = mix(s ^ h[j : len(h) - width + 1 + j])
    return s


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text, A-Z lower-cased, the sorted distinct hashes of its k-word shingles."""
    words = Words(column, lower=True)
    h = words.hashes()
    return [np.unique(shingles(h[a:b], k)) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
