"""A compressed FM-index over word ids: wavelet matrices, backward search, matching statistics.

Neither the text nor its suffix array is kept: rows of the sorted suffixes are
reached through the Burrows-Wheeler transform alone, and what a row's suffix
belongs to lies in a second wavelet matrix whose descent gives the least owner
of an interval. Everything works on numpy vectors, so that many query streams
advance at once.
"""

from __future__ import annotations

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


class Bits:
    """A compressed bit vector with rank and select.

    Words of 64 bits stand in superblocks of eight. Only words that are neither
    all zeros nor all ones are stored; runs, which the transform of repeated
    text is made of, cost a bit or two a word.
    """

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 512 + 1
        packed = np.zeros(blocks * 64, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        words = packed.view("<u8")
        ones = np.bitwise_count(words).astype(np.int64).reshape(blocks, 8)
        total = ones.sum(1)
        self.ones = int(total.sum())
        self.before = (np.cumsum(total) - total).astype(np.int32)  # ones before a superblock
        self.inside = (np.cumsum(ones, 1) - ones).astype(np.uint16).ravel()  # ones of the superblock before a word
        full = words == _ALL
        mixed = (words != 0) & ~full
        self.full, self.mixed = (np.packbits(x, bitorder="little") for x in (full, mixed))  # a byte for each superblock
        count = mixed.reshape(blocks, 8).sum(1)
        self.place = (np.cumsum(count) - count).astype(np.int32)
        self.stored = np.concatenate([words[mixed], np.zeros(1, np.uint64)])

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.before, self.inside, self.full, self.mixed, self.place, self.stored))

    def _word(self, w: np.ndarray) -> np.ndarray:
        block, bit = w >> 3, (w & 7).astype(np.uint8)
        one = np.left_shift(np.uint8(1), bit)
        mixed = self.mixed[block]
        at = self.place[block] + np.bitwise_count(mixed & (one - np.uint8(1)))
        same = np.where(self.full[block] & one, _ALL, np.uint64(0))
        return np.where(mixed & one, self.stored[np.minimum(at, len(self.stored) - 1)], same)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        below = np.left_shift(_ONE, (i & 63).astype(np.uint64)) - _ONE
        return self.before[w >> 3] + self.inside[w].astype(np.int64) + np.bitwise_count(self._word(w) & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the one that k ones precede; k is less than their number."""
        block = np.searchsorted(self.before, k, "right") - 1
        rest = k - self.before[block]
        w = block * 8 + (self.inside.reshape(-1, 8)[block] <= rest[:, None]).sum(1) - 1
        rest, word, at = rest - self.inside[w], self._word(w), np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((word >> at) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = rest >= low
            at += np.where(go, np.uint64(step), np.uint64(0))
            rest = rest - np.where(go, low, 0)
        return (w << 6) + at.astype(np.int64)


class WaveletMatrix:
    """A sequence of small integers, one compressed bit vector per level."""

    def __init__(self, values: np.ndarray, largest: int):
        self.size, self.levels = len(values), max(1, int(largest).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            one = (values >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(len(values) - self.bits[-1].ones)
            values = np.concatenate([values[~one], values[one]])
        # where a symbol's occurrences start once all levels are passed
        self.origin = np.zeros(int(largest) + 1, np.int32)
        self.origin = self._down(np.arange(int(largest) + 1), np.zeros(int(largest) + 1, np.int64)).astype(np.int32)

    def nbytes(self) -> int:
        return sum(b.nbytes() for b in self.bits) + self.origin.nbytes

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(reversed(range(self.levels)), self.bits, self.zeros, strict=True):
            ones = bits.rank(at)
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        return self._down(symbols, ends) - self.origin[symbols]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest value of each nonempty range: down the zeros' side wherever it is not empty."""
        value = np.zeros(len(lo), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            both = bits.rank(np.concatenate([lo, hi]))
            a, b = both[: len(lo)], both[len(lo) :]
            small = hi - lo > b - a
            lo, hi = np.where(small, lo - a, zeros + a), np.where(small, hi - b, zeros + b)
            value = value << 1 | ~small
        return value


class FmIndex:
    """Index of a text of ids (0 separates passages) for matches of at most ``depth`` words.

    ``owner`` gives for each position a small integer, of which least_owner()
    finds the smallest in an interval.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        self.size, self.depth = len(text), depth
        # suffixes by their first words, more of them than are ever matched
        rank, width, order = text.astype(np.int64), 1, np.argsort(text, kind="stable")
        while width <= depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(len(text), np.int64)
            rank[order] = new
            width *= 2
        largest = int(text.max())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))]).astype(np.int64)
        self.bwt = WaveletMatrix(text[order - 1], largest)
        self.owners = WaveletMatrix(owner[order], int(owner.max()))
        # by depth: where the rows begin that share so many words
        same, self.groups = np.ones(len(text) - 1, bool), [None]
        for j in range(depth - 1):
            here = text[(order + j) % len(text)]
            same &= here[1:] == here[:-1]
            self.groups.append(Bits(np.concatenate([[True], ~same])))

    def nbytes(self) -> int:
        return self.bwt.nbytes() + self.owners.nbytes() + self.first.nbytes + sum(g.nbytes() for g in self.groups[1:])

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows that start with the symbol followed by what they started with."""
        both = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        base = self.first[symbols]
        return base + both[: len(lo)], base + both[len(lo) :]

    def shorten(self, size: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows that share ``size`` words with row ``lo``."""
        out = np.zeros((2, len(lo)), np.int64)
        out[1] = self.size
        for d in np.unique(size[size > 0]):
            at, bits = np.flatnonzero(size == d), self.groups[d]
            group = bits.rank(lo[at] + 1) - 1
            after = np.minimum(group + 1, bits.ones - 1)
            both = bits.select(np.concatenate([group, after]))
            out[0, at] = both[: len(at)]
            out[1, at] = np.where(group + 1 < bits.ones, both[len(at) :], self.size)
        return out[0], out[1]

    def matching_statistics(self, query: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) by position of ``query``, for streams of ``counts`` positions at ``starts``.

        The length is that of the longest match that starts there, at most the
        depth; the interval is that of a match of full depth. Streams run from
        the right: a match is extended by the word before it and, where the
        text has no such words, shortened by its last one. A stream reads
        depth - 1 words beyond its positions; id 0 and ids above the text's
        stand for words the text does not hold.
        """
        length, low, high = (np.zeros(len(query), np.int64) for _ in range(3))
        live = counts > 0
        stop, top = starts[live], (starts + counts)[live]
        at = np.minimum(top + self.depth - 2, len(query) - 1)
        size, lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), self.size, np.int64)
        while len(at):
            symbol = query[at]
            symbol = np.where(symbol < len(self.first) - 1, symbol, 0)
            new_lo, new_hi = self.extend(symbol, lo, hi)
            foreign = symbol == 0
            grown = (new_hi > new_lo) & ~foreign
            lo, hi, size = np.where(grown, new_lo, lo), np.where(grown, new_hi, hi), np.where(foreign, 0, size + grown)
            told = grown | (size == 0)  # else shorten and try again
            full = grown & (size == self.depth)
            tell = told & (at < top)
            length[at[tell]] = size[tell]
            tell &= full
            low[at[tell]], high[at[tell]] = lo[tell], hi[tell]
            shorter = np.flatnonzero(full | ~told)
            size[shorter] -= 1
            lo[shorter], hi[shorter] = self.shorten(size[shorter], lo[shorter])
            lo[foreign], hi[foreign] = 0, self.size
            at = at - told
            going = at >= stop
            if not going.all():
                stop, top, at, size, lo, hi = (x[going] for x in (stop, top, at, size, lo, hi))
        return length, low, high

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner of the rows of each interval; intervals of one depth that start alike are one."""
        starts, first, of = np.unique(lo, return_index=True, return_inverse=True)
        return self.owners.least(starts, hi[first])[of]
