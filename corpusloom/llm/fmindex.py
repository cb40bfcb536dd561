"""FM-index over a sequence of symbols: suffix array, wavelet matrix, sampled positions.

Symbols are small integers.  The text ends with a symbol 0 that occurs once;
queries are arrays of equally long patterns, searched together.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling on what is still tied.

    Ranks and the position share one 64-bit key, so that a plain sort orders
    both; ties shrink from round to round.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    width = max(1, int(text.max()).bit_length()) if n else 1
    # The first sort is over as many symbols as fit beside the position.
    h = max(1, (62 - bits) // width)
    key = np.zeros(n, dtype=np.int64)
    for k in range(h):
        key <<= width
        key[: max(0, n - k)] |= text[k:] if k else text
    packed = np.sort(key << bits | np.arange(n))
    sa = packed & ((1 << bits) - 1)
    head = np.empty(n, dtype=bool)
    head[:1] = True
    lead = packed >> bits
    head[1:] = lead[1:] != lead[:-1]
    rank = np.empty(n, dtype=np.int64)
    first = np.flatnonzero(head)
    rank_of_row = np.repeat(first, np.diff(np.append(first, n)))
    rank[sa] = rank_of_row
    while len(first) < n:
        # Rows whose rank is shared: sort them by (rank, rank h symbols on).
        sizes = np.diff(np.append(first, n))
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        pos = sa[rows]
        after = pos + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank_of_row[rows]
        if 2 * bits + 1 + bits <= 63:
            packed = np.sort((group << (bits + 1) | second) << bits | pos)
            pos, both = packed & ((1 << bits) - 1), packed >> bits
            group, second = both >> (bits + 1), both & ((1 << (bits + 1)) - 1)
        else:
            order = np.lexsort((second, group))
            pos, group, second = pos[order], group[order], second[order]
        sa[rows] = pos
        new = np.empty(len(rows), dtype=bool)
        new[:1] = True
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        head[rows] = new | head[rows]
        first = np.flatnonzero(head)
        rank_of_row = np.repeat(first, np.diff(np.append(first, n)))
        rank[pos] = rank_of_row[rows]
        h *= 2
    return sa


class BitVector:
    """Bits with constant-time rank: bytes and the count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """rank(symbol, i) and access(i) over a sequence of integers, one bit vector a level."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.bits.append(BitVector(bit))
            one = bit.astype(bool)
            self.zeros.append(int(len(one) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = np.zeros(len(i), dtype=np.int64)
        end = i
        for k, (v, z) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            s, e = v.rank1(start), v.rank1(end)
            start, end = np.where(one, z + s, start - s), np.where(one, z + e, end - e)
        return end - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol = np.zeros(len(i), dtype=np.int64)
        start = np.zeros(len(i), dtype=np.int64)
        for v, z in zip(self.bits, self.zeros, strict=True):
            one = v.get(i).astype(bool)
            r, s = v.rank1(i), v.rank1(start)
            i, start = np.where(one, z + r, i - r), np.where(one, z + s, start - s)
            symbol = symbol << 1 | one
        return symbol, i - start


class FMIndex:
    """count and locate by backward search."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        """text must end with a 0 that occurs nowhere else in it."""
        self.n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]  # the suffix at 0 wraps to the end
        self.wavelet = WaveletMatrix(bwt)
        counts = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        kept = sa % sample == 0
        self.marked = BitVector(kept.astype(np.uint8))
        self.samples = sa[kept]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last row of the suffixes that start with each pattern."""
        start = np.zeros(len(patterns), dtype=np.int64)
        end = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = patterns[live, k]
            known = c < len(self.before) - 1
            base = self.before[np.where(known, c, 0)]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([start[live], end[live]]))
            start[live] = base + both[: len(live)]
            end[live] = np.where(known, base + both[len(live) :], start[live])
            live = live[start[live] < end[live]]
        return start, np.maximum(start, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by walking back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        out = np.empty(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            hit = self.marked.get(here).astype(bool)
            done = live[hit]
            out[done] = self.samples[self.marked.rank1(at[done])] + steps[done]
            live = live[~hit]
            symbol, rank = self.wavelet.access(at[live])
            at[live] = self.before[symbol] + rank
            steps[live] += 1
        return out
