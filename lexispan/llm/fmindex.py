"""An FM-index over words: the Burrows-Wheeler transform in a wavelet matrix with rank directories.

Rows are ordered by their first `depth` words alone (ties by place), which is all that backward search for
patterns of up to that many words needs.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in words of 64, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)])[:-1].astype(np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """For each i the ones before it."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & low)


class Wavelet:
    """A sequence of symbols below `alphabet`, a bit vector for each of their bits from the highest on."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol comes before each of the places."""
        ends = [np.zeros_like(symbol), *places]
        for shift, bits, zeros in self.levels:
            on = (symbol >> shift & 1).astype(bool)
            for k, i in enumerate(ends):
                ones = bits.ones(i)
                ends[k] = np.where(on, zeros + ones, i - ones)
        return [i - ends[0] for i in ends[1:]]


def ordered(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of text by their next `depth` symbols, ties by place; past the end comes symbol 0."""
    ranks = {1: np.unique(text, return_inverse=True)[1].astype(np.int64)}

    def after(r: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([r[k:], np.full(min(k, len(r)), r[-1] if k < len(r) else 0)])

    have, k = 0, 1
    whole = np.zeros(len(text), np.int64)
    while have < depth:  # the depth in binary, doubling as it goes
        if depth & k:
            key = whole * (ranks[k].max() + 1) + after(ranks[k], have)
            whole = np.unique(key, return_inverse=True)[1].astype(np.int64)
            have += k
        ranks[2 * k] = np.unique(ranks[k] * (ranks[k].max() + 1) + after(ranks[k], k), return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(whole, kind="stable")


class Index:
    """Of a text of symbols below `alphabet`; 0 stands between passages and at the end, and no pattern holds it."""

    def __init__(self, text: np.ndarray, alphabet: int, depth: int):
        self.places = ordered(text, depth).astype(np.int32)
        self.bwt = Wavelet(text[self.places - 1], alphabet)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.size, self.depth = len(text), depth

    def search(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to depth: for the places in text where words end, how many words back
        from there occur more than once in the index, and the rows where those of full depth do."""
        n = len(ends)
        length, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        live = np.arange(n)
        for step in range(self.depth):
            symbol = text[ends[live] - step].astype(np.int64)
            a, b = self.bwt.rank(symbol, low[live], high[live])
            a, b = self.first[symbol] + a, self.first[symbol] + b
            ok = (b - a > 1) & (symbol > 0)
            live = live[ok]
            if not len(live):
                break
            low[live], high[live] = a[ok], b[ok]
            length[live] += 1
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in the text of each range of rows; equal ranges are looked at once."""
        ranges, at = np.unique(low * (self.size + 1) + high, return_inverse=True)
        bounds = np.stack([ranges // (self.size + 1), ranges % (self.size + 1)], axis=1).ravel()
        extended = np.concatenate([self.places, [np.iinfo(np.int32).max]])
        return np.minimum.reduceat(extended, bounds)[::2][at]
