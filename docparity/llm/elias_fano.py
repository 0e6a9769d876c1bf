"""Elias-Fano sequences over flat 64-bit words, read many places at a time.

A non-decreasing sequence of n values up to u takes about 2 + log2(u / n) bits
a value: the low bits are packed, the high bits are written in unary. The place
of every 64th one leads to the i-th, and where zeros keep them far apart a count
of the ones before every 512 bits does. Small counts, most of them 0, 1 or 2, take
two bits and a code for each larger one.
"""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_BLOCK = 8  # words
_EACH = 64

_SELECT8 = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT8[_b, _k] = _i


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, in 64-bit words with one to spare."""
    words = np.zeros(len(values) * width // 64 + 2, _U64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U64)
        v = values.astype(_U64) & _U64((1 << width) - 1)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(v << shift, first)
        over = np.flatnonzero((at & 63) + width > 64)  # at most one of each word
        words[word[over] + 1] |= v[over] >> (_U64(64) - shift[over])
    return words


def unpack_bits(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.int64)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(_U64)
    v = (words[word] >> shift) | ((words[word + 1] << (_U64(63) - shift)) << _U64(1))
    return (v & _U64((1 << width) - 1)).astype(np.int64)


def _halves(values: np.ndarray) -> np.ndarray:
    """Places of 32 bits in 64-bit words; a sequence of one part has fewer than 2**32 high bits."""
    out = np.zeros(-(-len(values) // 2) * 2, np.uint32)
    out[: len(values)] = values
    return out.view(_U64)


def _unpack_all(words: np.ndarray, n: int, width: int) -> np.ndarray:
    """The first ``n`` values: every 64 of them take ``width`` words, so the k-th ones of all lots are shifted alike."""
    if not width:
        return np.zeros(n, np.int64)
    lots, mask = -(-n // 64), _U64((1 << width) - 1)
    table = np.zeros((width, lots), _U64)
    given = words[: lots * width]
    flat = np.zeros(lots * width, _U64)
    flat[: len(given)] = given
    table[:] = flat.reshape(lots, width).T
    out = np.empty((64, lots), _U64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[k] = table[word] >> _U64(shift)
        if shift + width > 64:
            out[k] |= table[word + 1] << _U64(64 - shift)
    return (out & mask).T.reshape(-1)[:n].view(np.int64)


class EliasFano:
    """``words`` may be part of a mapped file."""

    HEADER = 4  # words: n, width of the low bits, words of low bits, words of high bits

    def __init__(self, words: np.ndarray):
        words = words.view(np.ndarray)
        n, width, n_low, n_high = (int(x) for x in words[: self.HEADER])
        self.n, self.width = n, width
        at = self.HEADER
        self.low, at = words[at : at + n_low], at + n_low
        self.high, at = words[at : at + n_high], at + n_high
        n_dir, n_sel = n_high // _BLOCK, -(-n // _EACH)
        self.before, at = words[at : at + (n_dir + 1) // 2].view(np.uint32)[:n_dir], at + (n_dir + 1) // 2
        self.select, at = words[at : at + (n_sel + 1) // 2].view(np.uint32)[:n_sel], at + (n_sel + 1) // 2
        self.size = at

    @staticmethod
    def build(values: np.ndarray) -> np.ndarray:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = pack_bits(values, width)
        ones = (values >> width) + np.arange(n, dtype=np.int64)
        n_high = -(-((int(ones[-1]) if n else 0) + 1) // (64 * _BLOCK)) * _BLOCK
        bits = np.zeros(64 * n_high, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view(_U64)
        if n_high * 64 >= 1 << 32:
            raise ValueError("too long a sequence")
        per_block = np.bitwise_count(high).astype(np.int64).reshape(-1, _BLOCK).sum(axis=1)
        before = np.cumsum(per_block) - per_block
        return np.concatenate([np.array([n, width, len(low), n_high], _U64), low, high, _halves(before), _halves(ones[::_EACH])])

    def _by_block(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word of the high bits that has the i-th one, and how many of its ones come before it."""
        block = np.searchsorted(self.before, i, side="right") - 1
        rest, word = i - self.before[block].astype(np.int64), block * _BLOCK
        for _ in range(_BLOCK - 1):
            ones = np.bitwise_count(self.high[word]).astype(np.int64)
            over = rest >= ones
            if not over.any():
                break
            rest, word = np.where(over, rest - ones, rest), np.where(over, word + 1, word)
        return word, rest

    def __len__(self) -> int:
        return self.n

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little").view(bool))
        return ((ones - np.arange(self.n)) << self.width) | _unpack_all(self.low, self.n, self.width)

    def sampled(self) -> np.ndarray:
        """Every 64th value."""
        i = np.arange(len(self.select), dtype=np.int64) * _EACH
        return ((self.select.astype(np.int64) - i) << self.width) | unpack_bits(self.low, i, self.width)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        return ((self._ones(i) - i) << self.width) | unpack_bits(self.low, i, self.width)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at the places ``i`` and at those after them, which are there too."""
        at, after = self._ones(i), i + 1
        rest = (self.high[at >> 6] >> (at & 63).astype(_U64)) >> _U64(1)
        then = at + 1 + np.bitwise_count((rest & (~rest + _U64(1))) - _U64(1))
        if (far := np.flatnonzero(rest == 0)).size:
            then[far] = self._ones(after[far])
        return ((at - i) << self.width) | unpack_bits(self.low, i, self.width), ((then - after) << self.width) | unpack_bits(self.low, after, self.width)

    def _ones(self, i: np.ndarray) -> np.ndarray:
        """Places of the ones ``i`` in the high bits."""
        near = self.select[i // _EACH].astype(np.int64)
        word, rest = near >> 6, i % _EACH
        w = self.high[word] & (_U64(0xFFFFFFFFFFFFFFFF) << (near & 63).astype(_U64))
        ones = np.bitwise_count(w).astype(np.int64)
        live = np.flatnonzero(rest >= ones)
        for _ in range(_BLOCK):
            if not live.size:
                break
            rest[live] -= ones[live]
            word[live] += 1
            w[live] = self.high[word[live]]
            ones[live] = np.bitwise_count(w[live])
            live = live[rest[live] >= ones[live]]
        if live.size:
            word[live], rest[live] = self._by_block(i[live])
            w[live] = self.high[word[live]]
        shift = np.zeros(len(i), _U64)
        for half in (32, 16, 8):
            ones = np.bitwise_count((w >> shift) & _U64((1 << half) - 1)).astype(np.int64)
            over = rest >= ones
            rest = np.where(over, rest - ones, rest)
            shift = np.where(over, shift + _U64(half), shift)
        byte = ((w >> shift) & _U64(255)).astype(np.int64)
        return word * 64 + shift.astype(np.int64) + _SELECT8[byte, rest]

    def successor(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each key the first place in [lo, hi) whose value is no smaller; hi if there is none. The sequence ascends there."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while live.size:
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < key[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each key its place in [lo, hi), -1 if it is not there. The sequence ascends there."""
        out, lo, hi = np.full(len(key), -1, np.int64), lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while live.size:
            mid = (lo[live] + hi[live]) >> 1
            value = self.get(mid)
            there = value == key[live]
            out[live[there]] = mid[there]
            less = value < key[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[~there & (lo[live] < hi[live])]
        return out


class Plain:
    """A sequence decoded as a whole, for many look-ups; the same methods."""

    def __init__(self, sequence: EliasFano):
        self.v = sequence.all()

    def __len__(self) -> int:
        return len(self.v)

    def all(self) -> np.ndarray:
        return self.v

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.v[i]

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.v[i], self.v[i + 1]


class Small:
    """Numbers from 0 on, two bits each; from 3 on a byte more that a code book gives the number of. ``words`` may be part of a mapped file."""

    _LOW = _U64(0x5555555555555555)

    def __init__(self, words: np.ndarray):
        words = words.view(np.ndarray)
        n, more = (int(x) for x in words[:2])
        self.book, at = words[2:258].view(np.float64), 258
        size = n * 2 // 64 + 2
        self.codes, at = words[at : at + size], at + size
        self.before, at = words[at : at + (size + 1) // 2].view(np.uint32), at + (size + 1) // 2
        self.more = words[at:].view(np.uint8)[:more]

    @classmethod
    def build(cls, values: np.ndarray, quantised) -> np.ndarray:
        """``quantised`` gives bytes and a code book for positive numbers."""
        large = values[values > 2]
        more, book = quantised(large) if len(large) else (np.zeros(0, np.uint8), np.ones(256))
        codes = pack_bits(np.minimum(values, 3), 2)
        threes = np.bitwise_count(codes & (codes >> _U64(1)) & cls._LOW).astype(np.int64)
        before = _halves(np.cumsum(threes) - threes)
        padded = np.zeros(-(-len(more) // 8) * 8, np.uint8)
        padded[: len(more)] = more
        return np.concatenate([np.array([len(values), len(more)], _U64), book.view(_U64), codes, before, padded.view(_U64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        code = unpack_bits(self.codes, i, 2)
        out, large = code.astype(np.float64), np.flatnonzero(code == 3)
        if large.size:
            i = i[large]
            w = self.codes[i >> 5]
            below = (_U64(1) << ((i & 31) * 2).astype(_U64)) - _U64(1)
            rank = self.before[i >> 5].astype(np.int64) + np.bitwise_count(w & (w >> _U64(1)) & self._LOW & below)
            out[large] = self.book[self.more[rank]]
        return out
