"""Elias-Fano coded monotone sequences, read in place from any buffer, a mapped file included.

The low bits of the values lie side by side; the high bits are a bit vector in which each value is
a one after as many zeros as its high part says.  Reading a value, or finding one by its high
part, takes one selection in the bit vector, helped by the count of ones before each word.
All methods take and return numpy arrays.
"""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 16
_U1, _U2, _U3, _U4, _U7, _U8, _U56, _U255 = (np.uint64(x) for x in (1, 2, 3, 4, 7, 8, 56, 255))
_FIVES, _THREES, _NIBBLES, _EACH, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
_POP = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
_SELECT = np.zeros((256, 8), dtype=np.uint64)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _r] = _p


def _select_in(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with ``rank`` ones before it in each 64-bit word."""
    s = words - ((words >> _U1) & _FIVES)                    # ones of bytes, then of all bytes up to each
    s = (s & _THREES) + ((s >> _U2) & _THREES)
    s = ((s + (s >> _U4)) & _NIBBLES) * _EACH
    rank = rank.astype(np.uint64)
    whole = (((rank * _EACH | _TOPS) - s) & _TOPS) >> _U7     # one in every byte whose sum is at most rank
    shift = ((whole * _EACH) >> _U56) << _U3
    rest = rank - ((s << _U8 >> shift) & _U255)
    return (shift + _SELECT[((words >> shift) & _U255).astype(np.intp), rest.astype(np.intp)]).astype(np.int64)


class EliasFano:
    def __init__(self, buf, offset: int = 0):
        head = np.frombuffer(buf, dtype="<i8", count=4, offset=offset)
        self.n, self.width, n_low, n_high = (int(x) for x in head)
        at = offset + 32
        self.low = np.frombuffer(buf, dtype="<u8", count=n_low, offset=at)
        self.high = np.frombuffer(buf, dtype="<u8", count=n_high, offset=at + 8 * n_low)
        self.ones = np.frombuffer(buf, dtype="<i8", count=n_high, offset=at + 8 * (n_low + n_high))
        self.zeros = np.arange(n_high, dtype=np.int64) * 64 - self.ones
        self.end = at + 8 * (n_low + 2 * n_high)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> bytes:
        """Bytes of the ascending ``values``, each below ``universe``."""
        values = np.asarray(values, dtype="<u8")
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        packed = []
        for at in range(0, n, _CHUNK):                        # a chunk fills whole words
            low = np.ascontiguousarray(values[at:at + _CHUNK]).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(low[:, :(width + 7) // 8], axis=1, bitorder="little")[:, :width]
            packed.append(np.packbits(bits.reshape(-1), bitorder="little"))
        low_words = _words(np.concatenate(packed) if packed else np.zeros(0, dtype=np.uint8), extra=1)
        marks = np.zeros(n + (universe >> width) + 2, dtype=np.uint8)
        marks[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high_words = _words(np.packbits(marks, bitorder="little"))
        per_word = _POP[high_words.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        before = np.concatenate(([0], np.cumsum(per_word)[:-1])).astype("<i8")
        head = np.array([n, width, len(low_words), len(high_words)], dtype="<i8")
        return b"".join(x.tobytes() for x in (head, low_words, high_words, before))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.width
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        upper = self.low[word + 1] << np.uint64(1) << (np.uint64(63) - off)
        return ((self.low[word] >> off) | upper) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = word * 64 + _select_in(self.high[word], i - self.ones[word])
        return (((at - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)).astype(np.int64)

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Place in the bit vector of the zero with ``rank`` zeros before it."""
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        return word * 64 + _select_in(~self.high[word], rank - self.zeros[word])

    def _group(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first value with each high part, and of the first one beyond."""
        before = np.where(part > 0, self._zero(np.maximum(part - 1, 0)), -1)
        bit = before + 1                                      # the ones from here to the next zero
        word = np.minimum(bit >> 6, len(self.high) - 1)
        rest = ~self.high[word] >> (bit & 63).astype(np.uint64)
        run = np.bitwise_count((rest & -rest) - _U1).astype(np.int64)
        far = np.flatnonzero(rest == 0)                       # the next zero lies in a later word
        if len(far):
            run[far] = self._zero(part[far]) - bit[far]
        first = bit - part
        return first, first + run

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is not less among those with the key's high part, or their end; and that end."""
        keys = keys.astype(np.uint64)
        part = (keys >> np.uint64(self.width)).astype(np.int64)
        want = keys & np.uint64((1 << self.width) - 1)
        lo, end = self._group(part)
        hi = end.copy()
        left = np.flatnonzero(lo < hi)
        while len(left):
            a, b = lo[left], hi[left]
            mid = (a + b) >> 1
            less = self._low(mid) < want[left]
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            lo[left], hi[left] = a, b
            left = left[a < b]
        return lo, end

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 where it is no value.  Keys must be below the universe."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if self.n and len(keys):
            at, end = self.successor(keys)
            some = np.flatnonzero(at < end)
            low = keys[some].astype(np.uint64) & np.uint64((1 << self.width) - 1)
            some = some[self._low(at[some]) == low]
            out[some] = at[some]
        return out


def _words(data: np.ndarray, extra: int = 0) -> np.ndarray:
    out = np.zeros((len(data) + 7) // 8 + extra, dtype="<u8")
    out.view(np.uint8)[:len(data)] = data
    return out
