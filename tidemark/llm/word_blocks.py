"""Documents as blocks of word numbers, and compact arrays to send between tasks.

A block holds the words of many documents, or of a part of a long one, as numbers into its own
word list, which is exact: words are told apart by their bytes.  Operators that count n-grams
exchange arrays between blocks and shards instead of one row for every word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .text_hash import runs_of

ENTRY_BYTES = 4 << 20          # a longer text becomes several entries
LEAD = 2                       # words repeated at the start of the next entry as context

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def byte_set(*parts: bytes | range) -> np.ndarray:
    """Table of 256 flags."""
    table = np.zeros(256, dtype=bool)
    for p in parts:
        table[list(p)] = True
    return table


def squeeze(raw: bytes | np.ndarray) -> bytes:
    raw = raw.tobytes() if isinstance(raw, np.ndarray) else raw
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def expand(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], n, codec="zstd", asbytes=True) if n else b""


def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, no wider than the largest needs."""
    a = np.ascontiguousarray(a, dtype="<u8")
    width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(a).to_bytes(8, "little") + squeeze(np.ascontiguousarray(planes))


def unpack_ints(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(expand(blob[9:]), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers, by their differences."""
    return pack_ints(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(blob), dtype=np.uint64)


def pack_words(words: pa.Array) -> bytes:
    sizes = pa.compute.binary_length(words).to_numpy(zero_copy_only=False)
    head = pack_ints(sizes)
    return len(head).to_bytes(8, "little") + head + squeeze(b"".join(words.to_pylist()))


def unpack_words(blob: bytes) -> pa.Array:
    n = int.from_bytes(blob[:8], "little")
    return binary_array(unpack_ints(blob[8:8 + n]), expand(blob[8 + n:]))


def binary_array(sizes: np.ndarray, data) -> pa.Array:
    """Byte strings of the given sizes that lie one after the other in ``data``."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def entries(raw: bytes, separators: np.ndarray, limit: int = ENTRY_BYTES) -> Iterator[tuple[bytes, int, bool]]:
    """Parts of a text, cut at separators: (bytes, leading words that only give context, last part)."""
    if len(raw) <= limit:
        yield raw, 0, True
        return
    flags = separators[np.frombuffer(raw, dtype=np.uint8)]
    at = begin = 0
    while True:
        end = at + limit
        if end < len(raw):
            hit = np.flatnonzero(flags[end:end + limit])
            while not len(hit) and end + limit < len(raw):
                end += limit
                hit = np.flatnonzero(flags[end:end + limit])
            end = end + int(hit[0]) if len(hit) else len(raw)
        end = min(end, len(raw))
        yield raw[begin:end], len(runs_of(~flags[begin:at])[0]), end == len(raw)
        if end == len(raw):
            return
        starts = runs_of(~flags[begin:end])[0]
        begin += int(starts[-min(LEAD, len(starts))]) if len(starts) else end - begin
        at = end


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: each may hold a block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


@dataclass
class Block:
    """``numbers[i]`` is 0 for a break and else 1 + the place in ``words``, most frequent first."""

    words: pa.Array                # large binary
    numbers: np.ndarray            # uint32
    sizes: np.ndarray              # numbers of every entry


def make_block(parts: list[bytes], separators: np.ndarray, breaks: np.ndarray | None, closed: list[bool]) -> Block:
    """Word numbers of the parts, A-Z lower-cased.

    A run of break bytes between two words gives one 0, and so does the end of a closed part.
    """
    buf = _LOWER[np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)]
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    is_word = ~separators[buf]
    starts, ends = runs_of(is_word)
    arr = binary_array(ends - starts, buf[is_word]).dictionary_encode()
    place = arr.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(place, minlength=len(arr.dictionary)), kind="stable")
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
    first = np.searchsorted(starts, bounds)
    owner = np.repeat(np.arange(len(parts)), np.diff(first))
    broken = np.zeros(len(starts), dtype=np.int64)         # 0s before a word, within its part
    if breaks is not None and len(starts):
        seen = np.concatenate(([0], np.cumsum(breaks[buf])))
        inner = (np.diff(seen[starts], prepend=seen[starts[0]]) > 0) & (np.diff(owner, prepend=-1) == 0)
        np.cumsum(inner, out=broken)
    ends_before = np.concatenate(([0], np.cumsum(np.asarray(closed, dtype=np.int64))))
    at = np.arange(len(starts)) + broken + ends_before[owner] if len(starts) else np.zeros(0, dtype=np.int64)
    up_to = np.concatenate(([0], broken))[first]           # 0s inside the parts before each part
    sizes = np.diff(first) + np.diff(up_to) + np.asarray(closed, dtype=np.int64)
    numbers = np.zeros(int(sizes.sum()), dtype=np.uint32)
    numbers[at] = rank[place]
    return Block(arr.dictionary.take(pa.array(order)), numbers, sizes)
