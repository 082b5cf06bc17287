"""Vectorised hashing of words and word shingles over batches of texts.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII bytes of the
lower-cased text in UTF-8.  Every word gets a 64-bit polynomial hash from prefix sums over
the byte buffer, so a batch costs a few numpy passes whatever the number of words.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)                      # odd, so it has an inverse mod 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[i for i in range(256) if i >= 128 or chr(i).isalnum() or i == ord("_")]] = True
_SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), _BASE if kind == "up" else _INV, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * _SEGMENT:
            _powers[kind] = have
    return have


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span [start, end) of a uint8 buffer, independent of its position."""
    n = len(buf)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[buf] * _power("up", n)[:n], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * _power("down", n)[starts] + (ends - starts).astype(np.uint64))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and offsets: text i owns [offsets[i], offsets[i+1])."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    bounds = np.cumsum([0] + [len(d) + 1 for d in data])
    is_word = _WORD_BYTE[buf]
    hashes, begun, at = [], [], 0
    while at < len(buf):
        end = min(at + _SEGMENT, len(buf))
        while end < len(buf) and is_word[end - 1]:          # never cut inside a word
            end = min(end + 4096, len(buf))
            stop = np.flatnonzero(~is_word[end - 4096:end]) if end < len(buf) else ()
            if len(stop):
                end = end - 4096 + int(stop[0]) + 1
        s, e = runs_of(is_word[at:end])
        hashes.append(span_hashes(buf[at:end], s, e))
        begun.append(s + at)
        at = end
    starts = np.concatenate(begun) if begun else np.zeros(0, dtype=np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64),
            np.searchsorted(starts, bounds).astype(np.int64))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words per text; a text of 1 to n-1 words is one shingle.

    Repeats are kept; returns (hashes, offsets) in the layout of ``word_hashes``.
    """
    sizes = np.diff(offsets)
    q = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(n)]
    m = len(words)
    rolled = np.zeros(max(m - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        rolled += words[k:k + len(rolled)] * q[k]
    counts = np.where(sizes >= n, sizes - n + 1, np.where(sizes > 0, 1, 0))
    out_off = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    src = np.repeat(offsets[:-1] - out_off[:-1], counts) + np.arange(out_off[-1])
    short = (sizes > 0) & (sizes < n)
    out = np.empty(out_off[-1], dtype=np.uint64)
    whole = np.repeat(sizes >= n, counts)
    out[whole] = rolled[src[whole]]
    for i in np.flatnonzero(short):
        w = words[offsets[i]:offsets[i + 1]]
        with np.errstate(over="ignore"):
            out[out_off[i]] = sum((w[k] * q[k] for k in range(len(w))), np.uint64(len(w)))
    return mix(out), out_off
