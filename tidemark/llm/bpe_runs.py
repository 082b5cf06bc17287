"""Exact, memoised encoding of text between white spaces, or word by word where that is the same.

The tokenizers handled here drop white space before merging, so no token spans one:
encode(a + " " + b) == encode(a) + encode(b).  A text is therefore the concatenation of
its white-space-free runs, and a run that was met before costs one dictionary lookup.
Splitting is on ASCII white space only, which every such tokenizer treats as white space.
A text of plain characters only is cut into the tokenizer's own words right away, of which
there are far fewer than runs.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np

from .word_blocks import binary_array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO_RUNS = 200_000      # entries of a memo's generation; a memory bound, never a result bound
MEMO_BYTES = 64          # longer runs are encoded without being kept
_open: dict[str, "RunEncoder"] = {}

# The settings of a word tokenizer for which a run of plain characters (ASCII
# and Latin letters that have one form only) can be cut into words here.
_PLAIN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_TEXT = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF \t\n\r\x0b\x0c]*")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)      # classes of the bytes of plain text
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(ord("A"), ord("Z") + 1), *range(0x80, 0x9F)]] += 32      # second bytes of capital letters too
GROUP_BYTES = 8 << 20


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_plain(path: str) -> bool:
    conf = json.load(open(path, encoding="utf-8"))
    norm = [n["type"] for n in (conf.get("normalizer") or {}).get("normalizers", [])]
    pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (norm == _PLAIN_NORMALIZER and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"].get("Regex") == _PLAIN_SPLIT and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"] and conf["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in conf["added_tokens"]))


class Memo:
    """Bytes or words to ids in two generations: a full one becomes the old one, from which
    entries still in use are taken over, so frequent words are never encoded again."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def put(self, key, ids: bytes) -> None:
        if len(self.new) >= MEMO_RUNS:
            self.old, self.new = self.new, {}
        self.new[key] = ids

    def get(self, key) -> bytes | None:
        ids = self.new.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is not None:
                self.put(key, ids)
        return ids


class RunEncoder:
    """``encode`` gives the ids of one text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Memo()
        probe = "a b"
        ids = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", "b", probe)]
        if ids[0] + ids[1] != ids[2]:
            raise ValueError(f"{path}: this tokenizer joins words over white space")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token.encode()
        self.plain = _is_plain(path)
        self.letters = _byte_letters()
        self.words = Memo()
        self.is_end = np.array([t.endswith(b"</w>") for t in self.tokens])
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain characters: many words in one call of the merge model alone.

        They are spelled in byte letters and parted by spaces; each ends in its only token
        with the word-end mark, which is where the ids are cut.
        """
        letters = self.letters
        spelled = [w if w.isascii() else "".join([letters[b] for b in w.encode()]) for w in words]
        got = self.merges.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids
        ids = np.array(got, dtype="<u4")
        ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
        if len(ends) != len(words):
            raise ValueError("the vocabulary marks no word ends")
        data, at, out = ids.tobytes(), 0, []
        for e in ends.tolist():
            out.append(data[at:e])
            at = e
        return out

    def _known_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of the given words of plain characters."""
        ids = list(map(self.words.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        for at in range(0, len(unknown), 20_000):
            some = unknown[at:at + 20_000]
            for i, x in zip(some, self._encode_words([words[i].decode("utf-8") for i in some])):
                ids[i] = x
                if len(words[i]) <= MEMO_BYTES:
                    self.words.put(words[i], x)
        return ids

    def _known_runs(self, runs: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all given runs without white space, by the tokenizer itself."""
        get = self.memo.get
        known = {r: get(r) for r in runs}
        unknown = [r for r, ids in known.items() if ids is None]
        if unknown:
            got = self.tokenizer.encode_batch_fast([r.decode("utf-8") for r in unknown], add_special_tokens=False)
            for r, e in zip(unknown, got):
                known[r] = ids = array("I", e.ids).tobytes()
                if len(r) <= MEMO_BYTES:
                    self.memo.put(r, ids)
        return known

    def _is_plain_text(self, text: bytes) -> bool:
        return self.plain and b"<|" not in text and _PLAIN_TEXT.fullmatch(text.decode("utf-8")) is not None

    def _plain_ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of plain characters, cut into words all at once.

        A word begins where the class of byte changes and at every digit; an apostrophe that
        begins a run of signs takes the letters of a short form with it.
        """
        buf = _LOWER[np.frombuffer(b" ".join(texts) + b"   ", dtype=np.uint8)]
        kind = _CLASS[buf]
        begins = (kind != _SPACE) & ((np.diff(kind, prepend=np.uint8(_SPACE)) != 0) | (kind == _DIGIT))
        mark = np.flatnonzero((buf == ord("'")) & begins)
        one, two = buf[mark + 1], buf[mark + 2]
        size = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)).astype(np.int64)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))] = 2
        size[(one == ord("l")) & (two == ord("l"))] = 2
        mark, size = mark[size > 0], size[size > 0]
        begins[mark + 1] = False
        after = mark + 1 + size
        begins[after] |= kind[after] == _LETTER
        starts = np.flatnonzero(begins)
        inside = kind != _SPACE
        stops = np.flatnonzero(inside[:-1] & (begins[1:] | ~inside[1:])) + 1     # the text ends in spaces
        seen = binary_array(stops - starts, buf[inside]).dictionary_encode()
        ids = self._known_words(seen.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        n_ids = np.array([len(x) >> 2 for x in ids], dtype=np.int64)
        place = seen.indices.to_numpy(zero_copy_only=False)
        count = n_ids[place]
        ends = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat((np.cumsum(n_ids) - n_ids)[place] - ends[:-1], count) + np.arange(ends[-1])
        out = flat[source].tobytes()
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = (ends[np.searchsorted(starts, bounds)] * 4).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode_many(self, texts: list[bytes], group: int = GROUP_BYTES) -> list[bytes]:
        """Ids of each text; unknown words and runs of a group of texts are encoded in one call."""
        collects = gc.isenabled()
        gc.disable()                    # only flat lists are made here; scanning the memo is all cost
        try:
            return self._encode_many(texts, group)
        finally:
            if collects:
                gc.enable()

    def _encode_many(self, texts: list[bytes], group: int) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= group):
                size += len(texts[end])
                end += 1
            some = texts[at:end]
            plain = [self._is_plain_text(t) for t in some]
            easy = iter(self._plain_ids([t for t, p in zip(some, plain) if p]) if any(plain) else ())
            split = [None if p else t.split() for t, p in zip(some, plain)]
            runs = self._known_runs(set().union(*(parts for parts in split if parts is not None)))
            out.extend(next(easy) if parts is None else b"".join(map(runs.__getitem__, parts)) for parts in split)
            at = end
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Tokens joined by one space: what a tokenizer without a decoder step returns."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in ids])


def forget() -> None:
    """Free this worker's encoders and memos, for steps that come after all encoding."""
    _open.clear()


def encoder(path: str) -> RunEncoder:
    """One encoder per file and Python worker."""
    if path not in _open:
        _open[path] = RunEncoder(path)
    return _open[path]
