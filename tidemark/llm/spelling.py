"""Spelling variants of words through a dictionary of trie-node pairs.

The distinct words of the corpus span two tries, one from their first letters on and one from
their last letters back.  Every trie node gets a number, so a word with one position left out
is a pair of integers: the node of what stands before and the node of what stands after.  A trie
is numbered in parts of the sorted words; nodes on the border of two parts, which are prefixes
of the bounds, have numbers that all parts know.  Two
words differ by one replaced letter if they share such a pair; a word is another with one letter
deleted if its own (prefix node, suffix node) at a gap is a pair of the other with a position left
out.  Equal pairs are equal spellings, so nothing needs to be verified and nothing is missed.

The words that share a pair differ in one letter only, so a pair has at most as many words as the
alphabet has letters; each group yields its two best members and its size, never pairs of words.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, text_or_empty
from .text_hash import mix
from .word_blocks import pack_ints, pack_sorted, unpack_ints, unpack_sorted

RUN = "A-Za-zÀ-ÿ"
MEMO_WORDS = 400_000           # distinct words a task holds before it sends their counts
PART_WORDS = 100_000           # words of a part of either trie, on average
SHARD_PAIRS = 2_000_000        # node pairs that meet in a task, on average
SAMPLE = 64                    # words a part's bounds are chosen from
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def perturb(doc_id: str, run: str, modulus: int) -> str:
    """The run, short of one letter where the crc32 of ``<doc_id>:<run>`` is a multiple of ``modulus``."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, modulus: int = 31,
                text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n) of all letter runs of at least ``min_length`` letters after ``perturb``."""
    ship(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                      text_or_empty(text_col).alias("_text"))
    find = re.compile(f"[{RUN}]{{{min_length},}}").findall

    def count(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                              pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                for run, n in Counter(find(text.as_py().translate(_LOWER))).items():
                    held[perturb(doc, run, modulus)] += n
                if len(held) >= MEMO_WORDS:
                    yield flush()
        if held:
            yield flush()

    return (src.mapInArrow(count, "word string, n bigint").where(F.length("word") >= min_length)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def trie_paths(words: list[str], first_number: int, shared: dict[str, int]) -> list[list[int]]:
    """Numbers of the trie nodes on the way to each of the sorted ``words``, the root's first.

    Nodes in ``shared`` have their number there; the others count up from ``first_number``.
    """
    out: list[list[int]] = []
    last, path, fresh = "", [shared[""]], first_number
    for w in words:
        same = 0
        for x, y in zip(last, w):
            if x != y:
                break
            same += 1
        path = path[:same + 1]
        for d in range(same + 1, len(w) + 1):
            number = shared.get(w[:d])
            if number is None:
                number, fresh = fresh, fresh + 1
            path.append(number)
        out.append(path)
        last = w
    return out


def _splitters(words: DataFrame, column, parts: int) -> list[str]:
    """``parts - 1`` bounds that cut the sorted words into parts of about equal size."""
    if parts < 2:
        return []
    seen = words.select(column.alias("w")).orderBy(F.xxhash64("w")).limit(SAMPLE * parts).collect()
    seen = sorted(r["w"] for r in seen)
    return sorted({seen[len(seen) * i // parts] for i in range(1, parts)})


def _shared(splitters: list[str]) -> dict[str, int]:
    """Numbers of the nodes that words of several parts may pass: the prefixes of the bounds."""
    prefixes = sorted({w[:d] for w in splitters for d in range(len(w) + 1)} | {""})
    return {q: i for i, q in enumerate(prefixes)}


def _best(p, s, word, n, whole, own):
    """(word, near words, n and word of the best) of all members of pairs with company.

    A pair's members: words with a position left out (of these, ``own`` are longer than the
    pair's word by an insertion that is counted once), and at most one ``whole`` word.
    """
    order = np.lexsort((word, -n, whole, s, p))
    p, s, word, n, whole, own = (x[order] for x in (p, s, word, n, whole, own))
    head = np.ones(len(p), dtype=bool)
    head[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(head) - 1
    begin = np.flatnonzero(head)
    n_groups = len(begin)
    skips = np.bincount(group[~whole], minlength=n_groups)
    owns = np.bincount(group[own], minlength=n_groups)
    fulls = np.bincount(group[whole], minlength=n_groups)
    nobody = len(p)                                           # a place beyond the members
    word_, n_ = np.append(word, np.iinfo(np.int64).max), np.append(n, 0)
    full = np.full(n_groups, nobody)
    full[group[whole]] = np.flatnonzero(whole)
    top_own = np.full(n_groups, nobody)
    top_own[group[own][::-1]] = np.flatnonzero(own)[::-1]     # the first of each group remains
    at = np.arange(len(p))
    g = group
    best = np.where(at != begin[g], begin[g], np.where(skips[g] > 1, begin[g] + 1, nobody))
    rival = np.where(own, full[g], nobody)
    better = (n_[rival] > n_[best]) | ((n_[rival] == n_[best]) & (word_[rival] < word_[best]))
    best = np.where(better, rival, best)
    best = np.where(whole, top_own[g], best)
    near = np.where(whole, owns[g], skips[g] - 1 + np.where(own, fulls[g], 0))
    keep = near > 0
    return word[keep], near[keep], n_[best][keep], word_[best][keep]


def variant_groups(words: DataFrame, factor: int = 10, part_words: int = PART_WORDS,
                   shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """Near words of every word of a table (word, n) of distinct words.

    Near is one inserted, deleted or replaced code point.  Returns word, n, ``n_near`` (near
    words), ``form`` (the near word of largest n, ties to the first in code-point order, if its n
    is at least ``factor`` times the word's) with ``form_n``, and ``root``: the last word on the
    way from form to form, the word itself if it has no form.
    """
    ship(words.sparkSession)
    words = cut(words.select("word", "n"))
    count, letters = words.agg(F.count("word"), F.sum(F.length("word"))).first()
    parts = max(1, math.ceil(count / part_words))
    n_shards = max(1, math.ceil((2 * (letters or 0) + count) / shard_pairs))
    forward, back = _splitters(words, F.col("word"), parts), _splitters(words, F.reverse("word"), parts)

    def place(batches):
        for b in batches:
            part = [bisect.bisect_right(forward, w) for w in b.column("word").to_pylist()]
            yield b.append_column("part", pa.array(part, pa.int64()))

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")                         # byte order is code-point order
        part, names = table.column("part")[0].as_py(), table.column("word").to_pylist()
        paths = trie_paths(names, (part + 1) << 32, _shared(forward))
        return pa.table({"id": pa.array(range(part << 32, (part << 32) + len(names)), pa.int64()),
                         "word": table.column("word"), "n": table.column("n"),
                         "path": pa.array([np.array(x, dtype="<i8").tobytes() for x in paths], pa.binary()),
                         "part": pa.array([bisect.bisect_right(back, w[::-1]) for w in names], pa.int64())})

    # words in order: id by id, so that ties between words are ties between ids
    numbered = cut(words.mapInArrow(place, "word string, n bigint, part bigint").repartition(parts, "part")
                   .groupBy("part").applyInArrow(number, "id bigint, word string, n bigint, path binary, part bigint"))

    def pair_up(table: pa.Table) -> pa.Table:
        part, names = table.column("part")[0].as_py(), [w[::-1] for w in table.column("word").to_pylist()]
        order = sorted(range(len(names)), key=names.__getitem__)
        paths = trie_paths([names[i] for i in order], (part + 1) << 32, _shared(back))
        table = table.take(pa.array(order))
        sizes = np.array([len(x) for x in paths])
        before = np.frombuffer(b"".join(table.column("path").to_pylist()), dtype="<i8")
        after = np.concatenate([np.array(x[::-1], dtype=np.int64) for x in paths])
        last = np.cumsum(sizes) - 1                           # a word's place after its last letter
        inner = np.ones(len(before), dtype=bool)
        inner[last] = False
        skip = np.flatnonzero(inner)
        letter = np.frombuffer("".join(w[::-1] + "\0" for w in (names[i] for i in order)).encode("utf-32-le"),
                               dtype="<u4")
        fresh = letter != np.roll(letter, 1)                  # not the same letter as the one before
        fresh[last + 1 - sizes] = True
        word = np.repeat(table.column("id").to_numpy(), sizes)
        n = np.repeat(table.column("n").to_numpy(), sizes)
        kind = np.concatenate((np.full(len(before), 2), fresh[skip].astype(np.int64)))
        cols = [np.concatenate((before, before[skip])), np.concatenate((after, after[skip + 1])),
                np.concatenate((word, word[skip])), np.concatenate((n, n[skip])), kind]
        with np.errstate(over="ignore"):
            shard = mix(cols[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cols[1].view(np.uint64)) % np.uint64(n_shards)
        at = np.lexsort((cols[0], shard))
        cols = [c[at] for c in cols]
        bounds = np.searchsorted(shard[at], np.arange(n_shards + 1))
        rows = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if hi > lo]
        out = {"shard": pa.array([k for k, _, _ in rows], pa.int64()),
               "p": pa.array([pack_sorted(cols[0][lo:hi].astype(np.uint64)) for _, lo, hi in rows], pa.binary())}
        for name, c in zip(("s", "word", "n", "kind"), cols[1:]):
            out[name] = pa.array([pack_ints(c[lo:hi]) for _, lo, hi in rows], pa.binary())
        return pa.table(out)

    def meet(table: pa.Table) -> pa.Table:
        p = np.concatenate([unpack_sorted(x) for x in table.column("p").to_pylist()]).astype(np.int64)
        s, word, n, kind = (np.concatenate([unpack_ints(x) for x in table.column(c).to_pylist()]).astype(np.int64)
                            for c in ("s", "word", "n", "kind"))
        got = _best(p, s, word, n, kind == 2, kind == 1)
        return pa.table(dict(zip(("id", "near", "best_n", "best"), map(pa.array, got))))

    met = (numbered.repartition(parts, "part").groupBy("part")
           .applyInArrow(pair_up, "shard bigint, p binary, s binary, word binary, n binary, kind binary")
           .repartition(n_shards, "shard").groupBy("shard")
           .applyInArrow(meet, "id bigint, near bigint, best_n bigint, best bigint"))
    found = met.groupBy("id").agg(F.sum("near").alias("n_near"),
                                  F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("id"))).alias("near"))
    linked = cut(numbered.join(found, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("near.n") >= F.col("n") * factor, F.col("near.id")).alias("form_id"),
        F.when(-F.col("near.n") >= F.col("n") * factor, -F.col("near.n")).alias("form_n")))
    # each hop multiplies n, so a way is short; jumping doubles the hops done in each round
    ways = cut(linked.where("form_id is not null").select("id", "form_id", F.col("form_id").alias("root_id")))
    while True:
        step = ways.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        moved = cut(ways.join(step, "root_id", "left").select(
            "id", "form_id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
        ways = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    names = numbered.select("id", "word")
    spelled = (ways.join(names.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id")
               .join(names.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
               .select("id", "form", "root"))
    return linked.join(spelled, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                     "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, modulus: int = 31,
                      text_col: str = "text", id_col: str = "doc_id", part_words: int = PART_WORDS,
                      shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """Spelling variants among the words of all documents; see ``word_counts`` and ``variant_groups``.

    A null text has no words; a null id counts as empty text before the colon; a repeated row
    counts again; an empty table gives no rows; only the two columns are read, whole.
    """
    return variant_groups(word_counts(docs, min_length, min_count, modulus, text_col, id_col), factor, part_words,
                          shard_pairs)
