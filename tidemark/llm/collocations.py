"""Phrases whose words occur together far more often than apart, by Rabin-Karp fingerprints.

Blocks of documents of one language hold word numbers.  Prefix polynomials over the word hashes
of a block give the fingerprint of every n-gram as a difference.  Each block sends its distinct
fingerprints with their counts to shards; a shard adds them up and answers each block with one
flag for each fingerprint it sent: the place in the block's list is the pointer to the
occurrences.  Blocks then count the flagged n-grams again by their words, and only those become
text.  A fingerprint that several phrases share can only be flagged too often, never too
seldom, and the count of the texts decides, so the result is exact.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, text_or_empty
from .text_hash import mix, span_hashes
from .word_blocks import (byte_set, entries, expand, make_block, pack_ints, pack_sorted, pack_words, rows_of,
                          squeeze, unpack_ints, unpack_sorted, unpack_words)

BREAKS = byte_set(b".,;:!?", range(0x0A, 0x0E))
SEPARATORS = byte_set(b" \t", b".,;:!?", range(0x0A, 0x0E))
MAX_WORDS = 3
BLOCK_BYTES = 6 << 20          # text of a block
SHARD_GRAMS = 2_000_000        # fingerprints sent to a shard, on average
SPELLED_ROWS = 20_000          # phrases in an Arrow batch
FINGERPRINT_BITS = 48
RANK_PARTS = 64                # parts of a language that are ranked by themselves first

# floor(10^6 a a / (l r)) for counts of up to 15 digits: the products have up to 36
SCORE = ("cast((cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) * cast(1000000 AS decimal(7,0))) "
         "div (cast(l AS decimal(15,0)) * cast(r AS decimal(15,0))) AS bigint)")

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCKS = "block bigint, lang string, words binary, numbers binary, context binary, n_words bigint"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hash(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = words.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[:at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return span_hashes(buf, at[:-1], at[1:]) if len(words) else np.zeros(0, dtype=np.uint64)


def gram_prints(numbers: np.ndarray, hashes: np.ndarray, context: np.ndarray, seed: int, bits: int,
                max_words: int = MAX_WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``max_words``: places where an n-gram without a break ends, and its fingerprint.

    An n-gram that ends at a ``context`` place was counted with the entry before.
    """
    with np.errstate(over="ignore"):
        terms = np.concatenate((np.zeros(1, dtype=np.uint64), hashes))[numbers]
        sums = np.zeros(len(numbers) + 1, dtype=np.uint64)
        np.cumsum(terms * _powers(_BASE, len(numbers)), out=sums[1:], dtype=np.uint64)
        undo = _powers(_INVERSE, len(numbers))
        counted = numbers > 0
        counted[context] = False
        whole, out = numbers > 0, []
        for n in range(1, max_words + 1):
            if n > 1:
                whole = whole.copy()
                whole[n - 1:] &= numbers[:len(numbers) - n + 1] > 0
                whole[:n - 1] = False
            end = np.flatnonzero(whole & counted).astype(np.int32)
            raw = (sums[end + 1] - sums[end + 1 - n]) * undo[end + 1 - n]
            out.append((end, mix(raw + np.uint64(seed * MAX_WORDS + n) * np.uint64(_BASE)) >> np.uint64(64 - bits)))
    return out


class _Source:
    """Blocks as they were written, with their fingerprints in ascending order."""

    def __init__(self, lang: str, words: bytes, numbers: bytes, context: bytes, bits: int):
        self.words, self.numbers = unpack_words(words), unpack_ints(numbers).astype(np.uint32)
        grams = gram_prints(self.numbers, word_hash(self.words), unpack_ints(context).astype(np.int64),
                            zlib.crc32(lang.encode("utf-8", "surrogatepass")), bits)
        self.grams = grams
        self.prints, self.counts = np.unique(np.concatenate([p for _, p in grams]), return_counts=True)

    def shard_bounds(self, n_shards: int, bits: int) -> np.ndarray:
        tops = [(s << bits) // n_shards for s in range(n_shards + 1)]
        return np.searchsorted(self.prints, np.array(tops, dtype=np.uint64))

    def phrases(self, flags: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts, numbers of words and counts of the n-grams whose fingerprint is flagged."""
        texts, sizes, counts = [], [], []
        wanted = self.prints[flags]
        for n, (end, prints) in enumerate(self.grams, start=1):
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, prints), len(wanted) - 1)
                end = end[wanted[at] == prints]
            else:
                end = end[:0]
            key = self.numbers[end].astype(np.int64)
            for k in range(1, n):                                 # exact: tuples of word numbers
                _, key = np.unique(key * (len(self.words) + 1) + self.numbers[end - k], return_inverse=True)
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            last = end[first]
            parts = [self.words.take(pa.array(self.numbers[last - k].astype(np.int64) - 1))
                     for k in range(n - 1, -1, -1)]
            sep = pa.scalar(b" ", pa.large_binary())
            texts.append(pa.compute.binary_join_element_wise(*parts, sep) if n > 1 else parts[0])
            sizes.append(np.full(len(last), n, dtype=np.int32))
            counts.append(count.astype(np.int64))
        return pa.concat_arrays(texts), np.concatenate(sizes), np.concatenate(counts)


def _write_blocks(batches, block_bytes: int):
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    made = 0

    def flush(lang):
        nonlocal made
        parts = held.pop(lang)
        size.pop(lang)
        b = make_block([p for p, _, _ in parts], SEPARATORS, BREAKS, [last for _, _, last in parts])
        begin = np.cumsum(b.sizes) - b.sizes
        context = []
        for at, (_, lead, _) in zip(begin.tolist(), parts):
            if lead:
                words = np.flatnonzero(b.numbers[at:at + 2 * lead + 1])[:lead]
                context.extend((words + at).tolist())
        block = (TaskContext.get().partitionId() << 32) + made
        made += 1
        n_words = int(np.count_nonzero(b.numbers)) - len(context)
        return pa.RecordBatch.from_pylist(
            [{"block": block, "lang": lang, "words": pack_words(b.words), "numbers": pack_ints(b.numbers),
              "context": pack_ints(np.array(context, dtype=np.uint64)), "n_words": n_words}],
            schema=pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.binary()),
                              ("numbers", pa.binary()), ("context", pa.binary()), ("n_words", pa.int64())]))

    for batch in batches:
        langs = batch.column("_lang").to_pylist()
        texts = batch.column("_text").cast(pa.binary())
        for lang, text in zip(langs, texts):
            for part in entries(text.as_py(), SEPARATORS):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[0]) + 1
                if size[lang] >= block_bytes:
                    yield flush(lang)
        while sum(size.values()) >= 2 * block_bytes:          # many languages: the largest goes
            yield flush(max(size, key=size.get))
    for lang in list(held):
        yield flush(lang)


def phrase_counts(docs: DataFrame, min_count: int, text_col: str = "text", lang_col: str = "lang",
                  block_bytes: int = BLOCK_BYTES, shard_grams: int = SHARD_GRAMS,
                  bits: int = FINGERPRINT_BITS) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to 3 words that occur ``min_count`` times in a language.

    Returns (lang, phrase, k words, f) and (lang, n words in all).
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(text_or_empty(text_col).alias("_text"),
                      F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"))
    blocks = cut(src.mapInArrow(lambda it: _write_blocks(it, block_bytes), _BLOCKS))
    sums = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    n_shards = max(1, math.ceil(total * MAX_WORDS / shard_grams))

    def send(batches):
        for batch in batches:
            for row in rows_of(batch):
                s = _Source(row["lang"], row["words"], row["numbers"], row["context"], bits)
                at = s.shard_bounds(n_shards, bits)
                shard = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), pa.array([row["block"]] * len(shard), pa.int64()),
                     pa.array([pack_sorted(s.prints[at[i]:at[i + 1]]) for i in shard], pa.binary()),
                     pa.array([pack_ints(s.counts[at[i]:at[i + 1]]) for i in shard], pa.binary())],
                    names=["shard", "block", "prints", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        prints = [unpack_sorted(x) for x in table.column("prints").to_pylist()]
        counts = [unpack_ints(x) for x in table.column("counts").to_pylist()]
        seen, where = np.unique(np.concatenate(prints), return_inverse=True)
        often = np.bincount(where, weights=np.concatenate(counts), minlength=len(seen)) >= min_count
        flags = np.split(often[where], np.cumsum([len(p) for p in prints])[:-1])
        return pa.table({"block": table.column("block"), "shard": table.column("shard"),
                         "flags": pa.array([squeeze(np.packbits(f)) if f.any() else None for f in flags], pa.binary())})

    sent = blocks.select("block", "lang", "words", "numbers", "context").mapInArrow(
        send, "shard bigint, block bigint, prints binary, counts binary")
    answers = (sent.repartition(n_shards, "shard").groupBy("shard")
               .applyInArrow(add_up, "block bigint, shard bigint, flags binary").where("flags is not null")
               .groupBy("block").agg(F.collect_list(F.struct("shard", "flags")).alias("answers")))

    def spell(batches):
        for batch in batches:
            for row in rows_of(batch):
                s = _Source(row["lang"], row["words"], row["numbers"], row["context"], bits)
                at = s.shard_bounds(n_shards, bits)
                flags = np.zeros(len(s.prints), dtype=bool)
                for a in row["answers"]:
                    lo, hi = at[a["shard"]], at[a["shard"] + 1]
                    got = np.unpackbits(np.frombuffer(expand(a["flags"]), dtype=np.uint8))
                    flags[lo:hi] = got[:hi - lo].astype(bool)
                text, k, count = s.phrases(flags)
                del s
                for i in range(0, len(text), SPELLED_ROWS):
                    some = text[i:i + SPELLED_ROWS].cast(pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["lang"]] * len(some), pa.string()), some,
                         pa.array(k[i:i + SPELLED_ROWS], pa.int32()), pa.array(count[i:i + SPELLED_ROWS], pa.int64())],
                        names=["lang", "phrase", "k", "f"])

    spelled = (blocks.select("block", "lang", "words", "numbers", "context").join(answers, "block")
               .mapInArrow(spell, "lang string, phrase string, k int, f bigint"))
    counts = (spelled.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))
    return counts, sums


def collocations(docs: DataFrame, min_count: int = 10, inside_pct: int = 50, top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES,
                 shard_grams: int = SHARD_GRAMS, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """The strongest phrases of 2 and 3 words of every language.

    A phrase with a = f(phrase) >= ``min_count`` scores floor(10^6 a a / (l r)) for its worst cut
    into a first part with l and a rest with r occurrences (ties: the earliest cut).  It goes if
    a longer candidate holds its words side by side and occurs at least ``inside_pct`` per cent
    as often.  Returns lang, rank, phrase, a, l, r, n (words of the language), score for the
    ``top`` first of each language by score and a, both descending, then phrase in byte order.

    A null text is empty, a null language is ``und``; a repeated row counts again; an empty
    table gives no rows; only the two columns are read.  Texts of any length are read whole.
    """
    counts, sums = phrase_counts(docs, min_count, text_col, lang_col, block_bytes, shard_grams, bits)
    f = cut(counts)
    word = F.split("phrase", " ")
    grams = f.where("k > 1").withColumn("w", word)
    inner = (f.where(f"k = {MAX_WORDS}").withColumn("w", word)
             .select("lang", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]),
                                               F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("phrase"),
                     F.col("f").alias("longer"))
             .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = (grams.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * inside_pct)))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"),
                       F.explode(F.expr("""transform(sequence(1, k - 1), c -> struct(c AS c,
                           array_join(slice(w, 1, c), ' ') AS first, array_join(slice(w, c + 1, k - c), ' ') AS rest))"""))
                       .alias("cut"))
    parts = (cuts.select("lang", "phrase", "a", "cut.*")
             .join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
             .join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    worst = (parts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a")
             .agg(F.min(F.struct("score", "c", "l", "r")).alias("m"))
             .select("lang", "phrase", "a", "m.l", "m.r", "m.score"))
    # a language may hold most phrases: its first ones are found in parts, and among those in all
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = Window.partitionBy("lang", "part").orderBy(*order)
    some = (worst.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
            .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank", "part"))
    best = (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .where(F.col("rank") <= top))
    return best.join(sums, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
                                          "n", "score")
