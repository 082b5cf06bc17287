"""Similarity join on word 5-grams with Bayesian candidate pruning.

1. The unit is the word sequence, known by its digest: every row, whatever its id, belongs to
   the digest of its text, and one text of each digest is examined.
2. MinHash signatures in bands propose candidates: digests that agree in a band are
   tied to the band's first one, and the components of these ties are areas outside of
   which no link is looked for.  At the threshold a pair is missed with probability
   (1 - t**ROWS)**BANDS, 5e-8 for t = 0.8.
3. An area is cut into blocks by a hash, and a pair of blocks is one unit of work, so no unit
   holds more than two blocks, however many copies there are.  A digest goes to the units of
   those blocks that hold a digest it agrees with in a band: a chain of texts that are near
   only to the next ones costs its length, not the square of it.  Inside a unit, pairs are
   compared one slice of MinHash values after another and dropped once the posterior
   probability of reaching the threshold falls below TOLERANCE.
4. What is left is verified exactly on the shingle sets.  A unit returns link counts and a
   spanning forest of its links, never its pairs; components of the forests are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, text_or_empty
from .components import components
from .text_hash import mix, shingle_hashes, word_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
TOLERANCE = 1e-9
SLICE = 16                 # MinHash values compared at a time
BLOCK = 128                # digests in a block, on average
_HASHES = BANDS * ROWS
_rng = np.random.default_rng(91)
_MULT = _rng.integers(1, 1 << 63, _HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def min_hashes(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signature of every text: 32-bit minima; all ones for a text without shingles."""
    n = len(offsets) - 1
    out = np.full((n, _HASHES), 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    step = 1 << 14
    at = 0
    while at < len(filled):                         # slices that stay in cache
        end = at + 1
        while end < len(filled) and offsets[filled[end] + 1] - offsets[filled[at]] <= step:
            end += 1
        which = filled[at:end]
        lo, hi = offsets[which[0]], offsets[which[-1] + 1]
        x, begin = shingles[lo:hi], offsets[which] - lo
        for k in range(_HASHES):
            h = ((x * _MULT[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[which, k] = np.minimum.reduceat(h, begin)
        at = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band; equal keys mean equal values in that band."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(sig), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key ^ (rows[:, :, r] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))))
    return key.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest agreeing values among ``n`` for which P(J >= threshold | agreements) >= tolerance.

    The prior of J is uniform, so the posterior is Beta(m + 1, n - m + 1), and its upper tail is
    the chance that a Binomial(n + 1, threshold) stays at or below m.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def similar_pairs(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                  threshold: float, tolerance: float) -> np.ndarray:
    """Pairs (i in left, j in right) with Jaccard of at least ``threshold``; i < j if both are one block."""
    same = left is right
    alive = np.triu(np.ones((len(left), len(right)), dtype=bool), 1) if same \
        else np.ones((len(left), len(right)), dtype=bool)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    a, b = size[left][:, None], size[right][None, :]
    alive &= np.minimum(a, b) >= threshold * np.maximum(a, b)              # exact: J <= min / max
    agree = np.zeros(alive.shape, dtype=np.int16)
    for at in range(0, _HASHES, SLICE):
        if not alive.any():
            return np.zeros((0, 2), dtype=np.int64)
        for k in range(at, at + SLICE):
            agree += sig[left, k][:, None] == sig[right, k][None, :]
        alive &= agree >= least_matches(at + SLICE, threshold, tolerance)
    i, j = np.nonzero(alive)
    if not len(i):
        return np.zeros((0, 2), dtype=np.int64)
    both = _intersections(sets, left[i], right[j])
    total = size[left[i]] + size[right[j]] - both
    ok = both >= threshold * total - 1e-9
    return np.stack([left[i[ok]], right[j[ok]]], axis=1)


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the given pairs of sets."""
    used = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                         for x, y in zip(i.tolist(), j.tolist())], dtype=np.float64)
    slot = np.full(len(sets), -1)
    slot[used] = np.arange(len(used))
    member = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, term, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = count[term] > 1                                               # others are in no intersection
    member, term = member[shared], term[shared]
    order = np.argsort(term, kind="stable")
    member, term = member[order], term[order]
    inter = np.zeros((len(used), len(used)), dtype=np.float32)
    width, at = 4096, 0
    while at < len(term):                                                  # dense products over slices of terms
        end = int(np.searchsorted(term, term[at] + width))
        m = np.zeros((len(used), width), dtype=np.float32)
        m[member[at:end], term[at:end] - term[at]] = 1
        inter += m @ m.T
        at = end
    return inter[slot[i], slot[j]].astype(np.float64)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Root of each of ``n`` vertices under the given pairs."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs.tolist():
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _shingled(texts: list[str]):
    words, offsets = word_hashes(texts)
    return words, offsets, *shingle_hashes(words, offsets, WORDS)


def _groups_of_texts(texts: list[str], group_chars: int = 1 << 20):
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= group_chars):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _profiles(batches):
    """(id, two hashes of the text, words, two digests of the word sequence, band keys) of every text."""
    for b in batches:
        counts, d1, d2, keys = [], [], [], []
        for group in _groups_of_texts(b.column("_text").to_pylist()):
            words, off, sh, sh_off = _shingled(group)
            n = np.diff(off)
            place = np.arange(len(words), dtype=np.uint64) - np.repeat(off[:-1], n).astype(np.uint64)
            for out, salt in ((d1, 0x9E3779B97F4A7C15), (d2, 0xC2B2AE3D27D4EB4F)):
                spread = mix(words ^ mix(place * np.uint64(salt) + np.uint64(salt)))
                sums = np.zeros(len(words) + 1, dtype=np.uint64)
                np.cumsum(spread, dtype=np.uint64, out=sums[1:])
                out.append(mix(sums[off[1:]] - sums[off[:-1]] + n.astype(np.uint64)).view(np.int64))
            counts.append(n)
            keys.append(band_keys(min_hashes(sh, sh_off)))
        if not counts:
            continue
        keys = np.concatenate(keys)
        flat = pa.array(keys.reshape(-1), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, BANDS), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), b.column("_t1"), b.column("_t2"), pa.array(np.concatenate(counts), pa.int64()),
             pa.array(np.concatenate(d1), pa.int64()), pa.array(np.concatenate(d2), pa.int64()), lists],
            names=["id", "t1", "t2", "words", "d1", "d2", "bands"])


def _sets(batches):
    """Signature and sorted shingle set of every text, next to its place in the blocks."""
    for b in batches:
        sigs, sets = [], []
        for group in _groups_of_texts(b.column("_text").to_pylist()):
            _, _, sh, off = _shingled(group)
            sigs.extend(s.tobytes() for s in min_hashes(sh, off))
            sets.extend(np.unique(sh[x:y]).tobytes() for x, y in zip(off[:-1], off[1:]))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("area"), b.column("block"), b.column("others"),
                                          pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())],
                                         names=["node", "area", "block", "others", "sig", "grams"])


def _units(threshold: float, tolerance: float):
    """Work on runs of rows that share (area, lo, hi); rows arrive sorted by them."""
    def solve(rows: list[tuple]) -> list[tuple[int, int, int]]:
        lo, hi = rows[0][1], rows[0][2]
        node = np.array([r[3] for r in rows], dtype=np.int64)
        block = np.array([r[4] for r in rows])
        order = np.argsort(node, kind="stable")
        node, block = node[order], block[order]
        sig = np.array([np.frombuffer(rows[k][5], dtype=np.uint32) for k in order])
        sets = [np.frombuffer(rows[k][6], dtype=np.uint64) for k in order]
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        pairs = similar_pairs(sig, sets, left, right, threshold, tolerance)
        if not len(pairs):
            return []
        links = np.bincount(pairs.reshape(-1), minlength=len(node))
        root = forest(pairs, len(node))
        return [(int(node[k]), int(links[k]), int(node[root[k]])) for k in np.flatnonzero(links)]

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:3] != r[:3]:
                    out.extend(solve(held))
                    held = []
                held.append(r)
            yield _links(out)
        if held:
            yield _links(solve(held))
    return run


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    frame = pd.DataFrame(rows, columns=["node", "links", "hub"], dtype="int64")
    return pa.RecordBatch.from_pandas(frame, preserve_index=False)


def _text_keys(text: Column) -> tuple[Column, Column]:
    """Two hashes that tell the texts of one id apart."""
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def _visits(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, other): the blocks whose digests each node is compared with, its own among them.

    ``shared`` has (node, key), the band keys that several nodes share, and ``placed`` has
    (node, area, blocks, block).  In an area of one block that is block 0.  In a larger one it is
    each block with a node that shares a key.  Keys whose nodes lie in the same blocks, as most do
    among many copies of one text, are taken as one before anything is listed by node.
    """
    wide = shared.join(placed.where("blocks > 1").select("node", "block"), "node")
    spread = cut(wide.groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("others")))
    kinds = spread.groupBy("others").agg(F.min("key").alias("kind"))
    kind_of = spread.join(kinds, "others").select("key", "kind")
    of_node = wide.join(kind_of, "key").select("node", "kind").distinct()
    listed = of_node.join(kinds, "kind").select("node", F.explode("others").alias("other")).distinct()
    alone = placed.where("blocks = 1").select("node", F.lit(0).alias("other"))
    return alone.unionByName(listed)


def _classify(docs: DataFrame, threshold: float, tolerance: float, id_col: str,
              text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, digests): all rows' keys, and the class of every digest with words.

    ``texts`` has (id, t1, t2, words, d1, d2, n), a row for each distinct id and text, ``n`` rows
    of the input.  ``digests`` has (d1, d2, rep, t1, t2, n_copies, class_id, n_links, first):
    its smallest id (null if all are), the text of that id, its number of ids, the smallest
    id and the links of its class, and whether it is the class's first digest.
    """
    ship(docs.sparkSession)
    t1, t2 = _text_keys(text_or_empty(text_col))
    src = docs.select(F.col(id_col).cast("bigint").alias("_id"), t1.alias("_t1"), t2.alias("_t2"),
                      text_or_empty(text_col).alias("_text"))
    slim = cut(src.mapInArrow(_profiles, "id bigint, t1 bigint, t2 bigint, words bigint, d1 bigint, d2 bigint, "
                                         "bands array<bigint>"))
    texts = cut(slim.groupBy("id", "t1", "t2", "words", "d1", "d2").agg(F.count(F.lit(1)).alias("n")))
    if slim.count() != texts.count():                      # repeated rows: one of each is examined
        slim = cut(slim.dropDuplicates(["id", "t1", "t2"]))
        src = src.dropDuplicates(["_id", "_t1", "_t2"])
    members = texts.where("words > 0").groupBy("id", "d1", "d2").agg(F.min("t1").alias("t1"),
                                                                    F.min_by("t2", "t1").alias("t2"))
    copies = cut(members.groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.coalesce(F.min_by("t1", "id"), F.min("t1")).alias("t1"),
        F.coalesce(F.min_by("t2", "id"), F.min("t2")).alias("t2"), F.count(F.lit(1)).alias("n_copies"))
        .withColumn("node", F.monotonically_increasing_id()))
    shown = copies.select("node", "rep", F.col("t1").alias("r1"), F.col("t2").alias("r2"))
    reps = slim.join(shown, slim["id"].eqNullSafe(shown["rep"]) & (slim["t1"] == shown["r1"]) &
                     (slim["t2"] == shown["r2"]))
    keyed = reps.select("node", F.explode("bands").alias("key"))
    tied = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(tied.select("key", "hub"), "key").select("node", "key", "hub"))
    areas = cut(components(shared.select(F.col("node").alias("u"), F.col("hub").alias("v"))))
    sizes = areas.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(areas.join(sizes, "label")
                 .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
                 .select(F.col("id").alias("node"), F.col("label").alias("area"), "blocks",
                         F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))
    others = _visits(shared, placed).groupBy("node").agg(F.collect_list("other").alias("others"))
    chosen = placed.select("node", "area", "block").join(others, "node").join(shown, "node")
    signed = (src.join(chosen, src["_id"].eqNullSafe(chosen["rep"]) & (src["_t1"] == chosen["r1"]) &
                       (src["_t2"] == chosen["r2"]))
              .select("node", "area", "block", "others", "_text")
              .mapInArrow(_sets, "node bigint, area bigint, block int, others array<int>, sig binary, grams binary"))
    units = (signed.select("*", F.explode("others").alias("other"))
             .select("area", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                     "node", "block", "sig", "grams"))
    dealt = units.repartition("area", "lo", "hi").sortWithinPartitions("area", "lo", "hi")
    found = cut(dealt.mapInArrow(_units(threshold, tolerance), "node bigint, links bigint, hub bigint"))
    per_node = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    linked = cut(copies.join(classes.withColumnRenamed("id", "node"), "node")
                 .select("node", "label", "rep", "d1", "d2"))
    order = F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "d1", "d2")
    firsts = cut(linked.groupBy("label").agg(F.min(order).alias("_f"))
                 .select("label", "_f.rep", "_f.d1", "_f.d2"))
    named = linked.select("node", "label").join(
        firsts.select("label", F.col("rep").alias("class_id"), F.col("d1").alias("f1"), F.col("d2").alias("f2")), "label")
    digests = copies.join(named, "node", "left").join(per_node, "node", "left")
    alone = F.col("label").isNull()
    return texts, digests.select(
        "d1", "d2", "rep", "t1", "t2", "n_copies", F.when(alone, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | ((F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2")))).alias("first"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class and links of every document under Jaccard similarity of word 5-grams.

    Returns one row per distinct id and word sequence, null ids among them: the id column,
    ``class_id`` (smallest id among all documents that links and copies connect; null if none
    of them has an id), ``copy_of`` (smallest id with the same words in the same order),
    ``n_copies`` (ids of that copy group, null counted as one), ``n_links`` (other copy groups
    at the threshold or above) and ``n_words``.  Words are lower-cased runs of letters, digits
    and underscores; a text of 1 to 4 words is one shingle; texts without words, nulls among
    them, link to nothing and are copies of nothing.  An id with several word sequences has
    a row, and maybe another class, for each.
    """
    texts, digests = _classify(docs, threshold, tolerance, id_col, text_col)
    members = texts.select("id", "words", "d1", "d2").distinct()
    return (members.join(digests.drop("t1", "t2"), ["d1", "d2"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
                    F.coalesce("rep", "id").alias("copy_of"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("words").alias("n_words")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``near_classes`` that have an id; documents without one count in them."""
    return near_classes(docs, threshold, tolerance, id_col, text_col).where(F.col(id_col).isNotNull())


def keep_representatives(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One row of every class: of its smallest id, a null id only where no row has one.

    Where that id has several texts in the class, the one with the smallest digest stays.
    Texts without words are in no class, and all their rows stay.
    """
    texts, digests = _classify(docs, threshold, TOLERANCE, id_col, text_col)
    texts = texts.where("words > 0")
    chosen = digests.select("d1", "d2", "rep", "first", F.col("t1").alias("r1"), F.col("t2").alias("r2"))
    stays = (F.col("first") & F.col("id").eqNullSafe(F.col("rep")) & (F.col("t1") == F.col("r1")) &
             (F.col("t2") == F.col("r2")))

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("_gone_id"), F.col("t1").alias("_gone_t1"), F.col("t2").alias("_gone_t2"))

    t1, t2 = _text_keys(text_or_empty(text_col))
    own = [F.col(id_col).cast("bigint"), t1, t2]

    def same(of: DataFrame) -> Column:
        return (own[0].eqNullSafe(of["_gone_id"])) & (own[1] == of["_gone_t1"]) & (own[2] == of["_gone_t2"])

    gone = keys(texts.join(chosen, ["d1", "d2"]).where(~stays))
    kept = docs.join(gone, same(gone), "left_anti")
    repeated = keys(texts.where("n > 1"))
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, same(repeated), "left_semi")
    one = several.withColumns(dict(zip(("_gone_id", "_gone_t1", "_gone_t2"), own))).dropDuplicates(
        ["_gone_id", "_gone_t1", "_gone_t2"]).select(*docs.columns)
    return kept.join(repeated, same(repeated), "left_anti").unionByName(one)
