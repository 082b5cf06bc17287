"""Language-model scores of whole texts by n-gram tries in Elias-Fano levels.

The model interpolates words, word pairs and triples:

    p1(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p2(w | v)   = (c(v w) + M2 p1(w)) / (c(v) + M2)
    p3(w | u v) = (c(u v w) + M3 p2(w | v)) / (c(u v) + M3)

with counts over all training texts.  A text's first word has p1, its second p2.  A word v seen
more than ``NODE_COUNT`` times is a context together with a bucket of the word before it, so no
context holds more than about that many positions; p2 then refers to v in that bucket.

Blocks of documents send their words to shards of the vocabulary and get counts and numbers
back; then they send every position to the shard of its context v.  A shard builds the trie of
its contexts: monotone Elias-Fano levels with quantised probabilities, in which a word is found
by its rank among the successors of the shorter context.  It scores the positions that came and
sends one sum for each document back.  A trie is one flat buffer that is read in place, so a
written one can be mapped from its file.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collocations import word_hash
from .common import cut, ship, text_or_empty
from .elias_fano import EliasFano
from .text_hash import mix
from .word_blocks import (binary_array, byte_set, entries, expand, make_block, pack_ints, pack_sorted, pack_words,
                          rows_of, squeeze, unpack_ints, unpack_sorted, unpack_words)

SEPARATORS = byte_set(b" ", range(0x09, 0x0E))
ADD = 0.1                      # pseudo count of every word and of an unknown one
M2, M3 = 200.0, 3.0            # weight of the shorter context
NODE_COUNT = 1_000_000         # positions of a context word beyond which it is told apart by the word before
BLOCK_BYTES = 8 << 20          # text of a block
SHARD_WORDS = 1_000_000        # entries of word lists sent to a shard of the vocabulary, on average
SHARD_POSITIONS = 1_500_000    # positions sent to a trie's shard, on average
STEP, DEEPEST = 4096, 65535    # log10 probabilities are kept in steps of 1/4096, down to -16

_BUCKET = np.uint64(40)        # bits of a word number below the bucket


def quantise(log10: np.ndarray) -> np.ndarray:
    """Rounded down, so that the probabilities of a context never add up to more than 1."""
    return np.minimum(np.ceil(-log10 * STEP), DEEPEST).astype("<u2")


def restore(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) / -STEP


class NgramTrie:
    """Successors of contexts v and (u, v), read in place from a buffer that ``build`` returned.

    Contexts v are nodes 0 to n_nodes - 1 and words are 0 to n_words - 1.  Level two lists the
    successors of every node; level three the successors of every (u, v), each as its rank among
    the successors of v.
    """

    def __init__(self, buf, offset: int = 0):
        head = np.frombuffer(buf, dtype="<i8", count=4, offset=offset)
        self.n_nodes, self.n_words, n2, n_ctx = (int(x) for x in head)
        self.pairs = EliasFano(buf, offset + 32)
        self.first = EliasFano(buf, self.pairs.end)           # a node's first pair
        self.contexts = EliasFano(buf, self.first.end)
        self.base = EliasFano(buf, self.contexts.end)         # ranks before a context's own
        self.triples = EliasFano(buf, self.base.end)
        at = self.triples.end
        self.q2 = np.frombuffer(buf, dtype="<u2", count=n2, offset=at)
        self.back2 = np.frombuffer(buf, dtype="<u2", count=self.n_nodes, offset=at + 2 * n2)
        at += 2 * (n2 + self.n_nodes)
        self.back3 = np.frombuffer(buf, dtype="<u2", count=n_ctx, offset=at)
        self.q3 = np.frombuffer(buf, dtype="<u2", count=self.triples.n, offset=at + 2 * n_ctx)

    @staticmethod
    def build(n_nodes: int, log1: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray,
              m2: float = M2, m3: float = M3) -> bytes:
        """Trie of training positions: node ``v``, word ``u`` before it (-1: none), next word ``w``."""
        n_words, v = len(log1), v.astype(np.int64)
        pairs, where, c2 = np.unique(v * n_words + w, return_inverse=True, return_counts=True)
        of = pairs // max(n_words, 1)
        total = np.bincount(v, minlength=n_nodes)
        first = np.searchsorted(of, np.arange(n_nodes + 1))
        q2 = quantise(np.log10((c2 + m2 * 10.0 ** log1[pairs - of * n_words]) / (total[of] + m2)))
        back2 = quantise(np.log10(m2 / (total + m2)))
        long = u >= 0
        rank, where = (where - first[v])[long], where[long]
        contexts, ctx, cc = np.unique((v * n_words + u)[long], return_inverse=True, return_counts=True)
        width = np.diff(first)[contexts // max(n_words, 1)]
        base = np.concatenate(([0], np.cumsum(width)))
        triples, pick, c3 = np.unique(base[ctx] + rank, return_index=True, return_counts=True)
        q3 = quantise(np.log10((c3 + m3 * 10.0 ** restore(q2[where[pick]])) / (cc[ctx[pick]] + m3)))
        back3 = quantise(np.log10(m3 / (cc + m3)))
        grid = n_nodes * n_words + 1
        return b"".join((np.array([n_nodes, n_words, len(pairs), len(contexts)], dtype="<i8").tobytes(),
                         EliasFano.build(pairs, grid), EliasFano.build(first, len(pairs) + 1),
                         EliasFano.build(contexts, grid), EliasFano.build(base, int(base[-1]) + 1),
                         EliasFano.build(triples, int(base[-1]) + 1), q2.tobytes(), back2.tobytes(),
                         back3.tobytes(), q3.tobytes()))

    def score(self, log1: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 probability of every word ``w`` after ``u v`` (-1: no word before ``v``)."""
        out, chunk = np.empty(len(v)), 1 << 17
        order = np.argsort(v.astype(np.int64) * self.n_words + u)    # neighbours in the levels, one after the other
        first = self.first.access(np.arange(self.n_nodes))
        for at in range(0, len(v), chunk):
            s = order[at:at + chunk]
            out[s] = self._score(log1, first, *(x[s].astype(np.int64) for x in (v, u, w)))
        return out

    def _score(self, log1, first, v, u, w):
        pair = self.pairs.find(v * self.n_words + w)
        log = restore(self.back2[v]) + log1[w]
        seen = pair >= 0
        log[seen] = restore(self.q2[pair[seen]])
        ctx = np.full(len(v), -1, dtype=np.int64)
        long = u >= 0
        ctx[long] = self.contexts.find((v * self.n_words + u)[long])
        known = ctx >= 0
        triple = np.full(len(v), -1, dtype=np.int64)
        both = known & seen
        triple[both] = self.triples.find(self.base.access(ctx[both]) + pair[both] - first[v[both]])
        log[known] += restore(self.back3[ctx[known]])
        hit = triple >= 0
        log[hit] = restore(self.q3[triple[hit]])
        return log


def _write_blocks(batches, block_bytes: int):
    parts: list[tuple[bytes, int, bool]] = []
    docs: list[dict] = []
    size = made = 0
    id_type = None

    def flush():
        nonlocal parts, docs, size, made
        b = make_block([p for p, _, _ in parts], SEPARATORS, None, [last for _, _, last in parts])
        schema = pa.schema([("block", pa.int64()),
                            ("docs", pa.list_(pa.struct([("row", pa.int64()), ("id", id_type), ("held", pa.bool_())]))),
                            ("words", pa.binary()), ("numbers", pa.binary()), ("sizes", pa.binary()),
                            ("lead", pa.binary()), ("held", pa.binary()), ("n_words", pa.int64()),
                            ("n_tokens", pa.int64())])
        row = {"block": (TaskContext.get().partitionId() << 32) + made, "docs": docs, "words": pack_words(b.words),
               "numbers": pack_ints(b.numbers), "sizes": pack_ints(b.sizes),
               "lead": pack_ints(np.array([lead for _, lead, _ in parts], dtype=np.uint64)),
               "held": pack_ints(np.array([d["held"] for d in docs], dtype=np.uint64)),
               "n_words": len(b.words), "n_tokens": len(b.numbers)}
        parts, docs, size, made = [], [], 0, made + 1
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        id_type = batch.schema.field("_id").type
        names = ("_row", "_id", "_held", "_text")
        for row, doc, held, text in zip(*(batch.column(n).cast(pa.binary()) if n == "_text" else batch.column(n).to_pylist()
                                          for n in names)):
            for part in entries(text.as_py(), SEPARATORS):
                parts.append(part)
                docs.append({"row": row, "id": doc, "held": held})
                size += len(part[0]) + 1
                if size >= block_bytes:
                    yield flush()
    if parts:
        yield flush()


class _Positions:
    """The positions of a block, without those that an entry repeats from the one before."""

    def __init__(self, row: dict):
        self.numbers = unpack_ints(row["numbers"]).astype(np.int64)
        sizes, lead = unpack_ints(row["sizes"]).astype(np.int64), unpack_ints(row["lead"]).astype(np.int64)
        self.held = unpack_ints(row["held"]).astype(bool)
        self.n_entries = len(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        counted = inside >= lead[owner]
        self.at, self.owner, self.inside = np.flatnonzero(counted), owner[counted], inside[counted]

    def words(self, blob: bytes) -> pa.Array:
        """The end of a text, as an empty word, then the words."""
        return pa.concat_arrays([binary_array(np.zeros(1, dtype=np.int64), b""), unpack_words(blob)])

    def training(self, n_words: int) -> np.ndarray:
        return np.bincount(self.numbers[self.at[~self.held[self.owner]]], minlength=n_words)


def _node_keys(number: np.ndarray, count: np.ndarray, before: np.ndarray, node_count: int) -> np.ndarray:
    """Word number of a context with its bucket; ``before`` is the number of the word before + 1, or 0."""
    buckets = np.maximum(-(-count // node_count), 1).astype(np.uint64)
    return number.astype(np.uint64) | (mix(before.astype(np.uint64)) % buckets << _BUCKET)


def score_texts(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id",
                block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS,
                shard_positions: int = SHARD_POSITIONS, node_count: int = NODE_COUNT) -> DataFrame:
    """Scores of all texts by a model of those that are not ``held_out``.

    Returns one row per row of ``docs``: the id column, ``held_out``, ``n_tokens`` (words and
    the end), ``n_known`` (of them, seen in training), ``train_tokens``, ``base_score`` (sum
    of log10 p1) and ``score`` (log10 of the model's probability).  A null text is empty, that is
    its end alone; a null ``held_out`` counts as held out; null ids, repeated rows and ids are
    scored like any others; an empty table gives no rows; without training texts every token has
    p1 = 1; other columns are not read.  Words are told apart exactly, by their bytes.
    """
    entries_, _, _ = _scored(docs, held_out, text_col, id_col, block_bytes, shard_words, shard_positions, node_count)
    merged = entries_.groupBy("row").agg(
        F.first("id").alias("id"), F.first("held").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.first("train_tokens").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return merged.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                         "score")


def build_tries(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id",
                block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS,
                shard_positions: int = SHARD_POSITIONS, node_count: int = NODE_COUNT) -> DataFrame:
    """The tries themselves: (shard, nodes, words, counts, trie), one row per shard.

    ``nodes`` and ``words`` hold the numbers of the trie's contexts and words, ``counts`` the
    training counts of the words; ``trie`` is a buffer for ``NgramTrie``.
    """
    _, sent, facts = _scored(docs, held_out, text_col, id_col, block_bytes, shard_words, shard_positions, node_count)
    n_shards, train_tokens, types = facts

    def build(table: pa.Table) -> pa.Table:
        shard = _Shard(table, train_tokens, types)
        return pa.table({"shard": table.column("shard").slice(0, 1), "nodes": pa.array([pack_sorted(shard.nodes)]),
                         "words": pa.array([pack_sorted(shard.words)]), "counts": pa.array([pack_ints(shard.counts)]),
                         "trie": pa.array([shard.trie])})

    return sent.repartition(n_shards, "shard").groupBy("shard").applyInArrow(
        build, "shard bigint, nodes binary, words binary, counts binary, trie binary")


def log_p1(count: np.ndarray, train_tokens: int, types: int) -> np.ndarray:
    return np.log10((count + ADD) / (train_tokens + ADD * (types + 1)))


def _places(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(among, values).astype(np.int32)


class _Shard:
    """All positions of some contexts and the trie of those in training texts."""

    def __init__(self, table: pa.Table, train_tokens: int, types: int):
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        nodes, words = ([unpack_sorted(x) for x in col[c]] for c in ("nodes", "words"))
        self.nodes = np.unique(np.concatenate(nodes))
        self.words, first = np.unique(np.concatenate(words), return_index=True)
        self.counts = np.concatenate([unpack_ints(x) for x in col["counts"]])[first].astype(np.int64)
        self.owners = [unpack_sorted(x).astype(np.int64) for x in col["owners"]]
        self.v = np.concatenate([_places(self.nodes, n)[unpack_ints(x)] for n, x in zip(nodes, col["v"])])
        u, w = [], []
        for n, x, y in zip(words, col["u"], col["w"]):
            place = np.append(_places(self.words, n), np.int32(-1))
            u.append(place[unpack_ints(x).astype(np.int64) - 1])      # 0 is none
            w.append(place[unpack_ints(y)])
        self.u, self.w = np.concatenate(u), np.concatenate(w)
        held = np.concatenate([np.unpackbits(np.frombuffer(expand(x), dtype=np.uint8))[:len(o)].astype(bool)
                               for x, o in zip(col["held"], self.owners)])
        self.log1 = log_p1(self.counts, train_tokens, types)
        t = ~held
        self.trie = NgramTrie.build(len(self.nodes), self.log1, self.v[t], self.u[t], self.w[t])


def _scored(docs, held_out, text_col, id_col, block_bytes, shard_words, shard_positions, node_count):
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                      F.coalesce(held_out, F.lit(True)).alias("_held"), text_or_empty(text_col).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    docs_type = f"array<struct<row:bigint,id:{id_type},held:boolean>>"
    blocks = cut(src.mapInArrow(
        lambda it: _write_blocks(it, block_bytes),
        f"block bigint, docs {docs_type}, words binary, numbers binary, sizes binary, lead binary, held binary, "
        "n_words bigint, n_tokens bigint"))
    n_words, n_tokens = (x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    n_vocab = max(1, math.ceil(n_words / shard_words))
    n_shards = max(1, math.ceil(n_tokens / shard_positions))
    part = ["numbers", "sizes", "lead", "held"]

    def ask(batches):
        for batch in batches:
            for row in rows_of(batch):
                p = _Positions(row)
                words = p.words(row["words"])
                counts = p.training(len(words))
                shard = (word_hash(words) % np.uint64(n_vocab)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(n_vocab + 1))
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = order[bounds[s]:bounds[s + 1]]
                    yield pa.RecordBatch.from_pydict(
                        {"shard": [s], "block": [row["block"]], "words": [pack_words(words.take(pa.array(mine)))],
                         "counts": [pack_ints(counts[mine])]})

    def number(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        lists = [unpack_words(x) for x in table.column("words").to_pylist()]
        counts = np.concatenate([unpack_ints(x) for x in table.column("counts").to_pylist()])
        seen = pa.concat_arrays(lists).dictionary_encode()
        at = seen.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(at, weights=counts, minlength=len(seen.dictionary)).astype(np.int64)
        in_bytes = np.empty(len(total), dtype=np.int64)
        in_bytes[pa.compute.sort_indices(seen.dictionary).to_numpy()] = np.arange(len(total))
        rank = np.empty(len(total), dtype=np.int64)
        rank[np.lexsort((in_bytes, -total))] = np.arange(len(total))
        splits = np.cumsum([len(x) for x in lists])[:-1]
        first = np.arange(len(lists)) == 0
        return pa.table({
            "block": table.column("block"), "shard": table.column("shard"),
            "totals": pa.array([pack_ints(x) for x in np.split(total[at], splits)], pa.binary()),
            "ids": pa.array([pack_ints(x) for x in np.split(rank[at] * n_vocab + shard, splits)], pa.binary()),
            "types": pa.array(np.where(first, np.count_nonzero(total), 0), pa.int64()),
            "tokens": pa.array(np.where(first, total.sum(), 0), pa.int64())})

    numbered = cut(blocks.select("block", "words", *part)
                   .mapInArrow(ask, "shard bigint, block bigint, words binary, counts binary")
                   .repartition(n_vocab, "shard").groupBy("shard")
                   .applyInArrow(number, "block bigint, shard bigint, totals binary, ids binary, types bigint, tokens bigint"))
    types, train_tokens = (int(x or 0) for x in numbered.agg(F.sum("types"), F.sum("tokens")).first())
    answers = numbered.groupBy("block").agg(F.collect_list(F.struct("shard", "totals", "ids")).alias("answers"))
    known = blocks.select("block", "words", *part, "docs").join(answers, "block")

    def look_up(row):
        """Positions of a block, and the training count and number of each of its words."""
        p = _Positions(row)
        words = p.words(row["words"])
        shard = (word_hash(words) % np.uint64(n_vocab)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        got = sorted(row["answers"], key=lambda a: a["shard"])
        total, ids = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        total[order] = np.concatenate([unpack_ints(a["totals"]) for a in got])
        ids[order] = np.concatenate([unpack_ints(a["ids"]) for a in got])
        return p, total, ids

    def base(batches):
        for batch in batches:
            parts = []
            for row in rows_of(batch.drop_columns(["docs"])):
                p, total, _ = look_up(row)
                log1 = log_p1(total, train_tokens, types)
                slot = p.numbers[p.at]
                sums = [np.bincount(p.owner, weights=x, minlength=p.n_entries) for x in
                        (np.ones(len(slot)), total[slot] > 0, log1[slot], np.where(p.inside == 0, log1[slot], 0.0))]
                parts.append([dict(zip(("n_tokens", "n_known", "base", "start"), (int(a), int(b), c, d)))
                              for a, b, c, d in zip(*(x.tolist() for x in sums))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("docs"),
                 pa.array(parts, pa.list_(pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()),
                                                     ("base", pa.float64()), ("start", pa.float64())])))],
                names=["block", "docs", "parts"])

    def send(batches):
        for batch in batches:
            for row in rows_of(batch.drop_columns(["docs"])):
                p, total, ids = look_up(row)
                after = p.inside > 0
                at, owner = p.at[after], p.owner[after]
                w, v = p.numbers[at], p.numbers[at - 1]
                u = np.where(p.inside[after] > 1, p.numbers[np.maximum(at - 2, 0)], -1)
                node = _node_keys(ids[v], total[v], np.where(u >= 0, ids[u] + 1, 0), node_count)
                shard = (mix(node + np.uint64(1)) % np.uint64(n_shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(n_shards + 1))
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = order[bounds[s]:bounds[s + 1]]
                    nodes, vs = np.unique(node[mine], return_inverse=True)
                    used = np.zeros(len(ids), dtype=bool)
                    used[w[mine]] = True
                    used[u[mine][u[mine] >= 0]] = True
                    slots = np.flatnonzero(used)
                    slots = slots[np.argsort(ids[slots])]
                    place = np.zeros(len(ids) + 1, dtype=np.int64)   # the last is for no word
                    place[slots] = np.arange(len(slots))
                    yield pa.RecordBatch.from_pydict({
                        "shard": [s], "block": [row["block"]], "nodes": [pack_sorted(nodes)],
                        "words": [pack_sorted(ids[slots].astype(np.uint64))], "counts": [pack_ints(total[slots])],
                        "owners": [pack_sorted(owner[mine].astype(np.uint64))], "v": [pack_ints(vs)],
                        "u": [pack_ints(np.where(u[mine] >= 0, place[u[mine]] + 1, 0))],
                        "w": [pack_ints(place[w[mine]])],
                        "held": [squeeze(np.packbits(p.held[owner[mine]]))]})

    sent = known.mapInArrow(                                # the same columns as below: one shuffle serves both
        send, "shard bigint, block bigint, nodes binary, words binary, counts binary, owners binary, v binary, "
              "u binary, w binary, held binary")

    def score(table: pa.Table) -> pa.Table:
        shard = _Shard(table, train_tokens, types)
        blocks_, shards_ = table.column("block"), table.column("shard")
        del table
        log = NgramTrie(shard.trie).score(shard.log1, shard.v, shard.u, shard.w)
        owners, sums, at = [], [], 0
        for o in shard.owners:
            first = np.flatnonzero(np.diff(o, prepend=-1))
            owners.append(pack_sorted(o[first].astype(np.uint64)))
            sums.append(np.add.reduceat(log[at:at + len(o)], first).tobytes())
            at += len(o)
        return pa.table({"block": blocks_, "shard": shards_, "owners": pa.array(owners, pa.binary()),
                         "sums": pa.array(sums, pa.binary())})

    sums = (sent.repartition(n_shards, "shard").groupBy("shard")
            .applyInArrow(score, "block bigint, shard bigint, owners binary, sums binary")
            .groupBy("block").agg(F.collect_list(F.struct("shard", "owners", "sums")).alias("sums")))
    with_base = known.mapInArrow(
        base, f"block bigint, docs {docs_type}, "
              "parts array<struct<n_tokens:bigint,n_known:bigint,base:double,start:double>>")

    def finish(batches):
        for batch in batches:
            scores = []
            for start, got in zip(*(batch.column(c).to_pylist() for c in ("start", "sums"))):
                total = np.array(start)
                for a in sorted(got or [], key=lambda a: a["shard"]):
                    total[unpack_sorted(a["owners"]).astype(np.int64)] += np.frombuffer(a["sums"], dtype="<f8")
                scores.append(total.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("docs"), batch.column("parts"),
                                              pa.array(scores, pa.list_(pa.float64()))], names=["docs", "parts", "score"])

    parts_type = "array<struct<n_tokens:bigint,n_known:bigint,base:double,start:double>>"
    done = (with_base.join(sums, "block", "left")
            .select("docs", "parts", F.col("parts.start").alias("start"), "sums")
            .mapInArrow(finish, f"docs {docs_type}, parts {parts_type}, score array<double>")
            .select(F.explode(F.arrays_zip("docs", "parts", "score")).alias("e"))
            .select("e.docs.*", "e.parts.n_tokens", "e.parts.n_known", "e.parts.base", "e.score",
                    F.lit(train_tokens).cast("bigint").alias("train_tokens")))
    return done, sent, (n_shards, train_tokens, types)
