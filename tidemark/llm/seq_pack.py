"""Lexical retrieval packing: related documents share a training window.

Documents are dealt into shards by a hash.  Each shard holds a BM25 inverted index over the
token ids of its documents.  A seed document opens a window; the index returns the unused
documents nearest to it, best first, and they fill the window greedily.  The document that
overflows is cut, and its rest opens the next window as the next seed, so a shard has no
padding but in its last window.  Shards have a fixed size in tokens, so their number grows
with the corpus and a task's memory does not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_runs import encoder, forget
from .common import ship, text_or_empty

SHARD_BYTES = 12_000_000       # UTF-8 bytes of text in a shard, on average
K1, B = 1.2, 0.75
DENSE_PART = 4                 # a term in more than one of so many of a shard's documents has a dense row


class Bm25Index:
    """Inverted index over documents given as arrays of term ids."""

    def __init__(self, docs: list[np.ndarray], k1: float = K1, b: float = B):
        length = np.array([len(d) for d in docs], dtype=np.float64)
        every = np.concatenate(docs).astype(np.int64) if len(docs) else np.zeros(0, dtype=np.int64)
        width = int(every.max(initial=0)) + 1
        pairs, tf = np.unique(np.repeat(np.arange(len(docs)), length.astype(np.int64)) * width + every, return_counts=True)
        doc, term = np.divmod(pairs, width)
        sizes = np.bincount(doc, minlength=len(docs))
        self.terms = np.split(term, np.cumsum(sizes)[:-1]) if len(docs) else []
        n = len(docs)
        self.df = np.bincount(term, minlength=1)
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        norm = k1 * (1 - b + b * length / max(length.mean() if n else 1.0, 1.0))
        impact = idf[term] * tf * (k1 + 1) / (tf + norm[doc])
        self.own = np.split(impact, np.cumsum(sizes)[:-1]) if n else []
        order = np.argsort(term, kind="stable")
        self.gone = np.zeros(n, dtype=bool)
        self.doc, self.impact = doc[order].astype(np.int32), impact[order].astype(np.float32)
        self.begin = np.concatenate(([0], np.cumsum(self.df)))
        self.n = n
        self.left = np.arange(n)                 # documents not dropped, in the order of the dense columns
        # postings of the most common terms also as rows of a matrix, which one product adds up
        dense = np.flatnonzero(self.df >= max(n / DENSE_PART, 8))
        self.row = np.full(len(self.df), -1, dtype=np.int64)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), n))
        for i, t in enumerate(dense.tolist()):
            s = slice(self.begin[t], self.begin[t + 1])
            self.dense[i, self.doc[s]] = self.impact[s]

    def query(self, seed: int, n_terms: int | None = None) -> np.ndarray:
        """Scores of all documents left for all terms of document ``seed``, or its ``n_terms`` heaviest."""
        terms = self.terms[seed]
        if n_terms is not None and len(terms) > n_terms:
            terms = terms[np.argpartition(-self.own[seed], n_terms - 1)[:n_terms]]
        out = np.zeros(self.n)
        if not len(terms):
            return out
        rows = self.row[terms]
        many = rows[rows >= 0]
        if len(many):
            asked = np.zeros(len(self.dense))
            asked[many] = 1
            out[self.left] = asked @ self.dense
        few = terms[rows < 0]
        if len(few):
            sizes = self.begin[few + 1] - self.begin[few]
            at = np.repeat(self.begin[few] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out += np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)
        return out.astype(np.float32)            # the order of the additions must not part equal scores

    def drop(self, gone: np.ndarray) -> None:
        """Take documents out of the postings; the weights of the others stay as they are."""
        keep = ~gone[self.doc]
        self.begin = np.concatenate(([0], np.cumsum(keep)))[self.begin]
        self.doc, self.impact = self.doc[keep], self.impact[keep]
        stays = ~gone[self.left]
        self.left, self.dense = self.left[stays], self.dense[:, stays]
        self.gone = gone.copy()


def best_first(score: np.ndarray):
    """Places of positive scores, highest first, ties to the smaller place; sorted as far as they are asked for."""
    near = np.flatnonzero(score > 0)
    for k in (32, 512):
        if len(near) > 4 * k:
            at = score[near]
            bar = np.partition(at, len(at) - k)[len(at) - k]
            head, near = near[at >= bar], near[at < bar]
            yield from head[np.lexsort((head, -score[head]))].tolist()
    yield from near[np.lexsort((near, -score[near]))].tolist()


def pack_shard(docs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard's documents."""
    index = Bm25Index(docs)
    used = np.zeros(len(docs), dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = offset = cursor = 0

    def place(d: int) -> bool:
        """Append all of d, cutting at window ends; True if a new window was begun in it."""
        nonlocal sequence, offset
        used[d] = True
        start, left, began = 0, len(docs[d]), False
        while left:
            take = min(left, window - offset)
            pieces.append((d, start, take, sequence, offset))
            start, left, offset = start + take, left - take, offset + take
            if offset == window:
                sequence, offset, began = sequence + 1, 0, True
        return began

    seed = -1
    while True:
        if seed < 0:
            while cursor < len(docs) and used[cursor]:
                cursor += 1
            if cursor == len(docs):
                return pieces
            seed = cursor
            place(seed)
        if 4 * np.count_nonzero(used & ~index.gone) >= np.count_nonzero(~index.gone):
            index.drop(used)
        score = index.query(seed)
        score[used] = 0
        seed = -1
        for d in best_first(score):
            if place(d):
                seed = d                # its rest, if any, opened the window: it is the next seed
                break


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1,
                   shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of all documents, each closed by ``end_id``, into windows.

    Returns one row per piece: the id column, ``start``, ``length``, ``ids`` (binary:
    little-endian unsigned 32-bit integers), ``doc_tokens`` (with the end id),
    ``sequence_id`` and ``offset``.  Every id lies in exactly one piece.  A null or empty
    text is its end id alone; repeated rows and null ids are packed like any others; an empty
    table gives an empty result; other columns are never read.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    total = src.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    n_shards = max(1, math.ceil(total / shard_bytes))
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokenise(batches):
        enc = encoder(tokenizer_path)
        small = len(enc.tokens) <= 1 << 16 and end_id < 1 << 16
        for b in batches:
            ids = [x + end for x in enc.encode_many(b.column("_text").cast(pa.binary()).to_pylist())]
            if small:                   # half the bytes through the shuffle
                ids = [np.frombuffer(x, dtype="<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_shard"), pa.array(ids, pa.binary()),
                                              pa.array([small] * len(ids), pa.bool_())],
                                             names=["_id", "_shard", "_ids", "_small"])

    def pack(table: pa.Table) -> pa.Table:
        forget()                        # the worker may have encoded before
        table = table.sort_by([("_id", "ascending"), ("_ids", "ascending")])     # null ids last
        shard = table.column("_shard")[0].as_py()
        ids = [np.frombuffer(x, dtype="<u2" if s else "<u4")
               for x, s in zip(table.column("_ids").to_pylist(), table.column("_small").to_pylist())]
        got = np.array(pack_shard(ids, window), dtype=np.int64).reshape(-1, 5)
        owner = got[:, 0]
        return pa.table({
            id_col: table.column("_id").take(pa.array(owner)), "start": got[:, 1], "length": got[:, 2],
            "ids": pa.array([ids[d][s:s + n].astype("<u4").tobytes() for d, s, n in got[:, :3].tolist()], pa.binary()),
            "doc_tokens": np.array([len(x) for x in ids], dtype=np.int64)[owner],
            "sequence_id": (shard << 32) + got[:, 3], "offset": got[:, 4]})

    dealt = src.withColumn("_shard", F.pmod(F.xxhash64("_id", F.crc32(F.encode("_text", "UTF-8"))), F.lit(n_shards)))
    tokens = dealt.mapInArrow(tokenise, f"_id {id_type}, _shard bigint, _ids binary, _small boolean")
    return tokens.repartition(n_shards, "_shard").groupBy("_shard").applyInArrow(
        pack, f"`{id_col}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")
