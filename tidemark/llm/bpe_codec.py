"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks at places that depend on the
content alone, so copies, near copies and shared passages yield the same chunks whatever
their position.  Texts are dealt out by their smallest chunk hash (texts that share most
chunks meet in one partition; Spark's rebalance splits a partition that grows too large),
and there a chunk that several documents share is encoded once.

Joins are repaired exactly: a chunk stands for the tokens between its first and last white
space only, the span where encoding the chunk alone and encoding the whole text agree.  The
pieces outside that span are joined with those of the neighbouring chunks, growing until
white space is reached on both sides, and are encoded again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_runs import encoder
from .common import ship, text_or_empty

WINDOW = 16                    # bytes the rolling hash sees
MASK = np.uint32(0xFF)         # a cut every 256 bytes on average
MIN_CHUNK = 64                 # bytes between cuts at least
MEMO_CHUNKS = 50_000           # chunks kept per worker: a memory bound, never a result bound
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)
_WS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: bytes) -> list[int]:
    """Content-defined cut positions of one text, without 0 and len(data)."""
    if len(data) <= WINDOW + MIN_CHUNK:
        return []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width, factor = 1, 0x2545F491
    while width < WINDOW:                                   # doubling: windows of 1, 2, 4, 8, 16 bytes
        h = h[width:] + h[:-width] * np.uint32(pow(factor, width, 1 << 32))
        width *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    at = np.flatnonzero(((h >> np.uint32(13)) & MASK) == 0) + WINDOW
    out, last = [], 0
    for c in at.tolist():
        if c - last >= MIN_CHUNK and c < len(data):
            out.append(c)
            last = c
    return out


def chunks(data: bytes) -> list[bytes]:
    edges = [0, *cuts(data), len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def _span(chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
    """(head, body, tail) around the first and last white space, None without any."""
    ws = np.flatnonzero(_IS_WS[np.frombuffer(chunk, dtype=np.uint8)])
    if not len(ws):
        return None
    return chunk[:ws[0]], chunk[ws[0]:ws[-1] + 1], chunk[ws[-1] + 1:]


class ChunkEncoder:
    """Encodes texts chunk by chunk; chunks and seams already met are looked up."""

    def __init__(self, path: str):
        self.base = encoder(path)
        self.known: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}

    def _learn(self, new: list[bytes]) -> None:
        spans = [_span(c) for c in new]
        bodies = iter(self.base.encode_many([s[1] for s in spans if s]))
        for c, s in zip(new, spans):
            self.known[c] = (s[0], next(bodies), s[2]) if s else None

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                size += len(texts[end])
                end += 1
            if len(self.known) > MEMO_CHUNKS:
                self.known.clear()
            split = [chunks(t) for t in texts[at:end]]
            self._learn(list({c for cs in split for c in cs if c not in self.known}))
            plans: list[list[bytes]] = []
            seams: list[bytes] = []
            for cs in split:
                parts: list[bytes] = []                     # bodies at odd places, seams between them
                pending = b""
                for c in cs:
                    k = self.known[c]
                    if k is None:
                        pending += c
                    else:
                        seams.append(pending + k[0])
                        parts.append(k[1])
                        pending = k[2]
                seams.append(pending)
                plans.append(parts)
            repaired = iter(self.base.encode_many(seams))
            for parts in plans:
                whole = []
                for body in parts:
                    whole.append(next(repaired))
                    whole.append(body)
                whole.append(next(repaired))
                out.append(b"".join(whole))
            at = end
        return out


def _route(text: pd.Series) -> pd.Series:
    def smallest(t: str) -> int:
        h = min(xxhash.xxh64_intdigest(c) for c in chunks(t.encode("utf-8", "surrogatepass")))
        return h - (1 << 63)
    return pd.Series([smallest(t) for t in text], dtype="int64")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text.

    Returns one row per input row: the id column, ``ids`` (binary: little-endian unsigned
    32-bit integers), ``decoded`` (string).  Null texts count as empty and give no ids and an
    empty string; repeated rows and null ids are kept as they are; an empty table gives an
    empty result; other columns of ``docs`` are never read, so their names cannot clash.
    """
    ship(docs.sparkSession)
    route = F.pandas_udf(_route, "bigint")
    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    dealt = src.withColumn("_route", route("_text")).hint("rebalance", "_route")

    def run(batches):
        enc = ChunkEncoder(path)
        for b in batches:
            ids = enc.encode_many(b.column("_text").cast(pa.binary()).to_pylist())
            decoded = [enc.base.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                names=[id_col, "ids", "decoded"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return dealt.select("_id", "_text").mapInArrow(run, f"`{id_col}` {id_type}, ids binary, decoded string")
