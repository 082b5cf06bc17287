"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group.  Groups are gathered by a hash into cells, whose number is
fixed; each cell is a vector (bytes, tokens, rows).  The driver sees these vectors only and
places them, largest first, in the shard where the dot product with the residual capacity is
highest.  A group larger than half a shard's share is split by a hash of its ids into pieces
that are placed on their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, text_or_empty

CELLS_PER_SHARD = 1024         # cells of small groups, for each shard
PIECES = 64                    # pieces of a group that is too large for one shard
SLOT_ROWS = 20_000             # rows numbered together, on average
WEIGHTS = (8.0, 1.0, 1.0)      # bytes, tokens, rows


def place(vectors: np.ndarray, n_shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """Shard of every vector: largest first, highest weighted dot product with what is left.

    Ties go to the lower vector index and the lower shard.
    """
    total = vectors.sum(axis=0)
    share = np.where(total > 0, total, 1) / n_shards
    unit = vectors / share
    w = np.asarray(weights)
    left = np.ones((n_shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(unit)), -(unit * w).max(axis=1))):
        s = int(np.argmax(left @ (unit[i] * w)))
        out[i] = s
        left[s] -= unit[i]
    return out


def even_out(vectors: np.ndarray, shards: np.ndarray, n_shards: int, tolerance: float = 1e-3,
             rounds: int = 400) -> np.ndarray:
    """Exchange one vector of the fullest shard for one of the emptiest until bytes are even.

    Only exchanges that shrink the gap of the first component are made, so this ends; few
    and large groups need it, many cells are even already.
    """
    size, out = vectors[:, 0], shards.copy()
    load = np.bincount(out, weights=size, minlength=n_shards)
    for _ in range(rounds):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        if gap <= tolerance * load.mean():
            break
        a, b = np.flatnonzero(out == hi), np.flatnonzero(out == lo)
        give, take = np.append(size[a], 0.0), np.append(size[b], 0.0)       # 0: a move without return
        order = np.argsort(take, kind="stable")
        want = give - gap / 2                                               # best counterpart of each
        near = np.searchsorted(take[order], want)
        options = [(abs(give[i] - take[order[j]] - gap / 2), i, int(order[j]))
                   for i in range(len(give)) for j in (near[i] - 1, near[i]) if 0 <= j < len(take)]
        miss, i, j = min(options)
        if miss >= gap / 2 - 1e-9:
            break
        if i < len(a):
            out[a[i]] = lo
        if j < len(b):
            out[b[j]] = hi
        load = np.bincount(out, weights=size, minlength=n_shards)
    return out


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Assign every row to a shard and a gapless slot in it.

    Returns one row per input row: the id column, ``size`` (UTF-8 bytes plus 1; null text:
    1), ``tokens`` (pieces between single spaces), ``text_crc32``, ``shard``, ``slot``.
    Equal texts share a shard unless their group is larger than half of a shard's share.
    Slots number the rows of a shard from 0, ties (rows that repeat an id) in any order.
    Null ids are placed like others; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    utf8 = F.encode(text, "UTF-8")
    rows = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.size(F.split(text, " ")).cast("bigint").alias("tokens"), F.crc32(utf8).alias("crc"),
        F.xxhash64(text).alias("text_key"), F.xxhash64(F.col(id_col)).alias("id_key")))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    groups = rows.groupBy("text_key").agg(*sums)
    total = rows.agg(*sums).first()
    if not total["n"]:
        heavy = []
    else:                       # at most 2 * n_shards groups can pass each of the three tests
        half = [total[c] / n_shards / 2 for c in ("size", "tokens", "n")]
        over = (F.col("size") > half[0]) | (F.col("tokens") > half[1]) | (F.col("n") > half[2])
        heavy = [r[0] for r in groups.where(over & (F.col("n") > 1)).select("text_key").collect()]
    is_heavy = F.col("text_key").isin(heavy) if heavy else F.lit(False)
    cells = n_shards * CELLS_PER_SHARD
    celled = rows.withColumn("cell", F.when(is_heavy, F.xxhash64("text_key", F.pmod("id_key", F.lit(PIECES))))
                             .otherwise(F.pmod("text_key", F.lit(cells))))
    vectors = celled.groupBy("cell").agg(*sums).orderBy("cell").collect()   # cells + 6 * n_shards * PIECES rows at most
    sized = np.array([[r["size"], r["tokens"], r["n"]] for r in vectors], dtype=float).reshape(-1, 3)
    got = even_out(sized, place(sized, n_shards, weights), n_shards)
    assigned = docs.sparkSession.createDataFrame(
        [(r["cell"], int(s)) for r, s in zip(vectors, got)], "cell bigint, shard int")
    placed = celled.join(F.broadcast(assigned), "cell")

    per_shard = max(1, -(-(total["n"] or 0) // (n_shards * SLOT_ROWS)))
    numbered = placed.withColumn("part", F.pmod("id_key", F.lit(per_shard)))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (numbered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))
    within = W.partitionBy("shard", "part").orderBy("id", "crc")
    return (numbered.withColumn("at", F.row_number().over(within) - 1)
            .join(offsets, ["shard", "part"])
            .select(F.col("id").alias(id_col), "size", "tokens", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("begin") + F.col("at")).alias("slot")))
