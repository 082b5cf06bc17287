"""Approximate nearest neighbours on randomly rotated one-bit codes.

Every vector is centred, scaled to unit length and rotated; the signs of the result are its
code, packed to bits.  With two scalars (its length, and the inner product of the unit vector
with its code) the inner product with any query can be estimated without bias, and the error
is bounded with a probability set by EPSILON.  A candidate is read in full only if its upper
bound reaches the K-th best lower bound; those are ranked by the exact inner product.

Candidates and queries lie in blocks of fixed size; every pair of blocks is one row of work,
so memory does not grow with either table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, ship

K = 20
EPSILON = 4.0                 # half-width of the error bound, in deviations
BLOCK_ROWS, QUERY_ROWS = 4096, 512


def rotation(dim: int, seed: int = 1234) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, residual lengths, inner products of unit residuals with their codes)."""
    residual = vectors - centre
    length = np.linalg.norm(residual, axis=1)
    unit = (residual / np.where(length > 0, length, 1)[:, None]) @ rot
    bits = unit >= 0
    signs = np.where(bits, 1.0, -1.0) / math.sqrt(vectors.shape[1])
    fit = np.einsum("ij,ij->i", unit, signs)
    return np.packbits(bits, axis=1), length, np.where(length > 0, np.maximum(fit, 1e-9), 1.0)


def estimate(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray,
             centre: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of all inner products, one row for each query."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    rotated = queries @ rot
    raw = (rotated.astype(np.float32) @ signs.T).astype(np.float64) / math.sqrt(dim)
    est = (queries @ centre)[:, None] + raw * (length / fit)[None, :]
    spread = np.sqrt(np.maximum(1 - fit ** 2, 0)) / fit / math.sqrt(max(dim - 1, 1)) * length
    size = np.linalg.norm(queries, axis=1)
    return est, EPSILON * size[:, None] * spread[None, :] + 1e-5 * size[:, None] * (length + 1)[None, :]


def search_block(query_rows, query_ids, queries, rows, ids, vectors, codes, length, fit, centre, rot, k):
    """The k best of one block for each query row: arrays of query row, query id, vector id, row and exact score."""
    est, err = estimate(queries, codes, length, fit, centre, rot)
    found = [[] for _ in range(5)]
    for i in range(len(queries)):
        other = rows != query_rows[i]
        low = np.where(other, est[i] - err[i], -np.inf)
        n = int(other.sum())
        bar = np.partition(low, -k)[-k] if n > k else -np.inf
        near = np.flatnonzero(other & (est[i] + err[i] >= bar))
        exact = vectors[near] @ queries[i]
        best = np.lexsort((rows[near], ids[near], -exact))[:k]
        for out, x in zip(found, (np.full(len(best), query_rows[i]), np.full(len(best), query_ids[i]),
                                  ids[near[best]], rows[near[best]], exact[best])):
            out.append(x)
    kinds = (np.int64,) * 4 + (np.float64,)
    return [np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in zip(found, kinds)]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, v) of the rows whose vector has no null, NaN or infinity and is not all zero."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
                          v.alias("v"), finite.alias("f"), some.alias("s"))
    return rows.where("id is not null and v is not null and f and s").select("row", "id", "v")


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every query row by inner product, the row itself excluded.

    ``is_query`` is a condition on the column ``id``.  Returns ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score`` (exact inner product in double precision), ties to the smaller id.
    Vectors that are null, all zero or hold null or non-finite components, and null ids,
    take no part.  Every other row counts: rows that repeat an id are queries and candidates of
    their own, and vectors of each length are searched among their own kind.  Fewer
    candidates than ``k`` give fewer rows; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(usable(vectors, id_col, vec_col).withColumn("dim", F.size("v")))
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    schema = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score double"
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    main, total = dims[0]["dim"], dims[0]["n"]
    mean = (rows.where(F.col("dim") == main).select(F.posexplode("v").alias("p", "x")).groupBy("p")
            .agg(F.avg("x").alias("m")).collect())
    centre = np.zeros(main)
    for r in mean:
        centre[r["p"]] = r["m"]
    made: dict = {}

    def frame(dim: int):
        """Centre and rotation for vectors of a length; the commonest has its mean, others the origin."""
        if dim not in made:
            made.clear()
            made[dim] = (centre if dim == main else np.zeros(dim)), rotation(dim)
        return made[dim]

    n_blocks = max(1, math.ceil(total / BLOCK_ROWS))
    n_queries = rows.where(is_query).count()
    q_blocks = max(1, math.ceil(n_queries / QUERY_ROWS))

    def index(table: pa.Table) -> pa.Table:
        dim, v = table.column("dim")[0].as_py(), np.stack(table.column("v").to_numpy()).astype(np.float64)
        codes, length, fit = encode(v, *frame(dim))
        out = {"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1)}
        for name, x in (("rows", table.column("row").to_numpy()), ("ids", table.column("id").to_numpy()),
                        ("codes", codes), ("length", length), ("fit", fit), ("vectors", v)):
            out[name] = pa.array([x.tobytes()], pa.binary())
        return pa.table(out)

    def gather(table: pa.Table) -> pa.Table:
        v = np.stack(table.column("v").to_numpy()).astype(np.float64)
        return pa.table({"dim": table.column("dim").slice(0, 1),
                         "query_rows": pa.array([table.column("row").to_numpy().tobytes()], pa.binary()),
                         "query_ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()),
                         "queries": pa.array([v.tobytes()], pa.binary())})

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                as_ints = lambda c: np.frombuffer(r[c], dtype=np.int64)
                as_floats = lambda c: np.frombuffer(r[c], dtype=np.float64)
                got = search_block(
                    as_ints("query_rows"), as_ints("query_ids"), as_floats("queries").reshape(-1, dim), as_ints("rows"),
                    as_ints("ids"), as_floats("vectors").reshape(-1, dim),
                    np.frombuffer(r["codes"], dtype=np.uint8).reshape(len(as_ints("ids")), -1), as_floats("length"),
                    as_floats("fit"), *frame(dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got],
                                                 names=["query_row", "query_id", "vec_id", "row", "score"])

    # blocks of the commonest length have BLOCK_ROWS rows, those of the others fewer
    blocks = (rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).groupBy("dim", "block")
              .applyInArrow(index, "dim int, block int, rows binary, ids binary, codes binary, length binary, fit binary, "
                                   "vectors binary"))
    asked = (rows.where(is_query).withColumn("q", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(q_blocks))).groupBy("dim", "q")
             .applyInArrow(gather, "dim int, query_rows binary, query_ids binary, queries binary")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    found = asked.join(blocks, ["dim", "block"]).mapInArrow(search, schema)
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
