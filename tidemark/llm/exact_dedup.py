"""Exact duplicates through a cuckoo-filter index of live digests.

The index is a table of live digests, dealt into buckets by the digest.  A bucket holds the
digests themselves with their row counts and largest id; the cuckoo filter over a bucket
answers most lookups of unknown digests without touching the stored keys.  A hit is verified
against the bucket's content, so a false positive never merges two texts.  When an insertion
finds no room, the filter is rebuilt at twice the size from the stored keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, text_or_empty

SLOTS, MAX_KICKS = 4, 200
FOLD_ROWS = 65_536             # rows a task counts before it sends their texts on
BUCKET_ROWS = 10_000           # digests in a bucket, on average


class CuckooFilter:
    """Fingerprints of 16 bits in two candidate cells of four slots; supports deletion.

    Keys are 16-byte digests or longer.  ``keys`` is the content that hits are verified
    against and that a resize reinserts.
    """

    def __init__(self, capacity: int = 64):
        self.keys: dict[bytes, list[int]] = {}
        self.resizes = 0
        self._alloc(max(8, 1 << (max(capacity, 1) * 5 // (SLOTS * 4)).bit_length()))

    def _alloc(self, cells: int) -> None:
        self.cells = cells
        self.table = np.zeros((cells, SLOTS), dtype=np.uint16).tolist()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[:2], "little") or 1
        a = int.from_bytes(key[2:10], "little") & (self.cells - 1)
        return fp, a, self._other(a, fp)

    def _other(self, cell: int, fp: int) -> int:
        return (cell ^ (fp * 0x5BD1E995)) & (self.cells - 1)

    def maybe(self, key: bytes) -> bool:
        fp, a, b = self._places(key)
        return fp in self.table[a] or fp in self.table[b]

    def get(self, key: bytes) -> list[int] | None:
        """The live record of ``key``: the filter first, then the stored content."""
        return self.keys.get(key) if self.maybe(key) else None

    def _place(self, key: bytes) -> bool:
        fp, a, b = self._places(key)
        for c in (a, b):
            if 0 in self.table[c]:
                self.table[c][self.table[c].index(0)] = fp
                return True
        c = b
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            fp, self.table[c][slot] = self.table[c][slot], fp
            c = self._other(c, fp)
            if 0 in self.table[c]:
                self.table[c][self.table[c].index(0)] = fp
                return True
        return False

    def insert(self, key: bytes, record: list[int]) -> None:
        self.keys[key] = record
        if not self._place(key):
            self._resize()

    def _resize(self) -> None:
        """Twice the cells, filled from the stored keys; repeated until every key has room."""
        while True:
            self.resizes += 1
            self._alloc(self.cells * 2)
            if all(self._place(k) for k in self.keys):
                return

    def delete(self, key: bytes) -> None:
        del self.keys[key]
        fp, a, b = self._places(key)
        c = a if fp in self.table[a] else b
        self.table[c][self.table[c].index(fp)] = 0


INDEX_SCHEMA = "bucket bigint, digest binary, n bigint, max_id bigint"


def digest_of(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes as binary."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def bucket_count(n_digests: int) -> int:
    return max(1, -(-n_digests // BUCKET_ROWS))


def _bucket(digest: str, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(n_buckets))


def update_index(index: DataFrame, changes: DataFrame, n_buckets: int) -> DataFrame:
    """Apply per-digest changes to an index and return the new index.

    ``changes``: digest binary, n (rows added, or less than 0 for rows deleted), max_id (largest
    id among the rows added, null for deletions).  A digest whose count falls to 0 is deleted
    from the filter and the table.  After a deletion ``max_id`` stays the largest id ever
    added: recompute it from the rows where the largest row itself may have gone.
    Deleting an unknown digest has no effect.
    """
    def apply(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        bucket = CuckooFilter(len(old) + len(new))
        for row in old.to_pylist():
            bucket.insert(row["digest"], [row["n"], row["max_id"]])
        for row in new.to_pylist():
            d, n, m = row["digest"], row["n"], row["max_id"]
            found = bucket.get(d)
            if found is None:
                if n > 0:
                    bucket.insert(d, [n, m])
                continue
            found[0] += n
            if m is not None and (found[1] is None or m > found[1]):
                found[1] = m
            if found[0] <= 0:
                bucket.delete(d)
        return pa.table([pa.array([key[0].as_py()] * len(bucket.keys), pa.int64()),
                         pa.array(bucket.keys, pa.binary()), pa.array([r[0] for r in bucket.keys.values()], pa.int64()),
                         pa.array([r[1] for r in bucket.keys.values()], pa.int64())],
                        names=["bucket", "digest", "n", "max_id"])

    keyed = changes.select(_bucket("digest", n_buckets).alias("bucket"), "digest", "n", "max_id")
    return index.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInArrow(apply, INDEX_SCHEMA)


def _partials(rows: DataFrame) -> DataFrame:
    """(digest, n, max_id) of many rows at a time: what a task knows of a text before the shuffle."""
    def fold(held: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(held).group_by("digest").aggregate([("n", "sum"), ("max_id", "max")])
        return pa.table({"digest": got.column("digest"), "n": got.column("n_sum"), "max_id": got.column("max_id_max")})

    def count(batches):
        held, size = [], 0
        for b in batches:
            ones = pa.array(np.ones(b.num_rows, dtype=np.int64))
            held.append(pa.table({"digest": b.column("digest"), "n": ones, "max_id": b.column("_id")}))
            size += b.num_rows
            if size >= FOLD_ROWS:
                held = [fold(held)]
                size = len(held[0])
                if size > FOLD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from fold(held).to_batches()
    return rows.mapInArrow(count, "digest binary, n bigint, max_id bigint")


def empty_index(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], INDEX_SCHEMA)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group of equal texts.

    Returns one row per input row: the id column, ``digest`` (hex SHA-256 of the whole text, null
    as empty), ``keep_id`` (largest id of the group), ``group_size`` (rows), ``copies`` (rows
    of this id and text) and ``kept``.  Rows that repeat both id and text are each returned
    and each marked kept where their id is the largest; ``drop_copies`` leaves one of them.
    A null id never wins over another; a group of null ids only has a null ``keep_id`` and
    keeps its rows' marks by that null.  Rows are counted in batches before the shuffle, so a
    group holding a third of all rows reaches its bucket as one row per ``FOLD_ROWS`` rows
    or fewer; there the filter finds the text again and adds to the verified entry.
    """
    ship(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).cast("bigint").alias("_id"),
                           digest_of(text_or_empty(text_col)).alias("digest")))
    n_buckets = bucket_count(rows.count())
    index = update_index(empty_index(docs), _partials(rows), n_buckets)
    kept = F.col("_id").eqNullSafe(F.col("max_id"))
    return (rows.join(index, "digest")
            .select(F.col("_id").alias(id_col), F.lower(F.hex("digest")).alias("digest"),
                    F.col("max_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts one row, the one with the largest id.

    All columns are returned unchanged.  Rows that repeat id and text count as one document.
    """
    mark = "_digest"
    while mark in docs.columns:
        mark = "_" + mark
    groups = exact_groups(docs, id_col, text_col).where("kept")
    winners = groups.groupBy(F.unhex("digest").alias(mark), F.col("keep_id").alias(f"{mark}_id")).agg(
        F.count(F.lit(1)).alias(f"{mark}_n"))
    winners = cut(winners)
    marked = docs.withColumn(mark, digest_of(text_or_empty(text_col)))
    out = marked.join(winners, (marked[mark] == winners[mark])
                      & marked[id_col].cast("bigint").eqNullSafe(winners[f"{mark}_id"]), "left_semi")
    if winners.where(F.col(f"{mark}_n") > 1).limit(1).count():
        out = out.dropDuplicates([id_col, mark])
    return out.select(*[docs.columns[i] for i in range(len(docs.columns))])
