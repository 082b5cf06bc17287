"""Compaction, snapshot expiry and table mirroring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import versioned as V
from tidemark.plans.lineage import BaseRec, ExpireRec, TableNotFound


def compact(led, table: str, ref: str | None, commit: str | None) -> BaseRec:
    """Write the table state at a commit as a base; later reads use base + tail."""
    import uuid
    cut = led.cut(ref, commit)
    for b in led.hist.bases:
        if b.table_name == table and b.commit_id == cut:
            return b                      # already compacted at this commit
    state, schema = V.table_state(led.store, led.hist, table, cut, led.broadcast_rows)
    pcols = [p[0] for p in V.partition_columns(schema)]
    # a fresh folder per base: never overwrite files a reader may be scanning
    path = f"{led.store.base_path(table, cut)}-{uuid.uuid4().hex[:8]}"
    codec = led.properties(table, commit=cut).get("compression", "snappy")
    n = led.store.write_base(path, state, pcols, codec)
    rec = BaseRec(led._next_seq(), table, cut, path, n)
    led.store.append_log("bases", [rec])
    led.hist.bases.append(rec)
    return rec


def expire(led, older_than: dt.datetime, retain_last: int, purge: bool = True) -> list[str]:
    """Expire commits older than ``older_than`` that are neither among the newest
    ``retain_last`` commits of any branch nor the head of any ref.

    Each lineage that passes through an expired commit gets a base at its newest
    expired commit, so reads at later commits still work; as-of reads at an
    expired commit raise.  Returns the expired commit ids.
    """
    hist = led.hist
    refs = hist.ref_state()
    protected = set()
    lineages = {}
    for name, (kind, head, _) in refs.items():
        if head is None:
            continue
        protected.add(head)
        lin = hist.lineage(head)
        lineages[name] = lin
        if kind == "branch":
            protected.update(lin[:retain_last])
    already = hist.expired_ids()
    idx = hist.commit_index()
    doomed = sorted({cid for cid, recs in idx.items()
                     if recs[0].ts < older_than and cid not in protected and cid not in already},
                    key=lambda c: idx[c][0].seq)
    if not doomed:
        return []
    gone = set(doomed) | already
    # fold: a base at the newest expired commit of every lineage, for each live table there
    for name, lin in lineages.items():
        newest = next((c for c in lin if c in gone), None)
        if newest is None:
            continue
        for table in hist.tables_at(newest):
            recs = hist.table_commits(table, newest)
            b = hist.base_for(table, newest, recs[0].seq)
            if b is not None and b.commit_id == newest:
                continue
            compact(led, table, None, newest)
    recs = []
    for cid in doomed:
        recs.append(ExpireRec(led._next_seq() + len(recs), cid))
    led.store.append_log("expired", recs)
    hist.expired.extend(recs)
    if purge:
        # no live cut reads an expired commit's change rows any more: every lineage
        # through one now starts from a base at or after it
        for cid in doomed:
            for r in idx[cid]:
                led.store.delete_changes(r.table_name, cid)
    return doomed


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive (row count, hash sum) of a DataFrame; one partial aggregate."""
    # xxhash64 skips NULLs, so the positions of NULLs are hashed as well
    h = F.xxhash64(*[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"))


def mirror(led, table: str, dest: str, ref: str | None = "main", commit: str | None = None,
           ts=None) -> DataFrame:
    """Copy a table version to ``dest`` as Parquet and verify the copy.

    Returns one row: source_rows, copy_rows, equal (same count and content hash).
    """
    src = led.read(table, ref=ref, commit=commit, ts=ts)
    src.write.mode("overwrite").parquet(dest)
    copy = led.spark.read.schema(src.schema).parquet(dest)
    fc = content_fingerprint(copy)
    copy_n = fc.select("n").scalar()          # single-row scalar subqueries, no join
    copy_h = fc.select("h").scalar()
    a = content_fingerprint(src)
    return a.select(F.col("n").alias("source_rows"), copy_n.alias("copy_rows"),
                    ((F.col("n") == copy_n) & F.col("h").eqNullSafe(copy_h)).alias("equal"))
