"""File-drop streams into ledger tables.

Each micro-batch becomes one ledger commit whose id is derived from the stream
name and batch id; a replayed batch (after a driver or executor loss) finds its
commit already published and is skipped, so the sink is exactly-once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.ledger import Ledger


def drop_files_by_day(df: DataFrame, ts: str, dest: str) -> list[str]:
    """Write ``df`` as one folder of Parquet files per day, oldest day first, so the
    files arrive in time order the way a collector would drop them."""
    days = [r[0] for r in df.select(F.to_date(F.col(ts)).alias("d")).distinct().orderBy("d").collect()]
    typ = df.schema[ts].dataType.simpleString()
    out = []
    for d in days:    # one job per day: only the list of days reaches the driver
        lo = dt.datetime.combine(d, dt.time())
        hi = lo + dt.timedelta(days=1)
        # a range on the raw column is pushed into the scan, so row-group statistics
        # skip the other days and all days together read the data about once
        day_rows = df.where((F.col(ts) >= F.lit(lo).cast(typ)) & (F.col(ts) < F.lit(hi).cast(typ)))
        p = f"{dest}/day={d.isoformat()}"
        day_rows.write.mode("overwrite").parquet(p)
        out.append(p)
    return out


def stream_tag(stream: str, checkpoint: str) -> str:
    """Commit-id prefix of a stream: batch ids restart with a new checkpoint, so
    the checkpoint location is part of the identity."""
    import hashlib
    return f"{stream}-{hashlib.sha1(checkpoint.encode()).hexdigest()[:8]}"


def _commit_batch(led: Ledger, table: str, stream: str, ref: str, compact_every: int = 0):
    def fn(batch: DataFrame, batch_id: int) -> None:
        cid = f"{stream}-{batch_id:08d}"
        if cid in led.hist.commit_index():
            # replayed batch, already published: run it to completion without
            # writing so stateful operators still commit their state
            batch.write.format("noop").mode("overwrite").save()
            return
        led.append(table, batch, ref=ref, commit_id=cid, check_keys=False,
                   message=f"stream {stream} batch {batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            # many small batch commits -> one base; reads then list few partitions
            led.compact(table, ref=ref)
    return fn


def ingest(spark: SparkSession, src: str, schema: T.StructType, led: Ledger, table: str,
           checkpoint: str, stream: str = "ingest", ref: str = "main",
           max_files_per_trigger: int = 5, available_now: bool = True, compact_every: int = 0):
    """Continuous sample ingest: new files under ``src`` -> appends to ``table``."""
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
         .option("recursiveFileLookup", "true").parquet(src))
    w = (s.writeStream.foreachBatch(_commit_batch(led, table, stream_tag(stream, checkpoint), ref,
                                                  compact_every))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="15 seconds")
    return w.start()


WINDOW_COLUMNS = "n bigint, max_value double, n_late bigint, last_ts timestamp_ntz"


def create_window_table(led: Ledger, table: str, series: str, ref: str = "main") -> None:
    """Table for ``window_counts``; ``series`` declares the series columns, as in SQL."""
    led.create_table(table, f"window_start timestamp_ntz, {series}, {WINDOW_COLUMNS}", ref=ref)


def window_counts(spark: SparkSession, src: str, schema: T.StructType, led: Ledger, table: str,
                  checkpoint: str, ts: str, series: list[str], value: str,
                  window: str = "1 hour", delay: str = "1 hour", stream: str = "window",
                  ref: str = "main", max_files_per_trigger: int = 5, available_now: bool = True,
                  compact_every: int = 0):
    """Tumbling-window count and max per series, kept as partial aggregates.

    Each micro-batch adds its own partial rows, one per window and series; ``window_totals``
    folds them.  Counts add up and maxima combine, so the totals do not depend on how files
    fall into batches, no state is held between batches and no row is ever dropped.  Rows
    more than ``delay`` behind the newest time of the stream's batches before theirs are counted
    and also reported as ``n_late``.  The table is read for that time when the stream starts;
    after it, each batch reads its own commit only.
    """
    import pandas as pd
    width = pd.Timedelta(window).value // 1000
    slack = dt.timedelta(microseconds=pd.Timedelta(delay).value // 1000)
    tag = stream_tag(stream, checkpoint)
    newest: dict[str, dt.datetime | None] = {}    # read whole once a start, then batch by batch

    def fn(batch: DataFrame, batch_id: int) -> None:
        if "ts" not in newest:
            newest["ts"] = led.read(table, ref=ref).agg(F.max("last_ts")).first()[0]
        seen = newest["ts"]
        late = F.col(ts).cast("timestamp_ntz") < F.lit(seen - slack) if seen is not None else F.lit(False)
        start = F.timestamp_micros(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(width)) * F.lit(width))
        part = (batch.groupBy(start.cast("timestamp_ntz").alias("window_start"), *series)
                .agg(F.count(F.lit(1)).alias("n"), F.max(F.col(value)).alias("max_value"),
                     F.sum(F.when(late, 1).otherwise(0)).cast("bigint").alias("n_late"),
                     F.max(F.col(ts).cast("timestamp_ntz")).alias("last_ts")))
        _commit_batch(led, table, tag, ref, compact_every)(part, batch_id)
        own = led.changes(table, f"{tag}-{batch_id:08d}").agg(F.max("last_ts")).first()[0]
        newest["ts"] = max((t for t in (seen, own) if t is not None), default=None)

    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
         .option("recursiveFileLookup", "true").parquet(src))
    w = s.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def window_totals(partials: DataFrame, series: list[str]) -> DataFrame:
    """One row per window and series from the partial rows of ``window_counts``."""
    return partials.groupBy("window_start", *series).agg(
        F.sum("n").alias("n"), F.max("max_value").alias("max_value"), F.sum("n_late").alias("n_late"))
