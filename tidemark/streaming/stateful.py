"""Streaming queries that keep state between batches.

``watermarked_windows`` holds open windows in Spark's state store and emits each one once, when
the watermark has passed it.  ``track_series`` holds the last sample of every series in a
versioned table and carries it into the next batch.  Both publish a batch as one commit whose id
is derived from the checkpoint and the batch, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ordered as O
from tidemark.functions.labels import columns_key
from tidemark.ledger import Ledger
from tidemark.streaming.ingest import _commit_batch, stream_tag


def _start(writer, checkpoint: str, available_now: bool):
    w = writer.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def _files(spark: SparkSession, src: str, schema: T.StructType, max_files: int) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", "true").parquet(src))


# ---------------------------------------------------------------------------
# Windows that close behind a watermark
# ---------------------------------------------------------------------------
def _windowed(rows: DataFrame, ts: str, series: list[str], value: str, window: str) -> DataFrame:
    return (rows.groupBy(F.window(ts, window).alias("window"), *series)
            .agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value")))


def _flat(windows: DataFrame, series: list[str]) -> DataFrame:
    return windows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *series, "n", "max_value")


def watermarked_windows(spark: SparkSession, src: str, schema: T.StructType, led: Ledger, table: str,
                        checkpoint: str, ts: str, series: list[str], value: str, window: str = "1 hour",
                        delay: str = "1 hour", stream: str = "closed", ref: str = "main",
                        max_files_per_trigger: int = 5, available_now: bool = True, compact_every: int = 0):
    """Tumbling count and maximum per series, appended to ``table`` when a window is over.

    A window is over when a batch before has brought a time ``delay`` past its end.  State
    holds open windows only, whatever the length of the stream.  Rows that come after their
    window was emitted are left out of it, as they would reopen it; ``late_rows`` counts them.
    The first batch creates the table.
    """
    if table not in led.tables(ref=ref):
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        columns = ", ".join(f"`{c}` {kinds[c]}" for c in series)
        led.create_table(table, f"window_start timestamp_ntz, {columns}, n bigint, max_value {kinds[value]}", ref=ref)
    rows = _files(spark, src, schema, max_files_per_trigger).withColumn(ts, F.col(ts).cast("timestamp"))
    closed = _flat(_windowed(rows.withWatermark(ts, delay), ts, series, value, window), series)
    commit = _commit_batch(led, table, stream_tag(stream, checkpoint), ref, compact_every)

    def publish(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()               # the batch is counted and written: its state is updated once
        try:
            commit(held, batch_id)
        finally:
            held.unpersist()

    return _start(closed.writeStream.outputMode("append").foreachBatch(publish), checkpoint, available_now)


def open_windows(spark: SparkSession, checkpoint: str, series: list[str]) -> DataFrame:
    """Windows still in the state store of a ``watermarked_windows`` query, as they stand after its last batch."""
    state = spark.read.format("statestore").load(checkpoint)
    key, held = state.schema["key"].dataType.names, state.schema["value"].dataType.names
    return state.select(F.col(f"key.`{key[0]}`.start").cast("timestamp_ntz").alias("window_start"),
                        *[F.col(f"key.`{k}`").alias(c) for k, c in zip(key[1:], series)],
                        F.col(f"value.`{held[0]}`").alias("n"), F.col(f"value.`{held[1]}`").alias("max_value"))


def consumed_rows(spark: SparkSession, src: str, schema: T.StructType, checkpoint: str) -> DataFrame:
    """The rows of all files a file-drop query has taken so far, by the log of its source."""
    log = spark.read.text(f"{checkpoint}/sources/0").where("value like '{%'")
    taken = log.select(F.regexp_replace(F.get_json_object("value", "$.path"), "^file:/+", "file:/").alias("_path")).distinct()
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    return rows.withColumn("_path", path).join(taken, "_path", "left_semi").drop("_path")


def late_rows(spark: SparkSession, src: str, schema: T.StructType, led: Ledger, table: str, checkpoint: str,
              ts: str, series: list[str], value: str, window: str = "1 hour", ref: str = "main") -> DataFrame:
    """(window_start, series, n_late): rows taken in that neither an emitted nor an open window holds.

    One pass over the consumed files with partial counts; run it as an audit, not for every batch.
    """
    rows = consumed_rows(spark, src, schema, checkpoint).withColumn(ts, F.col(ts).cast("timestamp"))
    taken = _flat(_windowed(rows, ts, series, value, window), series)
    held = led.read(table, ref=ref).drop("_row_id").unionByName(open_windows(spark, checkpoint, series))
    both = (taken.select("window_start", *series, "n")
            .unionByName(held.select("window_start", *series, (-F.col("n")).alias("n"))))
    return both.groupBy("window_start", *series).agg(F.sum("n").alias("n_late")).where("n_late <> 0")


# ---------------------------------------------------------------------------
# The last sample of every series, carried from batch to batch
# ---------------------------------------------------------------------------
def series_tables(table: str) -> dict[str, str]:
    return {"last": f"{table}_last", "increase": f"{table}_increase", "late": f"{table}_late"}


def track_series(spark: SparkSession, src: str, schema: T.StructType, led: Ledger, table: str, checkpoint: str,
                 ts: str, series: list[str], value: str, tiebreak: str, step: str = "1 day", stream: str = "series",
                 ref: str = "main", max_files_per_trigger: int = 5, available_now: bool = True,
                 compact_every: int = 0, bucket_us: int = 3600 * O.US, transform=None):
    """Latest sample of every series and reset-aware increase per step, kept while files arrive.

    One commit a batch changes three tables: ``<table>_last`` (one row a series, by MERGE),
    ``<table>_increase`` (partial sums per series and step; ``increase_totals`` folds them) and
    ``<table>_late``: samples not newer than the series' last one, whole and in no sum, as
    an increase depends on the order.  The carried samples of the batch's series join the batch as
    the samples before it, so the sums equal those of ``counter_increase`` over all rows at once.
    ``transform`` is applied to the streamed rows first; NULL labels are labels that are absent.
    """
    names = series_tables(table)
    rows = _files(spark, src, schema, max_files_per_trigger)
    rows = transform(rows) if transform else rows
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    labels = ", ".join(f"`{c}` {kinds[c]}" for c in series)
    if names["last"] not in led.tables(ref=ref):
        with led.transaction(ref) as tx:
            tx.create_table(names["last"], f"series_key string, {labels}, last_ts {kinds[ts]}, "
                                           f"last_tie {kinds[tiebreak]}, last_value {kinds[value]}", keys=["series_key"])
            tx.create_table(names["increase"], f"{labels}, step_start timestamp, increase double")
            tx.create_table(names["late"], rows.schema)
    tag = stream_tag(stream, checkpoint)
    made = {"last_ts": ts, "last_tie": tiebreak, "last_value": value}

    def publish(batch: DataFrame, batch_id: int) -> None:
        cid = f"{tag}-{batch_id:08d}"
        if cid in led.hist.commit_index():
            return
        held = batch.withColumn("series_key", columns_key(series)).persist()
        try:
            last = led.read(names["last"], ref=ref)
            here = held.select("series_key").distinct()
            carried = last.join(here, "series_key", "left_semi")
            seen = held.join(carried.select("series_key", "last_ts", "last_tie"), "series_key", "left")
            late = (F.col(value).isNotNull() & F.col("last_ts").isNotNull()
                    & (F.struct(ts, tiebreak) <= F.struct(F.col("last_ts").alias(ts), F.col("last_tie").alias(tiebreak))))
            seen = seen.withColumn("_late", late).drop("last_ts", "last_tie")
            fresh = seen.where("not _late").drop("_late")
            before = carried.select("series_key", *series, *[F.col(a).alias(b) for a, b in made.items()],
                                    F.lit(True).alias("_carried"))
            samples = (fresh.select("series_key", *series, ts, tiebreak, value, F.lit(False).alias("_carried"))
                       .unionByName(before))
            inc = O.reset_aware_increase(samples, ["series_key"], ts, value, tiebreak, bucket_us).where("not _carried")
            sums = (inc.groupBy("series_key", *series, F.window(ts, step).start.alias("step_start"))
                    .agg(F.sum("inc").alias("increase")).drop("series_key"))
            order = O.newest(fresh, ts, tiebreak)
            newest = (fresh.where(F.col(value).isNotNull()).groupBy("series_key", *series)
                      .agg(*[F.max_by(F.col(b), order).alias(a) for a, b in made.items()]))
            with led.transaction(ref, commit_id=cid, message=f"stream {stream} batch {batch_id}") as tx:
                tx.merge(names["last"], newest, on="series_key",
                         update_set={a: f"source.{a}" for a in made})
                tx.append(names["increase"], sums)
                tx.append(names["late"], seen.where("_late").select(*rows.columns))
        finally:
            held.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            led.compact(names["last"], ref=ref)

    return _start(rows.writeStream.foreachBatch(publish), checkpoint, available_now)


def increase_totals(partials: DataFrame, series: list[str]) -> DataFrame:
    """One row per series and step from the partial sums of ``track_series``."""
    return partials.groupBy(*series, "step_start").agg(F.sum("increase").alias("increase"))
