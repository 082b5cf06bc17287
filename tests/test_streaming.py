"""Streams into ledger tables: replayed batches are skipped, late rows are dropped."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import Ledger
from tidemark.session import scratch_path
from tidemark.streaming.ingest import (_commit_batch, create_window_table, ingest, window_counts,
                                       window_totals)

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE"
B = dt.datetime(2024, 1, 1)


def test_replayed_batch_is_skipped(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("m.s", SCHEMA)
    fn = _commit_batch(led, "m.s", "s1", "main")
    batch = spark.createDataFrame([(1, B, "click", 1.0), (2, B, "view", 2.0)], SCHEMA)
    fn(batch, 0)
    fn(batch, 0)                                  # a replay after a failure
    fn(batch.where("event_id = 1"), 1)
    assert led.read("m.s").count() == 3
    assert sorted(r.commit_id for r in led.audit_log().collect() if r.commit_id.startswith("s1")) == \
        ["s1-00000000", "s1-00000001"]
    assert led.read("m.s").where("event_id = 2").count() == 1


def test_ingest_then_restart_adds_only_new_files(spark, root):
    src = scratch_path(spark, "drops")
    ckpt = scratch_path(spark, "ckpt")
    led = Ledger.open(spark, root)
    led.create_table("m.s", SCHEMA)
    spark.createDataFrame([(1, B, "click", 1.0)], SCHEMA).write.parquet(f"{src}/d1")
    ingest(spark, src, spark.createDataFrame([], SCHEMA).schema, led, "m.s", ckpt).awaitTermination()
    spark.createDataFrame([(2, B, "view", 2.0)], SCHEMA).write.parquet(f"{src}/d2")
    ingest(spark, src, spark.createDataFrame([], SCHEMA).schema, led, "m.s", ckpt).awaitTermination()
    assert sorted(r.event_id for r in led.read("m.s").collect()) == [1, 2]


def test_window_counts_keep_and_report_late_rows(spark, root):
    src, ckpt = scratch_path(spark, "drops"), scratch_path(spark, "ckpt")
    led = Ledger.open(spark, root)
    create_window_table(led, "m.h", "event_type string")
    h = dt.timedelta(hours=1)
    schema = spark.createDataFrame([], SCHEMA).schema
    files = [[(1, B, "a", 1.0), (2, B + 5 * h, "a", 2.0), (5, B, None, 4.0)],
             [(3, B + h, "a", 9.0), (4, B + 5 * h + dt.timedelta(minutes=5), "a", 3.0), (6, B, None, 7.0)]]
    for i, rows in enumerate(files):              # the second file is partly behind the first
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/f{i}")
        window_counts(spark, src, schema, led, "m.h", ckpt, "ts", ["event_type"],
                      "value", max_files_per_trigger=1).awaitTermination()
    got = {(r.window_start, r.event_type): (r.n, r.max_value, r.n_late)
           for r in window_totals(led.read("m.h"), ["event_type"]).collect()}
    assert got == {(B, "a"): (1, 1.0, 0), (B + h, "a"): (1, 9.0, 1), (B + 5 * h, "a"): (2, 3.0, 0),
                   (B, None): (2, 7.0, 1)}


def test_window_counts_read_the_table_once_a_start(spark, root, monkeypatch):
    src = scratch_path(spark, "drops")
    led = Ledger.open(spark, root)
    create_window_table(led, "m.h", "event_type string")
    h = dt.timedelta(hours=1)
    files = [[(1, B, "a", 1.0)], [], [(2, B + 9 * h, "a", 2.0)], [(3, B + 2 * h, "a", 3.0)], [(4, B + 9 * h, "b", 4.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/f{i}")
    reads = []
    plain = led.read
    monkeypatch.setattr(led, "read", lambda *a, **c: reads.append(a) or plain(*a, **c))
    window_counts(spark, src, spark.createDataFrame([], SCHEMA).schema, led, "m.h", scratch_path(spark, "ckpt"),
                  "ts", ["event_type"], "value", max_files_per_trigger=1).awaitTermination()
    assert len(reads) == 1
    got = {(r.window_start, r.event_type): (r.n, r.n_late) for r in window_totals(plain("m.h"), ["event_type"]).collect()}
    assert got == {(B, "a"): (1, 0), (B + 9 * h, "a"): (1, 0), (B + 2 * h, "a"): (1, 1), (B + 9 * h, "b"): (1, 0)}


def test_window_totals_do_not_depend_on_the_files(spark, root):
    rows = [(i, B + dt.timedelta(minutes=i * 7), "ab"[i % 2], float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = None
    for n, per in ((1, 1), (16, 3), (16, 16)):
        src = scratch_path(spark, "drops")
        df.repartition(n).write.parquet(src)
        led = Ledger.open(spark, f"{root}-{n}-{per}")
        create_window_table(led, "m.h", "event_type string")
        window_counts(spark, src, df.schema, led, "m.h", scratch_path(spark, "ckpt"), "ts", ["event_type"], "value",
                      max_files_per_trigger=per).awaitTermination()
        got = sorted(tuple(r) for r in window_totals(led.read("m.h"), ["event_type"]).drop("n_late").collect())
        want = want or got
        assert got == want and sum(r[2] for r in got) == 400


def test_commit_ids_depend_on_checkpoint():
    from tidemark.streaming.ingest import stream_tag
    assert stream_tag("w", "/a") != stream_tag("w", "/b")


def test_stream_sink_compacts_every_n_batches(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("m.s", SCHEMA)
    fn = _commit_batch(led, "m.s", "c", "main", compact_every=2)
    for i in range(5):
        fn(spark.createDataFrame([(i, B, "click", float(i))], SCHEMA), i)
    assert len(led.hist.bases) == 2
    assert sorted(r.event_id for r in led.read("m.s").collect()) == [0, 1, 2, 3, 4]
