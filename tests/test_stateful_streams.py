import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.functions.labels import columns_key, series_key
from tidemark.ledger import Ledger
from tidemark.operators import metrics as MX
from tidemark.session import scratch_path
from tidemark.streaming import stateful as S

SCHEMA = "event_id bigint, ts timestamp_ntz, event_type string, value double"
T0 = dt.datetime(2024, 1, 1)


def samples(n, seed=1, days=3):
    rng = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(minutes=rng.randrange(days * 1440)), rng.choice(["a", "b", "c", None]),
             None if rng.random() < 0.1 else float(rng.randrange(50))) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[0]))


def drop(spark, src, rows, name, at):
    """One file of rows with a modification time of its own, as the source reads files in that order."""
    folder = src.removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    kinds = [("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("event_type", pa.string()), ("value", pa.float64())]
    pq.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], pa.schema(kinds)),
                   f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (at, at))


def hours(rows):
    out = {}
    for _, ts, kind, value in rows:
        k = (ts.replace(minute=0), kind)
        n, best = out.get(k, (0, None))
        out[k] = (n + 1, best if value is None else value if best is None else max(best, value))
    return out


def flat(df):
    return {(r.window_start, r.event_type): (r.n, r.max_value) for r in df.collect()}


@pytest.mark.parametrize("files_a_day,at_once", [(1, 1), (16, 5), (64, 40)])
def test_windows_equal_batch_however_files_fall(spark, files_a_day, at_once):
    rows, src = samples(600), scratch_path(spark, "wm-src")
    rng, made = random.Random(files_a_day), 0
    for day in range(3):
        mine = [r for r in rows if (r[1] - T0).days == day]
        rng.shuffle(mine)                                  # any order within the day: the delay covers it
        for k in range(files_a_day):
            part = mine[k::files_a_day]
            if part:
                made += 1
                drop(spark, src, part, f"f{made:04d}", 1_700_000_000 + made)
    led, ckpt = Ledger.open(spark, scratch_path(spark, "wm-led")), scratch_path(spark, "wm-ckpt")
    schema = spark.createDataFrame([], SCHEMA).schema
    S.watermarked_windows(spark, src, schema, led, "m.closed", ckpt, "ts", ["event_type"], "value", delay="1 day",
                          max_files_per_trigger=at_once).awaitTermination()
    closed = led.read("m.closed").drop("_row_id")
    assert closed.count() > 0
    assert flat(closed.unionByName(S.open_windows(spark, ckpt, ["event_type"]))) == hours(rows)
    assert S.late_rows(spark, src, schema, led, "m.closed", ckpt, "ts", ["event_type"], "value").count() == 0


def test_late_rows_are_counted_aside(spark):
    rows, src = samples(300), scratch_path(spark, "late-src")
    late = [(9000 + i, T0 + dt.timedelta(minutes=5), "a", 99.0) for i in range(4)]
    for k, part in enumerate([rows[:150], rows[150:], late, [(9999, T0 + dt.timedelta(days=4), "a", 1.0)]]):
        drop(spark, src, part, f"f{k}", 1_700_000_000 + k)
    led, ckpt = Ledger.open(spark, scratch_path(spark, "late-led")), scratch_path(spark, "late-ckpt")
    schema = spark.createDataFrame([], SCHEMA).schema
    args = (src, schema, led, "m.closed", ckpt, "ts", ["event_type"], "value")
    S.watermarked_windows(spark, *args, delay="1 hour", max_files_per_trigger=1).awaitTermination()
    held = led.read("m.closed").drop("_row_id").unionByName(S.open_windows(spark, ckpt, ["event_type"]))
    assert flat(held) == hours(rows + [(9999, T0 + dt.timedelta(days=4), "a", 1.0)])
    assert [tuple(r) for r in S.late_rows(spark, *args).collect()] == [(T0, "a", 4)]


def _forget_last_batch(ckpt):
    """What a driver leaves that died after the commit of a batch and before its checkpoint entry."""
    ckpt = ckpt.removeprefix("file:")
    last = max(int(f) for f in os.listdir(f"{ckpt}/commits") if f.isdigit())
    for name in (f"{ckpt}/commits/{last}", f"{ckpt}/commits/.{last}.crc"):
        if os.path.exists(name):
            os.remove(name)


def test_tracked_series_equal_batch_under_replay(spark):
    rows, src = samples(400), scratch_path(spark, "tr-src")
    for k in range(4):
        drop(spark, src, rows[k * 80:(k + 1) * 80], f"f{k}", 1_700_000_000 + k)
    led, ckpt = Ledger.open(spark, scratch_path(spark, "tr-led")), scratch_path(spark, "tr-ckpt")
    schema = spark.createDataFrame([], SCHEMA).schema
    go = lambda: S.track_series(spark, src, schema, led, "m.s", ckpt, "ts", ["event_type"], "value", "event_id",
                                step="6 hours", max_files_per_trigger=1).awaitTermination()
    go()
    commits = len(led.hist.commit_index())
    _forget_last_batch(ckpt)
    go()                                                   # the batch is replayed and changes nothing
    assert len(led.hist.commit_index()) == commits
    drop(spark, src, rows[320:], "f9", 1_700_000_009)
    late = [(7000, T0, "a", 5.0), (7001, T0, None, 6.0), (7002, T0, "a", None)]
    drop(spark, src, late, "f99", 1_700_000_099)
    go()
    whole = spark.createDataFrame(rows + late[2:], SCHEMA)
    want = {(r.event_type, r.step_start): round(r.increase, 6) for r in
            MX.counter_increase(whole, ["event_type"], "ts", "value", "event_id", step="6 hours").collect()}
    got = {(r.event_type, r.step_start): round(r.increase, 6) for r in
           S.increase_totals(led.read("m.s_increase"), ["event_type"]).collect()}
    assert got == want
    want = {tuple(r) for r in MX.latest_sample(whole, ["event_type"], "ts", "value", "event_id").collect()}
    assert {(r.event_type, r.last_ts, r.last_value) for r in led.read("m.s_last").collect()} == want
    assert sorted(r.event_id for r in led.read("m.s_late").collect()) == [7000, 7001]


def test_label_sets_are_keys_whatever_their_order(spark):
    df = spark.sql("SELECT map('b', '1', 'a', 'x\"y') AS m UNION ALL SELECT map('a', 'x\"y', 'c', NULL, 'b', '1') "
                   "UNION ALL SELECT map() UNION ALL SELECT NULL")
    keys = [r[0] for r in df.select(series_key("m")).collect()]
    assert keys[0] == keys[1] == '{"a":"x\\"y","b":"1"}' and keys[2:] == ["{}", None]
    two = spark.sql("SELECT 1 AS z, NULL AS y")
    assert two.select(columns_key(["z", "y"])).first()[0] == two.select(columns_key(["y", "z"])).first()[0] == '{"z":"1"}'
