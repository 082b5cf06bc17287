"""Plan shapes the library relies on at scale (checked on the physical plan text)."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import Ledger
from tidemark.functions import ordered as O
from tidemark.operators import versioned as V

T = dt.datetime
SCHEMA = "k BIGINT, v STRING, amount DOUBLE"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def small_ledger(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("t.x", SCHEMA, keys=["k"])
    led.append("t.x", spark.range(0, 200).select(F.col("id").alias("k"), F.lit("a").alias("v"),
                                                 F.col("id").cast("double").alias("amount")))
    return led


def test_append_only_read_has_no_shuffle(spark, root):
    led = small_ledger(spark, root)
    p = plan(led.read("t.x"))
    assert "Exchange" not in p


def test_key_filter_reaches_the_scan_below_the_window(spark, root):
    led = small_ledger(spark, root)
    led.update("t.x", {"v": "'b'"}, where="k < 10")
    df = led.read("t.x").where(F.col("k").isin(3, 150))
    p = plan(df)
    assert "PushedFilters: [In(f1" in p or "PushedFilters: [IsNotNull(f1), In(f1" in p
    assert "WindowGroupLimit" in p               # partial top-1 before the shuffle
    assert sorted(r.k for r in df.collect()) == [3, 150]


def test_small_merge_restricts_target_before_window(spark, root):
    led = small_ledger(spark, root)
    led.update("t.x", {"v": "'b'"}, where="k < 10")
    src = spark.createDataFrame([(5, "m", 1.0), (500, "n", 2.0)], SCHEMA)
    tx = led.transaction("main")
    target, _ = tx._current("t.x", only_keys=src.select("k"))
    p = plan(target)
    assert p.count("LeftSemi") >= 2            # stable part and changed part both restricted
    assert "BroadcastHashJoin" in p
    led.merge("t.x", src, on=["k"], update_set={"v": "source.v"})
    got = {r.k: r.v for r in led.read("t.x").where("k IN (5, 500, 6)").collect()}
    assert got == {5: "m", 500: "n", 6: "b"}


def test_anti_join_broadcast_only_under_recorded_size(spark, root):
    led = small_ledger(spark, root)
    led.update("t.x", {"v": "'b'"}, where="k < 10")
    st, _ = V.table_state(led.store, led.hist, "t.x", led.hist.head("main"), broadcast_rows=1_000)
    assert "BroadcastHashJoin" in plan(st)
    st2, _ = V.table_state(led.store, led.hist, "t.x", led.hist.head("main"), broadcast_rows=5)
    assert "ResolvedHint" not in st2._jdf.queryExecution().analyzed().toString()


def test_series_windows_partition_by_time_bucket(spark):
    base = T(2024, 1, 1)
    df = spark.createDataFrame([("hot", base + dt.timedelta(seconds=i), i, float(i)) for i in range(50)],
                               "s string, ts timestamp_ntz, id long, v double")
    inc = O.reset_aware_increase(df, ["s"], "ts", "v", "id")
    p = plan(inc)
    # the per-sample window is partitioned by (series, bucket), never by series alone
    assert "windowspecdefinition(s#" in p and "_b#" in p.split("windowspecdefinition(")[1].split(",")[1]


def test_day_partitions_are_pruned(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("m.e", "id BIGINT, ts TIMESTAMP_NTZ", keys=["id"], partition_by=[("day", "ts")])
    led.append("m.e", spark.createDataFrame([(i, T(2024, 1, 1 + i % 5)) for i in range(20)],
                                            "id BIGINT, ts TIMESTAMP_NTZ"))
    df = led.read("m.e", days=("2024-01-02", "2024-01-03"))
    p = plan(df)
    assert "PartitionFilters: [isnotnull(_p_day_f2" in p
    assert df.count() == 8


def test_appends_after_an_update_are_not_shuffled(spark, root):
    led = small_ledger(spark, root)
    led.update("t.x", {"v": "'b'"}, where="k < 10")
    led.delete("t.x", "k = 20")
    for i in range(3):
        led.append("t.x", spark.range(200 + 10 * i, 210 + 10 * i).select(
            F.col("id").alias("k"), F.lit("c").alias("v"), F.lit(0.0).alias("amount")))
    led.append("t.x", spark.createDataFrame([(20, "again", 1.0)], SCHEMA))
    df = led.read("t.x")
    p = plan(df)
    assert p.count("Window [") <= 2              # over the changes, for live rows and touched keys
    commits = [r for r in led.hist.table_commits("t.x", led.cut(None, None)) if r.append_only and r.n_rows]
    assert len(commits) == 5
    got = {r.k: r.v for r in df.collect()}
    want = {k: "b" if k < 10 else "a" for k in range(200)} | {k: "c" for k in range(200, 230)} | {20: "again"}
    assert got == want


def test_latest_and_gauge_aggregate_by_hashing(spark):
    from tidemark.operators import metrics as MX
    rows = [("a", dt.datetime(2024, 1, 1), 1, 1.0), ("a", dt.datetime(2024, 1, 1), 2, 2.0),
            ("a", dt.datetime(2023, 1, 1), 9, 3.0), ("b", None, 1, 4.0), ("b", None, None, 5.0),
            (None, dt.datetime(1960, 1, 1), -3, 6.0), (None, dt.datetime(1960, 1, 1), None, 7.0)]
    df = spark.createDataFrame(rows, "s string, t timestamp, i bigint, v double")
    latest = MX.latest_sample(df, ["s"], "t", "v", "i")
    assert {(r.s, r.last_value) for r in latest.collect()} == {("a", 2.0), ("b", 4.0), (None, 6.0)}
    gauge = MX.gauge_series(df, ["s"], "t", "v", "i", "1 hour")
    for d in (latest, gauge):
        assert "SortAggregate" not in plan(d) and "HashAggregate" in plan(d)
