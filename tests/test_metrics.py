"""Bucketed ordered computations against a brute-force pandas model.

The data has one hot series (most rows), resets, samples on bucket and window
boundaries, and equal timestamps broken by the tie-break column.
"""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered as O
from tidemark.functions.status import map_values, threshold_color
from tidemark.operators import metrics as MX

BASE = dt.datetime(2024, 1, 1)


def samples(spark, n=1500, seed=7):
    rnd = random.Random(seed)
    rows = []
    vals = {}
    for i in range(n):
        s = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", "c"])
        sec = rnd.choice([rnd.randint(0, 4 * 3600), 3600, 7200, 3600 - 300, 3600 + 300, 3599])
        v = vals.get(s, 0) + rnd.randint(0, 5)
        if rnd.random() < 0.05:
            v = rnd.randint(0, 3)          # counter reset
        vals[s] = v
        rows.append((s, BASE + dt.timedelta(seconds=sec), i, float(v)))
    return rows, spark.createDataFrame(rows, "s string, ts timestamp_ntz, id long, v double")


def brute_inc(rows):
    df = pd.DataFrame(rows, columns=["s", "ts", "id", "v"]).sort_values(["s", "ts", "id"])
    df["p"] = df.groupby("s")["v"].shift()
    df["inc"] = [0.0 if pd.isna(p) else (v if v < p else v - p) for v, p in zip(df["v"], df["p"])]
    return df


def test_reset_aware_increase_matches_bruteforce(spark):
    rows, df = samples(spark)
    exp = brute_inc(rows)
    got = O.reset_aware_increase(df, ["s"], "ts", "v", "id", bucket_us=3600 * O.US).toPandas()
    m = exp.merge(got, on="id", suffixes=("", "_g"))
    assert len(m) == len(rows)
    assert (m["inc"] - m["inc_g"]).abs().max() < 1e-9


def test_trailing_sum_matches_bruteforce(spark):
    rows, df = samples(spark)
    exp = brute_inc(rows)
    inc = O.reset_aware_increase(df, ["s"], "ts", "v", "id")
    got = O.trailing_sum(inc, ["s"], "ts", "inc", 300 * O.US, 3600 * O.US, name="w").toPandas()
    want = {}
    for s, g in exp.groupby("s"):
        for _, r in g.iterrows():
            lo = r.ts - dt.timedelta(seconds=300)
            want[r.id] = g[(g.ts > lo) & (g.ts <= r.ts)]["inc"].sum()
    for _, r in got.iterrows():
        assert abs(r.w - want[r.id]) < 1e-9


def test_bucketed_row_number_matches_window(spark):
    rows, df = samples(spark)
    got = O.bucketed_row_number(df, ["s"], "ts", "id", bucket_us=1800 * O.US).toPandas()
    exp = pd.DataFrame(rows, columns=["s", "ts", "id", "v"]).sort_values(["s", "ts", "id"])
    exp["rn"] = exp.groupby("s").cumcount() + 1
    m = exp.merge(got, on="id", suffixes=("", "_g"))
    assert (m["rn"] == m["rn_g"]).all()


def test_trailing_sum_needs_wide_bucket(spark):
    _, df = samples(spark, 10)
    with pytest.raises(ValueError):
        O.trailing_sum(df, ["s"], "ts", "v", 600 * O.US, 300 * O.US)


def test_latest_sample_and_status(spark):
    df = spark.createDataFrame(
        [("pg", BASE, 1, 1.0), ("pg", BASE + dt.timedelta(seconds=15), 2, 0.0),
         ("pg", BASE + dt.timedelta(seconds=30), 3, None),
         ("objstore", BASE, 4, 1.0), ("objstore", BASE, 5, 2.0)],
        "job string, ts timestamp_ntz, id long, up double")
    latest = MX.latest_sample(df, ["job"], "ts", "up", "id")
    st = {r.job: (r.last_value, r.status, r.color) for r in MX.status(latest).collect()}
    assert st["pg"] == (0.0, "DOWN", "red")          # NULL sample skipped (lastNotNull)
    assert st["objstore"] == (2.0, None, "green")       # tie on ts broken by id; 2 has no mapping


def test_threshold_color():
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(None,), (0.0,), (0.5,), (1.0,), (7.0,)], "v double")
    got = [r[0] for r in df.select(threshold_color(F.col("v"))).collect()]
    assert got == [None, "red", "red", "green", "green"]
    got = [r[0] for r in df.select(map_values(F.col("v"))).collect()]
    assert got == [None, "DOWN", None, "UP", None]


def test_retention_bounds(spark):
    df = spark.createDataFrame([(BASE + dt.timedelta(days=d),) for d in range(10)], "ts timestamp_ntz")
    end = df.select(F.max("ts")).scalar()
    kept = MX.retain(df, "ts", end, "7 DAYS")
    assert kept.count() == 7                          # (end - 7d, end]


def test_label_matcher_and_time_range(spark):
    df = spark.createDataFrame(
        [("catalogdb", BASE, 1, 1.0), ("catalogdb", BASE + dt.timedelta(minutes=30), 2, 0.0),
         ("objstore", BASE + dt.timedelta(minutes=40), 3, 1.0),
         ("catalogdb", BASE + dt.timedelta(hours=2), 4, 1.0)],
        "job string, ts timestamp_ntz, id long, v double")
    latest = MX.latest_sample(df, ["job"], "ts", "v", "id", matchers={"job": "catalogdb"})
    assert [(r.job, r.last_value) for r in latest.collect()] == [("catalogdb", 1.0)]
    g = MX.gauge_series(df, ["job"], "ts", "v", "id", "1 hour", start=BASE, end=BASE + dt.timedelta(hours=1),
                        matchers={"job": "catalogdb"})
    assert [(r.value, r.n_samples) for r in g.collect()] == [(0.0, 1)]   # (start, end]: id 1 excluded


def test_matcher_on_label_map(spark):
    df = spark.createDataFrame(
        [("up", {"job": "catalogdb"}, BASE, 1, 1.0), ("up", {"job": "objstore"}, BASE, 2, 0.0)],
        "metric string, labels map<string,string>, ts timestamp_ntz, id long, value double")
    df = df.withColumn("job", F.col("labels")["job"])
    latest = MX.latest_sample(df, ["metric", "job"], "ts", "value", "id", matchers={"labels['job']": "objstore"})
    assert [(r.job, r.last_value) for r in latest.collect()] == [("objstore", 0.0)]
