"""Hot series-hours cut by counts, MERGE in one pass, base codecs, and roots on any Hadoop file system."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import Ledger
from tidemark.functions import ordered as O
from tidemark.operators import metrics as MX
from tidemark.operators import writes as W
from tidemark.plans.schema import TableSchema

BASE = dt.datetime(2024, 1, 1)


def hot_hour(spark, n=2000):
    """Half of all rows in one hour of one series, ties on minutes, NULL series, values and times."""
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        sec = rnd.choice([3600 + rnd.randint(0, 3599), 3600 + 60 * rnd.randint(0, 59), 3600 + rnd.randint(0, 3599),
                          rnd.randint(0, 4 * 3600)])
        s = "hot" if sec >= 3600 and sec < 7200 else rnd.choice(["a", None, "hot"])
        ts = None if rnd.random() < 0.01 else BASE + dt.timedelta(seconds=sec)
        rows.append((s, ts, i, None if rnd.random() < 0.02 else float(rnd.randint(0, 50))))
    return rows, spark.createDataFrame(rows, "s string, ts timestamp_ntz, id long, v double").repartition(6)


def brute(rows, window=300):
    """Row number, increment and trailing sum of every row, one series at a time."""
    out = {}
    for series in {r[0] for r in rows}:
        prev, seen = None, []
        own = [(-1 if ts is None else (ts - BASE).total_seconds(), i, v) for s, ts, i, v in rows if s == series]
        for n, (sec, i, v) in enumerate(sorted(own, key=lambda r: r[:2]), 1):
            inc = 0.0 if v is None or prev is None else v if v < prev else v - prev
            prev = prev if v is None else v
            seen.append((sec, inc))
            out[i] = [n, inc, sec]
        for _, i, _ in own:
            sec = out[i].pop()
            lo = max(sec - window, -0.5)       # times before the base are NULL
            out[i].append(sum(x for t, x in seen if (t == -1 if sec < 0 else lo < t <= sec)))
    return out


@pytest.mark.parametrize("rows_per_segment", [150, 1_000_000])
def test_hot_hour_is_cut_and_equals_brute_force(spark, rows_per_segment):
    rows, df = hot_hour(spark)
    want = brute(rows)
    cut = O.with_segments(df, ["s"], "ts", rows=rows_per_segment)
    held = cut.groupBy("s", F.array_max(F.filter("_starts", lambda x: x <= O.micros("ts"))).alias("g")).count()
    most = held.where("g IS NOT NULL").agg(F.max("count")).first()[0]
    in_minute = df.groupBy("s", F.date_trunc("minute", "ts")).count().agg(F.max("count")).first()[0]
    assert most > 700 if rows_per_segment > 4000 else most <= rows_per_segment + in_minute
    got = {r.id: r.rn for r in O.bucketed_row_number(df, ["s"], "ts", "id", rows=rows_per_segment).collect()}
    assert got == {i: w[0] for i, w in want.items()}
    inc = O.reset_aware_increase(df, ["s"], "ts", "v", "id", rows=rows_per_segment)
    assert set(inc.columns) == {"s", "ts", "id", "v", "inc"}
    assert {r.id: r.inc for r in inc.collect()} == {i: w[1] for i, w in want.items()}
    rate = MX.counter_rate(df, ["s"], "ts", "v", "id", rows=rows_per_segment).collect()
    assert len(rate) == len(rows)
    assert all(abs(r.rate * 300 - want[r.id][2]) < 1e-6 for r in rate)


def test_segments_of_an_empty_table(spark):
    _, df = hot_hour(spark, 5)
    assert MX.counter_rate(df.where("1 = 0"), ["s"], "ts", "v", "id").count() == 0


def test_segments_are_cut_with_one_small_broadcast(spark):
    _, df = hot_hour(spark, 50)
    plan = O.with_segments(df, ["s"], "ts")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_merge_reads_each_side_once(spark, root):
    spark.range(100).selectExpr("id", "id % 7 AS v", "'t' AS w").write.parquet(f"{root}/t")
    spark.range(90, 130).selectExpr("id", "id AS v", "'s' AS w").write.parquet(f"{root}/s")
    t, s = spark.read.parquet(f"{root}/t"), spark.read.parquet(f"{root}/s")
    schema = TableSchema.from_struct(t.schema, keys=["id"])
    out = W.merge_changes(t, s, schema, ["id"], {"v": "source.v + target.v"}, None, False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("LeftOuter") == 1
    got = {r.id: (r.v, r.w, r._op) for r in out.collect()}
    assert got == {i: (i + i % 7, "t", "U") if i < 100 else (i, "s", "I") for i in range(90, 130)}


def test_merge_on_other_columns_narrows_the_target(spark, root):
    led = Ledger.open(spark, root)
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4)], "id long, g string, v long")
    led.create_table("m.t", rows.schema)
    led.append("m.t", rows)
    src = spark.createDataFrame([("a", 10), ("c", 30), (None, 50)], "g string, v long")
    led.merge("m.t", src, on=["g"], update_set={"v": "target.v + source.v"})
    got = sorted(((r.id, r.g, r.v) for r in led.read("m.t").collect()), key=str)
    assert got == sorted([(1, "a", 11), (2, "a", 12), (3, "b", 3), (4, None, 4), (None, "c", 30),
                          (None, None, 50)], key=str)


def test_bases_use_the_table_codec(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("m.t", spark.range(1).schema, keys=["id"])
    led.set_properties("m.t", {"compression": "gzip"})
    led.append("m.t", spark.range(20))
    led.compact("m.t")
    files = led.store.files.names(led.hist.bases[-1].path, ".parquet")
    assert files and all(n.endswith(".gz.parquet") for n in files)


@pytest.fixture()
def mounted(spark, tmp_path):
    """A root on a file system of another scheme, mounted over a local folder."""
    key = "fs.viewfs.mounttable.tidemark.link./data"
    spark.conf.set(key, f"file://{tmp_path}")
    yield "viewfs://tidemark/data/ledger", tmp_path / "ledger"
    spark.conf.unset(key)


def test_log_lies_where_spark_resolves_the_root(spark, mounted):
    root, folder = mounted
    led = Ledger.open(spark, root)
    led.create_table("m.t", spark.range(1).schema, keys=["id"])
    led.append("m.t", spark.range(20))
    led.delete("m.t", "id < 5")
    led.create_branch("dev")
    assert list((folder / "_log" / "commits").glob("*.parquet"))
    for again in (root, f"file:{folder}", str(folder)):
        led = Ledger.open(spark, again)
        assert led.read("m.t").count() == 15 and led.read("m.t", ref="dev").count() == 15
    assert not list((folder / "_log" / "commits").glob("_tmp*"))


def test_a_long_log_is_one_scan(spark, root, monkeypatch):
    from tidemark.sources import store
    led = Ledger.open(spark, root)
    led.create_table("m.t", spark.range(1).schema, keys=["id"], ts="2024-01-01 10:00:00.123456")
    led.append("m.t", spark.range(3), ts="2024-01-02")
    led.create_branch("dev")
    few = Ledger.open(spark, root).hist
    monkeypatch.setattr(store, "LOG_FILES", 0)
    many = Ledger.open(spark, root).hist
    assert [vars(c) for c in few.commits] == [vars(c) for c in many.commits]
    assert [vars(c) for c in few.refs] == [vars(c) for c in many.refs]
