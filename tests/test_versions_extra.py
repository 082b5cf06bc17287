"""Diffs without identity and across schema changes, rollups with NULLs and extremes, the commit's
clock, partition transforms."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.ledger import Ledger
from tidemark.operators import rollup as R
from tidemark.operators.metrics import retained
from tidemark.operators.writes import pin_clock


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_multiset_diff_counts_repeats_and_nulls(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("t.x", "a int, b string")
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (None, None), (2, "y")], "a int, b string")
    led.append("t.x", df, commit_id="c1")
    led.append("t.x", df.where("a is null or a = 2"), commit_id="c2")
    led.delete("t.x", "a = 1", commit_id="c3")
    led.append("t.x", df.where("a = 1").limit(1), commit_id="c4")
    assert rows_of(led.diff("t.x", dict(commit="c1"), dict(commit="c4"))) == [
        (1, "x", "removed", 2), (2, "y", "added", 1), (None, None, "added", 1)]
    assert rows_of(led.diff("t.x", dict(commit="c4"), dict(commit="c1"))) == [
        (1, "x", "added", 2), (2, "y", "removed", 1), (None, None, "removed", 1)]
    assert led.diff("t.x", dict(commit="c2"), dict(commit="c2")).count() == 0


def test_diff_shows_added_dropped_and_renamed_columns(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("t.x", "k int, a int, b string, c string", keys=["k"])
    led.append("t.x", spark.createDataFrame([(1, 1, "p", None), (2, 2, "q", "z"), (3, 3, "r", None)],
                                            "k int, a int, b string, c string"), commit_id="c1")
    led.rename_column("t.x", "b", "name")
    led.drop_column("t.x", "c")
    led.add_column("t.x", "c", "int")                      # another field under the old name
    led.widen_column("t.x", "a", "bigint")
    led.update("t.x", {"c": "7"}, where="k = 1", commit_id="c2")
    d = {r.k: r.asDict() for r in led.diff("t.x", dict(commit="c1"), dict(commit="c2")).collect()}
    assert set(d) == {1, 2}                                # 3 has no value in either c, and a widened is equal
    assert d[1]["new_c"] == 7 and d[1]["old_c"] is None and d[2]["old_c"] == "z" and d[2]["new_c"] is None
    assert d[2]["old_b"] == d[2]["new_name"] == "q" and d[2]["change_type"] == "changed"
    back = {r.k: r.asDict() for r in led.diff("t.x", dict(commit="c2"), dict(commit="c1")).collect()}
    assert set(back) == {1, 2} and back[2]["new_c"] == "z" and back[1]["old_c"] == 7


def test_keyless_diff_across_columns(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("t.x", "a int")
    led.append("t.x", spark.createDataFrame([(1,), (2,)], "a int"), commit_id="c1")
    led.add_column("t.x", "b", "string")
    led.append("t.x", spark.createDataFrame([(1, "n")], "a int, b string"), commit_id="c2")
    assert rows_of(led.diff("t.x", dict(commit="c1"), dict(commit="c2"))) == [(1, "n", "added", 1)]


def test_rollup_refresh_equals_full_with_nulls_and_extremes(spark, root):
    led, rng = Ledger.open(spark, root), random.Random(4)
    led.create_table("t.x", "k int, g string, amount double", keys=["k"])
    rows = [(k, rng.choice(["a", "b", "c", None]), None if k % 4 == 0 else float(rng.randrange(20))) for k in range(80)]
    rows += [(100, "nulls", None), (101, "nulls", None)]
    led.append("t.x", spark.createDataFrame(rows, "k int, g string, amount double"))
    full = lambda: R.rollup(led.read("t.x"), ["g"], "amount", extremes=True)
    assert {r.g: r.total for r in full().collect()}["nulls"] is None
    steps = [lambda: led.delete("t.x", "amount = 19"), lambda: led.update("t.x", {"amount": "NULL"}, "g = 'b'"),
             lambda: led.update("t.x", {"g": "'b'", "amount": "-5"}, "k % 9 = 1"), lambda: led.delete("t.x", "g is null"),
             lambda: led.merge("t.x", spark.createDataFrame([(7, "a", 500.0), (900, "new", 1.0)],
                                                            "k int, g string, amount double"),
                               "k", update_set={"g": "source.g", "amount": "source.amount"}),
             lambda: led.delete("t.x", "k = 7"), lambda: led.update("t.x", {"amount": "3"}, "k = 100")]
    for step in steps:
        at, before = led.cut(), full()
        kept = spark.createDataFrame(before.collect(), before.schema)
        step()
        got = R.refresh(led, "t.x", kept, ["g"], "amount", dict(commit=at), dict(ref="main"))
        assert rows_of(got.select(full().columns)) == rows_of(full())
        plain = R.refresh(led, "t.x", kept.drop("min_amount", "max_amount"), ["g"], "amount", dict(commit=at), dict(ref="main"))
        assert rows_of(plain) == rows_of(R.rollup(led.read("t.x"), ["g"], "amount"))
    assert any(isinstance(r.total, Decimal) for r in full().collect())


def test_one_clock_per_commit(spark, root):
    at = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert pin_clock("now()", at) == "TIMESTAMP'2024-05-06 07:08:09.123456'"
    assert pin_clock("concat('now()', x.now, `current_date`, \"now()\", now)", at) == \
        "concat('now()', x.now, `current_date`, \"now()\", now)"
    assert pin_clock("Current_Date() + INTERVAL 1 DAY > current_date", at) == \
        "DATE'2024-05-06' + INTERVAL 1 DAY > DATE'2024-05-06'"
    assert pin_clock({"a": F.lit(1), "b": None}, at)["b"] is None
    led = Ledger.open(spark, root)
    df = spark.range(1000).select(F.col("id").alias("k")).repartition(7)
    for t in ("t.x", "t.y"):
        led.create_table(t, "k bigint, at timestamp", keys=["k"])
        led.append(t, df)
    with led.transaction() as tx:
        tx.update("t.x", {"at": "current_timestamp()"})
        tx.merge("t.y", df, "k", update_set={"at": "now()"})
    with led.transaction() as tx:
        tx.append("t.x", spark.range(2000, 2100).select(F.col("id").alias("k"), tx.now().alias("at")))
    seen = {r[0] for t in ("t.x", "t.y") for r in led.read(t).where("k < 2000").select("at").distinct().collect()}
    log = {r.commit_id: r.ts for r in led.commits_frame().collect()}
    assert len(seen) == 1 and seen <= set(log.values())
    assert led.read("t.x").where("k >= 2000").select("at").distinct().count() == 1


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("transform,col,bounds,kept", [
    ("day", "ts", (dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 4, 6)), 2),
    ("truncate[100]", "k", (150, 260), 2),
    ("truncate[100]", "k", 420, 1),
    ("truncate[1]", "s", "bx", 1),
    ("bucket[8]", "k", 77, 1),
    ("identity", "s", "cx", 1),
])
def test_filters_on_source_columns_prune_partitions(spark, root, transform, col, bounds, kept):
    led = Ledger.open(spark, root)
    df = spark.range(500).select(F.col("id").alias("k"), F.concat(F.expr("substring('abcd', cast(id % 4 AS int) + 1, 1)"), F.lit("x")).alias("s"),
                                 F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int))").alias("ts"))
    led.create_table("t.x", df.schema, partition_by=[(transform, col)])
    led.append("t.x", df)
    got = led.read("t.x", where={col: bounds})
    lo, hi = bounds if isinstance(bounds, tuple) else (bounds, bounds)
    want = df.where((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))
    assert rows_of(got.drop("_row_id")) == rows_of(want) and want.count() > 0
    files = got.select("_row_id").inputFiles()
    pruned = [f for f in plan_of(got).splitlines() if "PartitionFilters" in f]
    assert pruned and "_p_" in pruned[-1].split("PartitionFilters")[1].split("PushedFilters")[0], (files, kept)


def test_retention_reads_the_days_it_keeps(spark, root):
    led = Ledger.open(spark, root)
    df = spark.range(480).select(F.col("id").alias("k"), F.expr(
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int))").alias("ts"))
    led.create_table("t.x", df.schema, partition_by=[("day", "ts")])
    led.append("t.x", df)
    got = retained(led, "t.x", "ts", dt.timedelta(days=2))
    assert sorted(r.k for r in got.collect()) == list(range(432, 480))
    assert "_p_day" in [x for x in plan_of(got).splitlines() if "PartitionFilters" in x][-1]
    assert retained(led, "t.x", "ts", dt.timedelta(days=2), commit=led.cut()).count() == 48
