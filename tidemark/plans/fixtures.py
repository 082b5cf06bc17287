"""Fixture L: a commit history over ``orders``; fixture M: metric samples over ``events``.

Every row of ``orders`` enters the ledger: commits split it by ``k = o_orderkey % 10``.

    commit  ref   parent  ts          change
    c1      main  -       2024-01-01  create sales.orders; append k<6; tag v1
    c2      main  c1      2024-01-02  append k in (6,7); branch dev from here
    c3      main  c2      2024-01-03  merge source k in (5,6,7,8): matched -> status 'X', k=8 inserted
    c4      main  c3      2024-01-04  add column channel; append k=9 with channel 'web'
    d1      dev   c2      2024-01-03  append k=8 with status 'D'
    d2      dev   d1      2024-01-04  update k=0 set price 0
    c5      main  c4      2024-01-05  delete k=1

Side branches for scenario queries (they never touch main or dev):
    from_c1   from c1: no commits of its own
    dropped   from c1: drop sales.orders at 2024-01-02 12:00                 (x_drop)
    ddl       from c3: drop column o_orderpriority (x_dropcol); create sales.orders_empty (x_empty)
    multi     from c5: one commit appending customer as sales.customers and k=1 back (x_multi)
    feature   from c5: create staging.nation_dev from nation                  (x_feature)
    merged_src / merged_tgt from c5: dev merged with policy source / target   (x_msrc / x_mtgt)
    orphan change rows for commit 'x_orphan' written, never published.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.ledger import Ledger
from tidemark.operators import versioned as V
from tidemark.sources.tables import table

ORDERS = "sales.orders"
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]


def day(d: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, d, hour)


def kmod(c="o_orderkey"):
    return F.col(c) % 10


def build_ledger(spark: SparkSession, sf_dir: str, root: str, side_branches: bool = True) -> Ledger:
    orders = table(spark, sf_dir, "orders").select(*ORDERS_COLS)
    k = kmod()
    led = Ledger.open(spark, root)
    with led.transaction("main", ts=day(1), commit_id="c1", message="create + first load") as tx:
        tx.create_table(ORDERS, orders.schema, keys=["o_orderkey"])
        tx.append(ORDERS, orders.where(k < 6))
    led.tag("v1", commit="c1", ts=day(1))
    led.append(ORDERS, orders.where(k.isin(6, 7)), ts=day(2), commit_id="c2", message="load 6,7")
    led.create_branch("dev", commit="c2", ts=day(2))
    led.merge(ORDERS, orders.where(k.isin(5, 6, 7, 8)), on=["o_orderkey"],
              update_set={"o_orderstatus": "'X'"}, ts=day(3), commit_id="c3", message="upsert")
    with led.transaction("main", ts=day(4), commit_id="c4", message="add channel") as tx:
        tx.add_column(ORDERS, "channel", "string")
        tx.append(ORDERS, orders.where(k == 9).withColumn("channel", F.lit("web")))
    led.append(ORDERS, orders.where(k == 8).withColumn("o_orderstatus", F.lit("D")), ref="dev",
               ts=day(3), commit_id="d1", message="dev load 8")
    led.update(ORDERS, {"o_totalprice": "0"}, where="o_orderkey % 10 = 0", ref="dev", ts=day(4),
               commit_id="d2", message="dev reprice")
    led.delete(ORDERS, "o_orderkey % 10 = 1", ts=day(5), commit_id="c5", message="purge 1")
    if side_branches:
        _side_branches(led, spark, sf_dir, orders)
    return led


def _side_branches(led: Ledger, spark, sf_dir, orders: DataFrame) -> None:
    k = kmod()
    led.create_branch("dropped", commit="c1", ts=day(2))
    led.drop_table(ORDERS, ref="dropped", ts=day(2, 12), commit_id="x_drop")

    led.create_branch("from_c1", commit="c1", ts=day(6))

    led.create_branch("ddl", commit="c3", ts=day(6))
    led.drop_column(ORDERS, "o_orderpriority", ref="ddl", ts=day(6), commit_id="x_dropcol")
    led.create_table("sales.orders_empty", orders.schema, keys=["o_orderkey"], ref="ddl",
                     ts=day(6, 1), commit_id="x_empty")

    led.create_branch("multi", commit="c5", ts=day(6))
    cust = table(spark, sf_dir, "customer")
    with led.transaction("multi", ts=day(6, 2), commit_id="x_multi", message="two tables") as tx:
        tx.create_table("sales.customers", cust.schema, keys=["c_custkey"])
        tx.append("sales.customers", cust)
        tx.append(ORDERS, orders.where(k == 1))

    led.create_branch("feature", commit="c5", ts=day(6))
    nation = table(spark, sf_dir, "nation")
    with led.transaction("feature", ts=day(6, 3), commit_id="x_feature") as tx:
        tx.create_table("staging.nation_dev", nation.schema, keys=["n_nationkey"])
        tx.append("staging.nation_dev", nation)

    led.create_branch("merged_src", commit="c5", ts=day(7))
    led.merge_ref("dev", "merged_src", on_conflict="source", ts=day(7), commit_id="x_msrc")
    led.create_branch("merged_tgt", commit="c5", ts=day(7))
    led.merge_ref("dev", "merged_tgt", on_conflict="target", ts=day(7), commit_id="x_mtgt")

    # a writer that died after writing its change rows but before publishing the commit
    schema = led.schema(ORDERS)
    orphan = V.to_physical(orders.where(k == 1).withColumn("o_orderstatus", F.lit("Z")),
                           schema, led._next_seq() + 1000, "I")
    led.store.write_changes(ORDERS, "x_orphan", orphan, [])


_CACHE: dict = {}


def ledger_for(spark: SparkSession, sf_dir: str, variant: str = "full") -> Ledger:
    """Fixture L for this session and scale, built once under the checkpoint root."""
    from tidemark.session import scratch_path
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), variant)
    led = _CACHE.get(key)
    if led is None:
        root = scratch_path(spark, f"ledger-{variant}")
        led = build_ledger(spark, sf_dir, root, side_branches=(variant == "full"))
        if variant == "compacted":
            led.compact(ORDERS, commit="c3")
        elif variant == "expired":
            led.expire(day(5), retain_last=2)
        _CACHE[key] = led
    return led


# ---------------------------------------------------------------------------
# Fixture M: metric samples over events
# ---------------------------------------------------------------------------
EVENTS = "metrics.events"


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series = event_type, time = ts, tie-break = event_id, gauge = value."""
    return table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter with a reset at each day start: row_number per
    (event_type, day) ordered by (ts, event_id)."""
    from tidemark.functions.ordered import bucketed_row_number
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    ev = ev.withColumn("day", F.to_date("ts"))
    rn = bucketed_row_number(ev, ["event_type", "day"], "ts", "event_id", name="counter")
    return rn.select("event_type", "ts", "event_id", F.col("counter").cast("double").alias("counter"))


def up_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up flag per user: 0 for an 'error' event, else 1."""
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id", "ts", "event_id",
                     F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("up"))


def metrics_ledger_for(spark: SparkSession, sf_dir: str) -> Ledger:
    """Ledger holding events as a day-partitioned table."""
    from tidemark.session import scratch_path
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), "metrics")
    led = _CACHE.get(key)
    if led is None:
        led = Ledger.open(spark, scratch_path(spark, "ledger-metrics"))
        ev = table(spark, sf_dir, "events")
        with led.transaction("main", ts=day(31), commit_id="m1") as tx:
            tx.create_table(EVENTS, ev.schema, keys=["event_id"], partition_by=[("day", "ts")])
            tx.append(EVENTS, ev)
        _CACHE[key] = led
    return led


def event_drops_for(spark: SparkSession, sf_dir: str) -> str:
    """Events as one Parquet folder per day, written oldest day first."""
    from tidemark.session import scratch_path
    from tidemark.streaming.ingest import drop_files_by_day
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), "drops")
    path = _CACHE.get(key)
    if path is None:
        path = scratch_path(spark, "event-drops")
        drop_files_by_day(table(spark, sf_dir, "events"), "ts", path)
        _CACHE[key] = path
    return path
