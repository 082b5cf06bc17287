"""Registered queries: one per operator of the inventory, each with an
independent SQL statement over the raw tables that must give the same rows.

Ledger queries read fixture L (a commit history built from every row of
``orders``, see ``fixtures``); metric queries read fixture M (``events``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import maintenance as M
from tidemark.operators import metrics as MX
from tidemark.operators import rollup as R
from tidemark.plans import fixtures as FX
from tidemark.plans.fixtures import ORDERS, ORDERS_COLS, day
from tidemark.session import scratch_path
from tidemark.sources.tables import register_views, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


# Answered from the log or from constants, or about the storage layer: kept as functions with
# unit tests, but not registered as queries over the given tables.
UNREGISTERED = ("list_namespaces", "list_tables", "branch_list", "describe_schema", "history", "create_empty",
                "uncommitted_hidden", "compact_equals", "expire_snapshots")


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _led(spark, sf, variant="full"):
    return FX.ledger_for(spark, sf, variant)


def _fresh_orders(spark, sf, name: str, without: tuple = ()):
    """A ledger of its own holding all orders but those whose k is to be inserted, for queries that
    time a write."""
    from tidemark.ledger import Ledger
    orders = table(spark, sf, "orders").select(*FX.ORDERS_COLS)
    led = Ledger.open(spark, scratch_path(spark, f"ledger-{name}"))
    with led.transaction("main", commit_id="c1") as tx:
        tx.create_table(ORDERS, orders.schema, keys=["o_orderkey"])
        tx.append(ORDERS, orders.where(~FX.kmod().isin(*without)) if without else orders)
    return led, orders


def _count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# ---------------------------------------------------------------------------
# SQL building blocks for the oracle (k = o_orderkey % 10)
# ---------------------------------------------------------------------------
K = "(o_orderkey % 10)"
SIX = ", ".join(ORDERS_COLS)
STATUS_C3 = f"CASE WHEN {K} IN (5, 6, 7) THEN 'X' ELSE o_orderstatus END AS o_orderstatus"
CHANNEL = f"CASE WHEN {K} = 9 THEN 'web' END AS channel"
CURRENT = (f"SELECT o_orderkey, o_custkey, {STATUS_C3}, o_totalprice, o_orderdate, o_orderpriority, "
           f"{CHANNEL} FROM orders WHERE {K} <> 1")
AT_C3 = (f"SELECT o_orderkey, o_custkey, {STATUS_C3}, o_totalprice, o_orderdate, o_orderpriority "
         f"FROM orders WHERE {K} < 9")


def _merged(status_k8: str) -> str:
    return (f"SELECT o_orderkey, o_custkey, "
            f"CASE WHEN {K} IN (5, 6, 7) THEN 'X' WHEN {K} = 8 THEN {status_k8} ELSE o_orderstatus END "
            f"AS o_orderstatus, CASE WHEN {K} = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, "
            f"o_orderdate, o_orderpriority, {CHANNEL} FROM orders WHERE {K} <> 1")


def _n(where: str, tbl: str = "orders") -> str:
    return f"(SELECT count(*) FROM {tbl} WHERE {where})"


# ---------------------------------------------------------------------------
# Scans, sources, sinks
# ---------------------------------------------------------------------------
@query("scan_current", CURRENT)
def scan_current(spark, sf):
    return _led(spark, sf).read(ORDERS)


@query("scan_count", f"SELECT count(*) AS n FROM orders WHERE {K} <> 1")
def scan_count(spark, sf):
    return _count(_led(spark, sf).read(ORDERS))


@query("range_count", """
SELECT max(o_orderkey) - min(o_orderkey) + 1 AS n_range,
       max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS n_missing
FROM orders""")
def range_count(spark, sf):
    """Integer range source spanning the order-key domain; keys absent from orders."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    lo, hi = o.agg(F.min("id"), F.max("id")).first()       # two numbers reach the driver
    r = spark.range(lo, hi + 1)
    hit = o.distinct().withColumn("_hit", F.lit(1))
    j = r.join(hit, "id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_range"),
                 F.count_if(F.col("_hit").isNull()).cast("long").alias("n_missing"))


@query("create_empty", "SELECT count(*) AS n_rows, 6 AS n_cols FROM orders WHERE false")
def create_empty(spark, sf):
    df = _led(spark, sf).read("sales.orders_empty", ref="ddl")
    return _count(df, "n_rows").withColumn("n_cols", F.lit(len(df.columns)))


@query("list_namespaces", "SELECT * FROM (VALUES ('sales'), ('staging')) t(namespace)")
def list_namespaces(spark, sf):
    led = _led(spark, sf)
    return spark.createDataFrame([(n,) for n in led.namespaces("feature")], "namespace string")


_TABLES_BY_REF = {
    "main": ["sales.orders"], "dev": ["sales.orders"], "v1": ["sales.orders"], "dropped": [],
    "from_c1": ["sales.orders"], "ddl": ["sales.orders", "sales.orders_empty"],
    "multi": ["sales.customers", "sales.orders"], "feature": ["sales.orders", "staging.nation_dev"],
    "merged_src": ["sales.orders"], "merged_tgt": ["sales.orders"],
}


def _values(rows: list[tuple], cols: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({cols})"


@query("list_tables", _values([(r, t) for r, ts in _TABLES_BY_REF.items() for t in ts],
                              "ref, table_name"))
def list_tables(spark, sf):
    led = _led(spark, sf)
    rows = [(ref, t) for ref in led.hist.ref_state() for t in led.tables(ref=ref)]
    return spark.createDataFrame(rows, "ref string, table_name string")


@query("branch_tables", """
SELECT 'feature' AS ref, true AS present, count(*) AS n_rows FROM nation
UNION ALL SELECT 'main', false, CAST(NULL AS BIGINT)""")
def branch_tables(spark, sf):
    """A table created on a branch exists there and nowhere else."""
    led = _led(spark, sf)
    out = None
    for ref in ("feature", "main"):
        if "staging.nation_dev" in led.tables(ref=ref):
            df = _count(led.read("staging.nation_dev", ref=ref), "n_rows") \
                .select(F.lit(ref).alias("ref"), F.lit(True).alias("present"), "n_rows")
        else:
            df = spark.createDataFrame([(ref, False, None)], "ref string, present boolean, n_rows bigint")
        out = df if out is None else out.unionByName(df)
    return out


@query("drop_then_as_of", f"SELECT {SIX} FROM orders WHERE {K} < 6")
def drop_then_as_of(spark, sf):
    """Dropped at 2024-01-02 12:00 on branch 'dropped'; reading before the drop still works."""
    return _led(spark, sf).read(ORDERS, ref="dropped", ts=day(2))


@query("append_rows", f"SELECT {SIX}, 'I' AS change_op FROM orders WHERE {K} IN (6, 7)")
def append_rows(spark, sf):
    led, orders = _fresh_orders(spark, sf, "append", without=(6, 7))
    led.append(ORDERS, orders.where(FX.kmod().isin(6, 7)), commit_id="w")
    return led.changes(ORDERS, "w")


@query("mirror_check", f"""
SELECT count(*) AS source_rows, count(*) AS copy_rows, true AS equal FROM orders WHERE {K} <> 1""")
def mirror_check(spark, sf):
    led = _led(spark, sf)
    return M.mirror(led, ORDERS, scratch_path(spark, "mirror"))


# ---------------------------------------------------------------------------
# Projection, filters, sort/limit, ad-hoc SQL on a version
# ---------------------------------------------------------------------------
@query("project_filter_ge", f"""
SELECT o_orderkey, o_orderstatus, channel FROM ({CURRENT}) WHERE o_orderkey >= 100""")
def project_filter_ge(spark, sf):
    return _led(spark, sf).read(ORDERS).select("o_orderkey", "o_orderstatus", "channel") \
        .where(F.col("o_orderkey") >= 100)


@query("filter_in", f"SELECT * FROM ({CURRENT}) WHERE o_orderkey IN (10, 13)")
def filter_in(spark, sf):
    return _led(spark, sf).read(ORDERS).where(F.col("o_orderkey").isin(10, 13))


@query("case_null", f"""
SELECT o_orderkey, CASE WHEN channel IS NULL THEN 'old' ELSE 'new' END AS kind FROM ({CURRENT})""")
def case_null(spark, sf):
    df = _led(spark, sf).read(ORDERS)
    return df.select("o_orderkey",
                     F.when(F.col("channel").isNull(), "old").otherwise("new").alias("kind"))


@query("order_limit", f"SELECT * FROM ({CURRENT}) ORDER BY o_orderkey LIMIT 5")
def order_limit(spark, sf):
    return _led(spark, sf).read(ORDERS).orderBy("o_orderkey").limit(5)


ADHOC = """
SELECT c.c_mktsegment AS c_mktsegment, count(*) AS n_orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM {orders} o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment"""


@query("adhoc_sql_on_version", ADHOC.format(orders=f"(SELECT * FROM orders WHERE {K} < 8)"))
def adhoc_sql_on_version(spark, sf):
    led = _led(spark, sf)
    register_views(spark, sf, ["customer"])
    return led.sql(ADHOC.format(orders="orders_at_c2"),
                   views={"orders_at_c2": dict(table=ORDERS, commit="c2")})


# ---------------------------------------------------------------------------
# Versioned reads, metadata, diff, evolution, writes
# ---------------------------------------------------------------------------
@query("as_of_timestamp", f"SELECT {SIX} FROM orders WHERE {K} < 8")
def as_of_timestamp(spark, sf):
    return _led(spark, sf).read(ORDERS, ts=dt.datetime(2024, 1, 2, 12))


@query("as_of_commit", AT_C3)
def as_of_commit(spark, sf):
    return _led(spark, sf).read(ORDERS, commit="c3")


_MAIN_HISTORY = [("c1", None, "create+append", 1), ("c2", "c1", "append", 2), ("c3", "c2", "merge", 3),
                 ("c4", "c3", "evolve+append", 4), ("c5", "c4", "delete", 5)]


@query("history", " UNION ALL ".join(
    f"SELECT TIMESTAMP '2024-01-0{d} 00:00:00' AS made_current_at, '{c}' AS commit_id, "
    f"{'NULL' if p is None else repr(p)} AS parent_id, '{op}' AS operation, true AS is_current_ancestor"
    for c, p, op, d in _MAIN_HISTORY))
def history(spark, sf):
    h = _led(spark, sf).history(ORDERS, ref="main")
    return h.select(F.col("made_current_at").cast("timestamp_ntz").alias("made_current_at"),
                    "commit_id", "parent_id", F.col("op").alias("operation"), "is_current_ancestor")


def _counts(i="0", u="0", d="0"):
    return f"CAST({i} AS BIGINT), CAST({u} AS BIGINT), CAST({d} AS BIGINT)"


_AUDIT = [
    ("c1", "main", ORDERS, "create+append", _counts(_n(f"{K} < 6"))),
    ("c2", "main", ORDERS, "append", _counts(_n(f"{K} IN (6, 7)"))),
    ("c3", "main", ORDERS, "merge", _counts(_n(f"{K} = 8"), _n(f"{K} IN (5, 6, 7)"))),
    ("c4", "main", ORDERS, "evolve+append", _counts(_n(f"{K} = 9"))),
    ("d1", "dev", ORDERS, "append", _counts(_n(f"{K} = 8"))),
    ("d2", "dev", ORDERS, "update", _counts("0", _n(f"{K} = 0"))),
    ("c5", "main", ORDERS, "delete", _counts("0", "0", _n(f"{K} = 1"))),
    ("x_drop", "dropped", ORDERS, "drop", _counts()),
    ("x_dropcol", "ddl", ORDERS, "evolve", _counts()),
    ("x_empty", "ddl", "sales.orders_empty", "create", _counts()),
    ("x_multi", "multi", "sales.customers", "create+append", _counts("(SELECT count(*) FROM customer)")),
    ("x_multi", "multi", ORDERS, "append", _counts(_n(f"{K} = 1"))),
    ("x_feature", "feature", "staging.nation_dev", "create+append", _counts("(SELECT count(*) FROM nation)")),
    ("x_msrc", "merged_src", ORDERS, "merge_ref", _counts("0", _n(f"{K} IN (0, 8)"))),
    ("x_mtgt", "merged_tgt", ORDERS, "merge_ref", _counts("0", _n(f"{K} = 0"))),
]


def _audit_sql() -> str:
    parts = []
    for i, (c, r, t, op, cnt) in enumerate(_AUDIT):
        if i == 0:
            ci, cu, cd = [x.strip() for x in cnt.split(", CAST(")]
            cnt = f"{ci} AS n_inserted, CAST({cu} AS n_updated, CAST({cd} AS n_deleted"
            parts.append(f"SELECT '{c}' AS commit_id, '{r}' AS ref, '{t}' AS table_name, "
                         f"'{op}' AS op, {cnt}")
        else:
            parts.append(f"SELECT '{c}', '{r}', '{t}', '{op}', {cnt}")
    return "\nUNION ALL ".join(parts)


@query("audit_log", _audit_sql())
def audit_log(spark, sf):
    a = _led(spark, sf).audit_log()
    return a.select("commit_id", "ref", "table_name", "op", "n_inserted", "n_updated", "n_deleted")


_SNAP = [("c1", None, "create+append", _n(f"{K} < 6"), "0", "0"),
         ("c2", "c1", "append", _n(f"{K} IN (6, 7)"), "0", "0"),
         ("c3", "c2", "merge", _n(f"{K} = 8"), _n(f"{K} IN (5, 6, 7)"), "0"),
         ("c4", "c3", "evolve+append", _n(f"{K} = 9"), "0", "0"),
         ("c5", "c4", "delete", "0", "0", _n(f"{K} = 1"))]


@query("snapshots", " UNION ALL ".join(
    f"SELECT '{c}' AS commit_id, {'NULL' if p is None else repr(p)} AS parent_id, '{op}' AS operation, "
    f"CAST({i} AS BIGINT) AS added_rows, CAST({u} AS BIGINT) AS updated_rows, "
    f"CAST({d} AS BIGINT) AS deleted_rows" for c, p, op, i, u, d in _SNAP))
def snapshots(spark, sf):
    s = _led(spark, sf).snapshots(ORDERS, ref="main")
    return s.select("commit_id", "parent_id", "operation", "added_rows", "updated_rows", "deleted_rows")


@query("version_compare", f"""
SELECT 'history' AS version, count(*) AS n FROM orders WHERE {K} < 8
UNION ALL SELECT 'current' AS version, count(*) AS n FROM orders WHERE {K} <> 1""")
def version_compare(spark, sf):
    led = _led(spark, sf)
    old = _count(led.read(ORDERS, ts=day(2, 12))).select(F.lit("history").alias("version"), "n")
    cur = _count(led.read(ORDERS)).select(F.lit("current").alias("version"), "n")
    return old.union(cur)


@query("version_count_delta", f"""
SELECT {_n(f'{K} < 6')} AS before, {_n(f'{K} < 8')} AS after,
       {_n(f'{K} < 8')} - {_n(f'{K} < 6')} AS delta""")
def version_count_delta(spark, sf):
    led = _led(spark, sf)
    before = _count(led.read(ORDERS, commit="c1")).scalar()   # scalar subquery, not a cross join
    after = _count(led.read(ORDERS, commit="c2"), "after")
    return after.select(before.alias("before"), "after", (F.col("after") - before).alias("delta"))


@query("snapshot_diff", f"""
SELECT o_orderkey, CASE WHEN {K} IN (8, 9) THEN 'added' WHEN {K} = 1 THEN 'removed'
                        ELSE 'changed' END AS change_type
FROM orders
WHERE {K} IN (1, 8, 9) OR ({K} IN (5, 6, 7) AND o_orderstatus IS DISTINCT FROM 'X')""")
def snapshot_diff(spark, sf):
    d = _led(spark, sf).diff(ORDERS, dict(commit="c2"), dict(commit="c5"))
    return d.select("o_orderkey", "change_type")


@query("snapshot_diff_columns", f"""
SELECT o_orderkey, CASE WHEN {K} = 4 THEN 'removed' ELSE 'changed' END AS change_type,
       o_orderpriority AS old_o_orderpriority, o_orderstatus AS old_o_orderstatus,
       CASE WHEN {K} = 9 THEN 'web' END AS new_channel,
       CASE WHEN {K} <> 4 THEN o_orderstatus END AS new_status
FROM orders WHERE o_orderpriority IS NOT NULL OR {K} IN (4, 9)""")
def snapshot_diff_columns(spark, sf):
    """Diff over the union of columns: one added, one dropped, one renamed in between."""
    led, _ = _fresh_orders(spark, sf, "diff-columns")
    led.add_column(ORDERS, "channel", "string")
    led.rename_column(ORDERS, "o_orderstatus", "status")
    led.drop_column(ORDERS, "o_orderpriority")
    led.update(ORDERS, {"channel": "'web'"}, where="o_orderkey % 10 = 9")
    led.delete(ORDERS, "o_orderkey % 10 = 4")
    d = led.diff(ORDERS, dict(commit="c1"), dict(ref="main"))
    return d.select("o_orderkey", "change_type", "old_o_orderpriority", "old_o_orderstatus", "new_channel",
                    "new_status")


KEYLESS_NEW = """SELECT user_id % 50 AS u, CASE WHEN event_id % 10 = 2 THEN 'seen' ELSE event_type END AS kind,
       event_id % 10 AS digit FROM events WHERE event_id % 10 <> 7
UNION ALL SELECT user_id % 50, event_type, event_id % 10 FROM events WHERE event_type = 'click'"""


@query("snapshot_diff_multiset", f"""
WITH o AS (SELECT user_id % 50 AS u, event_type AS kind, event_id % 10 AS digit FROM events), n AS ({KEYLESS_NEW})
SELECT u, kind, digit, 'added' AS change_type, count(*) AS n FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) GROUP BY ALL
UNION ALL
SELECT u, kind, digit, 'removed', count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) GROUP BY ALL""")
def snapshot_diff_multiset(spark, sf):
    """Diff of a table without identity, whose rows repeat: how many more or fewer of each."""
    from tidemark.ledger import Ledger
    ev = table(spark, sf, "events")
    led = Ledger.open(spark, scratch_path(spark, "ledger-keyless"))
    kinds = ev.select((F.col("user_id") % 50).alias("u"), F.col("event_type").alias("kind"),
                      (F.col("event_id") % 10).alias("digit"))
    with led.transaction("main", commit_id="c1") as tx:
        tx.create_table("metrics.kinds", kinds.schema)
        tx.append("metrics.kinds", kinds)
    led.delete("metrics.kinds", "digit = 7")
    led.update("metrics.kinds", {"kind": "'seen'"}, where="digit = 2")
    led.append("metrics.kinds", kinds.where("kind = 'click'"))
    return led.diff("metrics.kinds", dict(commit="c1"), dict(ref="main"))


@query("add_column_nulls", f"SELECT o_orderkey, {CHANNEL} FROM orders")
def add_column_nulls(spark, sf):
    return _led(spark, sf).read(ORDERS, commit="c4").select("o_orderkey", "channel")


@query("add_column_if_absent", f"SELECT o_orderkey, {CHANNEL} FROM orders")
def add_column_if_absent(spark, sf):
    """Adding a column that is there already changes neither the schema nor the values."""
    led, _ = _fresh_orders(spark, sf, "add-if-absent")
    led.add_column(ORDERS, "channel", "string", if_not_exists=True)
    led.update(ORDERS, {"channel": "'web'"}, where="o_orderkey % 10 = 9")
    led.add_column(ORDERS, "channel", "string", if_not_exists=True)
    return led.read(ORDERS).select("o_orderkey", "channel")


@query("drop_column", f"""
SELECT o_orderkey, o_custkey, {STATUS_C3}, o_totalprice, o_orderdate FROM orders WHERE {K} < 9""")
def drop_column(spark, sf):
    return _led(spark, sf).read(ORDERS, ref="ddl")


_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
          ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("describe_schema", _values(
    [("c3", n, t, i + 1) for i, (n, t) in enumerate(_TYPES)] +
    [("c4", n, t, i + 1) for i, (n, t) in enumerate(_TYPES + [("channel", "string")])],
    "version, col_name, data_type, ordinal").replace(
    "t(version, col_name, data_type, ordinal)", "t(version, col_name, data_type, ordinal_i)").replace(
    "SELECT *", "SELECT version, col_name, data_type, CAST(ordinal_i AS BIGINT) AS ordinal"))
def describe_schema(spark, sf):
    led = _led(spark, sf)
    a = led.describe(ORDERS, commit="c3").select(F.lit("c3").alias("version"), "col_name", "data_type",
                                                 "ordinal")
    b = led.describe(ORDERS, commit="c4").select(F.lit("c4").alias("version"), "col_name", "data_type",
                                                 "ordinal")
    return a.union(b)


@query("merge_upsert", f"""
SELECT o_orderkey, CASE WHEN {K} = 8 THEN o_orderstatus ELSE 'X' END AS o_orderstatus,
       CASE WHEN {K} = 8 THEN 'I' ELSE 'U' END AS change_op
FROM orders WHERE {K} IN (5, 6, 7, 8)""")
def merge_upsert(spark, sf):
    led, orders = _fresh_orders(spark, sf, "merge", without=(8,))
    led.merge(ORDERS, orders.where(FX.kmod().isin(5, 6, 7, 8)), on=["o_orderkey"],
              update_set={"o_orderstatus": "'X'"}, commit_id="w")
    return led.changes(ORDERS, "w").select("o_orderkey", "o_orderstatus", "change_op")


@query("update_where", f"SELECT o_orderkey, 'Q' AS o_orderstatus, 'U' AS change_op FROM orders WHERE {K} = 0")
def update_where(spark, sf):
    led, _ = _fresh_orders(spark, sf, "update")
    led.update(ORDERS, {"o_orderstatus": "'Q'"}, where="o_orderkey % 10 = 0", commit_id="w")
    return led.changes(ORDERS, "w").select("o_orderkey", "o_orderstatus", "change_op")


@query("update_clock", f"""
SELECT o_orderkey, TIMESTAMP '2024-03-01 12:00:00' AS o_orderdate, '2024-03-01' AS o_orderpriority,
       'now()' AS o_orderstatus FROM orders WHERE {K} = 0""")
def update_clock(spark, sf):
    """Clock functions in a write give the commit's one time in every row."""
    led, _ = _fresh_orders(spark, sf, "clock")
    led.update(ORDERS, {"o_orderdate": "now()", "o_orderpriority": "cast(current_date AS string)",
                        "o_orderstatus": "'now()'"}, where="o_orderkey % 10 = 0 AND o_orderdate < CURRENT_TIMESTAMP()",
               ts="2024-03-01 12:00:00", commit_id="w")
    return led.changes(ORDERS, "w").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")


@query("delete_where", f"SELECT o_orderkey, 'D' AS change_op FROM orders WHERE {K} = 1")
def delete_where(spark, sf):
    led, _ = _fresh_orders(spark, sf, "delete")
    led.delete(ORDERS, "o_orderkey % 10 = 1", commit_id="w")
    return led.changes(ORDERS, "w").select("o_orderkey", "change_op")


@query("uncommitted_hidden", f"""
SELECT o_orderstatus, count(*) AS n FROM ({CURRENT}) GROUP BY o_orderstatus""")
def uncommitted_hidden(spark, sf):
    """Change rows of an unpublished commit (status 'Z') never show up."""
    return _led(spark, sf).read(ORDERS).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("multi_table_commit", """
SELECT 'sales.orders' AS table_name, 'x_multi' AS commit_id, count(*) AS n_rows FROM orders
UNION ALL SELECT 'sales.customers', 'x_multi', count(*) FROM customer""")
def multi_table_commit(spark, sf):
    led = _led(spark, sf)
    out = None
    for t in ("sales.orders", "sales.customers"):
        df = _count(led.read(t, commit="x_multi"), "n_rows").select(
            F.lit(t).alias("table_name"), F.lit("x_multi").alias("commit_id"), "n_rows")
        out = df if out is None else out.union(df)
    return out


@query("expire_snapshots", f"""
SELECT 'c1' AS commit_id, {_n(f'{K} < 6')} AS n_rows
UNION ALL SELECT 'c4', count(*) FROM orders
UNION ALL SELECT 'c5', {_n(f'{K} <> 1')}""")
def expire_snapshots(spark, sf):
    """Expire before 2024-01-05 keeping 2 per branch: c2, c3 go; main still reads at
    its surviving commits through the base written at c3."""
    led = _led(spark, sf, "expired")
    alive = [c for c in reversed(led.hist.lineage(led.hist.head("main")))
             if c not in led.hist.expired_ids()]
    out = None
    for c in alive:     # one distributed count per surviving commit (a handful)
        df = _count(led.read(ORDERS, commit=c), "n_rows").select(F.lit(c).alias("commit_id"), "n_rows")
        out = df if out is None else out.union(df)
    return out


@query("compact_equals", CURRENT)
def compact_equals(spark, sf):
    """Base written at c3; the head read is base + (c4, c5) and equals the plain read."""
    return _led(spark, sf, "compacted").read(ORDERS)


@query("partitioned_by_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def partitioned_by_day(spark, sf):
    led = FX.metrics_ledger_for(spark, sf)
    return led.read(FX.EVENTS).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("day_range_pruned", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-22' GROUP BY 1""")
def day_range_pruned(spark, sf):
    """Reads the partitions of the asked days only."""
    ev = FX.metrics_ledger_for(spark, sf).read(FX.EVENTS, days=("2024-01-08", "2024-01-22"))
    return ev.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("merge_branch_unkeyed", f"""
SELECT o_orderkey, CASE WHEN {K} = 3 THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def merge_branch_unkeyed(spark, sf):
    """Orders without a key: both branches append, the source also updates; nothing conflicts."""
    from tidemark.ledger import Ledger
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    led = Ledger.open(spark, scratch_path(spark, "unkeyed"))
    led.create_table(ORDERS, o.schema)
    led.append(ORDERS, o.where(f"{K} < 6"))
    led.create_branch("dev")
    led.append(ORDERS, o.where(f"{K} IN (6, 7)"), ref="dev")
    led.update(ORDERS, {"o_orderstatus": "'S'"}, f"{K} = 3", ref="dev")
    led.append(ORDERS, o.where(f"{K} IN (8, 9)"))
    led.merge_ref("dev", "main", on_conflict="fail")
    return led.read(ORDERS).select("o_orderkey", "o_orderstatus")


# ---------------------------------------------------------------------------
# Branches and tags
# ---------------------------------------------------------------------------
_REFS = [("main", "branch", "c5"), ("v1", "tag", "c1"), ("dev", "branch", "d2"),
         ("dropped", "branch", "x_drop"), ("from_c1", "branch", "c1"), ("ddl", "branch", "x_empty"),
         ("multi", "branch", "x_multi"), ("feature", "branch", "x_feature"),
         ("merged_src", "branch", "x_msrc"), ("merged_tgt", "branch", "x_mtgt")]


@query("branch_list", _values(_REFS, "name, kind, commit_id"))
def branch_list(spark, sf):
    return _led(spark, sf).refs().select("name", "kind", "commit_id")


@query("branch_from_commit", f"SELECT {SIX} FROM orders WHERE {K} < 6")
def branch_from_commit(spark, sf):
    return _led(spark, sf).read(ORDERS, ref="from_c1")


@query("branch_read", f"""
SELECT o_orderkey, o_custkey, CASE WHEN {K} = 8 THEN 'D' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN {K} = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE {K} < 9""")
def branch_read(spark, sf):
    return _led(spark, sf).read(ORDERS, ref="dev")


@query("branch_isolation", f"""
SELECT 'main' AS ref, {_n(f'{K} <> 1')} AS n_rows, CAST(0 AS BIGINT) AS n_dev_rows
UNION ALL SELECT 'dev', {_n(f'{K} < 9')}, {_n(f'{K} = 8')}""")
def branch_isolation(spark, sf):
    led = _led(spark, sf)
    out = None
    for ref in ("main", "dev"):
        df = led.read(ORDERS, ref=ref).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("o_orderstatus") == "D").cast("long").alias("n_dev_rows"))
        df = df.select(F.lit(ref).alias("ref"), "n_rows", "n_dev_rows")
        out = df if out is None else out.union(df)
    return out


@query("tag_read", f"SELECT {SIX} FROM orders WHERE {K} < 6")
def tag_read(spark, sf):
    return _led(spark, sf).read(ORDERS, ref="v1")


@query("merge_conflicts", f"SELECT o_orderkey, 'I' AS source_op, 'I' AS target_op FROM orders WHERE {K} = 8")
def merge_conflicts(spark, sf):
    return _led(spark, sf).conflicts("dev", "main", ORDERS)


@query("merge_branch_source", _merged("'D'"))
def merge_branch_source(spark, sf):
    return _led(spark, sf).read(ORDERS, ref="merged_src")


@query("merge_branch_target", _merged("o_orderstatus"))
def merge_branch_target(spark, sf):
    return _led(spark, sf).read(ORDERS, ref="merged_tgt")


# ---------------------------------------------------------------------------
# Rollups kept in step with the table
# ---------------------------------------------------------------------------
ROLLUP_SQL = f"""
SELECT o_orderstatus, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM ({CURRENT}) GROUP BY o_orderstatus"""


@query("rollup_full", ROLLUP_SQL)
def rollup_full(spark, sf):
    return R.rollup(_led(spark, sf).read(ORDERS), ["o_orderstatus"], "o_totalprice").drop("n_amounts")


@query("rollup_incremental", ROLLUP_SQL)
def rollup_incremental(spark, sf):
    """Rollup materialised at c2, then refreshed from the change rows of c3..c5 only."""
    led = _led(spark, sf)
    path = FX._CACHE.get(("rollup_c2", led.root))
    if path is None:
        path = scratch_path(spark, "rollup-c2")
        R.rollup(led.read(ORDERS, commit="c2"), ["o_orderstatus"], "o_totalprice") \
            .write.mode("overwrite").parquet(path)
        FX._CACHE[("rollup_c2", led.root)] = path
    prev = spark.read.parquet(path)
    return R.refresh(led, ORDERS, prev, ["o_orderstatus"], "o_totalprice",
                     dict(commit="c2"), dict(ref="main")).drop("n_amounts")


@query("rollup_extremes", f"""
SELECT o_orderpriority, count(*) AS n_rows, count(amount) AS n_amounts,
       CAST(sum(amount) AS DECIMAL(38,2)) AS total, min(amount) AS min_amount, max(amount) AS max_amount
FROM (SELECT o_orderpriority, CASE WHEN {K} = 3 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount
      FROM orders WHERE {K} <> 1
      QUALIFY o_totalprice < max(CASE WHEN {K} <> 1 THEN o_totalprice END) OVER (PARTITION BY o_orderpriority))
GROUP BY o_orderpriority""")
def rollup_extremes(spark, sf):
    """Minimum and maximum kept in step: rows go, amounts become NULL, then each group's dearest orders go."""
    led, orders = _fresh_orders(spark, sf, "extremes")
    path = scratch_path(spark, "rollup-extremes")
    R.rollup(led.read(ORDERS), ["o_orderpriority"], "o_totalprice", extremes=True).write.parquet(path)
    led.delete(ORDERS, "o_orderkey % 10 = 1")
    top = led.read(ORDERS).groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("o_totalprice"))
    dear = led.read(ORDERS).join(top, ["o_orderpriority", "o_totalprice"], "left_semi").select("o_orderkey")
    led.merge(ORDERS, dear.withColumn("gone", F.lit(True)), on="o_orderkey",
              update_set={"o_orderstatus": "'-'"}, insert_values=None)
    led.delete(ORDERS, "o_orderstatus = '-'")
    led.update(ORDERS, {"o_totalprice": "NULL"}, where="o_orderkey % 10 = 3")
    return R.refresh(led, ORDERS, spark.read.parquet(path), ["o_orderpriority"], "o_totalprice",
                     dict(commit="c1"), dict(ref="main"))


# ---------------------------------------------------------------------------
# Metric series (fixture M)
# ---------------------------------------------------------------------------
@query("latest_sample", """
SELECT event_type, ts AS last_ts, value AS last_value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE value IS NOT NULL) WHERE rn = 1""")
def latest_sample(spark, sf):
    return MX.latest_sample(FX.gauge_samples(spark, sf), ["event_type"], "ts", "value", "event_id")


@query("status_map", """
SELECT user_id, ts AS last_ts, up AS last_value,
       CASE up WHEN 0 THEN 'DOWN' WHEN 1 THEN 'UP' END AS status,
       CASE WHEN up >= 1 THEN 'green' ELSE 'red' END AS color
FROM (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS up,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1""")
def status_map(spark, sf):
    latest = MX.latest_sample(FX.up_samples(spark, sf), ["user_id"], "ts", "up", "event_id")
    return MX.status(latest)


@query("gauge_series", """
SELECT event_type, step_start, max(CASE WHEN rn = 1 THEN value END) AS value,
       count(*) AS n_samples
FROM (SELECT event_type, value, date_trunc('hour', ts) AS step_start,
             row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts)
                                ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE value IS NOT NULL)
GROUP BY 1, 2""")
def gauge_series(spark, sf):
    return MX.gauge_series(FX.gauge_samples(spark, sf), ["event_type"], "ts", "value", "event_id",
                           "1 hour")


COUNTER_CTE = """
WITH s AS (
  SELECT event_type, ts, event_id,
         CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id)
              AS DOUBLE) AS v
  FROM events),
i AS (
  SELECT event_type, ts, event_id, v,
         lag(v) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM s),
c AS (
  SELECT event_type, ts, event_id,
         CASE WHEN p IS NULL THEN 0.0 WHEN v < p THEN v ELSE v - p END AS inc FROM i)"""


@query("counter_increase", COUNTER_CTE + """
SELECT event_type, date_trunc('day', ts) AS step_start, sum(inc) AS increase FROM c GROUP BY 1, 2""")
def counter_increase(spark, sf):
    return MX.counter_increase(FX.counter_samples(spark, sf), ["event_type"], "ts", "counter",
                               "event_id", step="1 day")


@query("counter_rate", COUNTER_CTE + """
SELECT event_type, ts, event_id,
       sum(inc) OVER (PARTITION BY event_type ORDER BY ts
                      RANGE BETWEEN INTERVAL 299999999 MICROSECONDS PRECEDING AND CURRENT ROW) / 300.0
       AS rate
FROM c""")
def counter_rate(spark, sf):
    return MX.counter_rate(FX.counter_samples(spark, sf), ["event_type"], "ts", "counter", "event_id",
                           range_seconds=300)


@query("retention", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def retention(spark, sf):
    ev = table(spark, sf, "events")
    end = ev.select(F.max("ts")).scalar()
    kept = MX.retain(ev, "ts", end, "7 DAYS")
    return kept.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Streams (file drops of events, one folder per day)
# ---------------------------------------------------------------------------
@query("stream_ingest", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_ingest(spark, sf):
    from tidemark.ledger import Ledger
    from tidemark.streaming.ingest import ingest
    src = FX.event_drops_for(spark, sf)
    ev = table(spark, sf, "events")
    led = Ledger.open(spark, scratch_path(spark, "stream-ingest"))
    led.create_table("metrics.samples", ev.schema)          # samples have no identity: unkeyed
    q = ingest(spark, src, ev.schema, led, "metrics.samples", scratch_path(spark, "ckpt-ingest"))
    q.awaitTermination()
    return led.read("metrics.samples").groupBy(F.to_date("ts").alias("day")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("stream_window", """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(value) AS max_value
FROM events GROUP BY 1, 2""")
def stream_window(spark, sf):
    from tidemark.ledger import Ledger
    from tidemark.streaming.ingest import create_window_table, window_counts, window_totals
    src = FX.event_drops_for(spark, sf)
    ev = table(spark, sf, "events")
    led = Ledger.open(spark, scratch_path(spark, "stream-window"))
    create_window_table(led, "metrics.hourly", "event_type string")
    q = window_counts(spark, src, ev.schema, led, "metrics.hourly", scratch_path(spark, "ckpt-window"),
                      "ts", ["event_type"], "value")
    q.awaitTermination()
    return window_totals(led.read("metrics.hourly"), ["event_type"]).drop("n_late")


@query("stream_watermark", """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(value) AS max_value
FROM events GROUP BY 1, 2""")
def stream_watermark(spark, sf):
    """Windows emitted once behind a watermark of one day, and those still open in the state store."""
    from tidemark.ledger import Ledger
    from tidemark.streaming.stateful import open_windows, watermarked_windows
    src = FX.event_drops_for(spark, sf)
    ev = table(spark, sf, "events")
    led = Ledger.open(spark, scratch_path(spark, "stream-watermark"))
    ckpt = scratch_path(spark, "ckpt-watermark")
    q = watermarked_windows(spark, src, ev.schema, led, "metrics.closed", ckpt, "ts", ["event_type"], "value",
                            delay="1 day", max_files_per_trigger=10)
    q.awaitTermination()
    return led.read("metrics.closed").drop("_row_id").unionByName(open_windows(spark, ckpt, ["event_type"]))


def _tracked(spark, sf, name: str):
    from tidemark.ledger import Ledger
    from tidemark.streaming.stateful import track_series
    src = FX.event_drops_for(spark, sf)
    ev = table(spark, sf, "events")
    led = Ledger.open(spark, scratch_path(spark, f"stream-{name}"))
    q = track_series(spark, src, ev.schema, led, "metrics.events", scratch_path(spark, f"ckpt-{name}"), "ts",
                     ["event_type"], "value", "event_id", max_files_per_trigger=10)
    q.awaitTermination()
    return led


@query("stream_latest", ORACLE["latest_sample"])
def stream_latest(spark, sf):
    """Last sample of every series, carried from batch to batch in a versioned table."""
    return _tracked(spark, sf, "latest").read("metrics.events_last").select("event_type", "last_ts", "last_value")


@query("stream_increase", """
WITH i AS (
  SELECT event_type, ts, value AS v, lag(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p
  FROM events)
SELECT event_type, date_trunc('day', ts) AS step_start,
       round(sum(CASE WHEN p IS NULL OR v IS NULL THEN 0.0 WHEN v < p THEN v ELSE v - p END), 4) AS increase
FROM i GROUP BY 1, 2""")
def stream_increase(spark, sf):
    """Reset-aware increase per day of the values as they come in, over batch ends."""
    from tidemark.streaming.stateful import increase_totals
    led = _tracked(spark, sf, "increase")
    out = increase_totals(led.read("metrics.events_increase"), ["event_type"])
    return out.select("event_type", F.col("step_start").cast("timestamp_ntz").alias("step_start"),
                      F.round("increase", 4).alias("increase"))


LABELS = "CASE WHEN event_id % 2 = 0 THEN map('type', event_type, 'shard', cast(user_id % 4 AS string)) " \
         "ELSE map('shard', cast(user_id % 4 AS string), 'type', event_type, 'none', cast(NULL AS string)) END"


@query("latest_by_labels", """
SELECT '{"shard":"' || (user_id % 4) || '","type":"' || event_type || '"}' AS series, max(ts) AS last_ts,
       arg_max(value, (ts, event_id)) AS last_value
FROM events WHERE value IS NOT NULL AND event_type = 'click' GROUP BY 1""")
def latest_by_labels(spark, sf):
    """Series are label sets: a map's order does not matter, and a matcher asks for one label."""
    from tidemark.functions.labels import series_key
    ev = table(spark, sf, "events").withColumn("labels", F.expr(LABELS)).withColumn("series", series_key("labels"))
    return MX.latest_sample(ev, ["series"], "ts", "value", "event_id", matchers={"labels['type']": "click"})


@query("gauge_range", """
SELECT event_type, date_trunc('hour', ts) AS step_start, arg_max(value, (ts, event_id)) AS value, count(*) AS n_samples
FROM events WHERE value IS NOT NULL AND event_type = 'view' AND ts > TIMESTAMP '2024-01-05 06:30:00'
  AND ts <= TIMESTAMP '2024-01-20 18:00:00' GROUP BY 1, 2""")
def gauge_range(spark, sf):
    """Gauge steps of one label over a time range, both pushed into the scan."""
    return MX.gauge_series(FX.gauge_samples(spark, sf), ["event_type"], "ts", "value", "event_id", "1 hour",
                           start=dt.datetime(2024, 1, 5, 6, 30), end=dt.datetime(2024, 1, 20, 18),
                           matchers={"event_type": "view"})


@query("retention_days", """
SELECT event_id, ts, value FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def retention_days(spark, sf):
    """Retention over day partitions: older days are not read."""
    return MX.retained(FX.metrics_ledger_for(spark, sf), FX.EVENTS, "ts", dt.timedelta(days=7)).select(
        "event_id", "ts", "value")


def queries() -> dict[str, Query]:
    return {k: v for k, v in QUERIES.items() if k not in UNREGISTERED}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k not in UNREGISTERED}
