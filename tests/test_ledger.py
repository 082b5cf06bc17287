"""Ledger behaviour on the reference's own literal scenarios and on failure paths."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import Ledger
from tidemark.plans.lineage import (LedgerError, MergeConflict, NoVersionError, RefNotFound,
                                    TableNotFound)

T = dt.datetime


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


USERS = "id INT, name STRING, created_at TIMESTAMP"


def users_ledger(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("demo_db.users", USERS, keys=["id"], ts=T(2024, 1, 1))
    led.append("demo_db.users",
               spark.createDataFrame([(100, "Notebook User 1", T(2024, 1, 1)),
                                      (101, "Notebook User 2", T(2024, 1, 1))], USERS),
               ts=T(2024, 1, 1, 1))
    return led


def test_range_source(spark):
    assert spark.range(0, 100).count() == 100


def test_time_travel_counts(spark, root):
    led = users_ledger(spark, root)
    before = led.read("demo_db.users").count()
    led.append("demo_db.users", spark.createDataFrame([(5, "Eve", T(2024, 1, 2)),
                                                       (6, "Frank", T(2024, 1, 2))], USERS),
               ts=T(2024, 1, 2))
    assert led.read("demo_db.users").count() == before + 2
    assert led.read("demo_db.users", ts=T(2024, 1, 1, 12)).count() == before
    with pytest.raises(NoVersionError):
        led.read("demo_db.users", ts=T(2023, 12, 31))


def test_schema_evolution_and_merge(spark, root):
    led = users_ledger(spark, root)
    led.add_column("demo_db.users", "email", "string", ts=T(2024, 1, 2))
    led.add_column("demo_db.users", "email", "string", if_not_exists=True, ts=T(2024, 1, 2))
    with pytest.raises(ValueError):
        led.add_column("demo_db.users", "email", "string", ts=T(2024, 1, 2))
    schema4 = USERS + ", email STRING"
    led.append("demo_db.users", spark.createDataFrame(
        [(102, "Schema Test", T(2024, 1, 2), "schema@test.com")], schema4), by_name=False,
        ts=T(2024, 1, 2, 1))
    # arity is strict for positional inserts
    with pytest.raises(LedgerError):
        led.append("demo_db.users", spark.createDataFrame([(9, "x", T(2024, 1, 2))], USERS),
                   by_name=False)
    d = led.describe("demo_db.users")
    assert [r.col_name for r in d.orderBy("ordinal").collect()] == ["id", "name", "created_at", "email"]
    got = rows(led.read("demo_db.users"), "id", "email")
    assert got == [(100, None), (101, None), (102, "schema@test.com")]

    staging = spark.createDataFrame(
        [(100, "Notebook User 1 UPDATED", T(2024, 3, 3), "updated@example.com"),
         (103, "New Merged User", T(2024, 3, 3), "merged@example.com")], schema4)
    led.merge("demo_db.users", staging, on=["id"],
              update_set={"name": "source.name", "email": "source.email"},
              insert_values={"id": "source.id", "name": "source.name",
                             "created_at": "source.created_at", "email": "source.email"},
              ts=T(2024, 1, 3))
    got = {r.id: r for r in led.read("demo_db.users").collect()}
    assert sorted(got) == [100, 101, 102, 103]
    assert got[100].name == "Notebook User 1 UPDATED" and got[100].email == "updated@example.com"
    assert got[100].created_at == T(2024, 1, 1)          # not in the SET list: kept
    assert got[101].email is None
    assert got[102].name == "Schema Test"
    assert got[103].email == "merged@example.com"


def test_merge_rejects_duplicate_source_keys(spark, root):
    led = users_ledger(spark, root)
    src = spark.createDataFrame([(100, "a", T(2024, 1, 5)), (100, "b", T(2024, 1, 5))], USERS)
    with pytest.raises(LedgerError):
        led.merge("demo_db.users", src, on=["id"], update_set={"name": "source.name"})


def test_append_rejects_existing_key_and_null_key(spark, root):
    led = users_ledger(spark, root)
    with pytest.raises(LedgerError):
        led.append("demo_db.users", spark.createDataFrame([(100, "again", T(2024, 1, 5))], USERS))
    with pytest.raises(LedgerError):
        led.append("demo_db.users", spark.createDataFrame([(None, "null", T(2024, 1, 5))], USERS))


SALES = "id BIGINT, product STRING, amount DECIMAL(10,2), sale_date DATE"


def sales_ledger(spark, root):
    import decimal
    led = Ledger.open(spark, root)
    led.create_table("demo.sales", SALES, keys=["id"], ts=T(2024, 1, 1))
    d = dt.date(2024, 1, 1)
    led.append("demo.sales", spark.createDataFrame(
        [(1, "Laptop", decimal.Decimal("999.99"), d), (2, "Mouse", decimal.Decimal("29.99"), d),
         (3, "Keyboard", decimal.Decimal("79.99"), d)], SALES), ts=T(2024, 1, 1, 1))
    return led


def test_branch_isolation(spark, root):
    import decimal
    led = sales_ledger(spark, root)
    led.create_branch("dev", from_ref="main")
    assert led.create_branch("dev", from_ref="main") is not None      # exists: success
    led.append("demo.sales", spark.createDataFrame(
        [(4, "Monitor", decimal.Decimal("299.99"), dt.date(2024, 1, 2))], SALES), ref="dev",
        ts=T(2024, 1, 2))
    assert led.read("demo.sales", ref="dev").count() == 4
    assert led.read("demo.sales", ref="main").count() == 3
    with pytest.raises(RefNotFound):
        led.read("demo.sales", ref="nope")


def test_table_created_on_branch_is_absent_on_main(spark, root):
    led = sales_ledger(spark, root)
    led.create_branch("dev")
    led.create_table("demo_db.test_dev", "id INT, data STRING", keys=["id"], ref="dev")
    led.append("demo_db.test_dev", spark.createDataFrame([(1, "dev_data"), (2, "dev_test")],
                                                         "id INT, data STRING"), ref="dev")
    assert led.read("demo_db.test_dev", ref="dev").count() == 2
    with pytest.raises(TableNotFound):
        led.read("demo_db.test_dev", ref="main")
    assert led.tables("demo_db", ref="main") == []


def test_merge_ref_policies(spark, root):
    led = sales_ledger(spark, root)
    led.create_branch("dev")
    led.update("demo.sales", {"product": "'Laptop Pro'"}, where="id = 1", ref="dev")
    led.update("demo.sales", {"product": "'Laptop Max'"}, where="id = 1", ref="main")
    led.update("demo.sales", {"product": "'Mouse 2'"}, where="id = 2", ref="dev")
    assert rows(led.conflicts("dev", "main", "demo.sales"), "id") == [(1,)]
    with pytest.raises(MergeConflict):
        led.merge_ref("dev", "main", on_conflict="fail")
    led.create_branch("m2", from_ref="main")
    led.merge_ref("dev", "main", on_conflict="target")
    got = dict(rows(led.read("demo.sales"), "id", "product"))
    assert got[1] == "Laptop Max" and got[2] == "Mouse 2"
    led.merge_ref("dev", "m2", on_conflict="source")
    assert dict(rows(led.read("demo.sales", ref="m2"), "id", "product"))[1] == "Laptop Pro"


def test_value_filter_does_not_resurrect_old_versions(spark, root):
    led = sales_ledger(spark, root)
    led.update("demo.sales", {"product": "'Tablet'"}, where="id = 1")
    # the old image 'Laptop' must not come back through a pushed-down filter
    assert led.read("demo.sales").where(F.col("product") == "Laptop").count() == 0
    assert led.read("demo.sales").where(F.col("id") == 1).first().product == "Tablet"


def test_readded_column_hides_old_values(spark, root):
    led = sales_ledger(spark, root)
    led.drop_column("demo.sales", "product")
    led.add_column("demo.sales", "product", "string")
    assert led.read("demo.sales").where(F.col("product").isNotNull()).count() == 0
    assert "product" in led.read("demo.sales", ts=T(2024, 1, 1, 1)).columns


def test_widen_int_to_bigint(spark, root):
    led = users_ledger(spark, root)
    led.create_table("demo_db.n", "k INT, v INT", keys=["k"])
    led.append("demo_db.n", spark.createDataFrame([(1, 10)], "k INT, v INT"))
    led.widen_column("demo_db.n", "v", "bigint")
    led.append("demo_db.n", spark.createDataFrame([(2, 2 ** 40)], "k INT, v BIGINT"))
    assert rows(led.read("demo_db.n"), "k", "v") == [(1, 10), (2, 2 ** 40)]
    with pytest.raises(ValueError):
        led.widen_column("demo_db.n", "v", "int")


def test_delete_and_uncommitted(spark, root):
    from tidemark.operators import versioned as V
    led = sales_ledger(spark, root)
    led.delete("demo.sales", "id = 2")
    assert rows(led.read("demo.sales"), "id") == [(1,), (3,)]
    schema = led.schema("demo.sales")
    orphan = V.to_physical(led.read("demo.sales").withColumn("product", F.lit("ghost")), schema, 999, "U")
    led.store.write_changes("demo.sales", "never_published", orphan, [])
    assert led.read("demo.sales").where("product = 'ghost'").count() == 0
    assert led.refresh() is None and led.read("demo.sales").count() == 2


def test_compaction_and_expiry(spark, root):
    led = sales_ledger(spark, root)
    led.update("demo.sales", {"product": "'A'"}, where="id = 1", ts=T(2024, 1, 2))
    led.delete("demo.sales", "id = 3", ts=T(2024, 1, 3))
    before = rows(led.read("demo.sales"), "id", "product")
    led.compact("demo.sales")
    assert rows(led.read("demo.sales"), "id", "product") == before
    expired = led.expire(T(2024, 1, 3), retain_last=1)
    assert expired                      # older commits are gone
    assert rows(led.read("demo.sales"), "id", "product") == before
    with pytest.raises(NoVersionError):
        led.read("demo.sales", ts=T(2024, 1, 2, 12))
    # a fresh handle on the same root sees the same state
    again = Ledger.open(spark, led.root)
    assert rows(again.read("demo.sales"), "id", "product") == before


def test_drop_table_keeps_history(spark, root):
    led = sales_ledger(spark, root)
    led.drop_table("demo.sales", ts=T(2024, 1, 5))
    with pytest.raises(TableNotFound):
        led.read("demo.sales")
    assert led.read("demo.sales", ts=T(2024, 1, 2)).count() == 3
    assert led.drop_table("demo.sales", if_exists=True) is None


def test_multi_table_commit_is_one_version(spark, root):
    led = sales_ledger(spark, root)
    with led.transaction("main", ts=T(2024, 1, 4), commit_id="both") as tx:
        tx.create_table("demo.other", "k INT", keys=["k"])
        tx.append("demo.other", spark.createDataFrame([(1,), (2,)], "k INT"))
        tx.delete("demo.sales", "id = 1")
    assert led.read("demo.other", commit="both").count() == 2
    assert led.read("demo.sales", commit="both").count() == 2
    assert {r.table_name for r in led.hist.commit_index()["both"]} == {"demo.other", "demo.sales"}


def test_unkeyed_table(spark, root):
    led = Ledger.open(spark, root)
    led.create_table("demo.log", "msg STRING")
    led.append("demo.log", spark.createDataFrame([("a",), ("a",), ("b",)], "msg STRING"))
    assert led.read("demo.log").count() == 3
    led.delete("demo.log", "msg = 'a'")
    assert rows(led.read("demo.log"), "msg") == [("b",)]


def test_namespaces_and_properties(spark, root):
    led = sales_ledger(spark, root)
    assert led.create_namespace("demo_db") is not None
    assert led.create_namespace("demo_db") is None                 # IF NOT EXISTS
    with pytest.raises(LedgerError):
        led.create_namespace("demo_db", if_not_exists=False)
    assert led.namespaces() == ["demo", "demo_db"]
    assert led.tables("demo_db") == []
    led.set_properties("demo.sales", {"compression": "gzip"})
    assert led.properties("demo.sales") == {"compression": "gzip"}
    led.update("demo.sales", {"product": "'Z'"}, where="id = 3")
    cid = led.hist.head("main")
    files = spark.read.parquet(led.store.commit_changes_path("demo.sales", cid)).inputFiles()
    assert files and all(".gz" in f for f in files)
    assert led.read("demo.sales").where("product = 'Z'").count() == 1


def test_history_snapshots_and_diff(spark, root):
    led = sales_ledger(spark, root)
    led.update("demo.sales", {"product": "'Tablet'"}, where="id = 1", commit_id="u1")
    led.delete("demo.sales", "id = 2", commit_id="d1")
    h = [r.op for r in led.history("demo.sales").orderBy("seq").collect()]
    assert h == ["create", "append", "update", "delete"]
    s = {r.commit_id: (r.added_rows, r.updated_rows, r.deleted_rows)
         for r in led.snapshots("demo.sales").collect()}
    assert s["u1"] == (0, 1, 0) and s["d1"] == (0, 0, 1)
    first = led.hist.lineage(led.hist.head("main"))[-2]
    d = {r.id: r.change_type for r in led.diff("demo.sales", dict(commit=first), dict(ref="main")).collect()}
    assert d == {1: "changed", 2: "removed"}


def test_diff_of_identical_and_branch_versions(spark, root):
    led = sales_ledger(spark, root)
    assert led.diff("demo.sales", dict(ref="main"), dict(ref="main")).count() == 0
    led.create_branch("dev")
    led.delete("demo.sales", "id = 3", ref="dev")
    led.update("demo.sales", {"product": "'Mouse 3'"}, where="id = 2", ref="main")
    d = {r.id: r.change_type for r in led.diff("demo.sales", dict(ref="main"), dict(ref="dev")).collect()}
    assert d == {2: "changed", 3: "removed"}
    led.broadcast_rows = 0                      # forces the full outer join path
    d2 = {r.id: r.change_type for r in led.diff("demo.sales", dict(ref="main"), dict(ref="dev")).collect()}
    assert d2 == d


def test_expire_purges_unreachable_change_files(spark, root):
    import os
    from tidemark.session import local_path
    led = sales_ledger(spark, root)
    led.update("demo.sales", {"product": "'A'"}, where="id = 1", ts=T(2024, 1, 2), commit_id="old")
    led.update("demo.sales", {"product": "'B'"}, where="id = 2", ts=T(2024, 1, 3), commit_id="new")
    before = rows(led.read("demo.sales"), "id", "product")
    assert "old" in led.expire(T(2024, 1, 3), retain_last=1)
    p = local_path(led.store.commit_changes_path("demo.sales", "old"))
    assert not os.path.exists(p)
    assert rows(led.read("demo.sales"), "id", "product") == before


def test_compact_twice_is_idempotent(spark, root):
    led = sales_ledger(spark, root)
    a = led.compact("demo.sales")
    b = led.compact("demo.sales")
    assert a == b and len(led.hist.bases) == 1
    assert led.read("demo.sales").count() == 3
