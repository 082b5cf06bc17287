"""Writes and merges that must fail or keep every row, never lose one silently."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import Ledger
from tidemark.functions.ordered import bucketed_row_number, reset_aware_increase
from tidemark.ledger import LedgerError
from tidemark.operators.maintenance import content_fingerprint
from tidemark.plans.lineage import MergeConflict

T = "a.t"


@pytest.fixture()
def led(spark, root):
    led = Ledger.open(spark, root)
    led.create_table(T, "id bigint, name string, v string", keys=["id"])
    return led


def rows(spark, *data, schema="id bigint, name string, v string"):
    return spark.createDataFrame(list(data), schema)


def state(led, table=T, **kw):
    return sorted(tuple(r) for r in led.read(table, **kw).drop("_row_id").collect())


def test_taken_commit_id_is_refused_and_keeps_its_data(spark, led):
    led.append(T, rows(spark, (1, "n1", "a")), commit_id="x")
    with pytest.raises(LedgerError):
        led.append(T, rows(spark, (2, "n2", "b")), commit_id="x")
    assert state(led) == [(1, "n1", "a")]


def test_null_keys_fail(spark, led):
    with pytest.raises(Exception, match="NULL identity"):
        led.append(T, rows(spark, (1, "n", "a"), (None, "n", "b")), check_keys=False)
    led.append(T, rows(spark, (1, "n", "a")))
    with pytest.raises(LedgerError):
        led.merge(T, rows(spark, (None, "n", "b")), on="id", update_set={"v": "source.v"})
    assert state(led) == [(1, "n", "a")]


def test_two_appends_in_one_transaction_share_no_key(spark, led):
    with pytest.raises(LedgerError):
        with led.transaction("main") as tx:
            tx.create_table("a.u", "id bigint, v string", keys=["id"])
            tx.append("a.u", rows(spark, (1, "a"), schema="id bigint, v string"))
            tx.append("a.u", rows(spark, (1, "b"), schema="id bigint, v string"))


def test_identity_columns_are_not_updated(spark, led):
    led.append(T, rows(spark, (1, "n", "a")))
    with pytest.raises(LedgerError):
        led.update(T, {"id": "id + 100"}, "id = 1")
    with pytest.raises(LedgerError):
        led.merge(T, rows(spark, (1, "n", "a")), on="name", update_set={"id": "source.id + 1"})


def test_merge_cardinality(spark, led):
    s = "a bigint, b bigint, v string"
    led.create_table("a.two", s, keys=["a", "b"])
    with pytest.raises(LedgerError):
        led.merge("a.two", rows(spark, (1, 2, "x"), (1, 2, "y"), schema=s), on=["b", "a"], update_set={"v": "source.v"})
    led.create_table("a.free", "id bigint, v string")
    led.append("a.free", rows(spark, (1, "old"), schema="id bigint, v string"))
    with pytest.raises(LedgerError):
        led.merge("a.free", rows(spark, (1, "x"), (1, "y"), schema="id bigint, v string"), on="id",
                  update_set={"v": "source.v"})
    led.merge("a.free", rows(spark, (2, "x"), (2, "y"), schema="id bigint, v string"), on="id",
              update_set={"v": "source.v"})
    assert state(led, "a.free") == [(1, "old"), (2, "x"), (2, "y")]


def test_merge_on_other_columns_inserts_no_existing_key(spark, led):
    led.append(T, rows(spark, (1, "n1", "a")))
    with pytest.raises(LedgerError):
        led.merge(T, rows(spark, (1, "other", "b")), on="name", update_set={"v": "source.v"})
    led.merge(T, rows(spark, (2, "n2", "b"), (9, "n1", "c")), on="name", update_set={"v": "source.v"})
    assert state(led) == [(1, "n1", "c"), (2, "n2", "b")]


def test_unkeyed_branches_merge_without_conflict(spark, led):
    s = "id bigint, v string"
    led.create_table("a.free", s)
    led.append("a.free", rows(spark, (1, "a"), schema=s))
    led.create_branch("dev")
    led.append("a.free", rows(spark, (1, "a"), schema=s), ref="dev")
    led.append("a.free", rows(spark, (2, "b"), schema=s))
    led.merge_ref("dev", "main", on_conflict="fail")
    assert state(led, "a.free") == [(1, "a"), (1, "a"), (2, "b")]


@pytest.mark.parametrize("policy,want", [("target", "m"), ("source", "d")])
def test_unkeyed_conflicts_follow_the_policy(spark, led, policy, want):
    s = "id bigint, v string"
    led.create_table("a.free", s)
    led.append("a.free", rows(spark, (1, "a"), schema=s))
    led.create_branch("dev")
    led.update("a.free", {"v": "'d'"}, "id = 1", ref="dev")
    led.update("a.free", {"v": "'m'"}, "id = 1")
    with pytest.raises(MergeConflict):
        led.merge_ref("dev", "main", on_conflict="fail")
    led.merge_ref("dev", "main", on_conflict=policy)
    assert state(led, "a.free") == [(1, want)]


def test_schema_changes_and_drops_are_merged(spark, led):
    led.append(T, rows(spark, (1, "n", "a")))
    led.create_table("a.gone", "x bigint")
    led.create_branch("dev")
    led.add_column(T, "extra", "string", ref="dev")
    led.drop_column(T, "v", ref="dev")
    led.drop_table("a.gone", ref="dev")
    led.append(T, rows(spark, (2, "m", "b")))
    led.merge_ref("dev", "main", on_conflict="fail")
    assert led.read(T).columns == ["id", "name", "extra"]
    assert state(led) == [(1, "n", None), (2, "m", None)]
    assert "a.gone" not in led.hist.tables_at(led.hist.head("main"))


def test_merged_overwrite_is_logged_as_update(spark, led):
    led.create_branch("dev")
    led.append(T, rows(spark, (1, "n", "dev")), ref="dev")
    led.append(T, rows(spark, (1, "n", "main")))
    led.merge_ref("dev", "main", on_conflict="source", commit_id="m")
    r = led.audit_log().where("commit_id = 'm'").first()
    assert (r.n_inserted, r.n_updated) == (0, 1) and state(led) == [(1, "n", "dev")]


def test_times_with_an_offset(spark, led):
    led.append(T, rows(spark, (1, "n", "a")), ts=dt.datetime(2024, 1, 1, 12))
    assert led.read(T, ts="2024-01-01T14:30:00+02:00").count() == 1


def test_null_series_and_null_samples_are_kept(spark):
    b = dt.datetime(2024, 1, 1)
    data = [(None, b, 1, 5.0), (None, b + dt.timedelta(minutes=90), 2, 9.0)]
    data += [("a", b + dt.timedelta(minutes=20 * i), 10 + i, v) for i, v in
             enumerate([10.0, 15.0, None, None, None, None, None, 20.0, 3.0])]
    df = spark.createDataFrame(data, "s string, ts timestamp_ntz, id bigint, v double")
    out = reset_aware_increase(df, ["s"], "ts", "v", "id")
    got = {r.s: r.x for r in out.groupBy("s").agg(F.sum("inc").alias("x")).collect()}
    assert got == {None: 4.0, "a": 13.0} and out.count() == len(data)
    numbered = bucketed_row_number(df, ["s"], "ts", "id")
    assert sorted(r.rn for r in numbered.where("s is null").collect()) == [1, 2]


def test_fingerprint_sees_moved_nulls(spark):
    one = rows(spark, (1, "a", None))
    two = rows(spark, (1, None, "a"))
    assert content_fingerprint(one).first().h != content_fingerprint(two).first().h


def test_rollup_refresh_between_diverged_branches(spark, led):
    from tidemark.operators import rollup as R
    s = "id bigint, g string, amount double"
    led.create_table("a.r", s, keys=["id"])
    led.append("a.r", rows(spark, (1, "x", 1.0), (2, "x", 5.0), schema=s))
    led.create_branch("dev")
    led.append("a.r", rows(spark, (3, "x", 7.0), schema=s), ref="dev")
    led.delete("a.r", "id = 1")
    old = R.rollup(led.read("a.r", ref="dev"), ["g"], "amount")
    got = R.refresh(led, "a.r", old, ["g"], "amount", dict(ref="dev"), dict(ref="main")).collect()
    want = R.rollup(led.read("a.r"), ["g"], "amount").collect()
    assert got == want and (got[0].n_rows, float(got[0].total)) == (1, 5.0)
