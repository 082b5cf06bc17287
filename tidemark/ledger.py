"""The ledger facade: versioned tables, branches and tags over one root folder.

    led = Ledger.open(spark, root)
    led.create_table("sales.orders", schema, keys=["o_orderkey"])
    led.append("sales.orders", df)
    led.read("sales.orders", ts=datetime(2024, 1, 2))          # TIMESTAMP AS OF
    led.merge("sales.orders", staging, on=["o_orderkey"],
              update_set={"o_orderstatus": "source.o_orderstatus"})
    led.create_branch("dev", from_ref="main")
    led.merge_ref("dev", "main", on_conflict="source")

Reads are lazy DataFrames; writes run one Spark job per table touched, then
publish a single commit row.  One writer per root is assumed.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import versioned as V
from tidemark.operators import writes as W
from tidemark.plans.lineage import (BaseRec, CommitRec, LedgerError,
                                    MergeConflict, NoVersionError, RefNotFound, RefRec,
                                    TableNotFound)
from tidemark.plans.schema import TableSchema
from tidemark.sources.store import LedgerStore

__all__ = ["Ledger", "Transaction", "LedgerError", "NoVersionError", "TableNotFound",
           "RefNotFound", "MergeConflict"]


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _ts(x) -> dt.datetime | None:
    """Naive UTC time; a time with an offset is converted."""
    if x is None:
        return x
    t = x if isinstance(x, dt.datetime) else dt.datetime.fromisoformat(str(x))
    return t if t.tzinfo is None else t.astimezone(dt.timezone.utc).replace(tzinfo=None)


class Ledger:
    def __init__(self, spark: SparkSession, root: str, broadcast_rows: int = V.DEFAULT_BROADCAST_ROWS):
        self.spark = spark
        self.store = LedgerStore(spark, root)
        self.broadcast_rows = broadcast_rows
        self.hist = self.store.load_history()

    # -- opening ----------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, root: str, **kw) -> "Ledger":
        led = cls(spark, root, **kw)
        if "main" not in led.hist.ref_state():
            led._ref_event("main", "branch", None, "create", "")
        return led

    @property
    def root(self) -> str:
        return self.store.root

    def refresh(self) -> None:
        self.hist = self.store.load_history()

    def _next_seq(self) -> int:
        return self.hist.max_seq + 1

    def _ref_event(self, name, kind, commit_id, action, created_from, ts=None):
        rec = RefRec(self._next_seq(), name, kind, commit_id, action, created_from, _ts(ts) or _now())
        self.store.append_log("refs", [rec])
        self.hist.refs.append(rec)
        return rec

    # -- reading ----------------------------------------------------------
    def cut(self, ref: str | None = "main", commit: str | None = None, ts=None) -> str | None:
        return self.hist.resolve(ref, commit, _ts(ts))

    def schema(self, table: str, ref: str | None = "main", commit: str | None = None,
               ts=None) -> TableSchema:
        return self.hist.table_commits(table, self.cut(ref, commit, ts))[-1].schema

    def state(self, table: str, ref: str | None = "main", commit: str | None = None,
              ts=None) -> tuple[DataFrame, TableSchema]:
        return V.table_state(self.store, self.hist, table, self.cut(ref, commit, ts),
                             self.broadcast_rows)

    def read(self, table: str, ref: str | None = "main", commit: str | None = None, ts=None,
             days: tuple | None = None, where: dict | None = None) -> DataFrame:
        """Table as of a ref head, a commit, or a time (``TIMESTAMP AS OF``).

        ``where`` maps source columns to a value or to bounds ``(low, high)``, both inclusive,
        None for an open end.  Of the table's partition transforms (day, identity, truncate,
        bucket) each one on such a column prunes the scan by a predicate derived from it.
        ``days=(lo, hi)`` prunes day partitions (inclusive) of a table partitioned by
        ``("day", col)`` before the scan.
        """
        st, schema = self.state(table, ref, commit, ts)
        for col, bounds in (where or {}).items():
            f = schema.field(col)
            for cond in V.partition_predicates(schema, f, bounds):
                st = st.where(cond)
            lo, hi = bounds if isinstance(bounds, tuple) else (bounds, bounds)
            if lo is not None:
                st = st.where(F.col(f.phys) >= F.lit(lo).cast(f.type))
            if hi is not None:
                st = st.where(F.col(f.phys) <= F.lit(hi).cast(f.type))
        if days is not None:
            pcols = [p for p in V.partition_columns(schema) if p[0].startswith("_p_day_")]
            if not pcols:
                raise LedgerError(f"{table} is not partitioned by day")
            lo, hi = days
            st = st.where(F.col(pcols[0][0]).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
        return V.to_logical(st, schema)

    def changes(self, table: str, commit: str) -> DataFrame:
        """Change rows one commit wrote to ``table``: logical columns + change_op (I/U/D)."""
        recs = self.hist.table_commits(table, commit)
        rec = recs[-1]
        if rec.commit_id != commit:
            raise LedgerError(f"commit {commit} did not change {table}")
        phys = V.physical_schema([r.schema for r in recs])
        if rec.n_rows:
            df = self.store.read_changes(table, [commit], phys.add("commit_id", "string"))
        else:
            df = self.spark.createDataFrame([], phys)
        cols = [F.col(f.phys).cast(f.type).alias(f.name) for f in rec.schema.fields]
        return df.select(*cols, F.col("_op").alias("change_op"))

    def describe(self, table: str, ref: str | None = "main", commit: str | None = None,
                 ts=None) -> DataFrame:
        """``DESCRIBE t``: one row per column (col_name, data_type, is_key)."""
        schema = self.schema(table, ref, commit, ts)
        rows = [(f.name, f.type, f.name in schema.keys, i + 1) for i, f in enumerate(schema.fields)]
        return self.spark.createDataFrame(rows, "col_name string, data_type string, is_key boolean, "
                                                "ordinal long")

    def commits_frame(self) -> DataFrame:
        return self.store.log_frame("commits")

    def history(self, table: str, ref: str | None = "main", commit: str | None = None) -> DataFrame:
        """``t.history``: the table's commits in the ref's lineage (expired ones left out)."""
        cut = self.cut(ref, commit)
        recs = self.hist.table_commits(table, cut)
        ids = [r.commit_id for r in recs if r.commit_id not in self.hist.expired_ids()]
        c = self.commits_frame().where(F.col("table_name") == table).where(F.col("commit_id").isin(ids))
        return c.select(F.col("ts").alias("made_current_at"), "commit_id", "parent_id", "seq", "op",
                        F.lit(True).alias("is_current_ancestor"))

    def snapshots(self, table: str, ref: str | None = "main", commit: str | None = None) -> DataFrame:
        """``t.snapshots``: per commit, its operation and row counts by change kind."""
        cut = self.cut(ref, commit)
        ids = [r.commit_id for r in self.hist.table_commits(table, cut)
               if r.commit_id not in self.hist.expired_ids()]
        c = self.commits_frame().where(F.col("table_name") == table).where(F.col("commit_id").isin(ids))
        return c.select(F.col("ts").alias("committed_at"), "commit_id", "parent_id", "seq",
                        F.col("op").alias("operation"), F.col("n_inserted").alias("added_rows"),
                        F.col("n_updated").alias("updated_rows"),
                        F.col("n_deleted").alias("deleted_rows"))

    def audit_log(self, ref: str | None = None) -> DataFrame:
        """Every commit (all tables), or those in a ref's lineage."""
        c = self.commits_frame()
        if ref is not None:
            c = c.where(F.col("commit_id").isin(self.hist.lineage(self.hist.head(ref))))
        return c.select("seq", "commit_id", "parent_id", "ref", "table_name", "ts", "op", "author",
                        "message", "n_inserted", "n_updated", "n_deleted")

    def diff(self, table: str, old: dict, new: dict) -> DataFrame:
        """Row-level diff between two versions, each ``dict(ref=, commit=, ts=)``.

        Columns are matched by field id, over the union of both versions' columns: added,
        dropped and renamed ones show.  A table with keys gives added, removed and changed
        rows (``row_diff``); one without gives added and removed rows with their multiplicity
        (``multiset_diff``).  Only rows that some commit between the two versions touched can
        differ; when the commit log says those commits hold at most ``broadcast_rows`` change
        rows, both states are built for those keys or row ids only (broadcast semi join before
        the window), so the diff costs the size of the change, not of the table.  Across a
        dropped column all rows are compared.
        """
        cut_o, cut_n = self.cut(**old), self.cut(**new)
        so = self.hist.table_commits(table, cut_o)[-1].schema
        sn = self.hist.table_commits(table, cut_n)[-1].schema
        if so.key_phys != sn.key_phys:
            raise LedgerError("diff needs the same identity columns on both sides")
        gone = {f.id for f in so.fields} - {f.id for f in sn.fields}
        came = {f.id for f in sn.fields} - {f.id for f in so.fields}
        # a column that went differs in rows that no commit touched; one that came is NULL there
        whole = gone or (came and cut_o not in self.hist.lineage(cut_n))
        touched = None if whole else self._touched_keys(table, cut_o, cut_n)
        a, _ = V.table_state(self.store, self.hist, table, cut_o, self.broadcast_rows, only_keys=touched)
        b, _ = V.table_state(self.store, self.hist, table, cut_n, self.broadcast_rows, only_keys=touched)
        a, b = (d.select("*", *[F.lit(None).cast(f.type).alias(f.phys) for f in s.fields if f.phys not in d.columns])
                for d, s in ((a, so), (b, sn)))
        return (V.row_diff if sn.keys else V.multiset_diff)(a, b, so, sn)

    def _touched_keys(self, table: str, cut_a: str, cut_b: str):
        """Physical keys (or row ids) changed on either side since the common ancestor, or None when
        there are too many to broadcast (or the table was re-created in between)."""
        la, lb = set(self.hist.lineage(cut_a)), set(self.hist.lineage(cut_b))
        side = []
        for cut, other in ((cut_a, lb), (cut_b, la)):
            recs = self.hist.table_commits(table, cut)
            mine = [r for r in recs if r.commit_id not in other]
            if any("create" in r.ops for r in mine):
                return None
            side.append((recs, [r for r in mine if r.n_rows > 0]))
        if sum(r.n_rows for _, m in side for r in m) > self.broadcast_rows:
            return None
        out = None
        for recs, mine in side:
            if not mine:
                continue
            phys = V.physical_schema([r.schema for r in recs])
            ch = self.store.read_changes(table, [r.commit_id for r in mine], phys.add("commit_id", "string"))
            k = ch.select(*recs[-1].schema.key_phys)
            out = k if out is None else out.unionByName(k)
        if out is None:                      # nothing changed in between
            recs = side[1][0]
            phys = V.physical_schema([r.schema for r in recs])
            return self.spark.createDataFrame([], T.StructType([phys[k] for k in recs[-1].schema.key_phys]))
        return out

    def tables(self, namespace: str | None = None, ref: str | None = "main") -> list[str]:
        ts = self.hist.tables_at(self.hist.head(ref))
        return [t for t in ts if namespace is None or t.split(".")[0] == namespace]

    def namespaces(self, ref: str | None = "main") -> list[str]:
        cut = self.hist.head(ref)
        ns = {r.table_name.split(".")[0] for cid in self.hist.lineage(cut) if cid
              for r in self.hist.commit_index()[cid] if r.table_name}
        return sorted(ns)

    def refs(self) -> DataFrame:
        rows = [(name, kind, cid, src) for name, (kind, cid, src) in self.hist.ref_state().items()]
        return self.spark.createDataFrame(rows, "name string, kind string, commit_id string, "
                                                "created_from string")

    # -- refs -------------------------------------------------------------
    def create_branch(self, name: str, from_ref: str | None = "main", commit: str | None = None,
                      if_not_exists: bool = True, ts=None) -> str | None:
        st = self.hist.ref_state()
        if name in st:
            if if_not_exists:
                return st[name][1]
            raise LedgerError(f"reference {name!r} already exists")
        cid = commit if commit is not None else self.hist.head(from_ref)
        if commit is not None:
            self.hist.commit(commit)
        self._ref_event(name, "branch", cid, "create", commit or from_ref, ts)
        return cid

    def tag(self, name: str, ref: str | None = "main", commit: str | None = None, ts=None) -> str:
        if name in self.hist.ref_state():
            raise LedgerError(f"reference {name!r} already exists")
        cid = commit if commit is not None else self.hist.head(ref)
        self._ref_event(name, "tag", cid, "create", commit or ref, ts)
        return cid

    def delete_ref(self, name: str) -> None:
        kind, cid, _ = self.hist.ref_state()[name]
        self._ref_event(name, kind, cid, "delete", "")

    # -- writing ----------------------------------------------------------
    def transaction(self, ref: str = "main", ts=None, commit_id: str | None = None,
                    message: str = "", author: str = "") -> "Transaction":
        return Transaction(self, ref, _ts(ts), commit_id, message, author)

    def _single(self, fn_name, *args, ref="main", ts=None, commit_id=None, message="", author="",
                **kw) -> str:
        with self.transaction(ref, ts, commit_id, message, author) as tx:
            getattr(tx, fn_name)(*args, **kw)
        return tx.commit_id

    def create_namespace(self, namespace: str, if_not_exists: bool = True, **c):
        """``CREATE NAMESPACE [IF NOT EXISTS]``: recorded as a commit on the ref."""
        if namespace in self.namespaces(ref=c.get("ref", "main")):
            if if_not_exists:
                return None
            raise LedgerError(f"namespace {namespace!r} already exists")
        return self._single("create_namespace", namespace, **c)

    def set_properties(self, table, props: dict, **c):
        """``ALTER TABLE t SET TBLPROPERTIES``; ``compression`` sets the Parquet codec."""
        return self._single("set_properties", table, props, **c)

    def properties(self, table, ref="main", commit=None) -> dict:
        out: dict = {}
        for r in self.hist.table_commits(table, self.cut(ref, commit)):
            out.update(r.props.get("table_properties", {}))
        return out

    def create_table(self, table, schema, keys=(), partition_by=(), if_not_exists=False, **c):
        if if_not_exists and table in self.tables(ref=c.get("ref", "main")):
            return None
        return self._single("create_table", table, schema, keys=keys, partition_by=partition_by, **c)

    def drop_table(self, table, if_exists=False, **c):
        if if_exists and table not in self.tables(ref=c.get("ref", "main")):
            return None
        return self._single("drop_table", table, **c)

    def append(self, table, rows, by_name=True, check_keys=True, **c):
        return self._single("append", table, rows, by_name=by_name, check_keys=check_keys, **c)

    def merge(self, table, source, on, update_set=None, insert_values=None, **c):
        return self._single("merge", table, source, on, update_set=update_set,
                            insert_values=insert_values, **c)

    def delete(self, table, where, **c):
        return self._single("delete", table, where, **c)

    def update(self, table, set_, where=None, **c):
        return self._single("update", table, set_, where=where, **c)

    def add_column(self, table, name, type_, if_not_exists=False, **c):
        return self._single("add_column", table, name, type_, if_not_exists=if_not_exists, **c)

    def drop_column(self, table, name, if_exists=False, **c):
        return self._single("drop_column", table, name, if_exists=if_exists, **c)

    def rename_column(self, table, old, new, **c):
        return self._single("rename_column", table, old, new, **c)

    def widen_column(self, table, name, type_, **c):
        return self._single("widen_column", table, name, type_, **c)

    # -- branch merge -----------------------------------------------------
    def merge_ref(self, source: str, target: str, on_conflict: str = "fail", ts=None,
                  message: str = "", tables: list[str] | None = None,
                  commit_id: str | None = None) -> str | None:
        from tidemark.operators.branching import merge_ref
        return merge_ref(self, source, target, on_conflict, _ts(ts), message, tables, commit_id)

    def conflicts(self, source: str, target: str, table: str) -> DataFrame:
        from tidemark.operators.branching import conflicts
        return conflicts(self, source, target, table)

    # -- maintenance ------------------------------------------------------
    def compact(self, table: str, ref: str | None = "main", commit: str | None = None) -> BaseRec:
        from tidemark.operators.maintenance import compact
        return compact(self, table, ref, commit)

    def expire(self, older_than, retain_last: int = 1, purge: bool = True) -> list[str]:
        """Expire old commits; ``purge`` deletes their now unreachable change files."""
        from tidemark.operators.maintenance import expire
        return expire(self, _ts(older_than), retain_last, purge)

    def sql(self, query: str, views: dict | None = None) -> DataFrame:
        """Run SQL over versions: ``views`` maps a view name to read() kwargs."""
        for name, kw in (views or {}).items():
            kw = dict(kw)
            table = kw.pop("table")
            self.read(table, **kw).createOrReplaceTempView(name)
        return self.spark.sql(query)


class Transaction:
    """Collects table operations; ``commit()`` writes all change rows, then one
    commit row per table with a shared commit id (multi-table commits)."""

    def __init__(self, led: Ledger, ref: str, ts, commit_id, message, author):
        self.led = led
        self.ref = ref
        self.ts = ts or _now()
        self.commit_id = commit_id or uuid.uuid4().hex[:16]
        self.message = message
        self.author = author
        self.parent = led.hist.head(ref)
        kind = led.hist.ref_state()[ref][0]
        if kind != "branch":
            raise LedgerError(f"cannot commit to {kind} {ref!r}")
        self.seq = led._next_seq()
        # table -> dict(schema, ops, frames, append_only, created)
        self.tables: dict[str, dict] = {}

    def __enter__(self):
        return self

    def __exit__(self, et, ev, tb):
        if et is None:
            self.commit()
        return False

    def now(self) -> Column:
        """The commit's own time as a column, one value for all its rows and tables.  Clock
        functions in the expressions of ``update``, ``merge`` and ``delete`` mean the same."""
        return F.lit(self.ts).cast("timestamp_ntz").cast("timestamp")

    # -- staging ----------------------------------------------------------
    def _entry(self, table: str, create: bool = False) -> dict:
        if table in self.tables:
            return self.tables[table]
        if create:
            e = {"schema": None, "ops": [], "frames": [], "append_only": True, "props": {}}
        else:
            schema = self.led.hist.table_commits(table, self.parent)[-1].schema
            e = {"schema": schema, "ops": [], "frames": [], "append_only": True, "props": {}}
        self.tables[table] = e
        return e

    def _current(self, table: str, only_keys: DataFrame | None = None) -> tuple[DataFrame, TableSchema]:
        e = self._entry(table)
        if e["frames"]:
            raise LedgerError("read-after-write inside one transaction is not supported; "
                              "use separate commits")
        st, _ = V.table_state(self.led.store, self.led.hist, table, self.parent,
                              self.led.broadcast_rows, only_keys=only_keys)
        return V.to_logical(st, e["schema"]), e["schema"]

    def create_table(self, table, schema, keys=(), partition_by=()):
        if table in self.led.hist.tables_at(self.parent):
            raise LedgerError(f"table {table} already exists")
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        e = self._entry(table, create=True)
        e["schema"] = TableSchema.from_struct(schema, keys, partition_by)
        e["ops"].append("create")

    def drop_table(self, table):
        e = self._entry(table)
        e["ops"].append("drop")

    def create_namespace(self, namespace):
        e = self.tables.setdefault(f"{namespace}.", {"schema": TableSchema(()), "ops": [], "frames": [],
                                                       "append_only": True, "props": {}})
        e["ops"].append("namespace")

    def set_properties(self, table, props: dict):
        e = self._entry(table)
        e["props"].setdefault("table_properties", {}).update({k: str(v) for k, v in props.items()})
        e["ops"].append("properties")

    def add_column(self, table, name, type_, if_not_exists=False):
        e = self._entry(table)
        e["schema"] = e["schema"].add(name, type_, if_not_exists)
        e["ops"].append("evolve")

    def drop_column(self, table, name, if_exists=False):
        e = self._entry(table)
        e["schema"] = e["schema"].drop(name, if_exists)
        e["ops"].append("evolve")

    def rename_column(self, table, old, new):
        e = self._entry(table)
        e["schema"] = e["schema"].rename(old, new)
        e["ops"].append("evolve")

    def widen_column(self, table, name, type_):
        e = self._entry(table)
        e["schema"] = e["schema"].widen(name, type_)
        e["ops"].append("evolve")

    def append(self, table, rows: DataFrame, by_name=True, check_keys=True):
        """Insert rows.  ``check_keys=True`` (keyed tables) rejects NULL, duplicate and
        already-present keys, and lets reads skip the latest-per-key shuffle for this
        commit.  ``check_keys=False`` makes the append an upsert: a later row for an
        existing key replaces it; a NULL key fails the write.  Rows staged earlier in the
        same transaction count as present."""
        e = self._entry(table)
        schema = e["schema"]
        rows = W.conform(rows, schema, by_name)
        keys = list(schema.keys)
        if keys and check_keys:
            n, most, nulls = W.key_profile(rows, keys)
            if nulls:
                raise LedgerError(f"NULL identity in rows appended to {table}")
            if most > 1:
                dup = W.duplicate_key(rows, keys)
                raise LedgerError(f"duplicate key {dup.asDict()} in rows appended to {table}")
            for staged in e["frames"]:
                clash = staged.select(*keys).join(rows.select(*keys), keys, "left_semi").limit(1).collect()
                if clash:
                    raise LedgerError(f"key {clash[0].asDict()} already staged for {table}")
            if "create" not in e["ops"] and n > 0 and not e["frames"]:
                new_keys = rows.select(*keys)
                if n <= self.led.broadcast_rows:
                    # state restricted to the new keys: no shuffle of the table
                    cur, _ = self._current(table, only_keys=new_keys)
                    clash = cur.select(*keys).limit(1).collect()
                else:
                    cur, _ = self._current(table)
                    clash = cur.select(*keys).join(new_keys, keys, "left_semi").limit(1).collect()
                if clash:
                    raise LedgerError(f"key {clash[0].asDict()} already present in {table}")
        elif keys:
            rows = W.require_keys(rows, keys, table)
            e["append_only"] = False
        # unkeyed tables: every row gets a fresh row id, so appends never overwrite
        e["frames"].append(W.append_changes(rows))
        e["ops"].append("append")

    def merge(self, table, source: DataFrame, on, update_set=None, insert_values=None):
        on = [on] if isinstance(on, str) else list(on)
        schema = self._entry(table)["schema"]
        if schema.keys and set(update_set or ()) & set(schema.keys):
            raise LedgerError(f"MERGE cannot update identity columns {list(schema.keys)}")
        on_keys = bool(schema.keys) and set(on) == set(schema.keys)
        n, most, nulls = W.key_profile(source, on)
        if on_keys and nulls:
            raise LedgerError(f"NULL identity in the MERGE source for {table}")
        if most > 1 and on_keys:
            dup = W.duplicate_key(source, on)
            raise LedgerError(f"MERGE source has several rows for key {dup.asDict()}")
        small = n <= self.led.broadcast_rows
        if small and on_keys:
            # only target rows whose key is in the (small, counted) source can match
            target, schema = self._current(table, only_keys=source.select(*schema.keys))
        else:
            target, schema = self._current(table)
        if most > 1:
            # several source rows may share unmatched values; a target row may match one at most
            several = source.groupBy(*on).count().where("count > 1").select(*on)
            twice = target.join(several, on, "left_semi").limit(1).collect()
            if twice:
                raise LedgerError(f"several MERGE source rows match the target row {twice[0].asDict()}")
        if schema.keys and not on_keys:
            self._check_inserted_keys(table, target, source, schema, on, insert_values)
        e = self._entry(table)
        e["frames"].append(W.merge_changes(target, source, schema, on, W.pin_clock(update_set, self.ts),
                                           W.pin_clock(insert_values, self.ts), broadcast_keys=small and not on_keys))
        e["append_only"] = False
        e["ops"].append("merge")

    def _check_inserted_keys(self, table, target, source, schema, on, insert_values):
        """A MERGE matched on other columns must not insert NULL, repeated or existing keys."""
        keys = list(schema.keys)
        new = W.merge_changes(target, source, schema, on, None, insert_values or {
            c: F.col(f"source.{c}") for c in source.columns if schema.has(c)}, False).select(*keys)
        _, most, nulls = W.key_profile(new, keys)
        if nulls or most > 1:
            raise LedgerError(f"MERGE would insert NULL or repeated identities into {table}")
        there = target.select(*keys).join(new, keys, "left_semi").limit(1).collect()
        if there:
            raise LedgerError(f"MERGE would insert the existing key {there[0].asDict()} into {table}")

    def delete(self, table, where):
        cur, schema = self._current(table)
        e = self._entry(table)
        e["frames"].append(W.delete_changes(cur, schema, W.pin_clock(where, self.ts)))
        e["append_only"] = False
        e["ops"].append("delete")

    def update(self, table, set_: dict, where=None):
        cur, schema = self._current(table)
        if set(set_) & set(schema.keys):
            raise LedgerError(f"UPDATE cannot set identity columns {list(schema.keys)}; delete and append instead")
        e = self._entry(table)
        e["frames"].append(W.update_changes(cur, schema, W.pin_clock(where, self.ts), W.pin_clock(set_, self.ts)))
        e["append_only"] = False
        e["ops"].append("update")

    def put_changes(self, table, frame: DataFrame, op: str, schema: TableSchema | None = None):
        """Stage prepared change rows (logical columns + ``_op``); used by branch merges."""
        e = self._entry(table)
        if schema is not None:
            e["schema"] = schema
        e["frames"].append(frame)
        e["append_only"] = False
        e["ops"].append(op)

    def put_schema(self, table, schema: TableSchema, op: str):
        """Stage a schema without rows; used by branch merges."""
        e = self._entry(table)
        e["schema"] = schema
        e["ops"].append(op)

    # -- publishing -------------------------------------------------------
    def commit(self) -> str:
        led = self.led
        if not self.tables:
            raise LedgerError("empty transaction")
        if self.commit_id in led.hist.commit_index():
            raise LedgerError(f"commit id {self.commit_id!r} is taken")   # its data must never be overwritten
        if led.hist.head(self.ref) != self.parent:
            raise LedgerError(f"{self.ref} moved during the transaction")
        self.seq = led._next_seq()
        recs = []
        for table, e in self.tables.items():
            schema: TableSchema = e["schema"]
            counts = {}
            if e["frames"]:
                frame = e["frames"][0]
                for f in e["frames"][1:]:
                    frame = frame.unionByName(f, allowMissingColumns=True)
                phys = V.to_physical(frame, schema, self.seq, F.col("_op"))
                pcols = [p[0] for p in V.partition_columns(schema)]
                props = {}
                if "create" not in e["ops"]:
                    for r in led.hist.table_commits(table, self.parent):
                        props.update(r.props.get("table_properties", {}))
                props.update(e["props"].get("table_properties", {}))
                counts = led.store.write_changes(table, self.commit_id, phys, pcols,
                                                 compression=props.get("compression", "snappy"))
            recs.append(CommitRec(
                commit_id=self.commit_id, parent_id=self.parent, seq=self.seq, ref=self.ref,
                table_name=table, ts=self.ts, op="+".join(dict.fromkeys(e["ops"])),
                schema_json=schema.to_json(), props_json=json.dumps(e["props"]),
                author=self.author, message=self.message,
                n_inserted=counts.get("I", 0), n_updated=counts.get("U", 0),
                n_deleted=counts.get("D", 0), append_only=e["append_only"]))
        # publishing the commit row is the atomic step
        led.store.append_log("commits", recs)
        led.hist.commits.extend(recs)
        return self.commit_id
