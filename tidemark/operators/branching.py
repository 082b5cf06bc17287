"""Merging one branch into another with key-level conflict detection.

Fork point = nearest common ancestor of the two heads.  Each side's net change
per key since the fork is its newest change row (one shuffle on the key per
side).  A key changed on both sides with different results is a conflict:
``fail`` raises, ``source`` takes the source's row, ``target`` keeps the target's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import versioned as V
from tidemark.plans.lineage import LedgerError, MergeConflict, NoVersionError, TableNotFound
from tidemark.plans.schema import TableSchema


def _side(led, table: str, head: str | None, fork: str | None):
    """(net change rows in logical columns + _op, schema at head)."""
    hist = led.hist
    recs = hist.table_commits(table, head)
    fork_ids = set(hist.lineage(fork)) if fork else set()
    new = [r for r in recs if r.commit_id not in fork_ids]
    schema = recs[-1].schema
    if any(r.commit_id in hist.expired_ids() for r in new):
        raise NoVersionError(f"changes of {table} since the fork point have expired")
    data = [r for r in new if r.n_rows > 0]
    if not data:
        return None, schema
    phys = V.physical_schema([r.schema for r in recs])
    read_schema = phys.add("commit_id", "string")
    ch = led.store.read_changes(table, [r.commit_id for r in data], read_schema) \
        .select(*[f.name for f in phys.fields])
    latest = V.latest_per_key(ch, schema.key_phys)
    return V.to_logical(latest, schema, keep_meta=True).drop("_seq"), schema


def _fork_schema(hist, table: str, fork: str | None) -> TableSchema | None:
    if fork is None or table not in hist.tables_at(fork):
        return None
    return hist.table_commits(table, fork)[-1].schema


def _merged_schema(target: TableSchema, source: TableSchema, fork: TableSchema | None) -> TableSchema:
    """The target's schema with what the source changed since the fork: renamed and dropped
    columns (by field id; a drop removes the column for all rows) and added ones."""
    out = target
    source_names = {f.id: f.name for f in source.fields}
    for f in fork.fields if fork else ():
        now = source_names.get(f.id)
        if now is None and out.has(f.name) and f.name not in out.keys:
            out = out.drop(f.name)
        elif now is not None and now != f.name and out.has(f.name) and not out.has(now):
            out = out.rename(f.name, now)
    for f in source.fields:
        if out.has(f.name):
            if out.field(f.name).type != f.type:
                raise LedgerError(f"type clash on {f.name}: {out.field(f.name).type} vs {f.type}")
        elif fork is None or all(g.id != f.id for g in fork.fields):
            out = out.add(f.name, f.type)
    return out


def _identity(schema: TableSchema) -> list[str]:
    """Key columns; rows of a table without keys are told apart by their row id."""
    return list(schema.keys) or ["_row_id"]


def _images_differ(keys, cols) -> F.Column:
    same = F.col("s._op").eqNullSafe(F.col("t._op"))
    for c in cols:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    # two deletes agree whatever the images say
    both_deleted = (F.col("s._op") == "D") & (F.col("t._op") == "D")
    return ~(same | both_deleted)


def _conflicts(src: DataFrame, tgt: DataFrame, keys, cols) -> DataFrame:
    s = src.alias("s")
    t = tgt.alias("t")
    cond = None
    for k in keys:
        c = F.col(f"s.{k}") == F.col(f"t.{k}")
        cond = c if cond is None else cond & c
    j = s.join(t, cond, "inner").where(_images_differ(keys, cols))
    return j.select(*[F.col(f"s.{k}").alias(k) for k in keys],
                    F.col("s._op").alias("source_op"), F.col("t._op").alias("target_op"))


def _align(df: DataFrame, cols, schema: TableSchema) -> DataFrame:
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(schema.field(c).type))
    return df


def conflicts(led, source: str, target: str, table: str) -> DataFrame:
    s_head, t_head = led.hist.head(source), led.hist.head(target)
    fork = led.hist.fork_point(s_head, t_head)
    src, s_schema = _side(led, table, s_head, fork)
    tgt, t_schema = _side(led, table, t_head, fork)
    merged = _merged_schema(t_schema, s_schema, _fork_schema(led.hist, table, fork))
    keys = _identity(merged)
    types = {k: merged.field(k).type if merged.keys else "string" for k in keys}
    out_schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", source_op string, target_op string"
    if src is None or tgt is None:
        return led.spark.createDataFrame([], out_schema)
    cols = [c for c in merged.names if c not in keys]
    return _conflicts(_align(src, cols, merged), _align(tgt, cols, merged), keys, cols)


def _ops_at_target(src: DataFrame, tgt: DataFrame, keys) -> DataFrame:
    """Change rows of the source with the operation they are on the target: a key that the
    target inserted too is an update there, an update of a key it deleted an insert."""
    there = tgt.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_op").alias("_t_op"))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_t_{k}")
        cond = c if cond is None else cond & c
    op = (F.when(F.col("_op") == "D", "D")
          .when(F.col("_t_op") == "D", "I")
          .when((F.col("_op") == "I") & F.col("_t_op").isNotNull(), "U")
          .otherwise(F.col("_op")))
    return src.join(there, cond, "left").withColumn("_op", op).drop("_t_op", *[f"_t_{k}" for k in keys])


def _drop_tables(tx, hist, s_head, t_head, fork, on_conflict) -> None:
    """Carry tables dropped on the source; one that the target changed meanwhile is a conflict."""
    if fork is None:
        return
    here, now = set(hist.tables_at(t_head)), set(hist.tables_at(s_head))
    fork_ids = set(hist.lineage(fork))
    for table in sorted((set(hist.tables_at(fork)) & here) - now):
        changed = any(r.commit_id not in fork_ids for r in hist.table_commits(table, t_head))
        if changed and on_conflict == "fail":
            raise MergeConflict(f"{table} was dropped on the source and changed on the target", [])
        if not changed or on_conflict == "source":
            tx.drop_table(table)


def merge_ref(led, source: str, target: str, on_conflict: str, ts, message: str,
              tables, commit_id) -> str | None:
    if on_conflict not in ("fail", "source", "target"):
        raise ValueError("on_conflict must be fail, source or target")
    hist = led.hist
    s_head, t_head = hist.head(source), hist.head(target)
    fork = hist.fork_point(s_head, t_head)
    if fork == s_head:
        return None                      # nothing to merge
    tx = led.transaction(target, ts=ts, commit_id=commit_id,
                         message=message or f"merge {source} into {target}")
    if not tables:
        tables = hist.tables_at(s_head)
        _drop_tables(tx, hist, s_head, t_head, fork, on_conflict)
    t_tables = set(hist.tables_at(t_head))
    for table in tables:
        src, s_schema = _side(led, table, s_head, fork)
        if table not in t_tables:
            if _fork_schema(hist, table, fork) is not None and src is None:
                continue                 # dropped on the target, untouched on the source
            # table created on the source branch: create it on the target too
            tx.create_table(table, s_schema.struct(), s_schema.keys, s_schema.partition_by)
            if src is not None:
                tx.put_changes(table, src, "merge_ref")
            continue
        tgt, t_schema = _side(led, table, t_head, fork)
        merged = _merged_schema(t_schema, s_schema, _fork_schema(hist, table, fork))
        if src is None:
            if merged != t_schema:
                tx.put_schema(table, merged, "merge_ref")
            continue
        keys = _identity(merged)
        cols = [c for c in merged.names if c not in keys]
        src = _align(src, cols, merged).select(*keys, *cols, "_op")
        if tgt is not None:
            tgt = _align(tgt, cols, merged)
            clash = _conflicts(src, tgt, keys, cols)
            if on_conflict == "fail":
                sample = clash.limit(10).collect()
                if sample:
                    raise MergeConflict(f"{clash.count()} conflicting keys in {table}",
                                        [r.asDict() for r in sample])
            elif on_conflict == "target":
                # conflicts are bounded by the smaller side's change count; let AQE pick the join
                src = src.join(clash.select(*keys), keys, "left_anti")
            src = _ops_at_target(src, tgt, keys)
        tx.put_changes(table, src, "merge_ref", schema=merged)
    if not tx.tables:
        return None
    return tx.commit()
