"""Change-row builders for the write operations (logical columns + ``_op``).

Each builder returns a lazy DataFrame of the rows one commit adds to the change
table; the ledger writes it and only then publishes the commit row.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import LedgerError
from tidemark.plans.schema import TableSchema


def _expr(e) -> Column:
    return e if isinstance(e, Column) else F.expr(e)


# clock functions of SQL, outside quotes and not as a part of a longer name
_CLOCK = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
                    r"""|(?<![\w.])(now|current_timestamp|localtimestamp|current_date|curdate)\b(\s*\(\s*\))?""",
                    re.IGNORECASE)


def pin_clock(e, ts: dt.datetime):
    """SQL write expressions with their clock functions set to the commit's own time.

    A commit may take several jobs, and a lost executor may run a task again: each job has its
    own current time, the commit has one.  Takes an expression, a dict of them, or None;
    ``Column`` objects stay as they are, and so does ``now`` without parentheses.
    """
    if isinstance(e, dict):
        return {k: pin_clock(v, ts) for k, v in e.items()}
    if not isinstance(e, str):
        return e
    at = ts.strftime("%Y-%m-%d %H:%M:%S.%f")

    def literal(m: re.Match) -> str:
        name = (m.group(1) or "").lower()
        if not name or (name in ("now", "curdate", "localtimestamp") and not m.group(2)):
            return m.group(0)
        if name in ("current_date", "curdate"):
            return f"DATE'{at[:10]}'"
        return f"TIMESTAMP_NTZ'{at}'" if name == "localtimestamp" else f"TIMESTAMP'{at}'"
    return _CLOCK.sub(literal, e)


def conform(df: DataFrame, schema: TableSchema, by_name: bool = True) -> DataFrame:
    """Rows of ``df`` shaped to the table schema.

    By name: missing columns are NULL, unknown columns are an error.
    Positional (``by_name=False``, SQL ``INSERT ... VALUES``): arity must match.
    """
    names = schema.names
    if by_name:
        extra = [c for c in df.columns if c not in names and c != "_row_id"]
        if extra:
            raise LedgerError(f"unknown columns {extra}; table has {names}")
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.type).alias(f.name)
                for f in schema.fields]
    else:
        if len(df.columns) != len(names):
            raise LedgerError(f"expected {len(names)} values per row, got {len(df.columns)}")
        cols = [F.col(c).cast(f.type).alias(f.name) for c, f in zip(df.columns, schema.fields)]
    return df.select(*cols)


def duplicate_key(df: DataFrame, keys: list[str]):
    """One duplicated key (or None).  A hash aggregate with partial counts, so a
    hot key costs one row per task; ``limit(1)`` bounds what reaches the driver."""
    row = (df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect())
    return row[0] if row else None


def key_profile(df: DataFrame, keys: list[str]) -> tuple[int, int, int]:
    """(rows, max rows per key, rows with a NULL key part) in one job.  The per-key
    count is a partial hash aggregate, so a hot key costs one row per task."""
    any_null = None
    for k in keys:
        c = F.col(k).isNull()
        any_null = c if any_null is None else any_null | c
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    r = per_key.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n"),
                    F.coalesce(F.max("_c"), F.lit(0)).cast("long").alias("m"),
                    F.coalesce(F.sum(F.when(any_null, F.col("_c"))), F.lit(0)).cast("long").alias("z")
                    ).first()
    return int(r["n"]), int(r["m"]), int(r["z"])


def require_keys(rows: DataFrame, keys: list[str], table: str) -> DataFrame:
    """``rows`` with a check inside the plan: the write fails on a NULL key part."""
    for k in keys:
        rows = rows.withColumn(k, F.coalesce(F.col(k), F.raise_error(
            F.lit(f"NULL identity {k} in rows appended to {table}")).cast(rows.schema[k].dataType)))
    return rows


def append_changes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_op", F.lit("I"))


def delete_changes(state: DataFrame, schema: TableSchema, where) -> DataFrame:
    keys = list(schema.keys) or ["_row_id"]
    return state.where(_expr(where)).select(*keys).withColumn("_op", F.lit("D"))


def update_changes(state: DataFrame, schema: TableSchema, where, set_: dict) -> DataFrame:
    out = state.where(_expr(where)) if where is not None else state
    cols = [(_expr(set_[f.name]) if f.name in set_ else F.col(f.name)).cast(f.type).alias(f.name)
            for f in schema.fields]
    if not schema.keys:
        cols.append(F.col("_row_id"))
    return out.select(*cols).withColumn("_op", F.lit("U"))


def merge_changes(target: DataFrame, source: DataFrame, schema: TableSchema, on: list[str],
                  update_set: dict | None, insert_values: dict | None,
                  broadcast_keys: bool) -> DataFrame:
    """MERGE INTO target USING source ON target.k = source.k
         WHEN MATCHED THEN UPDATE SET ... WHEN NOT MATCHED THEN INSERT ...

    ``update_set`` / ``insert_values`` map target columns to expressions over
    ``source.<col>`` (and ``target.<col>`` for updates).  Columns missing from
    the SET list keep the target value; columns missing from the INSERT list are
    NULL.  ``insert_values=None`` inserts the same-named source columns.

    One left join from the source gives both kinds of rows, so each side is read
    once: a source row that finds target rows updates them, any other is inserted.
    ``broadcast_keys`` (size checked by the caller) narrows the target to the
    source's keys before that, without a shuffle of the target.
    """
    s = source.alias("source")
    if broadcast_keys:
        target = target.join(F.broadcast(source.select(*on)), on, "left_semi").select(*target.columns)
    t = target.withColumn("_hit", F.lit(True)).alias("target")
    cond = None
    for k in on:
        c = F.col(f"target.{k}") == F.col(f"source.{k}")   # plain '=': NULL keys never match
        cond = c if cond is None else cond & c
    ins = insert_values
    if ins is None:
        ins = {c: F.col(f"source.{c}") for c in source.columns if schema.has(c)}
    new = {f.name: (_expr(ins[f.name]) if f.name in ins else F.lit(None)).cast(f.type) for f in schema.fields}
    if update_set is None:
        return (s.join(t, cond, "left_anti").select(*[c.alias(n) for n, c in new.items()])
                .withColumn("_op", F.lit("I")))
    hit = F.col("target._hit").isNotNull()
    cols = []
    for f in schema.fields:
        old = _expr(update_set[f.name]) if f.name in update_set else F.col(f"target.{f.name}")
        cols.append(F.when(hit, old.cast(f.type)).otherwise(new[f.name]).alias(f.name))
    if not schema.keys:
        cols.append(F.col("target._row_id"))
    return s.join(t, cond, "left").select(*cols, F.when(hit, F.lit("U")).otherwise(F.lit("I")).alias("_op"))
