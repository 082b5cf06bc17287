"""Reading a versioned table: state at a cut, projection, row-level diff.

State at a cut = base (compacted snapshot, if any)
               + all append-only commits after it, wherever they stand  (no shuffle)
               + the latest change per key among the other commits
                 (one shuffle on the key, partial top-1 before it),
minus the base and appended rows whose key was changed by a later commit (anti
join; broadcast only when the recorded row count of the changing commits is
under the limit).  An append-only commit holds keys absent before it, so it can
follow a delete of a key but never supersede a live row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lineage import CommitRec, History, NoVersionError
from tidemark.plans.schema import Field, TableSchema, physical_fields
from tidemark.sources.store import LedgerStore

# Max rows of "touched" change rows whose keys we broadcast into the anti join.
# The count comes from the commit log (exact, recorded at write time).
DEFAULT_BROADCAST_ROWS = 2_000_000


_SIZED = re.compile(r"(truncate|bucket)\[(\d+)\]$")


def _transform(transform: str, f: Field, value: Column) -> tuple[str, Column, T.DataType]:
    """(physical name, partition value, its type) of a transform of ``value``, which has the field's type."""
    typ = T._parse_datatype_string(f.type)
    if transform == "day":
        return f"_p_day_{f.phys}", F.to_date(value), T.DateType()
    if transform == "identity":
        return f"_p_{f.phys}", value, typ
    m = _SIZED.match(transform)
    if not m or int(m[2]) < 1:
        raise ValueError(f"unknown partition transform {transform!r}")
    kind, width = m[1], int(m[2])
    if kind == "bucket":
        return f"_p_bucket{width}_{f.phys}", F.pmod(F.xxhash64(value), F.lit(width)).cast("int"), T.IntegerType()
    if isinstance(typ, T.IntegralType):
        return f"_p_trunc{width}_{f.phys}", (value - F.pmod(value, F.lit(width).cast(typ))).cast(typ), typ
    return f"_p_trunc{width}_{f.phys}", F.substring(value.cast("string"), 1, width), T.StringType()


def partition_columns(schema: TableSchema) -> list[tuple[str, Column, T.DataType]]:
    """(physical name, expression over physical columns, type) per partition transform: ``day``,
    ``identity``, ``truncate[w]`` (integers down to a multiple, else the first w characters)
    and ``bucket[n]`` (hash)."""
    return [_transform(t, schema.field(c), F.col(schema.field(c).phys)) for t, c in schema.partition_by]


def partition_predicates(schema: TableSchema, f: Field, bounds) -> list[Column]:
    """Conditions on partition columns that a value, or inclusive bounds, of their source column imply."""
    lo, hi = bounds if isinstance(bounds, tuple) else (bounds, bounds)
    out = []
    for transform, col in schema.partition_by:
        if col != f.name:
            continue
        if transform.startswith("bucket"):
            if lo is not None and lo == hi:              # hashes keep no order
                name, at, _ = _transform(transform, f, F.lit(lo).cast(f.type))
                out.append(F.col(name) == at)
            continue
        if lo is not None:
            name, at, _ = _transform(transform, f, F.lit(lo).cast(f.type))
            out.append(F.col(name) >= at)
        if hi is not None:
            name, at, _ = _transform(transform, f, F.lit(hi).cast(f.type))
            out.append(F.col(name) <= at)
    return out


def physical_schema(schemas: list[TableSchema]) -> T.StructType:
    last = schemas[-1]
    fields = [T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType())]
    if not last.keys:
        fields.append(T.StructField("_row_id", T.StringType()))
    for fid, typ in sorted(physical_fields(schemas).items()):
        fields.append(T.StructField(f"f{fid}", T._parse_datatype_string(typ)))
    for name, _, typ in partition_columns(last):
        fields.append(T.StructField(name, typ))
    return T.StructType(fields)


def table_state(store: LedgerStore, hist: History, table: str, cut: str | None,
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                only_keys: DataFrame | None = None) -> tuple[DataFrame, TableSchema]:
    """Physical rows (f<id> columns + partition columns) of ``table`` at ``cut``.

    ``only_keys`` (logical or physical key columns, or ``_row_id`` of a table without keys;
    at most ``broadcast_rows`` rows, checked by the caller) restricts the state to those keys: every segment is semi-joined
    with the broadcast key set *before* the latest-per-key window, so a MERGE with
    a small source never shuffles the whole table.
    """
    recs = hist.table_commits(table, cut)
    expired = hist.expired_ids()
    base = hist.base_for(table, cut, recs[0].seq)
    tail = [r for r in recs if r.seq > base_seq(hist, base)] if base else recs
    if cut in expired or any(r.commit_id in expired for r in tail):
        raise NoVersionError(f"version {cut} of {table} has expired")
    schema = recs[-1].schema
    phys = physical_schema([r.schema for r in recs])
    keys = schema.key_phys
    cols = [f.name for f in phys.fields]
    read_schema = T.StructType(phys.fields + [T.StructField("commit_id", T.StringType())])

    def restrict(df: DataFrame) -> DataFrame:
        if only_keys is None:
            return df
        if set(keys) <= set(only_keys.columns):
            ks = only_keys.select(*keys).distinct()
        else:
            ks = only_keys.select(*[F.col(k).cast(schema.field(k).type).alias(schema.field(k).phys)
                                    for k in schema.keys]).distinct()
        return df.join(F.broadcast(ks), keys, "left_semi")

    data = [r for r in tail if r.n_rows > 0]
    appends = [r for r in data if r.append_only]
    rest = [r for r in data if not r.append_only]

    parts = []
    if base is not None:
        parts.append(restrict(store.read_base(base, phys).select(cols)))
    if appends:
        parts.append(restrict(store.read_changes(table, [r.commit_id for r in appends], read_schema)
                              .select(cols)))
    stable = None
    for p in parts:
        stable = p if stable is None else stable.unionByName(p)

    if not rest:
        if stable is None:
            return store.spark.createDataFrame([], phys), schema
        return stable, schema

    changes = restrict(store.read_changes(table, [r.commit_id for r in rest], read_schema).select(cols))
    latest = latest_per_key(changes, keys)
    live = latest.where(F.col("_op") != "D")
    if stable is None:
        return live, schema
    touched = latest.select(*[F.col(k).alias(f"_t{k}") for k in keys], F.col("_seq").alias("_t_seq"))
    if sum(r.n_rows for r in rest) <= broadcast_rows:
        touched = F.broadcast(touched)
    later = F.col("_seq") < F.col("_t_seq")
    for k in keys:
        later = later & (F.col(k) == F.col(f"_t{k}"))
    return stable.join(touched, later, "left_anti").unionByName(live), schema


def base_seq(hist: History, base) -> int:
    return hist.commit(base.commit_id).seq


def latest_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Newest change row per key.  ``row_number() = 1`` is planned as a partial
    top-1 before the shuffle, so a key changed many times ships one row per task."""
    w = Window.partitionBy(*keys).orderBy(F.col("_seq").desc())
    return changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def to_logical(state: DataFrame, schema: TableSchema, keep_meta: bool = False) -> DataFrame:
    have = set(state.columns)
    cols = [(F.col(f.phys) if f.phys in have else F.lit(None)).cast(f.type).alias(f.name)
            for f in schema.fields]
    if keep_meta:
        cols += [F.col(c) for c in state.columns if c.startswith("_")]
    elif not schema.keys:
        cols.append(F.col("_row_id"))
    return state.select(*cols)


def to_physical(df: DataFrame, schema: TableSchema, seq: int, op: Column | str) -> DataFrame:
    """Logical rows -> change rows for one commit."""
    cols = [F.lit(seq).cast("long").alias("_seq"),
            (op if isinstance(op, Column) else F.lit(op)).alias("_op")]
    if not schema.keys:
        fresh = F.expr("uuid()")              # rows without an id are new
        cols.append((F.coalesce("_row_id", fresh) if "_row_id" in df.columns else fresh).alias("_row_id"))
    for f in schema.fields:
        src = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(src.cast(f.type).alias(f.phys))
    out = df.select(*cols)
    for name, expr, _ in partition_columns(schema):
        out = out.withColumn(name, expr)
    return out


def _aligned(old: TableSchema, new: TableSchema) -> list[tuple[Field | None, Field | None]]:
    """Fields of both versions side by side, by field id: (old or None, new or None)."""
    before = {f.id: f for f in old.fields}
    now = {f.id for f in new.fields}
    return [(before.get(f.id), f) for f in new.fields] + [(f, None) for f in old.fields if f.id not in now]


def row_diff(old: DataFrame, new: DataFrame, old_schema: TableSchema, new_schema: TableSchema) -> DataFrame:
    """Full outer join of two physical states on the key; NULL-safe compare of every other field.

    Output: the keys, change_type (added | removed | changed), then ``old_``/``new_`` images under
    each version's own column names.  Fields are matched by id, so a renamed column is one
    field, and a value in a column that only one version has is a change.
    """
    keys = new_schema.key_phys
    pairs = [(o, n) for o, n in _aligned(old_schema, new_schema) if (n or o).phys not in keys]
    o = old.select(*keys, *[F.col(x.phys).cast(x.type).alias(f"_o{x.id}") for x, _ in pairs if x],
                   F.lit(True).alias("_in_old"))
    n = new.select(*keys, *[F.col(x.phys).cast(x.type).alias(f"_n{x.id}") for _, x in pairs if x],
                   F.lit(True).alias("_in_new"))
    same = F.lit(True)
    for x, y in pairs:
        if x and y:
            same = same & F.col(f"_o{x.id}").eqNullSafe(F.col(f"_n{y.id}"))
        else:
            same = same & F.col(f"_o{x.id}" if x else f"_n{y.id}").isNull()
    ct = (F.when(F.col("_in_old").isNull(), "added")
          .when(F.col("_in_new").isNull(), "removed")
          .when(~same, "changed"))
    names = [F.col(new_schema.field(k).phys).alias(k) for k in new_schema.keys]
    images = [F.col(f"_o{x.id}").alias(f"old_{x.name}") for x, _ in pairs if x]
    images += [F.col(f"_n{y.id}").alias(f"new_{y.name}") for _, y in pairs if y]
    return (o.join(n, keys, "full_outer").withColumn("change_type", ct).where(F.col("change_type").isNotNull())
            .select(*names, "change_type", *images))


def multiset_diff(old: DataFrame, new: DataFrame, old_schema: TableSchema, new_schema: TableSchema) -> DataFrame:
    """Diff of rows without identity: how many more (added) or fewer (removed) of each there are.

    Both physical states are counted together, old rows as -1, NULLs equal to NULLs; one
    shuffle with partial counts.  Output: every column, change_type, n.  Fields are matched by
    id and named as in the new version; a column that the new one dropped keeps its old name,
    with the field id added where that name is taken.
    """
    pairs, taken, old_cols, new_cols, names = _aligned(old_schema, new_schema), set(), [], [], []
    for x, y in pairs:
        f = y or x
        name = f.name if f.name not in taken else f"{f.name}_{f.id}"
        taken.add(name)
        names.append(name)
        old_cols.append((F.col(x.phys) if x else F.lit(None)).cast(f.type).alias(name))
        new_cols.append((F.col(y.phys) if y else F.lit(None)).cast(f.type).alias(name))
    both = (old.select(*old_cols, F.lit(-1).alias("_sign"))
            .unionByName(new.select(*new_cols, F.lit(1).alias("_sign"))))
    net = both.groupBy(*names).agg(F.sum("_sign").alias("_net")).where("_net <> 0")
    return net.select(*names, F.when(F.col("_net") > 0, "added").otherwise("removed").alias("change_type"),
                      F.abs("_net").cast("bigint").alias("n"))
