"""Parquet layout of a ledger root.

    <root>/_log/commits/      one small Parquet file per commit (all its tables)
    <root>/_log/refs/         ref create / move / delete events
    <root>/_log/bases/        compaction bases (table state at a commit)
    <root>/_log/expired/      expired commit ids
    <root>/tables/<table>/changes/commit_id=<id>/   change rows of one commit
    <root>/tables/<table>/bases/<commit_id>/        full state at that commit

Change rows are written before the commit row that makes them visible, so a
writer that dies midway leaves only unreferenced files behind.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lineage import BaseRec, CommitRec, ExpireRec, History, RefRec
from tidemark.sources.files import SmallFiles

def _struct_for(cls) -> T.StructType:
    hints = {"str": T.StringType(), "str | None": T.StringType(), "int": T.LongType(),
             "bool": T.BooleanType(), "dt.datetime": T.TimestampType(),
             "dt.datetime | None": T.TimestampType()}
    return T.StructType([T.StructField(f.name, hints[f.type], True) for f in dataclasses.fields(cls)])


_ARROW = {"str": pa.string(), "str | None": pa.string(), "int": pa.int64(), "bool": pa.bool_(),
          "dt.datetime": pa.timestamp("us", tz="UTC"), "dt.datetime | None": pa.timestamp("us", tz="UTC")}

LOGS = {"commits": CommitRec, "refs": RefRec, "bases": BaseRec, "expired": ExpireRec}
META_COLS = ["_seq", "_op"]
LOG_FILES = 200          # log files the driver reads one by one; a longer log takes one Spark scan


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = SmallFiles(spark)

    # -- paths ------------------------------------------------------------
    def log_path(self, kind: str) -> str:
        return f"{self.root}/_log/{kind}"

    def table_path(self, table: str) -> str:
        return f"{self.root}/tables/{table}"

    def changes_path(self, table: str) -> str:
        return f"{self.table_path(table)}/changes"

    def commit_changes_path(self, table: str, commit_id: str) -> str:
        return f"{self.changes_path(table)}/commit_id={commit_id}"

    def base_path(self, table: str, commit_id: str) -> str:
        return f"{self.table_path(table)}/bases/{commit_id}"

    # -- metadata logs ----------------------------------------------------
    # The logs are a few bytes per commit, so the driver writes them directly
    # (one file per event, published by rename) instead of launching a Spark job.
    def append_log(self, kind: str, recs: list) -> None:
        if not recs:
            return
        import pyarrow.parquet as pq
        names = [f.name for f in dataclasses.fields(LOGS[kind])]
        schema = pa.schema([(f.name, _ARROW[f.type]) for f in dataclasses.fields(LOGS[kind])])
        tbl = pa.table({n: [getattr(r, n) for r in recs] for n in names}, schema=schema)
        out = pa.BufferOutputStream()
        pq.write_table(tbl, out)
        self.files.publish(self.log_path(kind), f"{recs[0].seq:012d}-{uuid.uuid4().hex[:8]}.parquet",
                           out.getvalue().to_pybytes())

    def log_frame(self, kind: str) -> DataFrame:
        schema = _struct_for(LOGS[kind])
        if not self.files.exists(self.log_path(kind)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.log_path(kind))

    def _log_rows(self, kind: str) -> list[dict]:
        """Rows of a log: a few files are read here, a long log by one Spark scan."""
        import pyarrow.parquet as pq
        names = self.files.names(self.log_path(kind), ".parquet")
        if len(names) <= LOG_FILES:
            return [row for n in names for row in
                    pq.read_table(pa.BufferReader(self.files.read(f"{self.log_path(kind)}/{n}"))).to_pylist()]
        log = self.log_frame(kind)
        cols = [F.unix_micros(c.name).alias(c.name) if isinstance(c.dataType, T.TimestampType) else F.col(c.name)
                for c in log.schema.fields]
        return [r.asDict() for r in log.select(*cols).collect()]

    def load_history(self) -> History:
        h = History()
        for kind, cls in LOGS.items():
            times = [f.name for f in dataclasses.fields(cls) if f.type.startswith("dt.datetime")]
            recs = []
            for row in self._log_rows(kind):
                for k in times:
                    if isinstance(row[k], int):
                        row[k] = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=row[k])
                    elif row[k] is not None and row[k].tzinfo is not None:
                        row[k] = row[k].astimezone(dt.timezone.utc).replace(tzinfo=None)
                recs.append(cls(**row))
            recs.sort(key=lambda r: r.seq)
            setattr(h, kind, recs)
        return h

    # -- change rows ------------------------------------------------------
    def write_changes(self, table: str, commit_id: str, df: DataFrame,
                      partition_cols: list[str], compression: str = "snappy") -> dict[str, int]:
        """Write one commit's change rows; return row counts per op."""
        from pyspark.sql import Observation
        path = self.commit_changes_path(table, commit_id)
        obs = Observation(f"changes-{commit_id}")
        # counted while writing: no second pass over the data
        observed = df.observe(obs, *[F.count_if(F.col("_op") == op).alias(op) for op in ("I", "U", "D")])
        w = observed.write.mode("overwrite").option("compression", compression)
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        w.parquet(path)
        return {k: int(v or 0) for k, v in obs.get.items()}

    def read_changes(self, table: str, commit_ids: list[str], schema: T.StructType) -> DataFrame:
        """Change rows of the given commits; only their partitions are listed."""
        if not commit_ids:
            return self.spark.createDataFrame([], schema)
        base = self.changes_path(table)
        paths = [self.commit_changes_path(table, c) for c in commit_ids]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def delete_changes(self, table: str, commit_id: str) -> None:
        self.files.delete(self.commit_changes_path(table, commit_id))

    def write_base(self, path: str, df: DataFrame, partition_cols: list[str], compression: str = "snappy") -> int:
        w = df.write.mode("overwrite").option("compression", compression)
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        w.parquet(path)
        return int(self.spark.read.parquet(path).count())

    def read_base(self, base: BaseRec, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(base.path)
