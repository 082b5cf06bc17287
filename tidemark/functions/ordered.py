"""Ordered per-series computations split into time buckets.

A window partitioned by series alone sends a whole series to one task; one hot
series (a third of all rows) would then stall the job.  These helpers partition
by (series, segment) and carry what a segment needs from the segments before it
through a small per-segment aggregate.  A segment is a time bucket, or a part of
one: buckets with more than ``rows`` samples of a series are cut between minutes,
by the samples counted in each, so no task need hold a whole hot bucket.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = 1_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def newest(df: DataFrame, ts: str, tiebreak: str) -> Column:
    """Sort value of a sample by (ts, tiebreak), NULLs first, for ``max_by``.

    With a timestamp and an integer tie-break it is one decimal, microseconds times 2**65
    plus the tie-break: a fixed-width buffer, so the aggregate runs by hashing and not by
    sorting.  Other types are compared as a struct.
    """
    types = df.schema[ts].dataType, df.schema[tiebreak].dataType
    if not (isinstance(types[0], (T.TimestampType, T.TimestampNTZType)) and isinstance(types[1], T.IntegralType)):
        return F.struct(F.col(ts), F.col(tiebreak))

    def wide(c: Column, null: int) -> Column:
        return F.coalesce(c.cast("decimal(20,0)"), F.lit(Decimal(null)).cast("decimal(20,0)"))
    return wide(micros(ts), -(1 << 61)) * F.lit(Decimal(1 << 65)) + wide(F.col(tiebreak), -(1 << 63) - 1)


SEGMENT_ROWS = 1_000_000        # samples of a series in a segment, about; more in a hot minute alone
MAX_CUTS = 100_000              # cuts broadcast at most: segments grow with the table beyond that


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that matches NULL keys; the columns of ``other`` besides the keys are added."""
    o = other.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        cond = c if cond is None else cond & c
    return df.join(o, cond, how).drop(*[f"_o_{k}" for k in keys])


def with_segments(df: DataFrame, series: list[str], ts: str, bucket_us: int = 3600 * US,
                  rows: int = SEGMENT_ROWS, fine_us: int = 60 * US) -> DataFrame:
    """``df`` with ``_starts``: where the segments of the row's bucket and of the next one start, in
    microseconds.

    Samples are counted per series and minute (``fine_us``; a partial hash aggregate), and a bucket
    is cut before the minute at which its running count has passed another ``rows``.  Only the cuts
    of overfull buckets are broadcast.  A cut stands for ``rows`` samples, and ``rows`` is at least
    the table's count over MAX_CUTS, so there are never more than MAX_CUTS of them.  Samples of one
    minute stay together.  NULL times have no start and form a segment of their own.
    """
    if bucket_us % fine_us:
        raise ValueError("a bucket must hold whole minutes (fine_us)")
    count = df.agg(F.count(F.lit(1))).scalar()
    aim = F.greatest(F.lit(float(rows)), F.ceil(count / F.lit(MAX_CUTS)).cast("double"))
    fine = (df.where(F.col(ts).isNotNull())
            .groupBy(*series, F.floor(micros(ts) / F.lit(fine_us)).cast("long").alias("_f"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_b", F.floor(F.col("_f") / F.lit(bucket_us // fine_us)).cast("long")))
    w = Window.partitionBy(*series, "_b").orderBy("_f")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = (fine.withColumn("_s", F.floor(before / aim))
            .withColumn("_p", F.lag("_s").over(w)).where(F.col("_s") > F.col("_p"))
            .select(*series, F.explode(F.array("_b", F.col("_b") - 1)).alias("_b"),
                    (F.col("_f") * F.lit(fine_us)).alias("_f"))
            .groupBy(*series, "_b").agg(F.collect_list("_f").alias("_cuts")))
    d = df.withColumn("_b", F.floor(micros(ts) / F.lit(bucket_us)).cast("long"))
    edges = F.array(F.col("_b") * F.lit(bucket_us), (F.col("_b") + 1) * F.lit(bucket_us))
    return (null_safe_join(d, F.broadcast(cuts), [*series, "_b"], "left")
            .withColumn("_starts", F.concat(edges, F.coalesce(F.col("_cuts"), F.array().cast("array<bigint>"))))
            .drop("_b", "_cuts"))


def _own_segment(ts: str) -> Column:
    return F.array_max(F.filter("_starts", lambda x: x <= micros(ts)))


def bucketed_row_number(df: DataFrame, group: list[str], ts: str, tiebreak: str,
                        bucket_us: int = 3600 * US, name: str = "rn", rows: int = SEGMENT_ROWS) -> DataFrame:
    """``row_number() over (partition by group order by ts, tiebreak)``, computed per
    (group, segment) plus the row count of earlier segments of the group."""
    d = with_segments(df, group, ts, bucket_us, rows).withColumn("_b", _own_segment(ts)).drop("_starts")
    counts = d.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wg = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wg), F.lit(0))).drop("_n")
    wb = Window.partitionBy(*group, "_b").orderBy(ts, tiebreak)
    return (null_safe_join(d, offsets, [*group, "_b"])
            .withColumn(name, F.row_number().over(wb) + F.col("_off"))
            .drop("_b", "_off"))


def reset_aware_increase(df: DataFrame, series: list[str], ts: str, value: str, tiebreak: str,
                         bucket_us: int = 3600 * US, name: str = "inc", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per-sample counter increment: ``v - prev``, or ``v`` after a reset (v < prev),
    0 for the first sample of a series.  A NULL value is no sample: its row gets 0 and
    the next sample is compared with the last value before it.  The previous sample of a
    segment's first one comes from the nearest earlier segment that has any.  Segments that
    ``df`` already carries (``with_segments``) are used and kept."""
    given = "_starts" in df.columns
    d = df if given else with_segments(df, series, ts, bucket_us, rows)
    d = d.withColumn("_b", _own_segment(ts))
    if not given:
        d = d.drop("_starts")
    last = (d.groupBy(*series, "_b")
            .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), newest(d, ts, tiebreak)))
                 .alias("_last")))
    ws = Window.partitionBy(*series).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(ws)).drop("_last")
    wb = Window.partitionBy(*series, "_b").orderBy(ts, tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.last(value, ignorenulls=True).over(wb), F.col("_carry"))
    v = F.col(value)
    inc = (F.when(F.col("_prev").isNull() | v.isNull(), F.lit(0.0))
           .when(v < F.col("_prev"), v)
           .otherwise(v - F.col("_prev")))
    return (null_safe_join(d, carry, [*series, "_b"])
            .withColumn("_prev", prev)
            .withColumn(name, inc.cast("double"))
            .drop("_prev", "_carry", "_b"))


def trailing_sum(df: DataFrame, series: list[str], ts: str, col: str, window_us: int,
                 bucket_us: int = 3600 * US, name: str = "trailing", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Sum of ``col`` over rows of the series with ts in (t - window, t].

    A row is copied into every later segment that starts within ``window`` after it, as a halo
    row, so each (series, segment) partition sees its whole frame; with segments of a minute or
    more these are at most the window's minutes and one.  Segments that ``df`` already carries
    are used.  Requires ``bucket_us >= window_us``.
    """
    if bucket_us < window_us:
        raise ValueError("bucket must be at least as wide as the window")
    d = df if "_starts" in df.columns else with_segments(df, series, ts, bucket_us, rows)
    d = d.withColumn("_t", micros(ts))
    later = F.filter("_starts", lambda x: (x > F.col("_t")) & (x < F.col("_t") + F.lit(window_us)))
    allrows = (d.withColumn("_b", F.explode(F.concat(F.array(_own_segment(ts)), later))).drop("_starts"))
    w = Window.partitionBy(*series, "_b").orderBy("_t").rangeBetween(-(window_us - 1), 0)
    return (allrows.withColumn(name, F.sum(col).over(w))
            .where(F.col("_b").isNull() | (F.col("_b") <= F.col("_t"))).drop("_b", "_t"))
