"""Metric-series operators over samples (series columns, time, value).

Dashboards over a time-series store are re-aimed as Spark jobs: latest value,
status mapping, gauge series per step, counter increase and rate, retention.
The end of a time range is always an argument (or a scalar subquery over the
data), never the wall clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ordered as O
from tidemark.functions.status import UP_DOWN_MAPPING, UP_DOWN_THRESHOLDS, map_values, threshold_color


def _matchers(df: DataFrame, matchers: dict | None) -> DataFrame:
    """Label equality matchers: ``{"job": "postgres"}`` on a column, or
    ``{"labels['job']": "postgres"}`` on a map of labels."""
    for c, v in (matchers or {}).items():
        col = c if isinstance(c, Column) else (F.expr(c) if "[" in c else F.col(c))
        df = df.where(col == F.lit(v))
    return df


def latest_sample(samples: DataFrame, series: list[str], ts: str, value: str, tiebreak: str,
                  matchers: dict | None = None) -> DataFrame:
    """Last non-null value per series (``lastNotNull``); ties on ts broken by ``tiebreak``.
    A grouped ``max_by`` keeps one row per series per task before the shuffle."""
    s = _matchers(samples, matchers).where(F.col(value).isNotNull())
    return s.groupBy(*series).agg(F.max(ts).alias("last_ts"),
                                  F.max_by(F.col(value), O.newest(s, ts, tiebreak)).alias("last_value"))


def status(latest: DataFrame, value: str = "last_value", mapping=UP_DOWN_MAPPING,
           steps=UP_DOWN_THRESHOLDS) -> DataFrame:
    """0 -> DOWN, 1 -> UP (else NULL), and the threshold colour of the value."""
    v = F.col(value)
    return latest.withColumn("status", map_values(v, mapping)).withColumn("color", threshold_color(v, steps))


def gauge_series(samples: DataFrame, series: list[str], ts: str, value: str, tiebreak: str,
                 step: str, start=None, end=None, matchers: dict | None = None) -> DataFrame:
    """One point per series and step: the last sample in the step, over (start, end]."""
    s = _matchers(samples, matchers)
    if start is not None:
        s = s.where(F.col(ts) > F.lit(start).cast(samples.schema[ts].dataType))
    if end is not None:
        s = s.where(F.col(ts) <= F.lit(end).cast(samples.schema[ts].dataType))
    s = s.where(F.col(value).isNotNull())
    step_start = F.window(F.col(ts), step).start
    agg = (s.groupBy(*series, step_start.alias("step_start"))
           .agg(F.max_by(F.col(value), O.newest(s, ts, tiebreak)).alias("value"),
                F.count(F.lit(1)).alias("n_samples")))
    return agg


def counter_increments(samples: DataFrame, series: list[str], ts: str, value: str, tiebreak: str,
                       bucket_us: int = 3600 * O.US, rows: int = O.SEGMENT_ROWS) -> DataFrame:
    return O.reset_aware_increase(samples, series, ts, value, tiebreak, bucket_us, rows=rows)


def counter_increase(samples: DataFrame, series: list[str], ts: str, value: str, tiebreak: str,
                     step: str = "1 day", bucket_us: int = 3600 * O.US, rows: int = O.SEGMENT_ROWS) -> DataFrame:
    """Reset-aware increase of a cumulative counter per series and step."""
    inc = counter_increments(samples, series, ts, value, tiebreak, bucket_us, rows)
    return (inc.groupBy(*series, F.window(F.col(ts), step).start.alias("step_start"))
            .agg(F.sum("inc").alias("increase")))


def counter_rate(samples: DataFrame, series: list[str], ts: str, value: str, tiebreak: str,
                 range_seconds: int = 300, bucket_us: int = 3600 * O.US, rows: int = O.SEGMENT_ROWS) -> DataFrame:
    """Per-second rate at each sample: reset-aware increase over (t - range, t] / range.
    No extrapolation to the range ends.  Both steps work on the same segments of the samples."""
    cut_up = O.with_segments(samples, series, ts, bucket_us, rows)
    inc = counter_increments(cut_up, series, ts, value, tiebreak, bucket_us, rows)
    tr = O.trailing_sum(inc, series, ts, "inc", range_seconds * O.US, bucket_us, name="_sum")
    return tr.select(*series, F.col(ts), F.col(tiebreak),
                     (F.col("_sum") / F.lit(float(range_seconds))).alias("rate"))


def retain(samples: DataFrame, ts: str, end: Column, keep: str) -> DataFrame:
    """Samples with ts in (end - keep, end]; ``end`` may be a scalar subquery."""
    return samples.where((F.col(ts) > end - F.expr(f"INTERVAL {keep}")) & (F.col(ts) <= end))


def retained(led, table: str, ts: str, keep: dt.timedelta, **at) -> DataFrame:
    """Samples of a versioned table with ts in (newest - keep, newest].

    The newest time is one number, read from statistics where the table allows; the cut then
    prunes the table's partitions on ``ts`` (day, identity or truncate), so older ones are not read.
    """
    newest = led.read(table, **at).agg(F.max(ts)).first()[0]
    if newest is None:
        return led.read(table, **at)
    return led.read(table, where={ts: (newest - keep, newest)}, **at).where(F.col(ts) > F.lit(newest - keep))
