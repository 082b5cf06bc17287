"""Rollups kept in step with a versioned table, refreshed from change rows only.

rollup(state)  = group by G: count(*), count(amount), sum(amount) [, min(amount), max(amount)]
refresh(r, a -> b) = r  + rollup(new images of keys changed in (a, b])
                        - rollup(old images of the same keys at a)
Groups whose count falls to 0 disappear; a group without amounts has a NULL total.  Counts and
exact (decimal) sums add up.  Extremes do not: a group that lost a row as extreme as its minimum
or maximum is computed again from its own rows, the others take the new rows' extremes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import versioned as V
from tidemark.plans.lineage import NoVersionError

AMOUNT_TYPE = "decimal(18,2)"
TOTAL_TYPE = "decimal(38,2)"


def rollup(state: DataFrame, group: list[str], amount: str, extremes: bool = False) -> DataFrame:
    """n_rows, n_amounts (not NULL) and total per group; with ``extremes`` also min_amount and max_amount."""
    a = F.col(amount).cast(AMOUNT_TYPE)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count(a).alias("n_amounts"), F.sum(a).cast(TOTAL_TYPE).alias("total")]
    if extremes:
        aggs += [F.min(a).alias("min_amount"), F.max(a).alias("max_amount")]
    return state.groupBy(*group).agg(*aggs)


def changes_between(led, table: str, old_cut: str, new_cut: str):
    """Commits of ``table`` on new_cut's lineage that old_cut does not have."""
    hist = led.hist
    old_ids = set(hist.lineage(old_cut))
    recs = hist.table_commits(table, new_cut)
    tail = [r for r in recs if r.commit_id not in old_ids]
    if any(r.commit_id in hist.expired_ids() for r in tail):
        raise NoVersionError("changes needed for the refresh have expired")
    return recs, tail


def refresh(led, table: str, previous: DataFrame, group: list[str], amount: str,
            old: dict, new: dict) -> DataFrame:
    """``previous``, a rollup at ``old``, brought to ``new``; extremes are kept if it has them."""
    extremes = "min_amount" in previous.columns
    old_cut = led.cut(**old)
    new_cut = led.cut(**new)
    if old_cut not in led.hist.lineage(new_cut) or not led.hist.table_commits(table, new_cut)[-1].schema.keys:
        # diverged versions have changes on both sides, and rows without a key have no old image to find
        return rollup(led.read(table, **new), group, amount, extremes)
    recs, tail = changes_between(led, table, old_cut, new_cut)
    data = [r for r in tail if r.n_rows > 0]
    if not data:
        return previous
    schema_new = recs[-1].schema
    keys = list(schema_new.keys)
    phys = V.physical_schema([r.schema for r in recs])
    ch = led.store.read_changes(table, [r.commit_id for r in data], phys.add("commit_id", "string")) \
        .select(*[f.name for f in phys.fields])
    latest = V.latest_per_key(ch, schema_new.key_phys)
    new_imgs = V.to_logical(latest.where(F.col("_op") != "D"), schema_new)
    touched = V.to_logical(latest, schema_new).select(*keys)
    if sum(r.n_rows for r in data) <= led.broadcast_rows:
        # old state built for the touched keys only (broadcast semi join before its window)
        st, schema_old = V.table_state(led.store, led.hist, table, old_cut, led.broadcast_rows,
                                       only_keys=touched)
        old_imgs = V.to_logical(st, schema_old)
    else:
        old_imgs = led.read(table, **old).join(touched, keys, "left_semi")
    amounts = F.col(amount).cast(AMOUNT_TYPE).alias("_a")
    signed = (new_imgs.select(*group, amounts, F.lit(1).alias("_s"))
              .unionByName(old_imgs.select(*group, amounts, F.lit(-1).alias("_s"))))
    sums = [F.sum("_s").cast("long").alias("n_rows"),
            F.sum(F.when(F.col("_a").isNotNull(), F.col("_s")).otherwise(0)).cast("long").alias("n_amounts"),
            F.sum(F.col("_a") * F.col("_s")).cast(TOTAL_TYPE).alias("total")]
    keep = ["n_rows", "n_amounts", "total"]
    both = previous.select(*group, *keep).unionByName(signed.groupBy(*group).agg(*sums))
    folded = [F.sum("n_rows").cast("long").alias("n_rows"), F.sum("n_amounts").cast("long").alias("n_amounts"),
              F.sum("total").cast(TOTAL_TYPE).alias("total")]
    total = F.when(F.col("n_amounts") > 0, F.col("total")).cast(TOTAL_TYPE).alias("total")
    merged = both.groupBy(*group).agg(*folded).where(F.col("n_rows") != 0).select(*group, "n_rows", "n_amounts", total)
    if not extremes:
        return merged
    came, went = F.when(F.col("_s") > 0, F.col("_a")), F.when(F.col("_s") < 0, F.col("_a"))
    edges = signed.groupBy(*group).agg(F.min(came).alias("_min_in"), F.max(came).alias("_max_in"),
                                       F.min(went).alias("_min_out"), F.max(went).alias("_max_out"))
    known = _null_safe(previous.select(*group, "min_amount", "max_amount"), edges, group, "full_outer")
    stale = (F.coalesce(F.col("_min_out") <= F.col("min_amount"), F.lit(False))
             | F.coalesce(F.col("_max_out") >= F.col("max_amount"), F.lit(False)))
    known = known.select(*group, F.least("min_amount", "_min_in").alias("min_amount"),
                         F.greatest("max_amount", "_max_in").alias("max_amount"), stale.alias("_stale"))
    stale_groups = known.where("_stale").select(*group)
    if sum(r.n_rows for r in data) <= led.broadcast_rows:      # a stale group lost one of these rows
        stale_groups = F.broadcast(stale_groups)
    again = (_null_safe(led.read(table, **new), stale_groups, group, "left_semi").groupBy(*group)
             .agg(F.min(F.col(amount).cast(AMOUNT_TYPE)).alias("min_amount"),
                  F.max(F.col(amount).cast(AMOUNT_TYPE)).alias("max_amount")))
    edges = known.where("not _stale").drop("_stale").unionByName(again)
    return _null_safe(merged, edges, group, "left")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, NULLs equal to NULLs; the keys appear once."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    j = left.join(r, cond, how)
    if how == "left_semi":
        return j
    rest = [c for c in left.columns + r.columns if c not in keys and not c.startswith("_r_")]
    return j.select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in keys], *rest)
