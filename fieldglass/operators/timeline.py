"""Logical time: periods (season, week), strictly-earlier history and ordered positions.

Two rules keep these operators safe when one key holds a large share of the rows: facts are
aggregated per period before anything spreads over periods, and series are cut into time buckets
so that a key is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.errors import InsufficientHistoryError

SEASON, WEEK = "season", "week"


def before(season: int, week: int, season_col: str = SEASON, week_col: str = WEEK) -> Column:
    """Rows strictly earlier than a period, in a form the parquet reader can push down."""
    return (F.col(season_col) < season) | ((F.col(season_col) == season) & (F.col(week_col) < week))


def at_period(season: int, week: int, season_col: str = SEASON, week_col: str = WEEK) -> Column:
    return (F.col(season_col) == season) & (F.col(week_col) == week)


def require_history(df: DataFrame, what: str) -> DataFrame:
    """Raise the typed error when there is no row; looks at one row only."""
    if df.isEmpty():
        raise InsufficientHistoryError(f"no earlier {what}")
    return df


def period_index(df: DataFrame, season: str = SEASON, week: str = WEEK, name: str = "ix") -> DataFrame:
    """Distinct periods numbered from 1 in order. One row per calendar week, a few hundred in all."""
    distinct = df.select(season, week).where(F.col(season).isNotNull() & F.col(week).isNotNull()).distinct()
    return distinct.withColumn(name, F.row_number().over(W.orderBy(season, week)))


def recent_periods(df: DataFrame, n: int, season: str = SEASON, week: str = WEEK) -> DataFrame:
    """The last n distinct periods present."""
    return df.select(season, week).distinct().orderBy(F.desc(season), F.desc(week)).limit(n)


def within_recent(df: DataFrame, n: int, season: str = SEASON, week: str = WEEK) -> DataFrame:
    """Rows of the last n distinct periods."""
    return df.join(recent_periods(df, n, season, week), [season, week], "left_semi")


def latest_index(periods: DataFrame, name: str = "ix") -> Column:
    """Largest period number as a scalar subquery."""
    return periods.agg(F.max(name)).scalar()


def spread_over_lookback(partials: DataFrame, periods: DataFrame, lookback: int) -> DataFrame:
    """Copy each per-period partial to the `lookback` following periods, as column `asof_ix`.

    Input rows are already aggregated per period, so the copies are bounded by lookback times the
    number of (period, key) cells, whatever the size of the fact table.
    """
    copies = partials.withColumn("asof_ix", F.explode(F.sequence(F.col("ix") + 1, F.col("ix") + lookback)))
    return copies.where(F.col("asof_ix") <= latest_index(periods))


def running_intervals(
    partials: DataFrame, keys: Sequence[str], sums: Sequence[str], last_ix: Column,
) -> DataFrame:
    """Running totals per key, repeated for every period in which they are the latest known.

    A total known after period `ix` holds for periods ix+1 up to the key's next own period, so the
    result is produced directly, with no join between periods and history.
    """
    ordered = W.partitionBy(*keys).orderBy("ix")
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = partials.select(
        *keys, "ix",
        *[F.sum(c).over(running).alias(c) for c in sums],
        F.coalesce(F.lead("ix").over(ordered), last_ix).alias("_until"),
    )
    return (
        totals.where(F.col("_until") > F.col("ix"))
        .withColumn("asof_ix", F.explode(F.sequence(F.col("ix") + 1, F.col("_until"))))
        .drop("_until", "ix")
    )


def same_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on keys in which nulls are a group of their own, as in windows and aggregates."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])


def with_group(df: DataFrame, keys: Sequence[str], name: str = "_group") -> DataFrame:
    """Add the keys as one struct. Structs are equal if their fields are, nulls included, so a join and a window by
    the struct share one shuffle, while a null-safe join by columns is dealt by other expressions than a window."""
    return df.withColumn(name, F.struct(*keys))


def time_bucket(time: Column, width: float) -> Column:
    return F.floor(time / F.lit(float(width)))


def ordered_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "pos",
) -> DataFrame:
    """Position of each row in its key's order, counted from 0.

    `bucket` must not decrease along the order. Rows are numbered inside (key, bucket) and shifted
    by the size of the earlier buckets, so a key with very many rows is numbered by many tasks;
    only the table of bucket sizes is ordered per key. Null keys are a group of their own, null
    buckets come first. Rows are dealt once, as sizes and numbers go by the same struct.
    """
    bucketed = with_group(df.withColumn("_bucket", bucket), [*keys, "_bucket"])
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = with_group(sizes, [*keys, "_bucket"]).select(
        "_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_group").orderBy(*order)
    return (
        bucketed.join(offsets, "_group")
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset", "_group")
    )


def with_halo(df: DataFrame, block_rows: int, halo: int, pos: str = "pos") -> DataFrame:
    """Cut each key's positions into blocks and copy the last `halo` rows of a block to the next.

    Adds `block` and `is_halo`; a window of up to `halo` rows back is then exact inside a block.
    """
    if halo > block_rows:
        raise ValueError("halo must not exceed the block")
    own = F.floor(F.col(pos) / block_rows)
    copies = F.when(
        F.col(pos) % block_rows >= block_rows - halo,
        F.array(F.struct(own.alias("block"), F.lit(False).alias("is_halo")),
                F.struct((own + 1).alias("block"), F.lit(True).alias("is_halo"))),
    ).otherwise(F.array(F.struct(own.alias("block"), F.lit(False).alias("is_halo"))))
    return df.withColumn("_copy", F.explode(copies)).select(*df.columns, "_copy.*")


def asof_lookup(
    probes: DataFrame, facts: DataFrame, keys: Sequence[str], probe_time: str, fact_time: str,
    payload: Sequence[str], out: str, width: float, forward: bool = False, tie: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """For each probe the last fact at or before its time, or the first at or after when `forward`.

    With `strict` a fact at exactly the probe's time does not count. Null keys are a group of their
    own; a probe with a null time has no match and comes back with null.

    The fact's columns come back as struct `out`, null without a match. Probes and facts meet in
    (key, time bucket) groups; the last fact of the earlier buckets is carried in from a table with
    one row per bucket, so no fact is paired with more than its bucket and no key fills one task.
    """
    sign = -1 if forward else 1
    probe_cols = probes.columns
    tie_value = F.col(tie) if tie else F.lit(0)
    value = F.struct(F.col(fact_time).alias("time"), *[F.col(c) for c in payload])
    fact_rows = facts.where(F.col(fact_time).isNotNull()).select(
        *keys, (sign * F.col(fact_time)).alias("_t"), F.lit(0).alias("_kind"),
        (sign * tie_value).cast("double").alias("_tie"), value.alias("_fact"),
    )
    probe_rows = probes.select(
        *keys, (sign * F.col(probe_time)).alias("_t"), F.lit(1).alias("_kind"),
        F.struct(*probe_cols).alias("_probe"),
    )
    rows = fact_rows.unionByName(probe_rows, allowMissingColumns=True).withColumn(
        "_bucket", time_bucket(F.col("_t"), width),
    )
    per_bucket = rows.groupBy(*keys, "_bucket").agg(
        F.max_by("_fact", F.when(F.col("_kind") == 0, F.struct("_t", "_tie"))).alias("_last"),
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"),
    )
    inside = (
        W.partitionBy(*keys, "_bucket").orderBy("_t", F.desc("_kind") if strict else F.asc("_kind"), "_tie")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        same_group(rows, carried, [*keys, "_bucket"])
        .withColumn("_in", F.last("_fact", ignorenulls=True).over(inside))
        .where(F.col("_kind") == 1)
        .select("_probe.*", F.coalesce("_in", "_carry").alias(out))
    )
