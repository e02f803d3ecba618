"""Energy of a sampled signal, its moving baseline and the triggers it gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.operators.timeline import asof_lookup, ordered_position, same_group, time_bucket, with_halo
from fieldglass.session import materialize

# Sample scale, baseline length and trigger limits.
SAMPLE_SCALE = 32767.0
BASELINE_ROWS = 20
MIN_RMS = 0.05
TRIGGER_RATIO = 1.3
COOLDOWN = 20.0
HOP_SECONDS = 0.5

BLOCK_ROWS = 50_000


def array_rms(samples: Column, scale: float = SAMPLE_SCALE) -> Column:
    """Root mean square of an int16 sample array, inside the row; null for an empty chunk."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + (x / scale) * (x / scale))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)))


def chunk_rms(samples: DataFrame, keys: Sequence[str], value: str, scale: float = 1.0) -> DataFrame:
    """Root mean square per chunk of a long sample table."""
    x = F.col(value) / scale
    return samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sqrt(F.avg(x * x)).alias("rms"))


def tumbling_chunks(samples: DataFrame, keys: Sequence[str], time: str, width: float = HOP_SECONDS) -> DataFrame:
    """Number the fixed-length, non-overlapping chunks of a signal."""
    return samples.withColumn("chunk_id", time_bucket(F.col(time), width))


def sliding_envelope(
    samples: DataFrame, keys: Sequence[str], index: str, value: str, n_samples: str, hop: int,
) -> DataFrame:
    """Root mean square of frames two hops long, one per hop, centred, with zeros beyond both ends.

    A sample belongs to exactly two frames, so each is emitted twice and combined map-side. The
    divisor is always the frame length, because zeros fill the edges.
    """
    own = F.floor(F.col(index) / hop)
    spread = samples.select(
        *keys, F.col(value).alias("_x"), F.explode(F.array(own, own + 1)).alias("frame"),
        F.floor(F.col(n_samples) / hop).alias("_last"),
    ).where(F.col("frame") <= F.col("_last"))
    return spread.groupBy(*keys, "frame").agg(
        F.sqrt(F.sum(F.col("_x") * F.col("_x")) / F.lit(2.0 * hop)).alias("rms"),
    )


def rolling_baseline(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column,
    rows: int = BASELINE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the previous `rows` values as `baseline`; null until that many exist.

    The series of a key is cut into blocks with a short overlap, so even a key with a large share
    of all rows is averaged by many tasks.
    """
    placed = ordered_position(df, keys, order, bucket, "_pos")
    cut = with_halo(placed, max(block_rows, rows), rows, "_pos")
    back = W.partitionBy(*keys, "block").orderBy("_pos").rowsBetween(-rows, -1)
    mean = F.when(F.count(value).over(back) == rows, F.avg(value).over(back))
    return (
        cut.withColumn("baseline", mean).where(~F.col("is_halo"))
        .select(*df.columns, "baseline")
    )


def energy_ratio(rms: Column, baseline: Column) -> Column:
    """Energy over baseline; 0 for a silent baseline."""
    return F.when(baseline > 0, rms / baseline).when(baseline.isNotNull(), 0.0)


def is_trigger(
    rms: Column, baseline: Column, min_rms: float = MIN_RMS, ratio: float = TRIGGER_RATIO,
) -> Column:
    return (rms > min_rms) & (energy_ratio(rms, baseline) > ratio)


def trigger_candidates(
    df: DataFrame, rms: str = "rms", baseline: str = "baseline", min_rms: float = MIN_RMS,
    ratio: float = TRIGGER_RATIO,
) -> DataFrame:
    return df.where(is_trigger(F.col(rms), F.col(baseline), min_rms, ratio)).withColumn(
        "ratio", energy_ratio(F.col(rms), F.col(baseline)),
    )


def islands(df: DataFrame, keys: Sequence[str], time: str, gap: float, width: float) -> DataFrame:
    """Number runs of times no more than `gap` apart, as `island`: the time the run starts.

    The last time of earlier buckets is carried over from a table with one row per bucket, so one
    key's times are spread over many tasks.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", time_bucket(F.col(time), width))
    per_bucket = rows.groupBy(*keys, "_bucket").agg(F.max(time).alias("_max"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = per_bucket.select(*keys, "_bucket", F.max("_max").over(earlier).alias("_carry"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(time)
    gapped = same_group(rows, carried, [*keys, "_bucket"]).withColumn(
        "_prev", F.coalesce(F.lag(time).over(inside), "_carry"),
    )
    starts = gapped.withColumn(
        "_start", F.when(F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > gap), F.col(time)),
    )
    last_start = starts.groupBy(*keys, "_bucket").agg(F.max("_start").alias("_s"))
    carried_start = last_start.select(*keys, "_bucket", F.max("_s").over(earlier).alias("_open"))
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        same_group(starts, carried_start, [*keys, "_bucket"])
        .withColumn("island", F.coalesce(F.max("_start").over(so_far), "_open"))
        .select(*df.columns, "island")
    )


def cooldown(
    df: DataFrame, keys: Sequence[str], time: str, gap: float = COOLDOWN, inclusive: bool = False,
) -> DataFrame:
    """Keep a trigger only when more than `gap` seconds after the last kept one of its key.

    The rule is sequential, but a pause longer than `gap` always restarts it, so every run between
    pauses begins with a kept time. Every time points to the first one more than `gap` later, and the
    kept times are those that the pointers reach from the runs' first times. Joining the pointers
    with themselves doubles the step, until no pointer is left inside a run: a few equality joins for
    runs of any length, and no group held in one task. With `inclusive` a trigger exactly `gap` later
    is kept as well. Returns the distinct kept (key, time) rows;
    null keys are a group of their own, null times are no triggers.
    """
    keys = list(keys)
    group = [*keys, "island"]
    times = df.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    runs = materialize(islands(times, keys, time, gap, 64 * gap), "cooldown-runs")
    probes = runs.select(*group, time, (F.col(time) + gap).alias("_from"))
    pointers = asof_lookup(
        probes, runs.select(*group, time), group, "_from", time, [], "_next", 64 * gap, forward=True, strict=not inclusive,
    ).where(F.col("_next").isNotNull()).select(*group, F.col(time).alias("_at"), F.col("_next.time").alias("_to"))
    pointers = materialize(pointers, "cooldown-step")
    reached = runs.groupBy(*group).agg(F.min(time).alias("_at"))
    while not pointers.isEmpty():
        moved = same_group(reached, pointers, [*group, "_at"]).select(*group, F.col("_to").alias("_at"))
        reached = materialize(reached.unionByName(moved).distinct(), "cooldown-reached")
        second = pointers.select(*group, F.col("_at").alias("_to"), F.col("_to").alias("_far"))
        pointers = materialize(
            same_group(pointers, second, [*group, "_to"]).select(*group, "_at", F.col("_far").alias("_to")), "cooldown-step")
    return reached.select(*keys, F.col("_at").alias(time))
