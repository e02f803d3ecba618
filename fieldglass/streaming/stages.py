"""Stateless stages, quarantine of bad records, and views over the newest records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldglass.functions.clock import event_time
from fieldglass.models.boosting import Fitted, score
from fieldglass.operators.fusion import probability_record, state_features
from fieldglass.operators.sampling import SCOREBOARD_STRIDE, every_nth, latest_per_key
from fieldglass.operators.tokens import read_regions
from fieldglass.session import materialize, scratch_path
from fieldglass.sources.records import bad_rows, good_rows


def scoreboard_states(
    frames: DataFrame, regions: Sequence[str], stride: int = SCOREBOARD_STRIDE, index: str = "frame_id",
) -> DataFrame:
    """Frames with token arrays to states: load shedding, parsing, best region. No state."""
    return read_regions(every_nth(frames, stride, index), regions)


def win_probabilities(
    states: DataFrame, fitted: Fitted, keep: Sequence[str] = ("timestamp_sec",), possession: str = "away",
) -> DataFrame:
    """States to probability records; the same function serves a batch and a stream."""
    return probability_record(score(fitted, state_features(states, possession)), keep=keep)


def start_append(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str | None = None,
) -> StreamingQuery:
    """Append to parquet files, exactly once. `interval` paces a replay or a live stream."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if interval:
        writer = writer.trigger(processingTime=interval)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


MOST_FAILING = 100
SHARD_ROWS = 1 << 16  # rows that are searched for failing records together
FEW_ROWS = 64  # rows that are told apart by their numbers
SIDE_BY_SIDE = 8  # trials at once


def handle_each(
    rows: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, most_failing: int = MOST_FAILING,
) -> DataFrame | None:
    """Append what a handler makes of the rows to `path`; returns the records that it cannot take, with its `_error`.

    The rows are handled together. If that fails, they are cut into shards by a hash and halved until each
    failing record stands alone. Trials write nothing, read their own shards only and run side by side; the rows
    without the failing records are then handled together again. A handler that fails on more than
    `most_failing` records of a shard is broken itself: its error is raised.
    """
    spark, names = rows.sparkSession, rows.columns
    held = materialize(rows.withColumn("_number", F.monotonically_increasing_id()), "handled")
    error = _refused(lambda: handle(held.select(*names)).write.mode("append").parquet(path))
    if error is None:
        return None
    whole = held.count()
    levels = (max(whole - 1, 0) // SHARD_ROWS).bit_length()
    shards = _in_shards(held, levels)
    extra = [c for c in shards.columns if c not in names]

    def part(depth: int, prefix: int, keys: list[tuple] | None) -> DataFrame:
        """Rows whose hash begins with some bits, or a listed few. Bounds are text, which Spark's generated code holds
        as a reference: the code of a handler is compiled once, not for every trial."""
        shallow = (1 << min(depth, levels)) - 1
        bits = format(prefix, f"0{depth}b")[::-1] if depth else ""
        lowest, highest = (bits, bits + "~") if keys is None else (keys[0][0], keys[-1][0])
        # One text: every column expression made here costs a trial some milliseconds of the driver.
        return shards.where(f"(_shard & {shallow}) = {prefix & shallow} AND _key BETWEEN '{lowest}' AND '{highest}'")

    def halves(depth: int, prefix: int, keys: list[tuple] | None) -> list[tuple]:
        """The two halves of a part; a single row is its own, an empty part has none."""
        if keys is None and whole >> depth > FEW_ROWS:
            return [(depth + 1, prefix, None), (depth + 1, prefix | 1 << depth, None)]
        if keys is None:
            keys = sorted(tuple(r) for r in part(depth, prefix, None).select("_key", "_number").collect())
        middle = len(keys) // 2
        return [(depth, prefix, listed) for listed in (keys[:middle], keys[middle:]) if listed]

    def trial(place: tuple) -> Exception | None:
        return _refused(lambda: handle(part(*place).drop(*extra)).write.format("noop").mode("overwrite").save())

    def search(place: tuple, error: Exception | None) -> tuple:
        """Of a part that fails: its halves to look into, the part that passed, and the row with its error if it is one.
        A second half is tried only where the first fails, too; otherwise the failure lies in it."""
        depth, prefix, keys = place
        if keys is not None and len(keys) == 1:
            error = error or trial(place)
            return [], [place] if error is None else [], [(place, error)] if error else []
        smaller = halves(*place)
        if len(smaller) < 2:
            return [(p, None) for p in smaller], [], []
        first, second = smaller
        found = trial(first)
        if found is None:
            return [(second, None)], [first], []
        other = trial(second)
        return [(first, found)] + ([(second, other)] if other else []), [] if other else [second], []

    failing: dict[int, str] = {}
    per_shard: Counter = Counter()
    passed: list[tuple] = []
    with ThreadPool(SIDE_BY_SIDE) as pool:
        run = inheritable_thread_target(spark)(search)
        running = [pool.apply_async(run, ((0, 0, None), error))]
        while running:
            ready = [r for r in running if r.ready()]
            running = [r for r in running if r not in ready]
            if not ready:
                running[0].wait(0.01)
            for further, well, alone in (r.get() for r in ready):
                passed += well
                running += [pool.apply_async(run, next_) for next_ in further]
                for place, error in alone:
                    shard = place[1] & ((1 << levels) - 1)
                    if per_shard[shard] == most_failing:
                        raise error
                    per_shard[shard] += 1
                    failing[place[2][0][1]] = str(error).strip().splitlines()[-1][:500]
    refused = spark.createDataFrame(list(failing.items()), "_number long, _error string")
    others = shards.join(refused, "_number", "left_anti").select(*names)
    if _refused(lambda: handle(others).write.mode("append").parquet(path)) is not None:
        # Rows that pass alone but not together: the parts that passed are handled one by one.
        for place in passed:
            handle(part(*place).select(*names)).write.mode("append").parquet(path)
    return shards.join(refused, "_number").select(*names, "_error")


def _refused(action: Callable[[], object]) -> Exception | None:
    try:
        action()
    except (PySparkException, Py4JJavaError) as error:
        return error
    return None


def _in_shards(numbered: DataFrame, levels: int) -> DataFrame:
    """The rows written in 2^levels folders by the low bits of their number's hash, so that a part of them is read alone."""
    spark, path = numbered.sparkSession, scratch_path(numbered.sparkSession, "shards")
    bits = F.xxhash64("_number")
    # The bits from the lowest on, as text; the number tells rows of one hash apart.
    key = F.concat(F.reverse(F.lpad(F.bin(bits), 64, "0")), F.lit("-"), F.lpad(F.col("_number").cast("string"), 20, "0"))
    hashed = numbered.withColumn("_key", key).withColumn("_shard", bits.bitwiseAND((1 << levels) - 1))
    (hashed.repartition("_shard") if levels else hashed).sortWithinPartitions("_shard", "_key").write.partitionBy("_shard").parquet(path)
    return spark.read.schema(hashed.schema).parquet(path)


def start_with_quarantine(
    decoded: DataFrame, good_path: str, bad_path: str, checkpoint: str,
    handle: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
    keep: Sequence[str] = (),
) -> StreamingQuery:
    """Process good records and set bad ones aside, so one bad record never stops the stream.

    Bad are records that do not parse, and those on which `handle` raises: these are kept as JSON text
    with the error. Each batch replaces its own folder: a batch repeated after a failure leaves one copy.
    """
    def split(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        good = good_rows(kept)
        target = f"{good_path}/batch={number}"
        bad = bad_rows(kept, keep).withColumn("error", F.lit(None).cast("string"))
        if handle is None:
            good.write.mode("overwrite").parquet(target)
        else:
            handle(good.limit(0)).write.mode("overwrite").parquet(target)
            refused = handle_each(good, handle, target)
            if refused is not None:
                text = F.to_json(F.struct(*[F.col(c) for c in good.columns]), {"ignoreNullFields": "false"})
                bad = bad.unionByName(refused.select(*keep, text.alias("value"), F.col("_error").alias("error")))
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        kept.unpersist()

    writer = decoded.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_latest(
    records: DataFrame, keys: Sequence[str], time: str, payload: Sequence[str], path: str, checkpoint: str,
    tie: str | None = None,
) -> StreamingQuery:
    """Keep the newest record per key; the state is one record per key.

    Update mode sends changed keys only. Each batch merges them with the version before it into one
    new version and drops older ones, so the view has one row per key and at most two versions. A
    batch repeated after a failure writes its version again.
    """
    newest = latest_per_key(records, keys, time, payload, tie)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        older = [v for v in _versions(spark, path) if v < number]
        rows = batch
        if older:
            named = batch.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
            previous = spark.read.parquet(f"{path}/version={older[-1]}")
            same = [previous[k].eqNullSafe(named[f"_new_{k}"]) for k in keys]
            rows = previous.join(named, same, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/version={number}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        for version in older[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return (
        newest.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current record per key: the newest version of the view."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def merge_topics(energy: DataFrame, scores: DataFrame) -> DataFrame:
    """Two record streams as one, told apart by `kind`: 0 for a score, 1 for energy."""
    return scores.withColumn("kind", F.lit(0)).unionByName(
        energy.withColumn("kind", F.lit(1)), allowMissingColumns=True,
    )


def with_event_time(df: DataFrame, time: str, delay: str, name: str = "event_time") -> DataFrame:
    """Event time from clip seconds, with the delay after which rows count as late."""
    return df.withColumn(name, event_time(F.col(time))).withWatermark(name, delay)
