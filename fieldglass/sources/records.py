"""JSON records of the topics: schemas, decoding, broker source and sink, replay from files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add
from time import time as clock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldglass.session import scratch_path

CORRUPT = "_corrupt"

# Topic names and the fields of their records.
RAW_FRAMES = "nfl.raw.frames"
RAW_AUDIO = "nfl.raw.audio"
METADATA = "nfl.metadata"
DETECTIONS = "nfl.detections"
WIN_PROB = "nfl.winprob"
HIGHLIGHTS = "nfl.highlights"
SCHEMAS = {
    RAW_FRAMES: "frame_id int, timestamp_sec double, jpg_base64 string",
    RAW_AUDIO: "chunk_id int, timestamp_sec double, sample_rate int, pcm_base64 string",
    METADATA: (
        "timestamp_sec double, quarter string, clock string, down int, distance int, away_team string, "
        "away_score int, home_team string, home_score int, raw_text string, frame_id int"
    ),
    DETECTIONS: (
        "frame_id int, timestamp_sec double, num_players int, offense_count int, defense_count int, "
        "players array<struct<bbox:array<double>,confidence:double,team:string,side:string,"
        "field_x:double,field_y:double>>"
    ),
    WIN_PROB: "timestamp_sec double, situation string, posteam_win_prob double, defteam_win_prob double",
    HIGHLIGHTS: "trigger_time_sec double, confirmed boolean, clip_path string",
}
MAX_RECORD_BYTES = 20_971_520


def decode(df: DataFrame, schema: str, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Parse JSON text; text that does not parse lands in the `_corrupt` column of its row."""
    parsed = F.from_json(
        F.col(value).cast("string"), f"{schema}, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return df.select(*keep, parsed.alias("_r")).select(*keep, "_r.*")


def encode(df: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """All columns but `keep` as one JSON text."""
    fields = F.struct(*[F.col(c) for c in df.columns if c not in keep])
    return df.select(*keep, F.to_json(fields, {"ignoreNullFields": "false"}).alias(value))


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(CORRUPT).isNotNull()).select(*keep, F.col(CORRUPT).alias("value"))


def kafka_options(servers: str, topics: str | Sequence[str], from_beginning: bool = True) -> dict[str, str]:
    """Options of a broker source for one or more topics. Offsets live in the query's checkpoint."""
    listed = topics if isinstance(topics, str) else ",".join(topics)
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": listed,
        "startingOffsets": "earliest" if from_beginning else "latest",
        "kafka.max.partition.fetch.bytes": str(MAX_RECORD_BYTES),
        "kafka.fetch.max.bytes": str(MAX_RECORD_BYTES),
        "failOnDataLoss": "false",
    }


def read_topics(
    spark: SparkSession, servers: str, topics: str | Sequence[str], from_beginning: bool = True,
) -> DataFrame:
    """Stream of (topic, value) from a broker."""
    return (
        spark.readStream.format("kafka").options(**kafka_options(servers, topics, from_beginning)).load()
        .select("topic", F.col("value").cast("string").alias("value"))
    )


def read_topic_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Stream of (topic, value) from JSON files with the same two fields."""
    return (
        spark.readStream.schema("topic string, value string")
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def topic_records(df: DataFrame, topic: str, schema: str | None = None) -> DataFrame:
    """One topic's decoded records out of a multi-topic stream."""
    return decode(df.where(F.col("topic") == topic), schema or SCHEMAS[topic])


def write_topic(
    df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None,
) -> StreamingQuery:
    """Publish records as JSON values; a key keeps one clip's records in one broker partition."""
    values = encode(df.withColumn("_key", F.col(key).cast("string")), keep=["_key"]) if key else encode(df)
    values = values.withColumnRenamed("_key", "key") if key else values
    return (
        values.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", topic).option("kafka.max.request.size", str(MAX_RECORD_BYTES))
        .option("checkpointLocation", checkpoint).outputMode("append").start()
    )


def write_replay(df: DataFrame, path: str, time: str, slices: int = 8, loops: int = 1) -> None:
    """Write a bounded table as time slices of about the same size, a file each, for a stream to read in order.

    The file source takes files by age and a batch takes whole files, so a slice is never cut between batches, however
    many tasks read the table: rows of the second part would be late. The table is read and dealt once; the files are
    then put in place one after the other. Each loop repeats the table under its own `loop_id`, so the state of a
    finished loop never meets the restarted clock. Rows without a time are left out.
    """
    spark = df.sparkSession
    places = F.percentile_approx(time, [k / slices for k in range(1, slices)], 10_000) if slices > 1 else F.array()
    rows, limits = df.where(F.col(time).isNotNull()).agg(F.count(time), places).first()
    if not rows:
        return
    later = [F.when(F.col(time) >= limit, 1).otherwise(0) for limit in sorted(set(limits or []))]
    number = reduce(add, later, F.lit(0))
    dealt = df.where(F.col(time).isNotNull()).withColumns({
        "loop_id": F.explode(F.array(*[F.lit(n) for n in range(loops)])), "slice": number,
    }).withColumn("_part", F.col("loop_id") * slices + F.col("slice"))
    staged = scratch_path(spark, "slices")
    dealt.repartition(slices * loops, "_part").write.partitionBy("_part").parquet(staged)
    _put_in_order(spark, staged, path)


def _put_in_order(spark: SparkSession, staged: str, path: str) -> None:
    """Move the files of `staged/_part=<n>` to one folder, each younger than those before it."""
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(staged)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(files.Path(path))
    found = []
    for part in system.listStatus(folder):
        if part.isDirectory() and part.getPath().getName().startswith("_part="):
            number = int(part.getPath().getName().removeprefix("_part="))
            found += [(number, f.getPath().getName(), f.getPath()) for f in system.listStatus(part.getPath()) if f.getPath().getName().endswith(".parquet")]
    now = max([int(clock() * 1000), *[f.getModificationTime() + 10 for f in system.listStatus(files.Path(path))]])
    for place, (number, name, source) in enumerate(sorted(found, key=lambda f: f[:2])):
        target = files.Path(f"{path}/{number:05d}-{name}")
        system.rename(source, target)
        system.setTimes(target, now + 10 * place, -1)
    system.delete(folder, True)


def read_replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream a replay; pacing is the trigger interval of the query that reads it."""
    return (
        spark.readStream.schema(f"{schema}, loop_id int, slice int")
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
