"""Batch fusion: a file of scoreboard states to a file of probability records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators.fusion import probability_record, state_features
from fieldglass.sources.records import METADATA, SCHEMAS
from fieldglass.sources.tables import read_json_lines, write_json_lines


def fuse_files(
    spark: SparkSession, source: str, target: str, score: Callable[[DataFrame], DataFrame],
    schema: str = SCHEMAS[METADATA], keep: tuple[str, ...] = ("timestamp_sec",), possession: str = "away",
) -> tuple[int, int]:
    """Write one record per complete state; returns how many were written and skipped.

    Both counts are observed while the records are written, so the source is read once.
    """
    read, written = Observation("read"), Observation("written")
    states = read_json_lines(spark, source, schema).observe(read, F.count(F.lit(1)).alias("n"))
    assumed = F.col("away_team" if possession == "away" else "home_team")
    scored = score(state_features(states, possession)).withColumn("posteam_assumption", assumed)
    records = probability_record(scored, keep=[*keep, "posteam_assumption"])
    write_json_lines(records.observe(written, F.count(F.lit(1)).alias("n")), target)
    return written.get["n"], read.get["n"] - written.get["n"]
