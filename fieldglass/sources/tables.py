"""Readers of the batch tables and writers of the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.nulls import nan_to_null
from fieldglass.operators.cleaning import labelable

WIN_PROB_COLUMNS = [
    "season", "game_id", "qtr", "down", "ydstogo", "yardline_100", "score_differential",
    "half_seconds_remaining", "game_seconds_remaining", "posteam_timeouts_remaining",
    "defteam_timeouts_remaining", "posteam_type", "result", "play_type",
]


def read_seasons(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Season files united by column name; a column missing in a season is null there.

    Only the asked columns are read, and later filters reach the parquet reader. With a `schema` no
    footer is read to plan: it names all columns that any season may have. Without one the seasons'
    schemas are merged, which reads the footer of every file.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    df = reader.parquet(*listed)
    return df if columns is None else df.select(*columns)


def union_seasons(frames: Sequence[DataFrame], types: dict[str, str] | None = None) -> DataFrame:
    """Unite seasons whose column types differ, after casting the named columns."""
    types = types or {}

    def cast(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})

    out = cast(frames[0])
    for frame in frames[1:]:
        out = out.unionByName(cast(frame), allowMissingColumns=True)
    return out


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    """Floating columns written by other tools may hold NaN for a missing value."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating}) if floating else df


def read_win_prob_plays(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = tuple(WIN_PROB_COLUMNS),
    keep: Column | None = None, possession: str = "posteam", schema: T.StructType | str | None = None,
) -> DataFrame:
    """The in-play model's columns of labelable plays; projection and filters run in the reader."""
    df = read_seasons(spark, paths, [*columns, possession], schema)
    return df.where(labelable() if keep is None else keep).select(*columns)


def read_optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A table that may be absent: no path means the features made from it are left out."""
    return None if path is None else spark.read.parquet(path)


def read_csv_dimension(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Small header CSV with string columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table. Rows of one partition value stay together, so files are few and large."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One document per line; null fields are written, so readers see the whole record."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Documents stored as one JSON array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
