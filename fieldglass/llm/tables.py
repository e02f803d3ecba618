"""Row identities and intermediate tables that the operators share.

Intermediate tables go to the shared folder of spark.checkpoint.dir, so a lost executor costs only
the tasks it ran. A table that is no longer read can be deleted with `discard`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.session import scratch_path

IDENTITY = ["_id_a", "_id_b"]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 1_000  # rows that a Python worker holds at once: texts and sets are long


def keep_once(df: DataFrame, label: str, batch: int = BATCH) -> DataFrame:
    """Write a table to the shared folder, with Arrow batches of `batch` rows at most, and read it back."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `keep_once` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spare_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that `df` does not have, in any case: underscores are added until it is free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_identity(df: DataFrame, id_column: str, text_column: str, names: list[str] = IDENTITY) -> DataFrame:
    """Add two never-null hashes, called `names`, that name a row by its id and whole text.

    Ids may be null or repeated; rows with the same id and text are the same row to every operator.
    """
    return df.withColumns({
        names[0]: F.xxhash64(F.col(id_column), F.col(text_column)),
        names[1]: F.xxhash64(F.col(text_column), F.lit(29), F.col(id_column)),
    })


def code_point_order(column: str) -> Column:
    """Sorts strings by UTF-8 bytes, which is code point order, with nulls last."""
    return F.col(column).asc_nulls_last()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
