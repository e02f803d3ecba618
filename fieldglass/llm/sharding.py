"""Sharding by extendible hashing, with Spark expressions only.

A directory entry is a prefix of a row's hash bits. Only buckets over the byte limit split on
another bit, until every shard fits. Buckets are summed per cell, never per row on the driver: the
first pass sums cells some bits deeper than the average bucket needs and reads every shallower
prefix from them; rows of a cell that is still too large go on with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.tables import discard, keep_once

LIMIT = 1 << 20  # bytes of a shard
CONTENT_BITS = 48  # hash bits from the id and text; then ROW_BITS that tell equal rows apart
ROW_BITS = 48
EXTRA_BITS = 4


def bits_of(hexadecimal: Column, n: int) -> Column:
    """The first n bits of a hex string as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(hexadecimal, 1, n // 4), 16, 2), n, "0")


def row_bits(id_column: str, text_column: str) -> Column:
    """Hash bits of a row: 48 from the MD5 of its id and text."""
    body = F.coalesce(F.col(text_column), F.lit(""))
    key = F.concat_ws("|", F.coalesce(F.col(id_column).cast("string"), F.lit("-")), F.md5(body.cast("binary")))
    return bits_of(F.md5(key.cast("binary")), CONTENT_BITS)


def shards(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, bytes, shard (its bits, empty when all rows fit one shard), depth.

    A shard holds at most `limit` bytes, unless it is one row that alone is larger. Null text has 0
    bytes. Rows with the same id and text share their first 48 bits and are told apart by 48 bits of
    a number given when ids and sizes are written, so even a third of equal rows is dealt out.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("bytes"),
        row_bits(id_column, text_column).alias("content"), F.monotonically_increasing_id().alias("row"))
    rows = keep_once(sized.select("id", "bytes", F.concat(
        "content", bits_of(F.md5(F.col("row").cast("string").cast("binary")), ROW_BITS)).alias("bits")), "shard-rows")
    directory = directory_of(rows, limit)
    # Depths present are at most CONTENT_BITS + ROW_BITS: a row meets its one entry by equality of prefix at each depth.
    depths = [r["depth"] for r in directory.select("depth").distinct().orderBy("depth").collect()]
    prefixes = F.explode(F.array(*[F.substring("bits", 1, d) for d in depths]) if depths else F.array(F.lit("")))
    placed = rows.select("id", "bytes", "bits", prefixes.alias("shard")).join(directory, "shard")
    return placed.select("id", "bytes", "shard", "depth", "shard_bytes", "shard_rows")


def directory_of(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows): the leaves of the directory for rows of (bytes, bits)."""
    most = CONTENT_BITS + ROW_BITS
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    reach = min(most, math.ceil(math.log2(max(1.0, total / limit))) + EXTRA_BITS)
    base, open_rows, leaves, own = 0, rows, None, False
    while True:
        cells = keep_once(open_rows.groupBy(F.substring("bits", 1, reach).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "shard-cells")
        depths = F.explode(F.sequence(F.lit(base), F.lit(reach)))
        sums = cells.select("cell", "bytes", "n", depths.alias("depth")).groupBy(
            F.expr("substring(cell, 1, depth)").alias("shard"), "depth").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        done = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == most)
        sums = keep_once(sums.withColumn("done", done), "shard-sums")
        # A bucket is in the directory if it is done and its parent is not; the parent of the first depth is open.
        parents = sums.where("not done").select(F.col("shard").alias("up"), (F.col("depth") + 1).alias("depth"))
        found = sums.where("done").withColumn("up", F.expr("substring(shard, 1, depth - 1)")).join(parents, ["up", "depth"], "left_semi")
        found = found.unionByName(sums.where(F.col("done") & (F.col("depth") == base)).withColumn("up", F.lit(""))) if base == 0 else found
        found = found.select("shard", "depth", "shard_bytes", "shard_rows")
        leaves = found if leaves is None else leaves.unionByName(found)
        deeper = sums.where((F.col("depth") == reach) & ~F.col("done")).select("shard")
        if deeper.isEmpty():
            return keep_once(leaves, "shard-directory")
        following = keep_once(open_rows.join(deeper.withColumnRenamed("shard", "cell"), F.substring("bits", 1, reach) == F.col("cell"), "left_semi"), "shard-open")
        if own:
            discard(open_rows)
        open_rows, own, base, reach = following, True, reach, min(most, reach + EXTRA_BITS)
