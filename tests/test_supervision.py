"""Restarts, counts, failing handlers and event-time windows of streams."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fieldglass.functions.labels import feed_status
from fieldglass.session import scratch_path
from fieldglass.sources import records
from fieldglass.streaming import stages as st
from fieldglass.streaming import supervision as sv
from fieldglass.streaming import windows as wn


def numbered_files(spark, n, files):
    path = scratch_path(spark, "numbers")
    for i in range(files):
        spark.range(i * n, (i + 1) * n).withColumn("t", F.col("id") * 0.01).coalesce(1).write.mode("append").parquet(path)
    return path


def failing_twice(spark, times=2, at=1):
    """A started query whose batch `at` fails a number of times before its sink takes it."""
    path, out, checkpoint = numbered_files(spark, 50, 3), scratch_path(spark, "out"), scratch_path(spark, "ck")
    left = [times]

    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == at and left[0]:
            left[0] -= 1
            raise RuntimeError("sink is away")

    def start():
        stream = sv.observed(spark.readStream.schema("id long, t double").option("maxFilesPerTrigger", 1).parquet(path), "t")
        return stream.writeStream.queryName("numbers").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return start, out


def test_a_batch_that_fails_twice_leaves_each_row_once(spark):
    start, out = failing_twice(spark)
    pauses = []
    sv.supervise(start, sv.Pauses(restarts=3, first=0.5), pauses.append)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(150))
    assert len(pauses) == 2 and pauses[0] == 0.5


def test_a_query_that_never_recovers_ends_with_its_error(spark):
    start, _ = failing_twice(spark, times=99)
    pauses = []
    with pytest.raises(StreamingQueryException):
        sv.supervise(start, sv.Pauses(restarts=3, first=1.0, longest=3.0), pauses.append)
    assert pauses[-1] == 3.0 and 3 <= len(pauses) <= 4


def test_counts_per_batch_feed_the_status(spark):
    feed = sv.Feed()
    spark.streams.addListener(feed)
    try:
        start, _ = failing_twice(spark, times=1)
        sv.supervise(start, sv.Pauses(first=0.0), lambda _: None)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        row = feed.table(spark).withColumn("status", feed_status(F.col("newest"), F.lit(3.0))).first()
    finally:
        spark.streams.removeListener(feed)
    assert (row["name"], row["rows"], row["batches"], row["failures"], row["status"]) == ("numbers", 150, 3, 1, "live")
    assert abs(row["newest"] - 1.49) < 1e-9


def refusing(ids):
    def handle(batch):
        error = F.raise_error(F.concat(F.lit("refused "), F.col("id"))).cast("long")
        return batch.select("id", F.when(F.col("id").isin(ids), error).otherwise(F.col("id") * 2).alias("twice"))
    return handle


def quarantined(spark, handle, n=1000):
    path = scratch_path(spark, "lines")
    rows = [("m", f'{{"id": {i}}}' if i != 500 else '{"id": ') for i in range(n)]
    spark.createDataFrame(rows, "topic string, value string").coalesce(2).write.json(path)
    decoded = records.topic_records(records.read_topic_files(spark, path, 10), "m", "id long")
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    st.start_with_quarantine(decoded, good, bad, scratch_path(spark, "ck"), handle).awaitTermination()
    return spark.read.parquet(good).select("id", "twice").collect(), spark.read.parquet(bad).select("value", "error").collect()


def test_three_failing_records_of_a_thousand_are_set_aside(spark):
    good, bad = quarantined(spark, refusing([3, 77, 901]))
    assert sorted((r["id"], r["twice"]) for r in good) == [(i, 2 * i) for i in range(1000) if i not in (3, 77, 901, 500)]
    assert sorted(r["value"] for r in bad) == sorted(['{"id": ', '{"id":3}', '{"id":77}', '{"id":901}'])
    assert sum("refused" in (r["error"] or "") for r in bad) == 3


def test_a_broken_handler_stops_the_stream(spark, monkeypatch):
    monkeypatch.setattr(st.handle_each, "__defaults__", (2,))
    with pytest.raises(StreamingQueryException):
        quarantined(spark, refusing(list(range(12))), 12)


def test_failing_records_of_many_shards(spark, monkeypatch):
    """The limit holds for a shard, not for the batch, and a trial that succeeds writes nothing."""
    monkeypatch.setattr(st, "SHARD_ROWS", 100)
    monkeypatch.setattr(st, "FEW_ROWS", 16)
    monkeypatch.setattr(st.handle_each, "__defaults__", (4,))
    refused = {13, 14, 205, 406, 607, 808, 999}
    rows, path = spark.range(1000).repartition(3), scratch_path(spark, "good")
    aside = st.handle_each(rows, refusing(sorted(refused)), path).collect()
    assert {r["id"]: f"refused {r['id']}" in r["_error"] for r in aside} == dict.fromkeys(refused, True) and len(aside) == len(refused)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == sorted(set(range(1000)) - refused)
    assert len(spark.read.parquet(path).inputFiles()) <= 64
    assert st.handle_each(rows, refusing([-1]), scratch_path(spark, "all")) is None


def test_rows_that_only_fail_together_are_all_handled(spark):
    def no_crowd(batch):
        crowd = batch.groupBy().agg(F.when(F.count("*") > 5, F.raise_error(F.lit("crowd")).cast("long")).otherwise(F.lit(0)).alias("zero"))
        return batch.crossJoin(crowd).select("id", (F.col("id") + F.col("zero")).alias("same"))

    path = scratch_path(spark, "good")
    aside = st.handle_each(spark.range(12), no_crowd, path)
    assert aside.count() == 0 and sorted(r["same"] for r in spark.read.parquet(path).collect()) == list(range(12))


def test_sliding_windows_and_late_rows(spark):
    path, out = scratch_path(spark, "samples"), scratch_path(spark, "out")
    schema = "clip string, t double, x double"
    parts = [[("a", i * 0.25, float(i)) for i in range(80)] + [(None, 1.0, 5.0), ("a", 2.0, None)], [("a", 30.0, 1.0)], [("a", 0.5, 9.0), ("a", 29.0, 2.0)], [("a", 99.0, 0.0)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = st.start_append(wn.windowed_energy(stream, ["clip"], "t", "x", 2.0, 1.0, "5 seconds"), out, scratch_path(spark, "ck"))
    query.awaitTermination()
    got = {(r["clip"], r["start"]): (r["n"], round(r["rms"], 9)) for r in spark.read.parquet(out).collect()}
    expected = {}
    samples = [*parts[0], ("a", 30.0, 1.0), ("a", 29.0, 2.0)]
    for clip, t, x in samples:
        if x is not None:
            for start in (int(t) - 1, int(t)):
                expected.setdefault((clip, float(start)), []).append(x)
    assert got == {k: (len(v), round((sum(x * x for x in v) / len(v)) ** 0.5, 9)) for k, v in expected.items()}
    assert wn.late_rows(query) > 0


def test_a_half_is_not_tried_where_the_failure_must_lie(spark, monkeypatch):
    """Fewer trials than two for each halving: 64 rows with one that fails have six halvings."""
    made, refused = [], st._refused
    monkeypatch.setattr(st, "FEW_ROWS", 4)
    monkeypatch.setattr(st, "_refused", lambda action: made.append(1) or refused(action))
    spark.range(64).select("id").coalesce(1).write.parquet(path := scratch_path(spark, "some"))
    rows = spark.read.parquet(path)
    counts = []
    for failing in range(0, 64, 7):
        made.clear()
        aside = st.handle_each(rows, refusing([failing]), scratch_path(spark, "good"))
        assert [r["id"] for r in aside.collect()] == [failing]
        counts.append(len(made) - 2)  # but for the rows together, before and after
    assert sum(counts) < 2 * 6 * len(counts)
