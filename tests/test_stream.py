"""Triggers and cooldown against brute force, live jobs against the batch job, records and sinks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import highlights, sampling, signal, timeline
from fieldglass.session import scratch_path
from fieldglass.sources import records, tables
from fieldglass.streaming.highlights import live_highlights
from fieldglass.streaming.stages import start_append, start_with_quarantine

TIMES = "k string, t double"


def kept(times, gap):
    out = []
    for t in sorted(times):
        if not out or t > out[-1] + gap:
            out.append(t)
    return out


def test_cooldown_of_the_known_case(spark):
    df = spark.createDataFrame([("a", t) for t in (1.0, 5.0, 20.9, 21.5, 30.0, 41.6, 62.0)], TIMES)
    assert sorted(r["t"] for r in signal.cooldown(df, ["k"], "t", 20.0).collect()) == [1.0, 21.5, 41.6, 62.0]


def test_cooldown_equals_the_greedy_walk(spark):
    rng = random.Random(11)
    rows = {k: [rng.uniform(0, 900) for _ in range(n)] + [5000.0 + i * 3 for i in range(n)] for k, n in (("a", 200), ("b", 30), ("c", 3))}
    df = spark.createDataFrame([(k, t) for k, ts in rows.items() for t in ts], TIMES)
    got = {}
    for r in signal.cooldown(df, ["k"], "t", 20.0).collect():
        got.setdefault(r["k"], []).append(r["t"])
    assert {k: sorted(v) for k, v in got.items()} == {k: kept(v, 20.0) for k, v in rows.items()}


def test_null_keys_and_times_lose_no_row(spark):
    scores = spark.createDataFrame([(None, 0.0, 0, 0), (None, 11.0, 7, 0), ("a", 0.0, 0, 0), ("a", 40.0, 0, 0)], "k string, t double, away_score int, home_score int")
    triggers = spark.createDataFrame([(None, 5.0), ("a", None), ("b", 5.0), ("a", 5.0)], TIMES)
    live = {(r["k"], r["t"]): r["confirmed"] for r in highlights.confirm_by_scores(triggers, scores, ["k"]).collect()}
    assert live == {(None, 5.0): True, ("a", None): False, ("b", 5.0): False, ("a", 5.0): False}
    assert highlights.confirm_at_points(triggers, scores, ["k"]).count() == 4
    energy = spark.createDataFrame([(None, 1.0, 1, 0.5), (None, 2.0, 2, 0.5), ("a", None, 3, 0.5)], "k string, t double, id long, rms double")
    out = signal.rolling_baseline(energy, ["k"], ["t", "id"], "rms", timeline.time_bucket(F.col("t"), 37.0), rows=1)
    assert {r["id"]: r["baseline"] for r in out.collect()} == {1: None, 2: 0.5, 3: None}
    assert {(r["k"], r["t"]) for r in signal.cooldown(triggers.union(triggers), ["k"], "t", 20.0).collect()} == {(None, 5.0), ("b", 5.0), ("a", 5.0)}


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_rolling_baseline_is_exact_across_blocks(spark, partitions):
    rng = random.Random(12)
    values = [rng.randrange(1, 100) / 64 for _ in range(300)]
    df = spark.createDataFrame([("a", float(i), i, v) for i, v in enumerate(values)], "k string, t double, id long, rms double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = signal.rolling_baseline(df, ["k"], ["t", "id"], "rms", timeline.time_bucket(F.col("t"), 37.0), block_rows=25)
        got = {r["id"]: r["baseline"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: (sum(values[i - 20:i]) / 20 if i >= 20 else None) for i in range(300)}


def test_rms(spark):
    df = spark.createDataFrame([(1, [32767, -32767]), (2, []), (3, [0, 0])], "k int, s array<int>")
    assert [r[0] for r in df.orderBy("k").select(signal.array_rms(F.col("s"))).collect()] == [1.0, None, 0.0]


def test_first_per_interval_and_strides(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate((0.0, 0.2, 0.5, 0.9, 1.4))], "k string, t double, id int")
    got = sampling.first_per_interval(df, ["k"], "t", ["id"]).orderBy("interval")
    assert [r["id"] for r in got.collect()] == [0, 2, 4]
    assert [r["id"] for r in sampling.every_nth(df, 2, "id").orderBy("id").collect()] == [1, 3]


ENERGY = "clip_id string, timestamp_sec double, id long, rms double"
SCORES = "clip_id string, timestamp_sec double, id long, away_score int, home_score int"


def clip_records():
    """Two clips of 240 s: energy twice a second with bursts, a score state each second."""
    rng = random.Random(13)
    energy, scores = [], []
    for clip in ("x", "y"):
        for i in range(480):
            loud = i % 97 in (60, 61, 62) or rng.random() < 0.01
            energy.append((clip, i / 2, i, (rng.randrange(20, 30) * (3 if loud else 1)) / 256))
        for s in range(240):
            away = None if rng.random() < 0.1 else 7 * (s // 25)
            scores.append((clip, float(s), s, away, 3))
    return energy, scores


def _as_batch(spark, energy, scores):
    e = spark.createDataFrame(energy, ENERGY).withColumnRenamed("timestamp_sec", "t")
    s = spark.createDataFrame(scores, SCORES).withColumnRenamed("timestamp_sec", "t")
    found = highlights.find_highlights(e, s, ["clip_id"], width=40.0)
    return {(r["clip_id"], r["t"]): r["confirmed"] for r in found.collect()}


def test_live_highlights_equal_the_batch_job_and_survive_a_restart(spark):
    energy, scores = clip_records()
    expected = _as_batch(spark, energy, scores)
    released = {k: v for k, v in expected.items() if k[1] + 23 <= 239.5 - 10}
    assert len(released) >= 4 and len(set(released.values())) == 2
    merged = sorted(
        [(c, t, i, rms, None, None, 1) for c, t, i, rms in energy] + [(c, t, i, None, a, h, 0) for c, t, i, a, h in scores],
        key=lambda r: r[1],
    )
    schema = "clip_id string, timestamp_sec double, id long, rms double, away_score int, home_score int, kind int"
    path, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    for part in (merged[:700], merged[700:]):
        size = 240
        for i in range(0, len(part), size):
            chunk = part[i:i + size]
            random.Random(i).shuffle(chunk)
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        found = live_highlights(
            stream.where("kind = 1").select("clip_id", "timestamp_sec", "id", "rms"),
            stream.where("kind = 0").select("clip_id", "timestamp_sec", "id", "away_score", "home_score"), delay="10 seconds",
        )
        start_append(found, out, checkpoint).awaitTermination()
    got = {(r["clip_id"], r["t"]): r["confirmed"] for r in spark.read.schema(found.schema).parquet(out).collect()}
    assert got == released


def test_one_bad_record_does_not_stop_the_stream(spark):
    path = scratch_path(spark, "lines")
    rows = [("m", f'{{"frame_id": {i}}}' if i != 3 else '{"frame_id": ') for i in range(1, 6)]
    spark.createDataFrame(rows, "topic string, value string").coalesce(1).write.json(path)
    decoded = records.topic_records(records.read_topic_files(spark, path), "m", "frame_id int")
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    start_with_quarantine(decoded, good, bad, scratch_path(spark, "ck")).awaitTermination()
    assert sorted(r["frame_id"] for r in spark.read.parquet(good).collect()) == [1, 2, 4, 5]
    assert [r["value"] for r in spark.read.parquet(bad).collect()] == ['{"frame_id": ']


def test_broker_options():
    options = records.kafka_options("host:1", [records.RAW_AUDIO, records.METADATA], from_beginning=False)
    assert options["subscribe"] == "nfl.raw.audio,nfl.metadata" and options["startingOffsets"] == "latest"


def test_seasons_unite_by_name(spark):
    path = scratch_path(spark, "seasons")
    spark.createDataFrame([(2023, 1.0)], "season int, epa double").write.parquet(f"{path}/a.parquet")
    spark.createDataFrame([(2024, 2.0, 0.5)], "season int, epa double, wp double").write.parquet(f"{path}/b.parquet")
    got = tables.read_seasons(spark, f"{path}/*.parquet", ["season", "wp"]).orderBy("season").collect()
    assert [tuple(r) for r in got] == [(2023, None), (2024, 0.5)]
    mixed = tables.union_seasons(
        [spark.createDataFrame([("7",)], "down string"), spark.createDataFrame([(3.0, 1)], "down double, x int")], {"down": "double"})
    assert sorted(r["down"] for r in mixed.collect()) == [3.0, 7.0]


def test_json_array_and_nan(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"week": 3, "actual": {"home_win": false}}, {"week": 4}]')
    got = tables.read_json_array(spark, str(tmp_path / "p.json"), "week int, actual struct<home_win:boolean>")
    assert [(r["week"], r["actual"]) for r in got.orderBy("week").collect()][1] == (4, None)
    nan = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert [r["x"] for r in tables.nan_columns_to_null(nan).orderBy("k").collect()] == [None, 2.0]


def test_players_are_classified_on_a_stream(spark):
    colours = spark.createDataFrame(
        [("CLE", "#FF3C00", "#311D00"), ("NE", "#002244", None)], "team_abbr string, team_color string, team_color2 string")
    from fieldglass.operators.vision import frame_counts, frame_detections, team_swatches
    from fieldglass.streaming.live import classified_players
    rows = [(f, 0.5 * f, 720, [10.0, 300.0, 30.0, 400.0], c, 0, h, "CLE", "NE", "CLE")
            for f in (1, 2, 3, 5) for c, h in ((0.9, 8.0), (0.9, 104.0), (0.9, 60.0), (0.1, 8.0))]
    schema = ("frame_id int, timestamp_sec double, frame_height int, bbox array<double>, confidence double, class int, hue double, "
              "away_team string, home_team string, posteam string")
    path, out = scratch_path(spark, "boxes"), scratch_path(spark, "players")
    spark.createDataFrame(rows, schema).write.parquet(path)
    players = classified_players(spark.readStream.schema(schema).parquet(path), team_swatches(colours))
    start_append(players, out, scratch_path(spark, "ck")).awaitTermination()
    seen = spark.read.schema(players.schema).parquet(out)
    assert [tuple(r) for r in frame_counts(seen).orderBy("frame_id").collect()] == [(2, 1.0, 3, 1, 1, 1), (5, 2.5, 3, 1, 1, 1)]
    record = frame_detections(seen).where("frame_id = 5").first()
    assert sorted((p["team"] or "", p["side"] or "") for p in record["players"]) == [("", ""), ("CLE", "offense"), ("NE", "defense")]


def test_a_saved_model_scores_the_same(spark):
    from fieldglass.models import boosting
    rng = random.Random(14)
    rows = [(2020 + i % 3, rng.uniform(-1, 1), None if i % 7 == 0 else rng.uniform(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "season int, a double, b double").withColumn("label", (F.col("a") > 0).cast("int"))
    fitted = boosting.train_win_probability(df, 2022, boosting.Boosting(trees=3, depth=2), ["a", "b"])
    assert fitted.metrics["accuracy"] > 0.9 and fitted.metrics["n_test"] == 100
    path = scratch_path(spark, "model")
    boosting.save(fitted, path, spark)
    again = boosting.load(path, spark)
    one, two = (boosting.score(m, df).orderBy("season", "a").collect() for m in (fitted, again))
    assert one == two and again.features == ["a", "b"]
    assert boosting.score(fitted, df.drop("b")).count() == 300


def test_features_before_a_change_stay_the_same(spark):
    """Changing plays of week 5 and later leaves every feature of weeks up to 5 alone."""
    from fieldglass.plans.features import feature_matrix
    rng = random.Random(15)
    pairs = (("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"))
    rows = [(f"g{w}{min(a, b)}", 2024, w, a, b, "pass", 0.5, rng.choice([0.0, 1.0]), 1.0, float(rng.randrange(1, 4)), float(rng.randrange(2)),
             rng.uniform(-5, 5), rng.uniform(-1, 1)) for w in range(1, 8) for a, b in pairs for _ in range(5)]
    schema = ("game_id string, season int, week int, posteam string, defteam string, play_type string, wp double, pass_attempt double, "
              "rush_attempt double, down double, success double, cpoe double, epa double")
    df = spark.createDataFrame(rows, schema)
    loud = df.withColumn("epa", F.when(F.col("week") >= 5, 99.0).otherwise(F.col("epa")))
    known = ["off_epa_pass_ema5", "def_epa_rush_ema5", "edsr_ema5", "adj_off_epa", "adj_def_epa"]

    def early(plays):
        out = feature_matrix(plays).where("week <= 5").select("game_id", "team", *[F.round(c, 9) for c in known])
        return sorted(map(str, out.collect()))

    assert early(df) == early(loud)


def test_live_jobs_release_highlights(spark, monkeypatch):
    """The live pipeline returns the highlights of its clips beside the probabilities, the same as the batch job's."""
    from fieldglass.catalog import live as cl
    from fieldglass.models import boosting
    rng = random.Random(41)
    words = {c: [["7"] * 12 for _ in range(80)] for c in (1, 2, 3)}
    for c in words:
        for seg in range(80):
            loud = 9 if seg in (30, 34, 55, 78) and c < 3 else 1
            words[c][seg] = ["KC", "14" if seg < 33 else "21", "SF", str(10 + c), "2ND & 7", "1ST 8:00", *["x" * (loud * rng.choice([3, 4]))] * 6]
    rows = [(c, s, [(float(i), w) for i, w in enumerate(ws)]) for c, segs in words.items() for s, ws in enumerate(segs)]
    made = spark.createDataFrame(rows, "doc_id long, seg int, tokens array<struct<x:double,text:string>>").repartition(3)
    train = spark.range(60).select((F.col("id") % 3 + 2020).cast("int").alias("season"), (F.col("id") % 2).alias("label"), (F.col("id") % 4).alias("qtr"))
    fitted = boosting.train_win_probability(train, 2022, boosting.Boosting(trees=2, depth=2), ["qtr"])
    monkeypatch.setattr(cl, "frames", lambda *_: made)
    monkeypatch.setattr(cl, "in_play_model", lambda *_: fitted)
    out = cl.l5(spark, "").collect()
    assert sorted((r["clip_id"], r["frame_id"]) for r in out if r["topic"] == "winprob") == sorted((c, s) for c, s, _ in rows)
    found = sorted((r["clip_id"], r["t"], r["confirmed"], r["clip_start"], r["tag"]) for r in out if r["topic"] == "highlights")
    # At 34 the clip rests, 55 + 23 lies beyond the last watermark of 79 - 5, as does 78.
    assert found == [(c, 30.0, True, 15.0, "confirmed") for c in (1, 2)]


def test_a_slice_of_a_replay_is_one_file(spark, tmp_path):
    """Files of a table read by many tasks: none mixes slices, and they are ordered by time."""
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 37 % 1000).cast("double").alias("t"))
    df = df.unionByName(spark.createDataFrame([(None,)], "t double"))
    path = str(tmp_path / "replay")
    records.write_replay(df, path, "t", 4, 2)
    records.write_replay(df.where("t < 5"), path, "t", 1)
    files = sorted((os.stat(f"{path}/{f}").st_mtime_ns, f) for f in os.listdir(path) if f.endswith(".parquet"))
    spans = [spark.read.parquet(f"{path}/{f}").agg(F.min("loop_id"), F.min("t"), F.max("t"), F.count("t")).first() for _, f in files]
    assert len(spans) == 9 and sum(s[3] for s in spans) == 2005
    for one, two in zip(spans[:8], spans[1:8]):
        assert (one[0], one[2]) < (two[0], two[1])
    assert max(s[3] for s in spans) < 300


def test_clips_of_a_bucket_keep_their_own_state(spark, monkeypatch):
    """Also where all clips share one bucket, ids are beyond the whole numbers of a double and one is null."""
    from fieldglass.streaming import highlights as live
    monkeypatch.setattr(live, "BUCKETS", 1)
    energy, scores = clip_records()
    named = {c: None if i == 0 else (1 << 60) + i for i, c in enumerate(sorted({r[0] for r in energy}))}
    expected = {(named[c], t): v for (c, t), v in _as_batch(spark, energy, scores).items() if t + 23 <= 239.5 - 10}
    path, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    schema = "clip_id long, timestamp_sec double, id long, rms double, away_score int, home_score int, kind int"
    rows = [(named[c], t, i, rms, None, None, 1) for c, t, i, rms in energy] + [(named[c], t, i, None, a, h, 0) for c, t, i, a, h in scores]
    records.write_replay(spark.createDataFrame(rows, schema).repartition(5), path, "timestamp_sec", 3)
    stream = records.read_replay(spark, path, schema, files_per_batch=1)
    found = live_highlights(
        stream.where("kind = 1").select("clip_id", "timestamp_sec", "id", "rms"),
        stream.where("kind = 0").select("clip_id", "timestamp_sec", "id", "away_score", "home_score"), delay="10 seconds")
    start_append(found, out, checkpoint).awaitTermination()
    got = {(r["clip_id"], r["t"]): r["confirmed"] for r in spark.read.schema(found.schema).parquet(out).collect()}
    assert got == expected and len({c for c, _ in got}) == len(named)
