"""Streaming jobs on replayed events; each returns what the finished stream has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.base import (
    STREAM_UNIT, USER_UNIT, amplitude, event_seconds, query, rounded, table,
)
from fieldglass.catalog.models import in_play_model
from fieldglass.catalog.records import BROKEN
from fieldglass.catalog.signal import HIGHLIGHT_SQL, SIGNAL_SQL
from fieldglass.catalog.tokens import WITH_STATES, frames
from fieldglass.operators import sampling as sp
from fieldglass.session import scratch_path
from fieldglass.sources import records as rc
from fieldglass.streaming import live as lv, stages as st, windows as wn
from fieldglass.streaming.highlights import Limits, live_highlights

SLICES = 6
FRAME_SLICES = 24
DELAY_SECONDS = 5
EVENT_FIELDS = "event_id long, event_type string, user_id long, t double, value double, props string"


def replayed(spark, folder, unit=STREAM_UNIT, loops=1, slices=SLICES):
    """Events cut into time slices and read back as a stream."""
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "user_id", event_seconds(unit).alias("t"), "value", "props",
    )
    path = scratch_path(spark, "replay")
    rc.write_replay(events, path, "t", slices, loops)
    return rc.read_replay(spark, path, EVENT_FIELDS, files_per_batch=2)


def finished(spark, df, name):
    """Run an append query over all there is and read its output."""
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    st.start_append(df, path, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def topic_files(spark, folder, name="topics"):
    """Events as (topic, value) records in JSON files, as a broker would hand them over."""
    path = scratch_path(spark, name)
    events = table(spark, folder, "events").selectExpr("event_type as topic", "event_id", "user_id", "value as v")
    rc.encode(events, keep=["topic"]).write.json(path)
    return rc.read_topic_files(spark, path, files_per_batch=4)


@query("a10_topic_source", "SELECT event_id, user_id, value AS v FROM events WHERE event_type = 'purchase'")
def a10(spark, folder):
    records = rc.topic_records(topic_files(spark, folder), "purchase", "event_id long, user_id long, v double")
    return finished(spark, rc.good_rows(records), "topic")


@query("a11_topic_dispatch", """SELECT event_type AS topic, event_id, user_id, CASE WHEN event_type = 'error' THEN value END AS v FROM events
WHERE event_type IN ('error', 'purchase')""")
def a11(spark, folder):
    """Two topics of one subscription, each with its own schema."""
    both = topic_files(spark, folder)
    errors = rc.good_rows(rc.topic_records(both, "error", "event_id long, user_id long, v double"))
    purchases = rc.good_rows(rc.topic_records(both, "purchase", "event_id long, user_id long"))
    tagged = errors.withColumn("topic", F.lit("error")).unionByName(
        purchases.withColumn("topic", F.lit("purchase")), allowMissingColumns=True,
    )
    return finished(spark, tagged, "dispatch")


@query("a13_replay_loops", """SELECT event_id, CAST(unnest([0, 1]) AS INTEGER) AS loop_id FROM events""")
def a13(spark, folder):
    return finished(spark, replayed(spark, folder, loops=2, slices=3).select("event_id", "loop_id"), "replay-out")


@query("i1_stateless_stage")
def i1(spark, folder):
    """Scoreboard states in, probability records out."""
    path = scratch_path(spark, "states-in")
    from fieldglass.operators.tokens import parse_token_frames
    states = parse_token_frames(frames(spark, folder))
    states.write.parquet(path)
    stream = spark.readStream.schema(states.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return finished(spark, st.win_probabilities(stream, in_play_model(spark, folder), ["doc_id", "seg"]), "winprob")


@query("i2_quarantine", """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
  event_type = 'error' AS bad FROM events""")
def i2(spark, folder):
    """Errors carry cut-off JSON text; they are set aside, all others are processed."""
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    values = replayed(spark, folder).selectExpr("event_id", f"{BROKEN} as props")
    decoded = rc.decode(values, "k int", "props", ["event_id"])

    def kept(batch):
        return batch

    st.start_with_quarantine(
        decoded, good, bad, scratch_path(spark, "quarantine-checkpoint"), kept, keep=["event_id"],
    ).awaitTermination()
    processed = spark.read.schema("event_id long, k int").parquet(good).select("event_id", "k", F.lit(False).alias("bad"))
    aside = spark.read.schema("event_id long, value string").parquet(bad).select(
        "event_id", F.lit(None).cast("int").alias("k"), F.lit(True).alias("bad"),
    )
    return processed.unionByName(aside)


def _live(spark, folder, limits=Limits()):
    stream = replayed(spark, folder, USER_UNIT)
    tens = F.floor(F.col("value") / 10).cast("int")
    energy = stream.where(F.col("event_type").isin("click", "view", "error")).select(
        F.col("user_id").alias("clip_id"), F.col("t").alias("timestamp_sec"), F.col("event_id").alias("id"), amplitude().alias("rms"),
    )
    scores = stream.where(F.col("event_type").isin("purchase", "signup")).select(
        F.col("user_id").alias("clip_id"), F.col("t").alias("timestamp_sec"), F.col("event_id").alias("id"),
        F.when(tens > 0, tens).alias("away_score"), (tens % 3).alias("home_score"),
    )
    return finished(spark, live_highlights(energy, scores, limits=limits, delay=f"{DELAY_SECONDS} seconds"), "highlights")


# A trigger comes out once the watermark, the newest time less the delay, has passed its release.
RELEASED = f"""t + 23 <= (SELECT floor(max(epoch_us(ts) - 1704067200000000) / {USER_UNIT:.1f}::DOUBLE * 1000) / 1000 FROM events) - {DELAY_SECONDS}"""


@query("i3_rolling_state", f"""{HIGHLIGHT_SQL.replace('c.t > k.t + 20', 'c.t > k.t')} SELECT clip_id, t FROM kept WHERE {RELEASED}""")
def i3(spark, folder):
    """Every energy record above its rolling baseline: no cooldown."""
    return _live(spark, folder, Limits(cooldown=0.0)).select("clip_id", "t")


@query("i4_cooldown_state", f"{HIGHLIGHT_SQL} SELECT clip_id, t FROM kept WHERE {RELEASED}")
def i4(spark, folder):
    return _live(spark, folder).select("clip_id", "t")


@query("i5_score_history_state", f"{HIGHLIGHT_SQL} SELECT clip_id, t, confirmed FROM found WHERE {RELEASED}")
def i5(spark, folder):
    return _live(spark, folder).select("clip_id", "t", "confirmed")


@query("i6_deferred_highlights", f"""{HIGHLIGHT_SQL} SELECT clip_id, t, confirmed, greatest(0, t - 15) AS clip_start, greatest(0, t - 15) + 35 AS clip_end,
  CASE WHEN confirmed THEN 'confirmed' ELSE 'audio_only' END AS tag FROM found WHERE {RELEASED}""")
def i6(spark, folder):
    return _live(spark, folder).select("clip_id", "t", "confirmed", "clip_start", "clip_end", "tag")


def _latest(spark, folder, payload):
    path, checkpoint = scratch_path(spark, "latest"), scratch_path(spark, "latest-checkpoint")
    stream = replayed(spark, folder)
    st.start_latest(stream, ["event_type"], "t", payload, path, checkpoint, tie="event_id").awaitTermination()
    return st.read_latest(spark, path)


@query("i7_stream_progress", "SELECT event_type, max((epoch_us(ts) - 1704067200000000) / 3e8::DOUBLE) AS last_seen FROM events GROUP BY event_type")
def i7(spark, folder):
    return _latest(spark, folder, ["event_id"]).select("event_type", "last_seen")


@query("i9_latest_record", """SELECT event_type, arg_max(event_id, {'t': ts, 'id': event_id}) AS event_id,
  arg_max(value, {'t': ts, 'id': event_id}) AS value FROM events GROUP BY event_type""")
def i9(spark, folder):
    return _latest(spark, folder, ["event_id", "value"]).select("event_type", "event_id", "value")


@query("i10_trend_of_sink", """SELECT event_type, event_id, value FROM (SELECT *,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 300""")
def i10(spark, folder):
    sink = finished(spark, replayed(spark, folder).select("event_type", "event_id", "t", "value"), "trend")
    return sp.last_points(sink, ["event_type"], "t", tie="event_id").select("event_type", "event_id", "value")


@query("i11_append_only_list", "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'")
def i11(spark, folder):
    wanted = replayed(spark, folder).where(F.col("event_type") == "purchase")
    return finished(spark, wanted.select("event_id", "event_type", "value"), "events")


@query("i13_restart", "SELECT event_id, event_type FROM events")
def i13(spark, folder):
    """Stop after a part of the input and start again from the checkpoint: no loss, no repeat."""
    events = table(spark, folder, "events").select("event_id", "event_type", event_seconds(STREAM_UNIT).alias("t"))
    path, out, checkpoint = (scratch_path(spark, n) for n in ("restart", "restart-out", "restart-checkpoint"))
    middle = events.agg(F.avg("t")).first()[0]
    for part in (F.col("t") < middle, F.col("t") >= middle):
        rc.write_replay(events.where(part), path, "t", 2)
        stream = rc.read_replay(spark, path, "event_id long, event_type string, t double")
        st.start_append(stream.select("event_id", "event_type"), out, checkpoint).awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(out)


@query("g3_merged_topics", """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS kind,
  CASE WHEN event_type <> 'purchase' THEN value END AS rms, CASE WHEN event_type = 'purchase' THEN value END AS score
FROM events WHERE event_type IN ('purchase', 'error')""")
def g3(spark, folder):
    stream = replayed(spark, folder)
    energy = stream.where(F.col("event_type") == "error").select("event_id", F.col("value").alias("rms"))
    scores = stream.where(F.col("event_type") == "purchase").select("event_id", F.col("value").alias("score"))
    return finished(spark, st.merge_topics(energy, scores), "merged")


@query("l5_live_pipeline")
def l5(spark, folder):
    """Token frames and energy in; states, probabilities and highlights out.

    All clips start at time 0 and run side by side, so the replay is cut by time as a live feed would be. Energy are the
    letters on the screen.
    """
    letters = F.aggregate("tokens", F.lit(0), lambda n, t: n + F.length(t["text"]))
    clips = frames(spark, folder).select(
        F.col("doc_id").alias("clip_id"), F.col("seg").cast("long").alias("frame_id"),
        F.col("seg").cast("double").alias("timestamp_sec"),
        F.col("tokens").alias("bottom"), F.slice("tokens", 1, 6).alias("top"),
        (letters / 128).alias("rms"), F.col("seg").cast("long").alias("id"),
    )
    path = scratch_path(spark, "frames-in")
    rc.write_replay(clips, path, "timestamp_sec", FRAME_SLICES)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clips.schema)
    stream = rc.read_replay(spark, path, fields, files_per_batch=4).drop("loop_id", "slice")
    paths = lv.LivePaths(scratch_path(spark, "live"))
    running = lv.start_live(
        stream.drop("rms", "id"), ["bottom", "top"], stream.select("clip_id", "timestamp_sec", "id", "rms"),
        in_play_model(spark, folder), paths, stride=1, delay=f"{DELAY_SECONDS} seconds",
    )
    for job in running.values():
        job.awaitTermination()
    return live_records(spark, paths)


def live_records(spark, paths):
    """What the live jobs have published: a row per probability record and per highlight, told apart by `topic`."""
    records = spark.read.schema("clip_id long, frame_id long, situation string, posteam_win_prob double, defteam_win_prob double").parquet(
        paths.data("winprob"))
    found = spark.read.schema("clip_id long, t double, confirmed boolean, clip_start double, clip_end double, tag string").parquet(
        paths.data("highlights"))
    return records.withColumn("topic", F.lit("winprob")).unionByName(found.withColumn("topic", F.lit("highlights")), allowMissingColumns=True)


# Windows that the watermark, five seconds behind the newest event, has passed; whole milliseconds as in the stream.
_IN_MILLIS = f"""WITH s AS ({SIGNAL_SQL}), m AS (SELECT stream, rms, CAST(trunc(t * 1000) AS BIGINT) AS ms FROM s),
closed AS (SELECT max(ms) - {DELAY_SECONDS * 1000} AS until FROM m)"""


def _samples(spark, folder):
    return replayed(spark, folder).select(F.col("event_type").alias("stream"), "t", amplitude().alias("rms"))


@query("i12_stream_chunks", f"""{_IN_MILLIS} SELECT stream, ms // 500 * 0.5::DOUBLE AS start, count(*) AS n, round(sqrt(sum(rms * rms) / count(*)), 6) AS rms
FROM m, closed GROUP BY stream, ms // 500, until HAVING (ms // 500 + 1) * 500 <= until""")
def i12_stream(spark, folder):
    chunks = wn.windowed_energy(_samples(spark, folder), ["stream"], "t", "rms", 0.5, delay=f"{DELAY_SECONDS} seconds")
    return rounded(finished(spark, chunks, "chunks").select("stream", "start", "n", "rms"), "rms")


@query("d18_stream_envelope", f"""{_IN_MILLIS}, f AS (SELECT stream, rms, unnest([ms // 15000 - 1, ms // 15000]) AS frame FROM m)
SELECT stream, frame * 15.0::DOUBLE AS start, count(*) AS n, round(sqrt(sum(rms * rms) / count(*)), 6) AS rms
FROM f, closed GROUP BY stream, frame, until HAVING (frame + 2) * 15000 <= until""")
def d18_stream(spark, folder):
    frames_ = wn.windowed_energy(_samples(spark, folder), ["stream"], "t", "rms", 30.0, 15.0, f"{DELAY_SECONDS} seconds")
    return rounded(finished(spark, frames_, "envelope").select("stream", "start", "n", "rms"), "rms")


@query("i2_failing_handler", """SELECT event_id, CASE WHEN event_id % 4000 <> 7 THEN CAST(round(value * 100) AS BIGINT) END AS cents,
  event_id % 4000 = 7 AS bad FROM events""")
def i2_failing(spark, folder):
    """A handler that raises on one record in 4,000: those are set aside one by one, all others are handled."""
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    values = replayed(spark, folder, slices=2).selectExpr("event_id", "to_json(named_struct('event_id', event_id, 'value', value)) as text")
    decoded = rc.decode(values.select("text"), "event_id long, value double", "text")

    def cents(batch):
        refused = F.raise_error(F.concat(F.lit("no cents for "), F.col("event_id")))
        return batch.select("event_id", F.when(F.col("event_id") % 4000 == 7, refused.cast("long")).otherwise(F.round(F.col("value") * 100).cast("long")).alias("cents"))

    st.start_with_quarantine(decoded, good, bad, scratch_path(spark, "failing-checkpoint"), cents).awaitTermination()
    handled = spark.read.schema("event_id long, cents long").parquet(good).select("event_id", "cents", F.lit(False).alias("bad"))
    aside = spark.read.schema("value string, error string").parquet(bad).where("error is not null")
    return handled.unionByName(aside.select(
        F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.lit(None).cast("long").alias("cents"), F.lit(True).alias("bad")))
