"""Energy, triggers, confirmation and sampling on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.base import (
    CLIP_ENERGY_SQL, CLIP_SCORES_SQL, SIGNAL_SQL, clip_energy, clip_scores, query, rounded, signal, table,
)
from fieldglass.functions import labels as lb
from fieldglass.operators import highlights as hl, sampling as sp, signal as sg
from fieldglass.operators.timeline import ordered_position, time_bucket

WIDTH = 600.0

BASE_CTE = f"""s AS ({SIGNAL_SQL}),
based AS (SELECT *, CASE WHEN count(rms) OVER w = 20 THEN avg(rms) OVER w END AS baseline FROM s
  WINDOW w AS (PARTITION BY stream ORDER BY t, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
CANDIDATE_CTE = f"""{BASE_CTE},
cand AS (SELECT *, rms / baseline AS ratio FROM based WHERE rms > 0.05::DOUBLE AND baseline > 0 AND rms / baseline > 1.3::DOUBLE)"""
KEPT_SQL = f"""WITH RECURSIVE {CANDIDATE_CTE},
kept AS (SELECT stream, min(t) AS t FROM cand GROUP BY stream
  UNION ALL SELECT k.stream, min(c.t) AS t FROM kept k JOIN cand c ON c.stream = k.stream AND c.t > k.t + 20 GROUP BY k.stream, k.t)"""


def _based(spark, folder):
    return sg.rolling_baseline(
        signal(spark, folder), ["stream"], ["t", "id"], "rms", time_bucket(F.col("t"), WIDTH), block_rows=500,
    )


@query("e7_rolling_baseline", f"WITH {BASE_CTE} SELECT stream, id, baseline FROM based")
def e7(spark, folder):
    return _based(spark, folder).select("stream", "id", "baseline")


@query("e8_trigger_candidates", f"WITH {CANDIDATE_CTE} SELECT stream, id, round(ratio, 6) AS ratio FROM cand")
def e8(spark, folder):
    return rounded(sg.trigger_candidates(_based(spark, folder)).select("stream", "id", "ratio"), "ratio")


@query("e9_cooldown", f"{KEPT_SQL} SELECT stream, t FROM kept")
def e9(spark, folder):
    return sg.cooldown(sg.trigger_candidates(_based(spark, folder)), ["stream"], "t")


@query("d17_chunk_rms", f"""WITH s AS ({SIGNAL_SQL}) SELECT stream, CAST(floor(t / 60) AS BIGINT) AS chunk_id,
  round(sqrt(avg(rms * rms)), 6) AS rms FROM s GROUP BY 1, 2""")
def d17(spark, folder):
    chunked = sg.tumbling_chunks(signal(spark, folder), ["stream"], "t", 60.0)
    return rounded(sg.chunk_rms(chunked, ["stream", "chunk_id"], "rms"), "rms")


@query("d17_array_rms", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 32767) AS SMALLINT)) AS samples FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(samples, lambda x: (x / 32767.0::DOUBLE) * (x / 32767.0::DOUBLE))) / len(samples)), 6) AS rms FROM v""")
def d17_array(spark, folder):
    samples = F.transform("embedding", lambda x: F.round(x.cast("double") * 32767).cast("smallint"))
    return rounded(table(spark, folder, "embeddings").select("vec_id", sg.array_rms(samples).alias("rms")), "rms")


@query("d18_sliding_envelope", f"""WITH s AS ({SIGNAL_SQL}), n AS (SELECT stream, rms,
    row_number() OVER (PARTITION BY stream ORDER BY t, id) - 1 AS ix, count(*) OVER (PARTITION BY stream) AS total FROM s),
f AS (SELECT stream, rms, unnest([ix // 50, ix // 50 + 1]) AS frame, total // 50 AS last_frame FROM n)
SELECT stream, frame, round(sqrt(sum(rms * rms) / 100), 6) AS rms FROM f WHERE frame <= last_frame GROUP BY stream, frame""")
def d18(spark, folder):
    placed = ordered_position(signal(spark, folder), ["stream"], ["t", "id"], time_bucket(F.col("t"), WIDTH), "ix")
    totals = placed.groupBy("stream").agg(F.count(F.lit(1)).alias("total"))
    return rounded(sg.sliding_envelope(placed.join(totals, "stream"), ["stream"], "ix", "rms", "total", 50), "rms")


@query("i12_tumbling_chunks", f"""WITH s AS ({SIGNAL_SQL}) SELECT stream, CAST(floor(t / 0.5::DOUBLE) AS BIGINT) AS chunk_id, count(*) AS n
FROM s GROUP BY 1, 2""")
def i12(spark, folder):
    chunked = sg.tumbling_chunks(signal(spark, folder), ["stream"], "t")
    return chunked.groupBy("stream", "chunk_id").agg(F.count(F.lit(1)).alias("n"))


@query("b18_every_nth", "SELECT event_id, event_type FROM events WHERE event_id % 3 = 2")
def b18(spark, folder):
    return sp.every_nth(table(spark, folder, "events"), 3, "event_id").select("event_id", "event_type")


@query("b19_interval_frames", """SELECT event_id, event_id / 29.97::DOUBLE AS timestamp_sec FROM events WHERE event_id % 30 = 0""")
def b19(spark, folder):
    return sp.sample_interval(table(spark, folder, "events"), 29.97, 1.0, "event_id").select("event_id", "timestamp_sec")


@query("b37_first_per_interval", f"""WITH s AS ({SIGNAL_SQL}) SELECT stream, CAST(floor(t / 20) AS BIGINT) AS "interval",
  arg_min(id, {{'t': t, 'id': id}}) AS id FROM s GROUP BY 1, 2""")
def b37(spark, folder):
    first = sp.first_per_interval(signal(spark, folder), ["stream"], "t", ["id"], 20.0, tie="id")
    return first.select("stream", "interval", "id")


@query("b37_rate_limit", f"""WITH RECURSIVE s AS ({SIGNAL_SQL}),
kept AS (SELECT stream, min(t) AS t FROM s GROUP BY stream
  UNION ALL SELECT k.stream, min(s.t) AS t FROM kept k JOIN s ON s.stream = k.stream AND s.t >= k.t + 20 GROUP BY k.stream, k.t)
SELECT stream, t, min(id) AS id FROM s JOIN kept USING (stream, t) GROUP BY stream, t""")
def b37_rate_limit(spark, folder):
    return sp.rate_limit(signal(spark, folder), ["stream"], "t", 20.0, tie="id").select("stream", "t", "id")


@query("e11_last_points", """SELECT event_type, event_id FROM (SELECT event_type, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 300""")
def e11(spark, folder):
    return sp.last_points(table(spark, folder, "events"), ["event_type"], "ts", tie="event_id").select("event_type", "event_id")


@query("b35_feed_status", f"""WITH s AS ({SIGNAL_SQL}), l AS (SELECT stream, max(t) FILTER (WHERE stream <> 'signup') AS seen FROM s GROUP BY stream)
SELECT stream, CASE WHEN seen IS NULL THEN 'waiting' WHEN (SELECT max(t) FROM s) - seen < 3 THEN 'live' ELSE 'stale' END AS status FROM l""")
def b35(spark, folder):
    records = signal(spark, folder)
    now = records.agg(F.max("t")).scalar()
    seen = records.groupBy("stream").agg(F.max(F.when(F.col("stream") != "signup", F.col("t"))).alias("seen"))
    return seen.select("stream", lb.feed_status(F.col("seen"), now, 3.0).alias("status"))


# Triggers are a user's errors; scores that user's purchases and signups.
TRIGGER_CTE = f"""e AS ({CLIP_ENERGY_SQL}), sc AS ({CLIP_SCORES_SQL}), tr AS (SELECT clip_id, t, id FROM e)"""


def _confirm_sql(before: str, after: str, after_pick: str, known: str, wait: str) -> str:
    return f"""{TRIGGER_CTE},
b AS (SELECT tr.id, arg_max({{'a': s.away_score, 'h': s.home_score}}, {{'t': s.t, 'id': s.id}}) AS v FROM tr JOIN sc s
  ON s.clip_id = tr.clip_id AND {before} {known} GROUP BY tr.id),
f AS (SELECT tr.id, {after_pick}({{'a': s.away_score, 'h': s.home_score}}, {{'t': s.t, 'id': s.id}}) AS v,
    min(s.t) AS at FROM tr JOIN sc s ON s.clip_id = tr.clip_id AND {after} {known} GROUP BY tr.id),
conf AS (SELECT tr.clip_id, tr.id, tr.t, coalesce({wait}, false) AS confirmed
  FROM tr LEFT JOIN b ON b.id = tr.id LEFT JOIN f ON f.id = tr.id)"""


LIVE_CONFIRM = _confirm_sql(
    "s.t <= tr.t - 5", "s.t >= tr.t + 5", "arg_min", "AND s.away_score IS NOT NULL",
    "b.v IS NOT NULL AND f.v IS NOT NULL AND f.at <= tr.t + 23 AND "
    "(b.v.a IS DISTINCT FROM f.v.a OR b.v.h IS DISTINCT FROM f.v.h)",
)
POINT_CONFIRM = _confirm_sql(
    "s.t <= greatest(0, tr.t - 8)", "s.t <= tr.t + 8", "arg_max", "",
    "b.v.a IS NOT NULL AND f.v.a IS NOT NULL AND (b.v.a IS DISTINCT FROM f.v.a OR b.v.h IS DISTINCT FROM f.v.h)",
)


@query("c16_confirm_by_scores", f"WITH {LIVE_CONFIRM} SELECT clip_id, id, confirmed FROM conf")
def c16(spark, folder):
    triggers = clip_energy(spark, folder).drop("rms")
    out = hl.confirm_by_scores(triggers, clip_scores(spark, folder), ["clip_id"], width=50.0, tie="id")
    return out.select("clip_id", "id", "confirmed")


@query("c17_confirm_at_points", f"WITH {POINT_CONFIRM} SELECT clip_id, id, confirmed FROM conf")
def c17(spark, folder):
    triggers = clip_energy(spark, folder).drop("rms")
    out = hl.confirm_at_points(triggers, clip_scores(spark, folder), ["clip_id"], width=50.0, tie="id")
    return out.select("clip_id", "id", "confirmed")


@query("b36_clip_bounds", f"""WITH {TRIGGER_CTE}
SELECT id, greatest(0, t - 15) AS clip_start, greatest(0, t - 15) + 35 AS clip_end,
  CASE WHEN rms > 0.5::DOUBLE THEN 'confirmed' ELSE 'audio_only' END AS tag,
  'highlight_' || CAST(CAST(round_even(t, 0) AS BIGINT) AS VARCHAR) || 's_' || CASE WHEN rms > 0.5::DOUBLE THEN 'confirmed' ELSE 'audio_only' END AS clip_name
FROM e""")
def b36(spark, folder):
    flagged = clip_energy(spark, folder).withColumn("confirmed", F.col("rms") > 0.5)
    return hl.clip_bounds(flagged).select("id", "clip_start", "clip_end", "tag", "clip_name")


@query("c18_records_in_clips", f"""WITH {TRIGGER_CTE}, clips AS (SELECT clip_id, id AS trigger_id, greatest(0, t - 15) AS a,
    greatest(0, t - 15) + 35 AS z FROM e)
SELECT c.clip_id, c.trigger_id, s.id AS record_id FROM clips c JOIN sc s ON s.clip_id = c.clip_id AND s.t >= c.a AND s.t <= c.z""")
def c18(spark, folder):
    clips = hl.clip_bounds(clip_energy(spark, folder).withColumn("confirmed", F.lit(True))).select(
        "clip_id", F.col("id").alias("trigger_id"), "clip_start", "clip_end",
    )
    records = clip_scores(spark, folder).select("clip_id", F.col("id").alias("record_id"), F.col("t").alias("at"))
    return hl.records_in_clips(clips, records, ["clip_id"], "at").select("clip_id", "trigger_id", "record_id")


# The whole batch highlight job on the users' clips.
HIGHLIGHT_SQL = f"""WITH RECURSIVE e AS ({CLIP_ENERGY_SQL}), sc AS ({CLIP_SCORES_SQL}),
based AS (SELECT *, CASE WHEN count(rms) OVER w = 20 THEN avg(rms) OVER w END AS baseline FROM e
  WINDOW w AS (PARTITION BY clip_id ORDER BY t, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
cand AS (SELECT * FROM based WHERE rms > 0.05::DOUBLE AND baseline > 0 AND rms / baseline > 1.3::DOUBLE),
kept AS (SELECT clip_id, min(t) AS t FROM cand GROUP BY clip_id
  UNION ALL SELECT k.clip_id, min(c.t) AS t FROM kept k JOIN cand c ON c.clip_id = k.clip_id AND c.t > k.t + 20 GROUP BY k.clip_id, k.t),
b AS (SELECT tr.clip_id, tr.t, arg_max({{'a': s.away_score, 'h': s.home_score}}, {{'t': s.t, 'id': s.id}}) AS v FROM kept tr JOIN sc s
  ON s.clip_id = tr.clip_id AND s.t <= tr.t - 5 AND s.away_score IS NOT NULL GROUP BY ALL),
f AS (SELECT tr.clip_id, tr.t, arg_min({{'a': s.away_score, 'h': s.home_score}}, {{'t': s.t, 'id': s.id}}) AS v, min(s.t) AS at
  FROM kept tr JOIN sc s ON s.clip_id = tr.clip_id AND s.t >= tr.t + 5 AND s.away_score IS NOT NULL GROUP BY ALL),
found AS (SELECT kept.clip_id, kept.t, coalesce(b.v IS NOT NULL AND f.v IS NOT NULL AND f.at <= kept.t + 23 AND
    (b.v.a IS DISTINCT FROM f.v.a OR b.v.h IS DISTINCT FROM f.v.h), false) AS confirmed
  FROM kept LEFT JOIN b ON b.clip_id = kept.clip_id AND b.t = kept.t LEFT JOIN f ON f.clip_id = kept.clip_id AND f.t = kept.t)"""


@query("i8_batch_highlights", f"""{HIGHLIGHT_SQL} SELECT clip_id, t, confirmed, greatest(0, t - 15) AS clip_start, greatest(0, t - 15) + 35 AS clip_end FROM found""")
def i8(spark, folder):
    found = hl.find_highlights(clip_energy(spark, folder), clip_scores(spark, folder), ["clip_id"], width=50.0)
    return found.select("clip_id", "t", "confirmed", "clip_start", "clip_end")


BATCH_SQL = HIGHLIGHT_SQL[:HIGHLIGHT_SQL.index("b AS (SELECT tr.clip_id")] + """measured AS (
  SELECT clip_id, t, arg_min({'rms': rms, 'baseline': baseline}, id) AS m FROM cand GROUP BY ALL),
b AS (SELECT tr.clip_id, tr.t, arg_max({'a': s.away_score, 'h': s.home_score}, {'t': s.t, 'id': s.id}) AS v FROM kept tr JOIN sc s
  ON s.clip_id = tr.clip_id AND s.t <= greatest(0, tr.t - 8) GROUP BY ALL),
f AS (SELECT tr.clip_id, tr.t, arg_max({'a': s.away_score, 'h': s.home_score}, {'t': s.t, 'id': s.id}) AS v FROM kept tr JOIN sc s
  ON s.clip_id = tr.clip_id AND s.t <= tr.t + 8 GROUP BY ALL),
found AS (SELECT kept.clip_id, kept.t, m.rms AS rms, m.baseline AS baseline, m.rms / m.baseline AS ratio,
    coalesce(b.v.a IS NOT NULL AND f.v.a IS NOT NULL AND (b.v.a IS DISTINCT FROM f.v.a OR b.v.h IS DISTINCT FROM f.v.h), false) AS confirmed
  FROM kept JOIN measured ON measured.clip_id = kept.clip_id AND measured.t = kept.t
  LEFT JOIN b ON b.clip_id = kept.clip_id AND b.t = kept.t LEFT JOIN f ON f.clip_id = kept.clip_id AND f.t = kept.t)"""


@query("i8_recorded_highlights", f"""{BATCH_SQL} SELECT clip_id, t, round(rms, 6) AS rms, round(baseline, 6) AS baseline,
  round(ratio, 6) AS ratio, confirmed FROM found""")
def i8_recorded(spark, folder):
    found = hl.find_batch_highlights(clip_energy(spark, folder), clip_scores(spark, folder), ["clip_id"], width=50.0)
    return rounded(found.select("clip_id", "t", "rms", "baseline", "ratio", "confirmed"), "rms", "baseline", "ratio")


@query("i6_highlight_records", f"""{HIGHLIGHT_SQL} SELECT round(t, 1) AS trigger_time_sec, confirmed,
  'highlight_' || CAST(CAST(round_even(t, 0) AS BIGINT) AS VARCHAR) || 's_' || CASE WHEN confirmed THEN 'confirmed' ELSE 'audio_only' END AS clip_path
FROM found""")
def i6_records(spark, folder):
    return hl.highlight_records(hl.find_highlights(clip_energy(spark, folder), clip_scores(spark, folder), ["clip_id"], width=50.0))
