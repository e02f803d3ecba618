"""Sinks, JSON records and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.asof import MONTHLY_CTE, WITH_CLEAN, monthly
from fieldglass.catalog.base import games, plays, query, table
from fieldglass.catalog.games import ACTUAL_CTE, WITH_GAMES
from fieldglass.catalog.tokens import STATES_CTE, frames
from fieldglass.operators import matchups as m, tokens as tk
from fieldglass.operators.games import team_game_actuals
from fieldglass.plans.fusion_job import fuse_files
from fieldglass.session import scratch_path
from fieldglass.sources import records as rc, tables as tb

STATE_SCHEMA = (
    "doc_id long, seg int, raw_text string, quarter string, clock string, down int, distance int, away_team string, "
    "away_score int, home_team string, home_score int"
)


def _states(spark, folder):
    return tk.parse_token_frames(frames(spark, folder))


@query("a6_fuse_files", f"""WITH {STATES_CTE}, scored AS (SELECT *, 1 / (1 + exp(-(away_score - home_score) / 7.0::DOUBLE)) AS p FROM states
  WHERE quarter IS NOT NULL AND clock IS NOT NULL AND down IS NOT NULL AND distance IS NOT NULL AND away_team IS NOT NULL
    AND away_score IS NOT NULL AND home_team IS NOT NULL AND home_score IS NOT NULL)
SELECT doc_id, seg, away_team AS posteam_assumption, round_even(p, 4) AS posteam_win_prob, round_even(1 - p, 4) AS defteam_win_prob,
  'Q' || quarter || ' ' || clock || ' | ' || down || '&' || distance || ' | ' || away_team || ' ' || away_score || ' - ' || home_team || ' ' || home_score
    AS situation, (SELECT count(*) FROM scored) AS written, (SELECT count(*) FROM states) - (SELECT count(*) FROM scored) AS skipped FROM scored""")
def a6(spark, folder):
    source, target = scratch_path(spark, "states-in"), scratch_path(spark, "records-out")
    tb.write_json_lines(_states(spark, folder), source)

    def logistic(df):
        return df.withColumn("p", 1 / (1 + F.exp(-F.col("score_differential") / F.lit(7.0))))

    written, skipped = fuse_files(spark, source, target, logistic, STATE_SCHEMA, ("doc_id", "seg"))
    schema = (
        "doc_id long, seg int, posteam_assumption string, situation string, posteam_win_prob double, defteam_win_prob double"
    )
    return tb.read_json_lines(spark, target, schema).withColumns({
        "written": F.lit(written).cast("long"), "skipped": F.lit(skipped).cast("long"),
    })


@query("a7_state_lines", f"WITH {STATES_CTE} SELECT * FROM states")
def a7(spark, folder):
    path = scratch_path(spark, "states")
    tb.write_json_lines(_states(spark, folder), path)
    return tb.read_json_lines(spark, path, STATE_SCHEMA)


@query("a8_parquet_sink", f"{WITH_CLEAN}, {MONTHLY_CTE} SELECT team, season, week, value FROM monthly")
def a8(spark, folder):
    path = scratch_path(spark, "monthly")
    tb.write_parquet(monthly(spark, folder), path, ["season"])
    return spark.read.parquet(path).select("team", "season", "week", "value")


@query("a9_nested_documents", f"""{WITH_GAMES}, {ACTUAL_CTE}
SELECT g.game_id, CASE WHEN result IS NOT NULL THEN home_score > away_score END AS home_won,
  CASE WHEN result IS NOT NULL THEN h.passed END AS home_passing
FROM games g LEFT JOIN actuals h ON h.game_id = g.game_id AND h.team = g.home_team""")
def a9(spark, folder):
    g = games(spark, folder)
    documents = m.with_actual(g.select("game_id"), g, team_game_actuals(plays(spark, folder)))
    path = scratch_path(spark, "documents")
    tb.write_json_lines(documents, path)
    read = tb.read_json_lines(spark, path, documents.schema)
    return read.select(
        "game_id", F.col("actual.home_win").alias("home_won"),
        F.col("actual.stats.home.passing_yards").alias("home_passing"),
    )


# Every row whose event type is an error carries a cut-off JSON text.
BROKEN = "case when event_type = 'error' then substr(props, 1, 4) else props end"


@query("h13_json_round_trip", "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def h13(spark, folder):
    """Decode, encode and decode again."""
    events = table(spark, folder, "events").select("event_id", "user_id", "props")
    decoded = rc.good_rows(rc.decode(events, "k int", "props", ["event_id", "user_id"]))
    encoded = rc.encode(decoded, keep=["event_id"])
    return rc.good_rows(rc.decode(encoded, "user_id long, k int", keep=["event_id"]))


@query("a12_encoded_values", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' ||
  json_extract_string(props, '$.k') || '}' AS value FROM events""")
def a12(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "props")
    decoded = rc.good_rows(rc.decode(events, "k int", "props", ["event_id", "event_type"]))
    encoded = rc.encode(decoded.select(F.col("event_id").alias("key"), "event_id", "event_type", "k"), keep=["key"])
    return encoded.withColumnRenamed("key", "event_id")
