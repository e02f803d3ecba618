"""Sources, filters and aggregates of plays."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.base import (
    CLEAN_FILTER, WITH_CLEAN, WITH_INJURIES, WITH_PLAYS, injuries, plays, query, rounded, table,
)
from fieldglass.operators import cleaning, games as g, injuries as inj
from fieldglass.operators.timeline import at_period, before
from fieldglass.sources.tables import read_optional, read_seasons, read_win_prob_plays

LINE_KEYS = ["game_id", "line", "part", "ydstogo"]
LINE_SQL = "game_id, line, part, ydstogo"
PREPARED_SQL = f"""{WITH_PLAYS}, labelled AS (
  SELECT * FROM plays WHERE posteam IS NOT NULL AND score_differential IS NOT NULL
    AND result IS NOT NULL AND result <> 0)
SELECT {LINE_SQL}, coalesce(down, 0) AS down, CAST(posteam_type = 'home' AS INTEGER) AS is_home,
  CASE WHEN posteam_type = 'home' THEN CAST(result > 0 AS INTEGER) ELSE 1 - CAST(result > 0 AS INTEGER) END AS label
FROM labelled"""


@query("a1_read_seasons", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem")
def a1(spark, folder):
    return read_seasons(
        spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"],
    )


@query("a2_read_win_prob_plays", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax <> 0 AND l_returnflag = 'R'""")
def a2(spark, folder):
    keep = (
        F.col("l_quantity").isNotNull() & F.col("l_discount").isNotNull()
        & (F.col("l_tax") != 0) & (F.col("l_returnflag") == "R")
    )
    return read_win_prob_plays(
        spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"],
        keep, "l_returnflag",
    ).drop("l_tax")


@query("a3_read_reports", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def a3(spark, folder):
    return read_seasons(spark, [f"{folder}/orders.parquet"], ["o_orderkey", "o_orderpriority", "o_orderstatus"])


@query("a4_optional_table", "SELECT o_orderkey, o_custkey, true AS with_schedule FROM orders")
def a4(spark, folder):
    absent = read_optional(spark, None)
    present = read_optional(spark, f"{folder}/orders.parquet")
    return present.select("o_orderkey", "o_custkey", F.lit(absent is None).alias("with_schedule"))


@query("b1_garbage_time", f"{WITH_PLAYS} SELECT {LINE_SQL}, wp FROM plays WHERE wp > 0.05::DOUBLE AND wp < 0.95::DOUBLE")
def b1(spark, folder):
    return cleaning.filter_garbage_time(plays(spark, folder)).select(*LINE_KEYS, "wp")


@query("b2_non_plays", f"""{WITH_PLAYS} SELECT {LINE_SQL}, play_type, qb_kneel, qb_spike FROM plays
WHERE qb_kneel IS DISTINCT FROM 1 AND qb_spike IS DISTINCT FROM 1 AND play_type IS DISTINCT FROM 'no_play'""")
def b2(spark, folder):
    return cleaning.filter_non_plays(plays(spark, folder)).select(*LINE_KEYS, "play_type", "qb_kneel", "qb_spike")


@query("b3_clean_plays", f"{WITH_PLAYS} SELECT {LINE_SQL}, wp, epa FROM plays WHERE {CLEAN_FILTER}")
def b3(spark, folder):
    return cleaning.clean_plays(plays(spark, folder)).select(*LINE_KEYS, "wp", "epa")


@query("b4_labelable_plays", f"""{WITH_PLAYS} SELECT {LINE_SQL}, result FROM plays
WHERE posteam IS NOT NULL AND score_differential IS NOT NULL AND result IS NOT NULL AND result <> 0""")
def b4(spark, folder):
    return plays(spark, folder).where(cleaning.labelable()).select(*LINE_KEYS, "result")


@query("b5_prepare_win_prob", PREPARED_SQL)
def b5(spark, folder):
    labelled = plays(spark, folder).where(cleaning.labelable())
    return cleaning.prepare_win_prob(labelled).select(*LINE_KEYS, "down", "is_home", "label")


@query("b6_early_downs", f"{WITH_PLAYS} SELECT {LINE_SQL}, down FROM plays WHERE down IN (1, 2)")
def b6(spark, folder):
    return plays(spark, folder).where(cleaning.early_down()).select(*LINE_KEYS, "down")


@query("b7_strictly_before", f"""{WITH_PLAYS} SELECT {LINE_SQL}, season, week FROM plays
WHERE (season, week) < (1998, 6)""")
def b7(spark, folder):
    return plays(spark, folder).where(before(1998, 6)).select(*LINE_KEYS, "season", "week")


@query("b8_target_week", f"{WITH_PLAYS} SELECT {LINE_SQL}, season, week FROM plays WHERE season = 1998 AND week = 6")
def b8(spark, folder):
    return plays(spark, folder).where(at_period(1998, 6)).select(*LINE_KEYS, "season", "week")


@query("b9_required_columns", "SELECT p_partkey, p_size, p_brand FROM part")
def b9(spark, folder):
    return cleaning.require_columns(
        table(spark, folder, "part"), ["p_partkey", "p_size", "p_brand"],
    ).select("p_partkey", "p_size", "p_brand")


@query("b13_status_weight", f"""{WITH_INJURIES} SELECT season, week, team, gsis_id, position,
  CAST(CASE report_status WHEN 'Out' THEN 1.0 WHEN 'Doubtful' THEN 0.75 WHEN 'Questionable' THEN 0.25 ELSE 0 END AS DOUBLE)
    AS weight FROM injuries""")
def b13(spark, folder):
    return injuries(spark, folder).select(
        "season", "week", "team", "gsis_id", "position", inj.status_weight(F.col("report_status")).alias("weight"),
    )


OFF_KEYS = "game_id, posteam AS team, week, season"


@query("d1_offensive_value", f"""{WITH_CLEAN} SELECT {OFF_KEYS},
  avg(CASE WHEN pass_attempt = 1 THEN epa END) AS off_epa_pass, avg(CASE WHEN rush_attempt = 1 THEN epa END) AS off_epa_rush
FROM clean WHERE posteam IS NOT NULL AND (pass_attempt = 1 OR rush_attempt = 1) GROUP BY game_id, posteam, week, season""")
def d1(spark, folder):
    return g.offensive_value_by_game(cleaning.clean_plays(plays(spark, folder)))


@query("d2_defensive_value", f"""{WITH_CLEAN} SELECT game_id, defteam AS team, week, season,
  avg(CASE WHEN pass_attempt = 1 THEN epa END) AS def_epa_pass, avg(CASE WHEN rush_attempt = 1 THEN epa END) AS def_epa_rush
FROM clean WHERE pass_attempt = 1 OR rush_attempt = 1 GROUP BY game_id, defteam, week, season""")
def d2(spark, folder):
    return g.defensive_value_by_game(cleaning.clean_plays(plays(spark, folder)))


@query("d3_early_down_success", f"""{WITH_CLEAN} SELECT {OFF_KEYS}, avg(success) AS edsr
FROM clean WHERE posteam IS NOT NULL AND down IN (1, 2) GROUP BY game_id, posteam, week, season""")
def d3(spark, folder):
    return g.early_down_success_rate(cleaning.clean_plays(plays(spark, folder)))


@query("d4_zscore", """SELECT p_partkey,
  round(CASE WHEN (SELECT stddev_pop(p_size) FROM part) = 0 THEN 0
    ELSE (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) END, 6) AS z_size
FROM part""")
def d4(spark, folder):
    scored = g.zscore(table(spark, folder, "part"), {"z_size": "p_size"})
    return rounded(scored.select("p_partkey", "z_size"), "z_size")


COMPOSITE_CTE = """m AS (
  SELECT game_id, posteam AS team, week, season, avg(epa) AS e, avg(cpoe) AS c FROM clean
  WHERE posteam IS NOT NULL AND pass_attempt = 1 AND cpoe IS NOT NULL GROUP BY game_id, posteam, week, season),
composite AS (SELECT game_id, team, week, season,
  0.7::DOUBLE * (e - avg(e) OVER ()) / stddev_pop(e) OVER () + 0.3::DOUBLE * (c - avg(c) OVER ()) / stddev_pop(c) OVER ()
    AS qb_composite FROM m)"""


@query("d5_passer_composite", f"""{WITH_CLEAN}, {COMPOSITE_CTE}
SELECT game_id, team, week, season, round(qb_composite, 6) AS qb_composite FROM composite""")
def d5(spark, folder):
    return rounded(g.passer_composite(cleaning.clean_plays(plays(spark, folder))), "qb_composite")


@query("d6_passer_game_stats", f"""{WITH_PLAYS} SELECT game_id, season, week, posteam AS team, passer_player_id,
  passer_player_name, avg(epa) AS qb_epa, avg(cpoe) AS qb_cpoe, count(*) AS qb_dropbacks
FROM plays WHERE pass_attempt = 1 AND passer_player_id IS NOT NULL AND posteam IS NOT NULL
GROUP BY game_id, season, week, posteam, passer_player_id, passer_player_name""")
def d6(spark, folder):
    return g.passer_game_stats(plays(spark, folder))


@query("d7_team_game_actuals", f"""{WITH_PLAYS} SELECT game_id, posteam AS team,
  coalesce(sum(passing_yards) FILTER (WHERE pass_attempt = 1), 0) AS actual_passing_yards,
  coalesce(sum(rushing_yards) FILTER (WHERE rush_attempt = 1), 0) AS actual_rushing_yards,
  CAST(count(*) FILTER (WHERE sack = 1) AS DOUBLE) AS actual_sacks_taken
FROM plays WHERE posteam IS NOT NULL AND (pass_attempt = 1 OR rush_attempt = 1 OR sack = 1) GROUP BY game_id, posteam""")
def d7(spark, folder):
    return g.team_game_actuals(plays(spark, folder))


BURDEN_SQL = """SELECT season, week, team,
  sum(CAST(CASE report_status WHEN 'Out' THEN 1.0 WHEN 'Doubtful' THEN 0.75 WHEN 'Questionable' THEN 0.25 ELSE 0 END AS DOUBLE))
    AS injury_burden,
  count(*) FILTER (WHERE report_status = 'Out') AS players_out,
  count(*) FILTER (WHERE report_status = 'Out' AND position = 'QB') AS qb_out
FROM injuries GROUP BY season, week, team"""


@query("d8_injury_burden", f"{WITH_INJURIES} {BURDEN_SQL}")
def d8(spark, folder):
    return inj.injury_burden(injuries(spark, folder))


@query("d9_week_injury_burden", f"""{WITH_INJURIES}, burden AS ({BURDEN_SQL})
SELECT team, injury_burden, qb_out FROM burden WHERE season = 1998 AND week = 6""")
def d9(spark, folder):
    return inj.injury_burden_of_week(injuries(spark, folder), 1998, 6)


TEAM_GAME_CTE = f"""o AS (
  SELECT game_id, posteam AS team, week, season,
    avg(CASE WHEN pass_attempt = 1 THEN epa END) AS off_epa_pass, avg(CASE WHEN rush_attempt = 1 THEN epa END) AS off_epa_rush
  FROM clean WHERE posteam IS NOT NULL AND (pass_attempt = 1 OR rush_attempt = 1) GROUP BY ALL),
d AS (
  SELECT game_id, defteam AS team, week, season,
    avg(CASE WHEN pass_attempt = 1 THEN epa END) AS def_epa_pass, avg(CASE WHEN rush_attempt = 1 THEN epa END) AS def_epa_rush
  FROM clean WHERE pass_attempt = 1 OR rush_attempt = 1 GROUP BY ALL),
e AS (SELECT game_id, posteam AS team, week, season, avg(success) AS edsr FROM clean
  WHERE posteam IS NOT NULL AND down IN (1, 2) GROUP BY ALL),
{COMPOSITE_CTE},
team_game AS (SELECT * FROM o FULL JOIN d USING (game_id, team, week, season)
  FULL JOIN e USING (game_id, team, week, season) FULL JOIN composite USING (game_id, team, week, season))"""


@query("c1_team_game_table", f"""{WITH_CLEAN}, {TEAM_GAME_CTE}
SELECT game_id, team, week, season, off_epa_pass, off_epa_rush, def_epa_pass, def_epa_rush, edsr,
  round(qb_composite, 6) AS qb_composite FROM team_game""")
def c1(spark, folder):
    return rounded(g.team_game_table(cleaning.clean_plays(plays(spark, folder))), "qb_composite")


@query("c2_aligned_outer", f"""{WITH_PLAYS}, p AS (SELECT game_id, posteam, sum(passing_yards) AS passed FROM plays
  WHERE pass_attempt = 1 AND posteam IS NOT NULL GROUP BY ALL),
r AS (SELECT game_id, posteam, sum(rushing_yards) AS ran FROM plays
  WHERE rush_attempt = 1 AND posteam IS NOT NULL GROUP BY ALL),
s AS (SELECT game_id, posteam, count(*) AS sacked FROM plays WHERE sack = 1 AND posteam IS NOT NULL GROUP BY ALL)
SELECT game_id, posteam AS team, coalesce(passed, 0) + coalesce(ran, 0) AS yards,
  CAST(coalesce(sacked, 0) AS DOUBLE) AS sacks
FROM p FULL JOIN r USING (game_id, posteam) FULL JOIN s USING (game_id, posteam)""")
def c2(spark, folder):
    actual = g.team_game_actuals(plays(spark, folder))
    return actual.select(
        "game_id", "team", (F.col(g.ACTUALS[0]) + F.col(g.ACTUALS[1])).alias("yards"),
        F.col(g.ACTUALS[2]).alias("sacks"),
    )


@query("f1_ordered_team_games", f"""{WITH_CLEAN} SELECT {OFF_KEYS}, count(*) AS n FROM clean
WHERE posteam IS NOT NULL GROUP BY game_id, posteam, week, season ORDER BY team, season, week, game_id""")
def f1(spark, folder):
    rows = cleaning.clean_plays(plays(spark, folder)).where(F.col("posteam").isNotNull())
    counted = rows.groupBy("game_id", F.col("posteam").alias("team"), "week", "season").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("team", "season", "week", "game_id")
