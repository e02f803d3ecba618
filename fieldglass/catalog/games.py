"""Schedule, matchups, predictions and reports on orders as games."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.base import (
    GAMES_SQL, INJURIES_SQL, PLAYS_SQL, TEAM, WITH_GAMES, WITH_INJURIES, games, injuries, plays, query, rounded, table,
)
from fieldglass.catalog.asof import MONTHLY_CTE, WITH_CLEAN, monthly
from fieldglass.catalog.plays import BURDEN_SQL
from fieldglass.functions import labels as lb
from fieldglass.models import metrics
from fieldglass.models.attribution import top_contributions
from fieldglass.operators import injuries as inj, matchups as m, schedule as sch
from fieldglass.operators.games import team_game_actuals

TARGET = "season = 1998 AND week = 6"


@query("b10_rest_advantage", f"""{WITH_GAMES} SELECT game_id, home_team, away_team, home_rest, away_rest,
  home_rest - away_rest AS rest_advantage_home FROM games""")
def b10(spark, folder):
    return sch.rest_advantage(games(spark, folder))


@query("b20_prefixed_columns", "SELECT n_nationkey AS home_n_nationkey, n_name AS home_n_name, n_regionkey AS home_n_regionkey FROM nation")
def b20(spark, folder):
    return m.prefixed(table(spark, folder, "nation"), "home_")


# A team's figures of a month, once as the home and once as the away side of every game.
SIDES_CTE = f"""games AS ({GAMES_SQL}), rated AS (SELECT team, season, week, value, team < 'T05' AS is_dome FROM monthly),
both_sides AS (SELECT g.*, h.value AS home_value, a.value AS away_value, h.is_dome AS home_is_dome, a.is_dome AS away_is_dome
  FROM games g LEFT JOIN rated h ON h.team = g.home_team AND h.season = g.season AND h.week = g.week
  LEFT JOIN rated a ON a.team = g.away_team AND a.season = g.season AND a.week = g.week)"""
WITH_SIDES = f"{WITH_CLEAN}, {MONTHLY_CTE}, {SIDES_CTE}"


def _game_features(spark, folder):
    """A team's monthly figures as its features in each of that month's games."""
    rated = monthly(spark, folder).withColumn("is_dome", F.col("team") < "T05")
    rows = sch.team_rows(games(spark, folder)).select("game_id", "team", "season", "week").distinct()
    return rows.join(rated, ["team", "season", "week"]).drop("season", "week")


@query("c9_both_sides", f"{WITH_SIDES} SELECT game_id, home_team, away_team, home_value, away_value FROM both_sides")
def c9(spark, folder):
    joined = m.join_both_sides(games(spark, folder), _game_features(spark, folder))
    return joined.select("game_id", "home_team", "away_team", "home_value", "away_value")


@query("b21_differences", f"""{WITH_SIDES} SELECT game_id, round(home_value - away_value, 6) AS diff_value,
  CAST(home_is_dome AS DOUBLE) - CAST(away_is_dome AS DOUBLE) AS diff_is_dome FROM both_sides""")
def b21(spark, folder):
    joined = m.join_both_sides(games(spark, folder), _game_features(spark, folder))
    diffs = m.with_differences(joined, ["value", "is_dome"])
    return rounded(diffs.select("game_id", "diff_value", "diff_is_dome"), "diff_value")


@query("b22_outcome", f"""{WITH_GAMES} SELECT game_id, result,
  CAST(CASE WHEN result > 0 THEN 1 WHEN result < 0 THEN 0 END AS DOUBLE) AS home_win FROM games""")
def b22(spark, folder):
    return m.with_outcome(games(spark, folder)).select("game_id", "result", "home_win")


@query("b23_feature_columns", f"""{WITH_SIDES} SELECT game_id, home_value, away_value, home_value - away_value AS diff_value
FROM both_sides""")
def b23(spark, folder):
    table_ = m.matchup_table(_game_features(spark, folder), games(spark, folder), features=["value"])
    return table_.select("game_id", *m.feature_columns(table_, ["value"]))


@query("b24_aligned_features", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
  CAST(NULL AS DOUBLE) AS absent FROM part""")
def b24(spark, folder):
    return m.align_features(
        table(spark, folder, "part"), ["p_size", "p_retailprice", "absent"],
    ).select("p_partkey", "p_size", "p_retailprice", "absent")


@query("c3_left_join_panel", f"""{WITH_CLEAN}, {MONTHLY_CTE}, games AS ({GAMES_SQL})
SELECT g.game_id, g.home_team AS team, m.value FROM games g LEFT JOIN monthly m
  ON m.team = g.home_team AND m.season = g.season AND m.week = g.week""")
def c3(spark, folder):
    rows = games(spark, folder).select("game_id", F.col("home_team").alias("team"), "season", "week")
    return rows.join(monthly(spark, folder), ["team", "season", "week"], "left").select("game_id", "team", "value")


@query("c4_game_attributes", f"""WITH plays AS ({PLAYS_SQL}), games AS ({GAMES_SQL}),
rows_ AS (SELECT DISTINCT game_id, posteam AS team FROM plays WHERE posteam IS NOT NULL)
SELECT game_id, team, home_rest - away_rest AS rest_advantage_home, coalesce(roof IN ('dome', 'closed'), false) AS is_dome,
  CASE WHEN roof IN ('dome', 'closed') THEN 70 ELSE temp END AS temp_f,
  CASE WHEN roof IN ('dome', 'closed') THEN 0 ELSE wind END AS wind_mph
FROM rows_ LEFT JOIN games USING (game_id)""")
def c4(spark, folder):
    rows = plays(spark, folder).where(F.col("posteam").isNotNull()).select(
        "game_id", F.col("posteam").alias("team"),
    ).distinct()
    return sch.with_game_attributes(rows, games(spark, folder))


@query("c5_burden_or_zero", f"""{WITH_INJURIES}, games AS ({GAMES_SQL}),
burden AS ({BURDEN_SQL}),
rows_ AS (SELECT DISTINCT home_team AS team, season, week FROM games)
SELECT team, season, week, coalesce(injury_burden, 0) AS injury_burden, coalesce(players_out, 0) AS players_out,
  coalesce(qb_out, 0) AS qb_out FROM rows_ LEFT JOIN burden USING (team, season, week)""")
def c5(spark, folder):
    rows = games(spark, folder).select(F.col("home_team").alias("team"), "season", "week").distinct()
    return inj.with_injury_burden(rows, inj.injury_burden(injuries(spark, folder)))


@query("c11_team_rows", f"""{WITH_GAMES} SELECT game_id, season, week, home_team AS team, 'home' AS side FROM games
UNION ALL SELECT game_id, season, week, away_team, 'away' FROM games""")
def c11(spark, folder):
    return sch.team_rows(games(spark, folder))


@query("c12_games_of_week", f"""{WITH_GAMES} SELECT game_id, home_team, away_team FROM games
WHERE game_id IN (SELECT game_id FROM games WHERE {TARGET})""")
def c12(spark, folder):
    return sch.games_of_week(games(spark, folder), 1998, 6).select("game_id", "home_team", "away_team")


@query("g2_teams_playing", f"""{WITH_GAMES} SELECT home_team AS team FROM games WHERE {TARGET}
UNION SELECT away_team FROM games WHERE {TARGET}""")
def g2(spark, folder):
    return sch.teams_playing(games(spark, folder), 1998, 6)


@query("f2_current_week", f"""{WITH_GAMES} SELECT season, week FROM games WHERE result IS NULL
ORDER BY season, week LIMIT 1""")
def f2(spark, folder):
    return sch.current_week_frame(games(spark, folder))


ACTUAL_CTE = f"""plays AS ({PLAYS_SQL}), actuals AS (SELECT game_id, posteam AS team,
    coalesce(sum(passing_yards) FILTER (WHERE pass_attempt = 1), 0) AS passed,
    coalesce(sum(rushing_yards) FILTER (WHERE rush_attempt = 1), 0) AS ran,
    count(*) FILTER (WHERE sack = 1) AS sacked
  FROM plays WHERE posteam IS NOT NULL AND (pass_attempt = 1 OR rush_attempt = 1 OR sack = 1) GROUP BY ALL)"""


@query("c19_actual_attached", f"""{WITH_GAMES}, {ACTUAL_CTE}
SELECT g.game_id, CASE WHEN result IS NOT NULL THEN CAST(home_score AS INTEGER) END AS home_score,
  CASE WHEN result IS NOT NULL THEN CAST(away_score AS INTEGER) END AS away_score,
  CASE WHEN result IS NOT NULL THEN home_score > away_score END AS home_won,
  CASE WHEN result IS NOT NULL THEN h.passed END AS home_passing, CASE WHEN result IS NOT NULL THEN a.ran END AS away_rushing
FROM games g LEFT JOIN actuals h ON h.game_id = g.game_id AND h.team = g.home_team
LEFT JOIN actuals a ON a.game_id = g.game_id AND a.team = g.away_team""")
def c19(spark, folder):
    g = games(spark, folder)
    attached = m.with_actual(g.select("game_id"), g, team_game_actuals(plays(spark, folder)))
    return attached.select(
        "game_id", F.col("actual.home_score"), F.col("actual.away_score"), F.col("actual.home_win").alias("home_won"),
        F.col("actual.stats.home.passing_yards").alias("home_passing"),
        F.col("actual.stats.away.rushing_yards").alias("away_rushing"),
    )


# A fixed logistic score of the rest difference stands in for a model's probability.
SCORED_CTE = f"""scored AS (SELECT game_id, season, week, home_team, away_team, result,
  1 / (1 + exp(-(home_rest - away_rest) / 4.0::DOUBLE)) AS p, result > 0 AS home_won,
  CAST(CASE WHEN result > 0 THEN 1 WHEN result < 0 THEN 0 END AS DOUBLE) AS home_win FROM ({GAMES_SQL}))"""


def _scored(spark, folder):
    rest = (F.col("home_rest") - F.col("away_rest")) / F.lit(4.0)
    return m.with_outcome(games(spark, folder)).withColumns({
        "p": 1 / (1 + F.exp(-rest)), "home_won": F.col("result") > 0,
    })


@query("b34_hit_flag", f"WITH {SCORED_CTE} SELECT game_id, (p > 0.5::DOUBLE) = home_won AS hit FROM scored")
def b34(spark, folder):
    return _scored(spark, folder).select("game_id", lb.is_hit(F.col("p"), F.col("home_won")).alias("hit"))


@query("d22_hit_summary", f"""WITH {SCORED_CTE} SELECT season, week, count(*) AS games, count(home_won) AS played,
  count(*) FILTER (WHERE (p > 0.5::DOUBLE) = home_won) AS hits FROM scored GROUP BY season, week""")
def d22(spark, folder):
    return metrics.hit_summary(_scored(spark, folder), probability="p")


@query("d19_classification_metrics", f"""WITH {SCORED_CTE} SELECT
  round(avg(CAST(CAST(p >= 0.5::DOUBLE AS DOUBLE) = home_win AS DOUBLE)), 6) AS accuracy,
  round(avg(-(home_win * ln(p) + (1 - home_win) * ln(1 - p))), 6) AS log_loss,
  round(avg((p - home_win) * (p - home_win)), 6) AS brier_score, count(*) AS n_test
FROM scored WHERE home_win IS NOT NULL""")
def d19(spark, folder):
    scored = _scored(spark, folder).dropna(subset=["home_win"])
    return rounded(metrics.classification_metrics(scored, "home_win", "p"), "accuracy", "log_loss", "brier_score")


@query("d20_mean_absolute_error", f"""WITH games AS ({GAMES_SQL}) SELECT round(avg(abs(home_score - 25)), 6) AS mae_home_score,
  round(avg(abs(away_score - home_rest)), 6) AS mae_away_score FROM games""")
def d20(spark, folder):
    scored = games(spark, folder).withColumn("flat", F.lit(25.0))
    errors = metrics.mean_absolute_errors(scored, [("home_score", "flat"), ("away_score", "home_rest")])
    return rounded(errors, "mae_home_score", "mae_away_score")


@query("f3_top_contributions", """WITH c AS (SELECT o_custkey AS game_id, o_orderkey AS feature,
  CAST(round(o_totalprice * 100) - 25000000 AS DOUBLE) AS contribution FROM orders)
SELECT game_id, feature, contribution, place FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS place FROM c)
WHERE place <= 5""")
def f3(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("game_id"), F.col("o_orderkey").alias("feature"),
        (F.round(F.col("o_totalprice") * 100) - 25000000).alias("contribution"),
    )
    return top_contributions(rows, ["game_id"])


@query("f4_newest_records", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5""")
def f4(spark, folder):
    newest = table(spark, folder, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5)
    return newest.select("o_orderkey", "o_custkey", "o_totalprice")


@query("f5_by_probability", f"""WITH {SCORED_CTE} SELECT game_id, round(p, 6) AS p, result IS NOT NULL AS played FROM scored
ORDER BY played DESC, p DESC, game_id""")
def f5(spark, folder):
    played = _scored(spark, folder).withColumn("played", F.col("result").isNotNull())
    return rounded(
        played.orderBy(F.desc("played"), F.desc("p"), "game_id").select("game_id", "p", "played"), "p",
    )


REASON_FEATURES = """CASE o_orderpriority WHEN '1-URGENT' THEN 'home_qb_out' WHEN '2-HIGH' THEN 'away_edsr_ema5'
  WHEN '3-MEDIUM' THEN 'diff_adj_off_epa' WHEN '5-LOW' THEN 'home_rest_advantage_home' ELSE 'unlisted' END"""


@query("b32_reason_text", f"""WITH r AS (SELECT o_orderkey, {REASON_FEATURES} AS feature,
    (o_totalprice - 250000) / 1000000 AS contribution,
    {TEAM.format('o_custkey % 25')} AS home, {TEAM.format('o_orderkey % 25')} AS away FROM orders),
d AS (SELECT *, regexp_replace(feature, '^(home_|away_|diff_)', '') AS base FROM r),
t AS (SELECT *, CASE base WHEN 'qb_out' THEN 'a kezdő irányító sérülés miatt hiányzik'
    WHEN 'edsr_ema5' THEN 'a korai down (1-2. down) siker-arány'
    WHEN 'adj_off_epa' THEN 'az ellenfél-korrigált támadó hatékonyság'
    WHEN 'rest_advantage_home' THEN 'pihenőnap-előny' ELSE base END AS described,
  ' - ' || CASE WHEN abs(contribution) > 0.1::DOUBLE THEN 'erősen' ELSE 'enyhén' END || ' '
    || CASE WHEN contribution > 0 THEN home ELSE away END || ' felé billenti az esélyt' AS ending FROM d)
SELECT o_orderkey, CASE WHEN starts_with(feature, 'home_') THEN home || ': ' || described || ending
  WHEN starts_with(feature, 'away_') THEN away || ': ' || described || ending
  ELSE described || ' különbsége' || ending END AS text FROM t""")
def b32(spark, folder):
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{REASON_FEATURES} AS feature", "(o_totalprice - 250000) / 1000000 AS contribution",
        f"{TEAM.format('o_custkey % 25')} AS home", f"{TEAM.format('o_orderkey % 25')} AS away",
    )
    return rows.select(
        "o_orderkey",
        lb.reason_text(F.col("feature"), F.col("contribution"), F.col("home"), F.col("away")).alias("text"),
    )


@query("b33_confidence_badge", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '✅ egészséges kezdő'
  WHEN '2-HIGH' THEN '⚠️ sérülés miatt becsült tartalék' WHEN '3-MEDIUM' THEN '❓ kezdő sérült, tartalék ismeretlen'
  WHEN '5-LOW' THEN '❓ nincs historikus adat' ELSE '?' END AS badge FROM orders""")
def b33(spark, folder):
    code = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "confirmed_healthy")
        .when(F.col("o_orderpriority") == "2-HIGH", "inferred_due_to_injury")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "starter_injured_no_known_backup")
        .when(F.col("o_orderpriority") == "5-LOW", "no_history")
    )
    return table(spark, folder, "orders").select("o_orderkey", lb.confidence_badge(code).alias("badge"))


@query("h12_prefixes", """SELECT c_custkey, regexp_replace(c_name, '^(Customer#|Supplier#)', '') AS stripped,
  starts_with(c_mktsegment, 'MA') AS starts_ma FROM customer""")
def h12(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", lb.strip_prefix(F.col("c_name"), "Customer#", "Supplier#").alias("stripped"),
        F.col("c_mktsegment").startswith("MA").alias("starts_ma"),
    )
