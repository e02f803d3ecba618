"""Rolling means, as-of panels, likely starters and opponent-adjusted ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.base import (
    GAMES_SQL, INJURIES_SQL, PLAYS_SQL, WITH_CLEAN, WITH_PLAYS, games, injuries, plays, query, rounded, signal,
)
from fieldglass.catalog.base import SIGNAL_SQL
from fieldglass.operators import ridge, rolling, shrinkage, starters, timeline
from fieldglass.operators.cleaning import clean_plays
from fieldglass.operators.games import passer_game_stats
from fieldglass.operators.schedule import weather_bucket, weather_features
from fieldglass.plans.features import passer_weather_games

# One row per team and month: mean value of the cleaned plays.
MONTHLY_CTE = """monthly AS (SELECT posteam AS team, season, week, avg(epa) AS value FROM clean
  WHERE posteam IS NOT NULL GROUP BY posteam, season, week)"""
WITH_MONTHLY = f"{WITH_CLEAN}, {MONTHLY_CTE}"


def monthly(spark, folder):
    clean = clean_plays(plays(spark, folder)).where(F.col("posteam").isNotNull())
    return clean.groupBy(F.col("posteam").alias("team"), "season", "week").agg(F.avg("epa").alias("value"))


def ema_sql(source: str, keys: str, order: str, column: str, select: str, places: int = 6) -> str:
    """The moving mean as a ratio of two window sums, weights 1.5 to the row number for span 5."""
    return f"""numbered AS (SELECT *, pow(1.5::DOUBLE, row_number() OVER (PARTITION BY {keys} ORDER BY {order})) AS wt FROM {source})
SELECT {select}, round(
  sum({column} * wt) OVER w / sum(CASE WHEN {column} IS NOT NULL THEN wt END) OVER w, {places}) AS {column}_ema5
FROM numbered WINDOW w AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("e1_previous_value", f"""{WITH_MONTHLY} SELECT team, season, week, value,
  lag(value) OVER (PARTITION BY team, season ORDER BY week) AS value_prev FROM monthly""")
def e1(spark, folder):
    return rolling.previous_value(monthly(spark, folder), ["value"], order=["week"])


@query("e2_rolling_ema", f"{WITH_MONTHLY}, " + ema_sql("monthly", "team, season", "week", "value", "team, season, week"))
def e2(spark, folder):
    rolled = rolling.rolling_ema(monthly(spark, folder), ["value"], order=["week"])
    return rounded(rolled.select("team", "season", "week", "value_ema5"), "value_ema5")


@query("e2_rolling_ema_all_seasons",
       f"{WITH_MONTHLY}, " + ema_sql("monthly", "team", "season, week", "value", "team, season, week"))
def e2_all(spark, folder):
    rolled = rolling.rolling_ema(monthly(spark, folder), ["value"], reset_each_season=False, order=["week"])
    return rounded(rolled.select("team", "season", "week", "value_ema5"), "value_ema5")


# Event streams are far longer than the growing weights allow: the reference sum uses the last 120
# rows, whose older remainder is below the rounding.
EMA_STREAM_SQL = f"""WITH s AS ({SIGNAL_SQL}),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t, id) AS rn FROM s)
SELECT a.stream, a.id, round(sum(b.rms * pow(2.0::DOUBLE / 3, a.rn - b.rn)) / sum(pow(2.0::DOUBLE / 3, a.rn - b.rn)), 6) AS rms_ema5
FROM n a LEFT JOIN n b ON a.stream = b.stream AND b.rn < a.rn AND b.rn >= a.rn - 120 GROUP BY a.stream, a.id"""


@query("e2_rolling_ema_long_series", EMA_STREAM_SQL)
def e2_long(spark, folder):
    rolled = rolling.rolling_ema_blocks(
        signal(spark, folder), "rms", ["stream"], ["t", "id"], timeline.time_bucket(F.col("t"), 600.0),
    )
    return rounded(rolled.select("stream", "id", "rms_ema5"), "rms_ema5")


@query("e3_latest_ema", f"""{WITH_MONTHLY},
past AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY season DESC, week DESC) - 1 AS age FROM monthly
  WHERE (season, week) < (2000, 6))
SELECT team, round(sum(value * pow(2.0::DOUBLE / 3, age)) / sum(CASE WHEN value IS NOT NULL THEN pow(2.0::DOUBLE / 3, age) END), 6)
  AS value_ema5 FROM past GROUP BY team""")
def e3(spark, folder):
    return rounded(rolling.latest_ema(monthly(spark, folder), 2000, 6, ["value"], order=[]), "value_ema5")


@query("e4_recent_periods", f"""{WITH_PLAYS} SELECT DISTINCT season, week FROM plays
WHERE (season, week) < (2000, 6) ORDER BY season DESC, week DESC LIMIT 32""")
def e4(spark, folder):
    return timeline.recent_periods(plays(spark, folder).where(timeline.before(2000, 6)), 32)


@query("c7_within_recent", f"""{WITH_PLAYS}, past AS (SELECT * FROM plays WHERE (season, week) < (2000, 6)),
recent AS (SELECT DISTINCT season, week FROM past ORDER BY season DESC, week DESC LIMIT 32)
SELECT season, week, posteam, count(*) AS n FROM past JOIN recent USING (season, week) GROUP BY ALL""")
def c7(spark, folder):
    past = plays(spark, folder).where(timeline.before(2000, 6))
    return timeline.within_recent(past, 32).groupBy("season", "week", "posteam").agg(F.count(F.lit(1)).alias("n"))


@query("d21_distinct_periods", f"{WITH_PLAYS} SELECT DISTINCT posteam AS team, season, week FROM plays")
def d21(spark, folder):
    return plays(spark, folder).select(F.col("posteam").alias("team"), "season", "week").dropDuplicates()


STATS_CTE = f"""plays AS ({PLAYS_SQL}), games AS ({GAMES_SQL}),
stats AS (SELECT game_id, season, week, posteam AS team, passer_player_id, passer_player_name,
    avg(epa) AS qb_epa, avg(cpoe) AS qb_cpoe, count(*) AS qb_dropbacks
  FROM plays WHERE pass_attempt = 1 AND passer_player_id IS NOT NULL AND posteam IS NOT NULL GROUP BY ALL),
weather AS (SELECT game_id, coalesce(roof IN ('dome', 'closed'), false) AS is_dome,
    CASE WHEN roof IN ('dome', 'closed') THEN 70 ELSE temp END AS temp_f,
    CASE WHEN roof IN ('dome', 'closed') THEN 0 ELSE wind END AS wind_mph FROM games),
buckets AS (SELECT game_id, CASE WHEN is_dome THEN 'dome' WHEN temp_f IS NULL AND wind_mph IS NULL THEN 'unknown'
    WHEN wind_mph >= 15 THEN 'windy' WHEN temp_f <= 45 THEN 'cold' ELSE 'mild' END AS weather_bucket FROM weather),
qw AS (SELECT * FROM stats LEFT JOIN buckets USING (game_id))"""
PANEL_CTE = f"""{STATS_CTE},
grid AS (SELECT DISTINCT season, week FROM qw),
partials AS (SELECT passer_player_id, weather_bucket, season, week, count(*) AS n, sum(qb_epa) AS se, count(qb_epa) AS ce,
    sum(qb_cpoe) AS sc, count(qb_cpoe) AS cc FROM qw GROUP BY ALL),
overall AS (SELECT a.season, a.week, p.passer_player_id, sum(se) / nullif(sum(ce), 0) AS oe, sum(sc) / nullif(sum(cc), 0) AS oc
  FROM grid a JOIN partials p ON (p.season, p.week) < (a.season, a.week) GROUP BY ALL),
inbucket AS (SELECT a.season, a.week, p.passer_player_id, p.weather_bucket, sum(n)::BIGINT AS n_bucket,
    sum(se) / nullif(sum(ce), 0) AS be, sum(sc) / nullif(sum(cc), 0) AS bc
  FROM grid a JOIN partials p ON (p.season, p.week) < (a.season, a.week)
  WHERE p.weather_bucket IS NOT NULL GROUP BY ALL),
panel AS (SELECT passer_player_id, weather_bucket, (n_bucket * be + 8 * oe) / (n_bucket + 8) AS qb_weather_epa,
    (n_bucket * bc + 8 * oc) / (n_bucket + 8) AS qb_weather_cpoe, n_bucket, season, week
  FROM inbucket JOIN overall USING (season, week, passer_player_id))"""
PANEL_SQL = f"""WITH {PANEL_CTE} SELECT passer_player_id, weather_bucket, round(qb_weather_epa, 6) AS qb_weather_epa,
  round(qb_weather_cpoe, 6) AS qb_weather_cpoe, n_bucket, season, week FROM panel"""


def _panel_rounded(df):
    return rounded(df, "qb_weather_epa", "qb_weather_cpoe")


@query("d10_shrunk_profile", f"{PANEL_SQL} WHERE season = 2000 AND week = 6")
def d10(spark, folder):
    return _panel_rounded(shrinkage.shrunk_profile(passer_weather_games(plays(spark, folder), games(spark, folder)), 2000, 6))


@query("d11_shrunk_panel", PANEL_SQL)
def d11(spark, folder):
    return _panel_rounded(shrinkage.shrunk_panel(passer_weather_games(plays(spark, folder), games(spark, folder))))


@query("c8_bucket_with_overall", f"""WITH {STATS_CTE},
b AS (SELECT passer_player_id, weather_bucket, count(*) AS n, sum(qb_epa) AS se, count(qb_epa) AS ce FROM qw
  WHERE (season, week) < (2000, 6) GROUP BY ALL),
o AS (SELECT passer_player_id, sum(se) / sum(ce) AS overall_epa FROM b GROUP BY ALL)
SELECT passer_player_id, weather_bucket, n AS n_bucket, round(se / nullif(ce, 0), 6) AS bucket_epa,
  round(overall_epa, 6) AS overall_epa FROM b JOIN o USING (passer_player_id) WHERE weather_bucket IS NOT NULL""")
def c8(spark, folder):
    from pyspark.sql import Window as W
    past = passer_weather_games(plays(spark, folder), games(spark, folder)).where(timeline.before(2000, 6))
    parts = past.groupBy("passer_player_id", "weather_bucket").agg(
        F.count(F.lit(1)).alias("n_bucket"), F.sum("qb_epa").alias("s"), F.count("qb_epa").alias("c"),
    )
    player = W.partitionBy("passer_player_id")
    both = parts.withColumn("overall_epa", F.sum("s").over(player) / F.sum("c").over(player))
    out = both.where(F.col("weather_bucket").isNotNull()).select(
        "passer_player_id", "weather_bucket", "n_bucket", F.try_divide("s", "c").alias("bucket_epa"), "overall_epa",
    )
    return rounded(out, "bucket_epa", "overall_epa")


@query("c20_asof_grid", f"""{WITH_CLEAN}, cells AS (SELECT season, week, posteam, count(epa) AS n, coalesce(sum(epa), 0) AS total
  FROM clean WHERE posteam IS NOT NULL GROUP BY ALL),
ix AS (SELECT season, week, row_number() OVER (ORDER BY season, week) AS ix FROM (SELECT DISTINCT season, week FROM cells))
SELECT a.season, a.week, c.posteam, sum(c.n)::BIGINT AS n, sum(c.total) AS total
FROM cells c JOIN ix h ON c.season = h.season AND c.week = h.week JOIN ix a ON h.ix < a.ix AND h.ix >= a.ix - 12
GROUP BY ALL""")
def c20(spark, folder):
    clean = clean_plays(plays(spark, folder)).where(F.col("posteam").isNotNull())
    cells = clean.groupBy("season", "week", "posteam").agg(
        F.count("epa").alias("n"), F.coalesce(F.sum("epa"), F.lit(0.0)).alias("total"),
    )
    periods = timeline.period_index(cells)
    indexed = cells.join(periods, ["season", "week"]).drop("season", "week")
    spread = timeline.spread_over_lookback(indexed, periods, 12)
    summed = spread.groupBy("asof_ix", "posteam").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return summed.join(periods.withColumnRenamed("ix", "asof_ix"), "asof_ix").drop("asof_ix")


@query("g1_panels_of_all_weeks", f"""{WITH_CLEAN}, cells AS (SELECT season, week, posteam, count(epa) AS n FROM clean
  WHERE posteam IS NOT NULL GROUP BY ALL), p AS (SELECT DISTINCT season, week FROM cells)
SELECT p.season, p.week, c.posteam, sum(c.n)::BIGINT AS n FROM p JOIN cells c ON (c.season, c.week) < (p.season, p.week) GROUP BY ALL""")
def g1(spark, folder):
    clean = clean_plays(plays(spark, folder)).where(F.col("posteam").isNotNull())
    cells = clean.groupBy("season", "week", "posteam").agg(F.count("epa").alias("n"))
    periods = timeline.period_index(cells)
    indexed = cells.join(periods, ["season", "week"]).drop("season", "week")
    running = timeline.running_intervals(indexed, ["posteam"], ["n"], timeline.latest_index(periods))
    return running.join(periods.withColumnRenamed("ix", "asof_ix"), "asof_ix").drop("asof_ix")


@query("d12_opponent_adjusted")
def d12(spark, folder):
    rated = ridge.opponent_adjusted(clean_plays(plays(spark, folder)), 2000, 6)
    return rounded(rated, "adj_off_epa", "adj_def_epa")


@query("d13_opponent_adjusted_panel")
def d13(spark, folder):
    rated = ridge.opponent_adjusted_panel(clean_plays(plays(spark, folder)))
    return rounded(rated, "adj_off_epa", "adj_def_epa")


@query("c6_both_ratings_per_team")
def c6(spark, folder):
    """Teams that only attack or only defend keep a row with the other rating null."""
    rated = ridge.opponent_adjusted(clean_plays(plays(spark, folder)), 1995, 3, lookback=None)
    return rounded(rated, "adj_off_epa", "adj_def_epa")


STARTERS_CTE = f"""{STATS_CTE}, injuries AS ({INJURIES_SQL}),
points AS (SELECT DISTINCT posteam AS team, season, week FROM plays WHERE posteam IS NOT NULL),
ordered AS (SELECT p.team, p.season AS s, p.week AS w, st.season, st.week, st.passer_player_id AS id,
    st.passer_player_name AS name, max(st.qb_dropbacks) AS used
  FROM points p JOIN stats st ON st.team = p.team AND (st.season, st.week) < (p.season, p.week) GROUP BY ALL),
starter AS (SELECT team, s, w, id, name FROM (
    SELECT *, row_number() OVER (PARTITION BY team, s, w ORDER BY season DESC, week DESC, used DESC, id) AS place FROM ordered)
  WHERE place = 1),
backup AS (SELECT team, s, w, id AS backup_id, name AS backup_name FROM (
    SELECT o.*, row_number() OVER (PARTITION BY o.team, o.s, o.w ORDER BY o.season DESC, o.week DESC, o.id DESC) AS place
    FROM ordered o JOIN starter t ON o.team = t.team AND o.s = t.s AND o.w = t.w AND o.id <> t.id) WHERE place = 1),
judged AS (SELECT p.team, p.season, p.week, t.id, t.name, b.backup_id, b.backup_name,
    EXISTS (SELECT 1 FROM injuries i WHERE i.season = p.season AND i.week = p.week AND i.team = p.team
      AND i.gsis_id = t.id AND i.report_status = 'Out') AS injured
  FROM points p LEFT JOIN starter t ON t.team = p.team AND t.s = p.season AND t.w = p.week
  LEFT JOIN backup b ON b.team = p.team AND b.s = p.season AND b.w = p.week),
starters AS (SELECT team, season, week,
  CASE WHEN injured THEN backup_id ELSE id END AS passer_player_id,
  CASE WHEN injured THEN backup_name ELSE name END AS passer_player_name,
  CASE WHEN id IS NULL THEN 'no_history' WHEN NOT injured THEN 'confirmed_healthy'
    WHEN backup_id IS NOT NULL THEN 'inferred_due_to_injury' ELSE 'starter_injured_no_known_backup' END AS confidence
FROM judged)"""


def _points(spark, folder):
    return plays(spark, folder).where(F.col("posteam").isNotNull()).select(F.col("posteam").alias("team"), "season", "week")


@query("e6_likely_starters", f"WITH {STARTERS_CTE} SELECT * FROM starters")
def e6(spark, folder):
    stats = passer_game_stats(plays(spark, folder))
    return starters.likely_starters(stats, _points(spark, folder), injuries(spark, folder))


# The point asked for need not be a week in which the team played.
ONE_POINT = "points AS (SELECT 'T07' AS team, 2000 AS season, 6 AS week)"
ALL_POINTS = "points AS (SELECT DISTINCT posteam AS team, season, week FROM plays WHERE posteam IS NOT NULL)"


@query("e5_likely_starter", f"WITH {STARTERS_CTE.replace(ALL_POINTS, ONE_POINT)} SELECT * FROM starters")
def e5(spark, folder):
    stats = passer_game_stats(plays(spark, folder))
    out = starters.likely_starter(stats, "T07", 2000, 6, injuries(spark, folder))
    return out.withColumns({"season": F.col("season").cast("int"), "week": F.col("week").cast("int")})


@query("c10_profile_of_starter", f"""WITH {PANEL_CTE.replace(STATS_CTE, STARTERS_CTE)},
played AS (SELECT DISTINCT posteam AS team, season, week, game_id FROM plays WHERE posteam IS NOT NULL)
SELECT team, season, week, game_id, passer_player_id, weather_bucket, round(qb_weather_epa, 6) AS qb_weather_epa,
  round(qb_weather_cpoe, 6) AS qb_weather_cpoe
FROM played LEFT JOIN starters USING (team, season, week) LEFT JOIN buckets USING (game_id)
  LEFT JOIN (SELECT passer_player_id, weather_bucket, season, week, qb_weather_epa, qb_weather_cpoe FROM panel)
  USING (passer_player_id, weather_bucket, season, week)""")
def c10(spark, folder):
    p, g = plays(spark, folder), games(spark, folder)
    found = starters.likely_starters(passer_game_stats(p), _points(spark, folder), injuries(spark, folder))
    panel = shrinkage.shrunk_panel(passer_weather_games(p, g))
    played = p.where(F.col("posteam").isNotNull()).select(F.col("posteam").alias("team"), "season", "week", "game_id").distinct()
    rows = played.join(found, ["team", "season", "week"], "left").join(weather_bucket(weather_features(g)), "game_id", "left")
    joined = shrinkage.with_profile(rows, panel)
    return _panel_rounded(joined.select(
        "team", "season", "week", "game_id", "passer_player_id", "weather_bucket", "qb_weather_epa", "qb_weather_cpoe"))


def _residuals(cells, rated, by=()):
    """What each team's normal equation leaves over, for fitted ratings and the cells they were fitted on, per system `by`."""
    known = cells.where(F.col("n") > 0)
    attack = rated.select(*by, F.col("team").alias("off"), F.col("adj_off_epa").alias("a"))
    defence = rated.select(*by, F.col("team").alias("def"), F.col("adj_def_epa").alias("d"))
    joined = known.join(attack, [*by, "off"], "left").join(defence, [*by, "def"], "left")
    effect = F.coalesce("a", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))
    bases = joined.groupBy(*by).agg((F.sum(F.col("total") - F.col("n") * effect) / F.sum("n")).alias("base"))
    based = joined.join(bases, [*by]) if by else joined.withColumn("base", bases.scalar())
    left = based.select(*by, "off", "def", "a", "d", (F.col("total") - F.col("n") * (F.col("base") + effect)).alias("left"))
    sides = [
        left.where(F.col(side).isNotNull()).groupBy(*by, F.col(side).alias("team")).agg(
            (F.sum("left") - ridge.ALPHA * F.max(value)).alias("residual")).withColumn("side", F.lit(side))
        for side, value in (("off", "a"), ("def", "d"))]
    return sides[0].unionByName(sides[1]).select(*by, "team", "side", (F.abs("residual") < 1e-6).alias("solved"))


def _residual_sql(past: str) -> str:
    return f"""{WITH_CLEAN}, past AS (SELECT * FROM clean WHERE {past}),
cells AS (SELECT posteam AS off, defteam AS def FROM past GROUP BY ALL HAVING count(epa) > 0)
SELECT DISTINCT off AS team, 'off' AS side, true AS solved FROM cells WHERE off IS NOT NULL
UNION ALL SELECT DISTINCT def, 'def', true FROM cells WHERE def IS NOT NULL"""


@query("d12_normal_equations", _residual_sql("""(season, week) < (2000, 6) AND (season, week) IN (
  SELECT (season, week) FROM (SELECT DISTINCT season, week FROM clean WHERE (season, week) < (2000, 6))
  ORDER BY season DESC, week DESC LIMIT 32)"""))
def d12_normal_equations(spark, folder):
    """Ridge ratings have no closed SQL form; that they solve their normal equations has."""
    clean = clean_plays(plays(spark, folder))
    cells = timeline.within_recent(ridge.play_cells(clean.where(timeline.before(2000, 6))), 32)
    return _residuals(cells.groupBy("off", "def").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), ridge.opponent_adjusted(clean, 2000, 6))


@query("c6_normal_equations", _residual_sql("(season, week) < (1995, 3)"))
def c6_normal_equations(spark, folder):
    clean = clean_plays(plays(spark, folder))
    cells = ridge.play_cells(clean.where(timeline.before(1995, 3)))
    return _residuals(
        cells.groupBy("off", "def").agg(F.sum("n").alias("n"), F.sum("total").alias("total")),
        ridge.opponent_adjusted(clean, 1995, 3, lookback=None))


@query("b12_weather_bucket", f"WITH {STATS_CTE} SELECT game_id, weather_bucket FROM buckets")
def b12(spark, folder):
    return weather_bucket(weather_features(games(spark, folder)))


@query("b11_weather_features", f"WITH {STATS_CTE} SELECT game_id, is_dome, temp_f, wind_mph FROM weather")
def b11(spark, folder):
    return weather_features(games(spark, folder))


@query("d13_normal_equations", f"""{WITH_CLEAN},
periods AS (SELECT season, week, row_number() OVER (ORDER BY season, week) AS ix FROM (
  SELECT DISTINCT season, week FROM clean WHERE season IS NOT NULL AND week IS NOT NULL)),
cells AS (SELECT ix, posteam AS off, defteam AS def FROM clean JOIN periods USING (season, week) GROUP BY ALL HAVING count(epa) > 0),
past AS (SELECT p.season, p.week, c.off, c.def FROM cells c JOIN periods p ON p.ix > c.ix AND p.ix <= c.ix + {ridge.LOOKBACK})
SELECT DISTINCT season, week, off AS team, 'off' AS side, true AS solved FROM past WHERE off IS NOT NULL
UNION ALL SELECT DISTINCT season, week, def, 'def', true FROM past WHERE def IS NOT NULL""")
def d13_normal_equations(spark, folder):
    """Every week's ratings solve the normal equations of the weeks before it, team by team."""
    clean = clean_plays(plays(spark, folder))
    cells = ridge.play_cells(clean).dropna(subset=["season", "week"])
    periods = timeline.period_index(cells)
    spread = timeline.spread_over_lookback(cells.join(periods, ["season", "week"]).drop("season", "week"), periods, ridge.LOOKBACK)
    history = spread.groupBy("asof_ix", "off", "def").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).join(
        periods.withColumnRenamed("ix", "asof_ix"), "asof_ix")
    return _residuals(history, ridge.opponent_adjusted_panel(clean), ["season", "week"])
