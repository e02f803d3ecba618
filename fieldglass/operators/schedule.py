"""Game-level attributes: rest, weather, home and away teams, the current week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.errors import InsufficientHistoryError
from fieldglass.operators.cleaning import require_columns
from fieldglass.operators.timeline import at_period

# Roof states without weather, neutral indoor weather, bucket names and limits.
INDOOR_ROOFS = ["dome", "closed"]
INDOOR_TEMPERATURE, INDOOR_WIND = 70.0, 0.0
WEATHER_BUCKETS = ["dome", "cold", "windy", "mild", "unknown"]
COLD_LIMIT, WIND_LIMIT = 45.0, 15.0


def rest_advantage(games: DataFrame) -> DataFrame:
    columns = ["game_id", "home_team", "away_team", "home_rest", "away_rest"]
    return require_columns(games, columns).select(
        *columns, (F.col("home_rest") - F.col("away_rest")).alias("rest_advantage_home"),
    )


def weather_features(games: DataFrame) -> DataFrame:
    """Indoor games get neutral weather; gaps of outdoor games stay null."""
    require_columns(games, ["game_id", "roof", "temp", "wind"])
    indoor = F.coalesce(F.col("roof").isin(*INDOOR_ROOFS), F.lit(False))
    return games.select(
        "game_id",
        indoor.alias("is_dome"),
        F.when(indoor, F.lit(INDOOR_TEMPERATURE)).otherwise(F.col("temp").cast("double")).alias("temp_f"),
        F.when(indoor, F.lit(INDOOR_WIND)).otherwise(F.col("wind").cast("double")).alias("wind_mph"),
    )


def weather_bucket(weather: DataFrame, cold: float = COLD_LIMIT, wind: float = WIND_LIMIT) -> DataFrame:
    """First match of dome, unknown, windy, cold, mild."""
    bucket = (
        F.when(F.col("is_dome"), "dome")
        .when(F.col("temp_f").isNull() & F.col("wind_mph").isNull(), "unknown")
        .when(F.col("wind_mph") >= wind, "windy")
        .when(F.col("temp_f") <= cold, "cold")
        .otherwise("mild")
    )
    return weather.select("game_id", bucket.alias("weather_bucket"))


def with_game_attributes(features: DataFrame, games: DataFrame) -> DataFrame:
    """Attach rest and weather by game."""
    attributes = rest_advantage(games).select("game_id", "rest_advantage_home").join(
        weather_features(games), "game_id",
    )
    return features.join(attributes, "game_id", "left")


def team_rows(games: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows per game, home side first."""
    keep = keep or ["game_id", "season", "week"]
    sides = F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.lit("home").alias("side")),
        F.struct(F.col("away_team").alias("team"), F.lit("away").alias("side")),
    ))
    return games.select(*keep, sides.alias("_s")).select(*keep, "_s.team", "_s.side")


def teams_playing(games: DataFrame, season_at: int, week_at: int) -> DataFrame:
    """Distinct teams of a week."""
    return team_rows(games.where(at_period(season_at, week_at))).select("team").distinct()


def games_of_week(games: DataFrame, season_at: int, week_at: int) -> DataFrame:
    """Games whose id occurs in the week."""
    ids = games.where(at_period(season_at, week_at)).select("game_id")
    return games.join(ids, "game_id", "left_semi")


def current_week_frame(games: DataFrame) -> DataFrame:
    """Earliest period with an unplayed game, as one row."""
    return games.where(F.col("result").isNull()).agg(
        F.min(F.struct("season", "week")).alias("p"),
    ).select("p.season", "p.week")


def current_week(games: DataFrame) -> tuple[int, int]:
    row = current_week_frame(games).first()
    if row is None or row["season"] is None:
        raise InsufficientHistoryError("no unplayed game in the schedule")
    return int(row["season"]), int(row["week"])
