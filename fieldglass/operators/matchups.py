"""Team rows to game rows: both sides' features, differences, label and actual figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.nulls import tristate

# Team features of a game row, in order.
TEAM_FEATURES = [
    "off_epa_pass_ema5", "off_epa_rush_ema5", "def_epa_pass_ema5", "def_epa_rush_ema5",
    "edsr_ema5", "adj_off_epa", "adj_def_epa", "is_dome", "injury_burden", "qb_out",
    "qb_weather_epa", "qb_weather_cpoe",
]
REST_FEATURE = "home_rest_advantage_home"
GAME_COLUMNS = ["game_id", "season", "week", "home_team", "away_team", "result"]


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def join_both_sides(games: DataFrame, per_team: DataFrame, game: str = "game_id", team: str = "team") -> DataFrame:
    """Attach a per-team table twice, as the home and as the away side; games without rows stay.

    Team rows are gathered by game, a few to a game, and each game picks its sides' rows: both tables are dealt by game
    once, where two joins by game and team deal the team rows twice and the widened games again. Several rows of one
    team in a game, or of one game, give a row each, as in a join.
    """
    values = [c for c in per_team.columns if c not in (game, team)]
    rows = per_team.where(F.col(game).isNotNull() & F.col(team).isNotNull()).groupBy(game).agg(
        F.collect_list(F.struct(F.col(team).alias("team"), F.struct(*values).alias("values"))).alias("_rows"))
    out = games.join(rows, game, "left")
    for side in ("home", "away"):
        asked = F.col(f"{side}_team")
        own = F.filter("_rows", lambda r: r["team"] == asked)  # noqa: B023
        out = out.select("*", F.explode_outer(own).alias("_own")).select(
            game, *[c for c in out.columns if c != game], *[F.col("_own.values")[c].alias(f"{side}_{c}") for c in values])
    return out.drop("_rows")


def with_differences(df: DataFrame, features: Sequence[str] = TEAM_FEATURES) -> DataFrame:
    """Home minus away for every feature present on both sides; flags count as 0 and 1."""
    present = [f for f in features if f"home_{f}" in df.columns and f"away_{f}" in df.columns]
    return df.withColumns({
        f"diff_{f}": F.col(f"home_{f}").cast("double") - F.col(f"away_{f}").cast("double") for f in present
    })


def with_outcome(df: DataFrame, result: str = "result") -> DataFrame:
    """Home win 1 or 0; null for a tie or an unplayed game."""
    return df.withColumn("home_win", tristate(F.col(result)).cast("double"))


def matchup_table(
    team_features: DataFrame, games: DataFrame, actuals: DataFrame | None = None,
    features: Sequence[str] = TEAM_FEATURES,
) -> DataFrame:
    """One row per game. Period columns of the team side are left out, as the game has its own."""
    sides = team_features.drop("season", "week")
    base = games.select(*[c for c in GAME_COLUMNS if c in games.columns])
    table = with_outcome(with_differences(join_both_sides(base, sides), features))
    return table if actuals is None else join_both_sides(table, actuals)


def feature_columns(df: DataFrame, features: Sequence[str] = TEAM_FEATURES) -> list[str]:
    """Ordered model inputs among the columns present."""
    wanted = [f"{side}_{f}" for f in features for side in ("home", "away", "diff")] + [REST_FEATURE]
    return [c for c in wanted if c in df.columns]


def align_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model inputs as doubles; an absent column is null."""
    return df.withColumns({
        c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in columns
    })


def with_actual(predictions: DataFrame, games: DataFrame, actuals: DataFrame) -> DataFrame:
    """Attach the final score and both teams' figures as struct `actual`; null when unplayed."""
    finals = games.where(F.col("result").isNotNull()).select(
        "game_id", "home_team", "away_team", "home_score", "away_score",
    )
    both = join_both_sides(finals, actuals)

    def figures(side: str):
        return F.struct(
            F.col(f"{side}_actual_passing_yards").alias("passing_yards"),
            F.col(f"{side}_actual_rushing_yards").alias("rushing_yards"),
            F.col(f"{side}_actual_sacks_taken").alias("sacks_taken"),
        ).alias(side)

    document = F.struct(
        F.col("home_score").cast("int").alias("home_score"),
        F.col("away_score").cast("int").alias("away_score"),
        (F.col("home_score") > F.col("away_score")).alias("home_win"),
        F.struct(figures("home"), figures("away")).alias("stats"),
    )
    return predictions.join(both.select("game_id", document.alias("actual")), "game_id", "left")
