"""Play rows to one row per team and game.

Each table is one conditional aggregate: a play is read once and combined before the shuffle,
instead of one aggregate per statistic joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.nulls import sum_or_zero
from fieldglass.operators.cleaning import early_down

KEYS = ["game_id", "team", "week", "season"]
ACTUALS = ["actual_passing_yards", "actual_rushing_yards", "actual_sacks_taken"]


def _passes() -> Column:
    return F.col("pass_attempt") == 1


def _rushes() -> Column:
    return F.col("rush_attempt") == 1


def _throws_measured() -> Column:
    return _passes() & F.col("cpoe").isNotNull()


def _any(*flags: Column) -> Column:
    """True when any flag is true; a null flag counts as false."""
    total = F.lit(False)
    for flag in flags:
        total = total | F.coalesce(flag, F.lit(False))
    return total


def _per_team(plays: DataFrame, team: str) -> DataFrame:
    return plays.withColumn("team", F.col(team)).dropna(subset=KEYS)


def _avg_where(flag: Column, value: str) -> Column:
    return F.avg(F.when(flag, F.col(value)))


def offensive_value_by_game(plays: DataFrame, value: str = "epa") -> DataFrame:
    return (
        _per_team(plays, "posteam").where(_any(_passes(), _rushes())).groupBy(*KEYS)
        .agg(_avg_where(_passes(), value).alias("off_epa_pass"), _avg_where(_rushes(), value).alias("off_epa_rush"))
    )


def defensive_value_by_game(plays: DataFrame, value: str = "epa") -> DataFrame:
    return (
        _per_team(plays, "defteam").where(_any(_passes(), _rushes())).groupBy(*KEYS)
        .agg(_avg_where(_passes(), value).alias("def_epa_pass"), _avg_where(_rushes(), value).alias("def_epa_rush"))
    )


def early_down_success_rate(plays: DataFrame, success: str = "success") -> DataFrame:
    return (
        _per_team(plays, "posteam").where(early_down()).groupBy(*KEYS)
        .agg(F.avg(success).alias("edsr"))
    )


def zscore(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add population z-scores, `{new: old}`; 0 where the spread is 0 or unknown.

    Mean and spread come from one scalar subquery, so no second input is joined. The subquery also
    counts the other columns: it then needs the same rows as the outer query, and Spark runs the
    aggregate behind both only once.
    """
    moments = df.agg(
        F.struct(
            *[
                F.struct(F.avg(old).alias("mean"), F.stddev_pop(old).alias("sd")).alias(new)
                for new, old in columns.items()
            ],
            F.struct(*[F.count(c).alias(c) for c in df.columns]).alias("_counts"),
        ),
    ).scalar()
    with_moments = df.withColumn("_moments", moments)
    out = {
        new: F.when(
            F.coalesce(F.col(f"_moments.{new}.sd"), F.lit(0.0)) == 0, F.lit(0.0),
        ).otherwise((F.col(old) - F.col(f"_moments.{new}.mean")) / F.col(f"_moments.{new}.sd"))
        for new, old in columns.items()
    }
    return with_moments.withColumns(out).drop("_moments")


def passer_composite(plays: DataFrame, epa_weight: float = 0.7, cpoe_weight: float = 0.3) -> DataFrame:
    """Weighted z-scores of mean value and mean accuracy per team and game, over measured passes."""
    means = (
        _per_team(plays, "posteam").where(_throws_measured()).groupBy(*KEYS)
        .agg(F.avg("epa").alias("qb_epa"), F.avg("cpoe").alias("qb_cpoe"))
    )
    scored = zscore(means, {"_z_epa": "qb_epa", "_z_cpoe": "qb_cpoe"})
    return scored.select(
        *KEYS, (epa_weight * F.col("_z_epa") + cpoe_weight * F.col("_z_cpoe")).alias("qb_composite"),
    )


def team_game_table(
    plays: DataFrame, value: str = "epa", epa_weight: float = 0.7, cpoe_weight: float = 0.3,
) -> DataFrame:
    """One row per team and game with offence, defence, early-down and passer figures.

    A play counts for two teams. Emitting both sides and aggregating once replaces three full
    outer joins: the rows combine map-side and are shuffled a single time.
    """
    sides = F.explode(F.array(
        F.struct(F.col("posteam").alias("team"), F.lit(True).alias("attacking")),
        F.struct(F.col("defteam").alias("team"), F.lit(False).alias("attacking")),
    ))
    rows = plays.select(
        "game_id", "week", "season", "pass_attempt", "rush_attempt", "down", "success", "cpoe",
        F.col(value).alias("epa"), sides.alias("_side"),
    ).select("*", "_side.*").dropna(subset=KEYS)
    attacking, defending = F.col("attacking"), ~F.col("attacking")
    attack_seen = attacking & _any(_passes(), _rushes(), early_down(), _throws_measured())
    defence_seen = defending & _any(_passes(), _rushes())
    means = rows.where(attack_seen | defence_seen).groupBy(*KEYS).agg(
        _avg_where(attacking & _passes(), "epa").alias("off_epa_pass"),
        _avg_where(attacking & _rushes(), "epa").alias("off_epa_rush"),
        _avg_where(defending & _passes(), "epa").alias("def_epa_pass"),
        _avg_where(defending & _rushes(), "epa").alias("def_epa_rush"),
        _avg_where(attacking & early_down(), "success").alias("edsr"),
        _avg_where(attacking & _throws_measured(), "epa").alias("_qb_epa"),
        _avg_where(attacking & _throws_measured(), "cpoe").alias("_qb_cpoe"),
        F.max(attacking & _any(_throws_measured())).alias("_qb_seen"),
    )
    scored = zscore(means, {"_z_epa": "_qb_epa", "_z_cpoe": "_qb_cpoe"})
    composite = F.when(
        F.col("_qb_seen"), epa_weight * F.col("_z_epa") + cpoe_weight * F.col("_z_cpoe"),
    )
    return scored.withColumn("qb_composite", composite).drop(
        "_qb_epa", "_qb_cpoe", "_qb_seen", "_z_epa", "_z_cpoe",
    )


def team_game_actuals(plays: DataFrame) -> DataFrame:
    """Yards passed and run and sacks taken per team and game; absent parts are 0."""
    sacked = F.col("sack") == 1
    return (
        plays.withColumn("team", F.col("posteam")).dropna(subset=["game_id", "team"])
        .where(_any(_passes(), _rushes(), sacked)).groupBy("game_id", "team")
        .agg(
            sum_or_zero(F.when(_passes(), F.col("passing_yards"))).alias(ACTUALS[0]),
            sum_or_zero(F.when(_rushes(), F.col("rushing_yards"))).alias(ACTUALS[1]),
            F.count_if(sacked).cast("double").alias(ACTUALS[2]),
        )
    )


def passer_game_stats(plays: DataFrame) -> DataFrame:
    """Mean value, mean accuracy and dropbacks per passer and game."""
    keys = ["game_id", "season", "week", "team", "passer_player_id", "passer_player_name"]
    return (
        plays.withColumn("team", F.col("posteam")).where(_passes()).dropna(subset=keys).groupBy(*keys)
        .agg(
            F.avg("epa").alias("qb_epa"), F.avg("cpoe").alias("qb_cpoe"),
            F.count(F.lit(1)).alias("qb_dropbacks"),
        )
    )
