"""Row filters and derived columns of the play table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.errors import MissingColumnsError
from fieldglass.functions.nulls import differs

WIN_PROB_LOW, WIN_PROB_HIGH = 0.05, 0.95

# Inputs of the in-play model, in order.
WIN_PROB_FEATURES = [
    "qtr", "down", "ydstogo", "yardline_100", "score_differential",
    "half_seconds_remaining", "game_seconds_remaining",
    "posteam_timeouts_remaining", "defteam_timeouts_remaining", "is_home",
]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"missing columns: {missing}")
    return df


def filter_garbage_time(
    plays: DataFrame, low: float = WIN_PROB_LOW, high: float = WIN_PROB_HIGH, wp: str = "wp",
) -> DataFrame:
    """Keep plays whose win probability lies strictly between the bounds; nulls are dropped."""
    return plays.where((F.col(wp) > low) & (F.col(wp) < high))


def filter_non_plays(
    plays: DataFrame, kneel: str = "qb_kneel", spike: str = "qb_spike", play_type: str = "play_type",
) -> DataFrame:
    """Drop kneels, spikes and called-back plays; null flags and an absent flag column keep the row."""
    keep = differs(F.col(play_type), "no_play")
    for flag in (kneel, spike):
        if flag in plays.columns:
            keep = keep & differs(F.col(flag), 1)
    return plays.where(keep)


def clean_plays(plays: DataFrame, low: float = WIN_PROB_LOW, high: float = WIN_PROB_HIGH) -> DataFrame:
    return plays.transform(filter_garbage_time, low, high).transform(filter_non_plays)


def labelable() -> Column:
    """Plays of a decided game with a known possession and score."""
    return (
        F.col("posteam").isNotNull() & F.col("score_differential").isNotNull()
        & F.col("result").isNotNull() & (F.col("result") != 0)
    )


def early_down(down: str = "down") -> Column:
    return F.col(down).isin(1, 2)


def prepare_win_prob(
    plays: DataFrame, features: list[str] | None = None,
    side: str = "posteam_type", result: str = "result", down: str = "down",
) -> DataFrame:
    """Model input: down 0 when unknown, home flag, label from the possessing side, no null feature."""
    home_flag = F.coalesce((F.col(side) == "home").cast("int"), F.lit(0))
    home_win = (F.col(result) > 0).cast("int")
    return (
        plays.withColumn(down, F.coalesce(F.col(down), F.lit(0.0)))
        .withColumn("is_home", home_flag)
        .withColumn("label", F.when(F.col("is_home") == 1, home_win).otherwise(1 - home_win))
        .dropna(subset=features or WIN_PROB_FEATURES)
    )
