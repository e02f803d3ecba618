"""Filters, aggregates, moving means, ratings, schedule and injuries on small fixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.errors import InsufficientHistoryError, MissingColumnsError
from fieldglass.operators import cleaning, games, injuries, ridge, rolling, schedule, timeline


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_garbage_time(spark):
    df = spark.createDataFrame([(w,) for w in (0.01, 0.04, 0.5, 0.96, 0.99, None)], "wp double")
    assert rows_of(cleaning.filter_garbage_time(df), "wp") == [(0.5,)]


def test_non_plays_keep_nulls(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, "qb_kneel"), (0.0, 1.0, "qb_spike"), (0.0, 0.0, "no_play"), (0.0, None, "pass"), (None, 0.0, None)],
        "qb_kneel double, qb_spike double, play_type string",
    )
    assert cleaning.filter_non_plays(df).count() == 2
    assert cleaning.filter_non_plays(df.drop("qb_kneel", "qb_spike")).count() == 4


def test_required_columns_are_named(spark):
    with pytest.raises(MissingColumnsError, match="away_rest.*home_rest"):
        schedule.rest_advantage(spark.createDataFrame([(1, "A", "B")], "game_id int, home_team string, away_team string"))


def test_zscore_of_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double")
    assert [r["z"] for r in games.zscore(df, {"z": "x"}).collect()] == [0.0, 0.0]


def panel(spark, values, season=2024):
    return spark.createDataFrame(
        [("A", season, w + 1, f"g{w:03d}", v) for w, v in enumerate(values)],
        "team string, season int, week int, game_id string, x double",
    )


def test_ema_never_sees_its_own_week(spark):
    out = rows_of(rolling.rolling_ema(panel(spark, [0.1, 0.2, 1000.0, 0.3]), ["x"], span=3), "week")
    ema = [r[-1] for r in out]
    assert ema[0] is None and ema[2] < 1 < ema[3]


def test_ema_resets_each_season(spark):
    both = panel(spark, [1.0, 2.0]).unionByName(panel(spark, [3.0, 4.0], 2025))
    out = rows_of(rolling.rolling_ema(both, ["x"]), "season", "week")
    assert out[2][-1] is None
    kept = rows_of(rolling.rolling_ema(both, ["x"], reset_each_season=False), "season", "week")
    assert kept[2][-1] is not None


@pytest.mark.parametrize("span", [1, 2, 5, 9])
def test_ema_equals_pandas(spark, span):
    rng = random.Random(3)
    values = [None if rng.random() < 0.25 else rng.uniform(-5, 5) for _ in range(60)]
    expected = pd.Series(values, dtype=float).shift(1).ewm(span=span, min_periods=1).mean()
    got = [r[-1] for r in rows_of(rolling.rolling_ema(panel(spark, values), ["x"], span=span), "week")]
    for g, e in zip(got, expected):
        assert (g is None and np.isnan(e)) or g == pytest.approx(e, abs=1e-9)


def test_ema_of_long_series_equals_pandas(spark):
    rng = random.Random(4)
    values = [rng.uniform(-5, 5) if i % 400 < 30 or 900 < i < 1500 else None for i in range(2500)]
    expected = pd.Series(values, dtype=float).shift(1).ewm(span=5, min_periods=1).mean()
    df = panel(spark, values)
    got = rolling.rolling_ema_blocks(df, "x", ["team"], ["week"], F.floor(F.col("week") / 300))
    for r, e in zip(rows_of(got, "week"), expected):
        assert (r[-1] is None and np.isnan(e)) or r[-1] == pytest.approx(e, abs=1e-9)


def test_ema_of_several_columns_equals_pandas(spark):
    both = panel(spark, [1.0, None, 4.0, 2.0]).unionByName(panel(spark, [None, 3.0, 5.0], 2025)).withColumn("y", F.col("x") * 2)
    pdf = both.toPandas().sort_values(["season", "week"])
    for reset in (True, False):
        groups = pdf.groupby("season")["x"] if reset else [(0, pdf["x"])]
        expected = [v for _, x in groups for v in x.shift(1).ewm(span=5, min_periods=1).mean()]
        for r, e in zip(rows_of(rolling.rolling_ema(both, ["x", "y"], reset_each_season=reset), "season", "week"), expected, strict=True):
            assert (r[-2] is None and np.isnan(e)) or (r[-2], r[-1]) == pytest.approx((e, 2 * e))


def test_ema_has_no_longest_series_and_keeps_null_keys(spark):
    assert rolling.rolling_ema(panel(spark, [1.0] * 2000), ["x"]).count() == 2000
    df = spark.createDataFrame([(None, 2024, 1, "a", 1.0), (None, 2024, 2, "b", 3.0), ("T", None, 1, "c", 5.0), ("T", 2024, None, "d", 7.0), ("T", 2024, 1, "e", 9.0)],
                               "team string, season int, week int, game_id string, x double")
    out = {r["game_id"]: r["x_ema5"] for r in rolling.rolling_ema(df, ["x"]).collect()}
    assert out == {"a": None, "b": 1.0, "c": None, "d": None, "e": 7.0}


def test_ridge_of_many_teams_solves_the_normal_equations():
    rng = np.random.default_rng(3)
    size = 5000
    cells = pd.DataFrame({"off": rng.integers(0, size, 40_000), "def": rng.integers(0, size, 40_000), "n": rng.integers(1, 9, 40_000)})
    cells["off"], cells["def"] = "T" + cells["off"].astype(str), "T" + cells["def"].astype(str)
    cells["total"] = cells["n"] * rng.normal(size=len(cells))
    fit = ridge.solve_cells(cells, 1.0).set_index("team")
    attack, defence = cells["off"].map(fit["adj_off_epa"]), cells["def"].map(fit["adj_def_epa"])
    intercept = ((cells["total"] - cells["n"] * (attack + defence)).sum()) / cells["n"].sum()
    left = cells["total"] - cells["n"] * (intercept + attack + defence)
    assert np.abs(left.groupby(cells["off"]).sum() - fit["adj_off_epa"]).max() < 1e-8
    assert np.abs(left.groupby(cells["def"]).sum() - fit["adj_def_epa"]).max() < 1e-8


def plays(spark, changes=None, weeks=4, teams=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for week in range(1, weeks + 1):
        for off in range(teams):
            for k in range(20):
                rows.append((2024, week, f"T{off}", f"T{(off + 1 + k % (teams - 1)) % teams}", float(rng.normal())))
    df = spark.createDataFrame(rows, "season int, week int, posteam string, defteam string, epa double")
    for condition, value in (changes or []):
        df = df.withColumn("epa", F.when(F.expr(condition), value).otherwise(F.col("epa")))
    return df


def exact_ridge(pdf, alpha=1.0):
    off, dfn = pd.get_dummies(pdf.posteam, dtype=float), pd.get_dummies(pdf.defteam, dtype=float)
    x, y = np.hstack([off, dfn]), pdf.epa.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return dict(zip(off.columns, w)), dict(zip(dfn.columns, w[len(off.columns):]))


def test_ridge_equals_the_play_level_fit(spark):
    df = plays(spark)
    off, dfn = exact_ridge(df.where("week < 4").toPandas())
    got = {r["team"]: r for r in ridge.opponent_adjusted(df, 2024, 4).collect()}
    for team, row in got.items():
        assert row["adj_off_epa"] == pytest.approx(off[team], abs=1e-10)
        assert row["adj_def_epa"] == pytest.approx(dfn[team], abs=1e-10)
    panel_rows = {r["team"]: r for r in ridge.opponent_adjusted_panel(df).where("week = 4").collect()}
    for lookback in (32, None):
        rows = {r["team"]: r for r in ridge.opponent_adjusted_panel(df, lookback=lookback).where("week = 4").collect()}
        assert {t: pytest.approx(r["adj_off_epa"], abs=1e-10) for t, r in rows.items()} == {
            t: r["adj_off_epa"] for t, r in panel_rows.items()
        }


def test_ridge_does_not_leak(spark):
    loud = plays(spark, [("week = 3 and posteam = 'T0'", 50.0)])

    def rating(week):
        return ridge.opponent_adjusted(loud, 2024, week).where("team = 'T0'").first()["adj_off_epa"]

    assert rating(3) < 5 < rating(4)


def test_ridge_lookback(spark):
    loud = plays(spark, [("week = 1 and posteam = 'T0'", 50.0)])

    def rating(lookback):
        return ridge.opponent_adjusted(loud, 2024, 4, lookback=lookback).where("team = 'T0'").first()["adj_off_epa"]

    assert rating(None) > rating(2)


def test_ridge_without_history(spark):
    with pytest.raises(InsufficientHistoryError):
        ridge.opponent_adjusted(plays(spark), 2024, 1)
    empty = plays(spark, [("true", None)])
    with pytest.raises(InsufficientHistoryError):
        ridge.opponent_adjusted(empty, 2024, 4)
    assert ridge.opponent_adjusted_panel(empty).count() == 0
    assert ridge.opponent_adjusted_panel(plays(spark)).where("week = 1").count() == 0


def test_rest_and_weather(spark):
    g = spark.createDataFrame(
        [(1, "A", "B", 7, 7, "dome", None, None), (2, "C", "D", 10, 6, "outdoors", 28.0, 15.0), (3, "E", "F", 7, 8, None, None, None)],
        "game_id int, home_team string, away_team string, home_rest int, away_rest int, roof string, temp double, wind double",
    )
    assert [r[-1] for r in rows_of(schedule.rest_advantage(g), "game_id")] == [0, 4, -1]
    weather = schedule.weather_features(g)
    assert rows_of(weather, "game_id") == [(1, True, 70.0, 0.0), (2, False, 28.0, 15.0), (3, False, None, None)]
    assert [r[1] for r in rows_of(schedule.weather_bucket(weather), "game_id")] == ["dome", "windy", "unknown"]


def test_current_week(spark):
    g = spark.createDataFrame([(2024, 18, 3.0), (2025, 2, None), (2025, 1, None)], "season int, week int, result double")
    assert schedule.current_week(g) == (2025, 1)
    with pytest.raises(InsufficientHistoryError):
        schedule.current_week(g.where("result is not null"))


def test_injury_burden(spark):
    reports = spark.createDataFrame(
        [(2024, 1, "A", "QB", "Out"), (2024, 1, "A", "WR", "Questionable"), (2024, 1, "A", "RB", "Doubtful"), (2024, 1, "B", "WR", None)],
        "season int, week int, team string, position string, report_status string",
    )
    assert rows_of(injuries.injury_burden(reports), "team") == [(2024, 1, "A", 2.0, 1, 1), (2024, 1, "B", 0.0, 0, 0)]
    custom = injuries.injury_burden(reports, {"Out": 2.5})
    assert rows_of(custom, "team")[0][3] == 2.5


def test_periods(spark):
    df = spark.createDataFrame([(2024, 2), (2023, 18), (2024, 1), (2024, 2)], "season int, week int")
    assert rows_of(timeline.period_index(df), "ix") == [(2023, 18, 1), (2024, 1, 2), (2024, 2, 3)]
    assert df.where(timeline.before(2024, 2)).count() == 2
    assert timeline.within_recent(df, 2).count() == 3


def test_asof_lookup_equals_brute_force(spark):
    rng = random.Random(5)
    facts = [("k%d" % rng.randrange(2), rng.uniform(0, 100), i) for i in range(60)]
    probes = [("k%d" % rng.randrange(3), rng.uniform(-5, 110), i) for i in range(60)]
    f = spark.createDataFrame(facts, "k string, t double, v int")
    p = spark.createDataFrame(probes, "k string, t double, id int")
    for forward in (False, True):
        got = {r["id"]: r["hit"] and r["hit"]["v"] for r in timeline.asof_lookup(p, f, ["k"], "t", "t", ["v"], "hit", 7.0, forward).collect()}
        for k, t, i in probes:
            own = [(ft, v) for fk, ft, v in facts if fk == k and (ft >= t if forward else ft <= t)]
            expected = (min(own) if forward else max(own))[1] if own else None
            assert got[i] == expected


def test_team_game_table_equals_joined_parts(spark):
    rng = random.Random(6)
    rows = [
        (g, 1 + g % 3, 2024, rng.choice(["A", "B", None]), rng.choice(["A", "B"]), rng.choice([0.0, 1.0, None]),
         rng.choice([0.0, 1.0]), rng.choice([1.0, 2.0, 3.0, None]), float(rng.randrange(2)), rng.choice([None, 2.0, -3.0]),
         rng.choice([None, 1.0, 2.0, -4.0]))
        for g in range(12) for _ in range(6)
    ]
    df = spark.createDataFrame(
        rows, "game_id int, week int, season int, posteam string, defteam string, pass_attempt double, rush_attempt double, "
        "down double, success double, cpoe double, epa double",
    )
    keys = games.KEYS
    parts = games.offensive_value_by_game(df).join(games.defensive_value_by_game(df), keys, "full_outer").join(
        games.early_down_success_rate(df), keys, "full_outer").join(games.passer_composite(df), keys, "full_outer")
    whole = games.team_game_table(df).select(*parts.columns)

    def near(table):
        return sorted(
            tuple("null" if v is None else (f"{v:.9f}" if isinstance(v, float) else str(v)) for v in r) for r in table.collect()
        )

    assert near(whole) == near(parts)
