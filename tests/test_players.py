"""Passer profiles, starters, matchups and reasons."""

import pytest
from pyspark.sql import functions as F

from fieldglass.errors import InsufficientHistoryError
from fieldglass.functions.labels import confidence_badge, feed_status, reason_text
from fieldglass.operators import games, matchups, shrinkage, starters

STATS = "game_id string, season int, week int, team string, passer_player_id string, passer_player_name string, qb_dropbacks int"


def stats(spark, rows):
    return spark.createDataFrame([(f"g{w}", 2024, w, t, i, i.upper(), n) for w, t, i, n in rows], STATS)


def reports(spark, rows):
    return spark.createDataFrame(
        [(2024, w, t, i, s) for w, t, i, s in rows],
        "season int, week int, team string, gsis_id string, report_status string",
    )


def starter(spark, rows, week, out=()):
    found = starters.likely_starter(stats(spark, rows), "A", 2024, week, reports(spark, out) if out else None)
    row = found.first()
    return row["passer_player_id"], row["confidence"]


def test_healthy_starter_is_the_most_used_of_the_last_game(spark):
    rows = [(1, "A", "p1", 30), (2, "A", "p2", 25), (2, "A", "p1", 9), (3, "A", "p9", 40)]
    assert starter(spark, rows, 3) == ("p2", "confirmed_healthy")
    assert starter(spark, [(1, "A", "p2", 7), (1, "A", "p1", 7)], 2) == ("p1", "confirmed_healthy")


def test_injured_starter_gives_the_latest_other(spark):
    rows = [(1, "A", "p3", 5), (1, "A", "p1", 30), (2, "A", "p1", 31), (3, "A", "p1", 33)]
    assert starter(spark, rows, 4, [(4, "A", "p1", "Out")]) == ("p3", "inferred_due_to_injury")
    assert starter(spark, rows, 4, [(4, "A", "p1", "Questionable")]) == ("p1", "confirmed_healthy")


def test_injured_without_backup_and_no_history(spark):
    rows = [(2, "A", "p1", 31), (3, "A", "p1", 33)]
    assert starter(spark, rows, 4, [(4, "A", "p1", "Out")]) == (None, "starter_injured_no_known_backup")
    assert starter(spark, rows, 2) == (None, "no_history")


def test_starters_equal_brute_force(spark):
    import random
    rng = random.Random(8)
    rows = list({(w, t, f"p{i}"): (w, t, f"p{i}", rng.randrange(1, 5))
                 for w in range(1, 15) for t in "AB" for i in [rng.randrange(4) for _ in range(rng.choice([0, 1, 1, 2]))]}.values())
    out = [(w, t, f"p{rng.randrange(4)}", "Out") for w in range(1, 16) for t in "AB"]
    points = spark.createDataFrame([(t, 2024, w) for t in "AB" for w in range(1, 16)], "team string, season int, week int")
    got = {(r["team"], r["week"]): (r["passer_player_id"], r["confidence"])
           for r in starters.likely_starters(stats(spark, rows), points, reports(spark, out)).collect()}
    for t in "AB":
        for w in range(1, 16):
            past = [r for r in rows if r[1] == t and r[0] < w]
            if not past:
                assert got[t, w] == (None, "no_history")
                continue
            last = max(r[0] for r in past)
            first = min((-r[3], r[2]) for r in past if r[0] == last)[1]
            if (w, t, first, "Out") not in out:
                assert got[t, w] == (first, "confirmed_healthy")
                continue
            others = [(r[0], r[2]) for r in past if r[2] != first]
            assert got[t, w] == ((max(others)[1], "inferred_due_to_injury") if others else (None, "starter_injured_no_known_backup"))


def weather_games(spark, rows):
    return spark.createDataFrame(
        [("p1", b, 2024, w, e, None) for b, w, e in rows],
        "passer_player_id string, weather_bucket string, season int, week int, qb_epa double, qb_cpoe double",
    )


def test_shrinkage(spark):
    df = weather_games(spark, [("mild", w, 0.3) for w in range(1, 6)] + [("cold", 6, -2.0)])
    row = {r["weather_bucket"]: r for r in shrinkage.shrunk_profile(df, 2024, 7).collect()}
    overall = (5 * 0.3 - 2.0) / 6
    assert row["cold"]["qb_weather_epa"] == pytest.approx((-2.0 + 8 * overall) / 9)
    assert row["cold"]["qb_weather_cpoe"] is None
    panel = shrinkage.shrunk_panel(df.unionByName(weather_games(spark, [("mild", 7, 9.0)])))
    at7 = {r["weather_bucket"]: r["qb_weather_epa"] for r in panel.where("week = 7").collect()}
    assert at7["cold"] == pytest.approx(row["cold"]["qb_weather_epa"])


def test_shrinkage_does_not_leak(spark):
    df = weather_games(spark, [("mild", 1, 0.1), ("cold", 2, 5.0)])
    assert [r["weather_bucket"] for r in shrinkage.shrunk_profile(df, 2024, 2).collect()] == ["mild"]
    with pytest.raises(InsufficientHistoryError):
        shrinkage.shrunk_profile(df, 2024, 1)


def test_passers_are_kept_apart(spark):
    rows = [("g", 2024, 1, "A", "p1", "P1", 1.0, 0.5, 2.0), ("g", 2024, 1, "A", "p1", "P1", 1.0, -0.2, None),
            ("g", 2024, 1, "A", "p2", "P2", 1.0, 1.0, 1.0), ("g", 2024, 1, "A", None, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(
        rows, "game_id string, season int, week int, posteam string, passer_player_id string, passer_player_name string, "
        "pass_attempt double, epa double, cpoe double")
    got = {r["passer_player_id"]: (r["qb_epa"], r["qb_dropbacks"]) for r in games.passer_game_stats(df).collect()}
    assert got == {"p1": (pytest.approx(0.15), 2), "p2": (1.0, 1)}


def test_matchup_table(spark):
    features = spark.createDataFrame(
        [(1, "H", 2024, 1, 0.5, True), (1, "A", 2024, 1, 0.2, None)],
        "game_id int, team string, season int, week int, adj_off_epa double, is_dome boolean")
    g = spark.createDataFrame(
        [(1, 2024, 1, "H", "A", 3.0), (2, 2024, 1, "X", "Y", 0.0), (3, 2024, 2, "X", "Y", None)],
        "game_id int, season int, week int, home_team string, away_team string, result double")
    table = matchups.matchup_table(features, g)
    row = {r["game_id"]: r for r in table.collect()}
    assert row[1]["diff_adj_off_epa"] == pytest.approx(0.3) and row[1]["diff_is_dome"] is None
    assert (row[1]["home_win"], row[2]["home_win"], row[3]["home_win"]) == (1.0, None, None)
    assert matchups.feature_columns(table)[:3] == ["home_adj_off_epa", "away_adj_off_epa", "diff_adj_off_epa"]


def test_texts(spark):
    df = spark.createDataFrame([("home_qb_out", -0.3), ("diff_is_dome", 0.05), ("other", 0.2)], "f string, c double")
    texts = [r[0] for r in df.select(reason_text(F.col("f"), F.col("c"), F.lit("GB"), F.lit("ATL"))).collect()]
    assert texts[0] == "GB: a kezdő irányító sérülés miatt hiányzik - erősen ATL felé billenti az esélyt"
    assert texts[1].startswith("fedett stadion (nincs időjárási hatás) különbsége - enyhén GB")
    codes = spark.createDataFrame([("no_history",), ("new",), (None,)], "c string")
    assert [r[0] for r in codes.select(confidence_badge(F.col("c"))).collect()] == ["❓ nincs historikus adat", "new", "?"]
    seen = spark.createDataFrame([(None,), (90.0,), (50.0,)], "s double")
    assert [r[0] for r in seen.select(feed_status(F.col("s"), F.lit(100.0))).collect()] == ["waiting", "live", "stale"]
