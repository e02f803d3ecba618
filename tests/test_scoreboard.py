"""Token parsing, fusion features, colours and field positions."""

import difflib
import itertools
import string

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import colour, geometry, text
from fieldglass.operators import fusion, tokens, vision

TOKENS = "f int, tokens array<struct<x:double,text:string>>"


def parse(spark, *texts):
    listed = [(float(10 * i), t) for i, t in enumerate(texts)]
    return tokens.parse_token_frames(spark.createDataFrame([(1, listed)], TOKENS)).first().asDict()


def test_full_layout(spark):
    state = parse(spark, "2ND & 7", "CLE", "0", "NE", "0", "1ST 12:00 08")
    assert state["down"] == 2 and state["distance"] == 7 and state["quarter"] == "1ST" and state["clock"] == "12:00"
    assert (state["away_team"], state["home_team"], state["away_score"], state["home_score"]) == ("CLE", "NE", 0, 0)
    assert state["raw_text"] == "2ND & 7 CLE 0 NE 0 1ST 12:00 08"


@pytest.mark.parametrize("token, quarter, clock", [
    ("2ND14:34", "2ND", "14:34"), ("2ND 14.36", "2ND", "14:36"), ("IST 9:00", "1ST", "9:00"),
])
def test_glued_quarter_and_clock(spark, token, quarter, clock):
    state = parse(spark, token)
    assert (state["quarter"], state["clock"]) == (quarter, clock)


def test_misread_down_and_empty_frame(spark):
    state = parse(spark, "ZNd & 7")
    assert (state["down"], state["distance"]) == (2, 7)
    assert all(v is None for k, v in parse(spark).items() if k not in ("f", "raw_text"))


def test_lone_team_takes_the_nearer_score(spark):
    rows = [(1, [(100.0, "0"), (400.0, "DAL"), (410.0, "7")]), (2, [(100.0, "3"), (110.0, "NYG"), (500.0, "7")])]
    got = {r["f"]: r for r in tokens.parse_token_frames(spark.createDataFrame(rows, TOKENS)).collect()}
    assert got[1]["home_team"] == "DAL" and got[1]["away_team"] is None
    assert got[2]["away_team"] == "NYG" and got[2]["home_team"] is None


def test_best_region_in_row_and_by_group(spark):
    rows = [(1, [(1.0, "CLE")], [(1.0, "2ND 14:34"), (2.0, "7")]), (2, [(1.0, "KC")], [(1.0, "10")])]
    df = spark.createDataFrame(rows, "f int, low array<struct<x:double,text:string>>, top array<struct<x:double,text:string>>")
    got = {r["f"]: r for r in tokens.read_regions(df, ["low", "top"]).collect()}
    assert got[1]["clock"] == "14:34" and got[2]["away_team"] == "KC"
    long = df.select("f", F.lit(0).alias("region"), F.col("low").alias("tokens")).unionByName(
        df.select("f", F.lit(1).alias("region"), F.col("top").alias("tokens")))
    best = {r["f"]: r for r in tokens.best_region(tokens.parse_token_frames(long), ["f"], "region").collect()}
    assert best[1]["clock"] == "14:34" and best[2]["away_team"] == "KC"


def test_long_table_of_tokens(spark):
    df = spark.createDataFrame([(1, 20.0, "7"), (1, 10.0, "CLE")], "f int, x double, text string")
    assert [t["text"] for t in tokens.gather_tokens(df, ["f"]).first()["tokens"]] == ["CLE", "7"]


def test_team_codes_match_like_matching_blocks(spark):
    """Every one-letter edit of every code finds what the matching-block ratio finds."""
    seen = set()
    for code in text.TEAM_CODES:
        for i, letter in itertools.product(range(len(code) + 1), string.ascii_uppercase):
            seen.update({code[:i] + letter + code[i:], code[:i] + letter + code[i + 1:], code[:i] + code[i + 1:]})
    words = sorted(w for w in seen if 2 <= len(w) <= 4)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = dict(tuple(r) for r in df.select("w", text.team_text(F.col("w"))).collect())
    for w in words:
        found = difflib.get_close_matches(w, text.TEAM_CODES, n=1, cutoff=text.TEAM_CUTOFF)
        assert got[w] == (found[0] if found else None)


STATE = ("2ND", "10:15", 3, 7, "CLE", 10, "NE", 7)


def states(spark, *rows):
    return spark.createDataFrame(
        [(float(i), *r) for i, r in enumerate(rows)],
        "timestamp_sec double, quarter string, clock string, down int, distance int, away_team string, away_score int, "
        "home_team string, home_score int")


def test_state_features(spark):
    row = fusion.state_features(states(spark, STATE, ("1ST", "5:00", *STATE[2:]))).orderBy("timestamp_sec").collect()
    assert (row[0]["qtr"], row[0]["score_differential"], row[0]["is_home"], row[0]["ydstogo"]) == (2, 3, 0, 7)
    assert (row[1]["half_seconds_remaining"], row[1]["game_seconds_remaining"]) == (1200, 3000)


def test_incomplete_states_give_no_row(spark):
    broken = [tuple(None if i == j else v for j, v in enumerate(STATE)) for i in range(8)] + [("5TH", *STATE[1:])]
    assert fusion.state_features(states(spark, *broken)).count() == 0


def test_probability_record(spark):
    df = states(spark, STATE).withColumn("p", F.lit(0.70764))
    row = fusion.probability_record(df).first()
    assert row["situation"] == "Q2ND 10:15 | 3&7 | CLE 10 - NE 7"
    assert (row["posteam_win_prob"], row["defteam_win_prob"]) == (0.7076, 0.2924)


def test_nearest_swatch(spark):
    swatches = [(0, "CLE", 10), (1, "NE", 105)]
    df = spark.createDataFrame([(1, 10.0), (2, 105.0), (3, 90.0), (4, None), (5, 60.0), (6, 175.0)], "k int, hue double")
    df = df.withColumn("s", F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("team"), F.lit(h).alias("hue")) for o, t, h in swatches]))
    got = [r[0] for r in df.orderBy("k").select(colour.nearest_swatch(F.col("hue"), F.col("s"))).collect()]
    assert got == ["CLE", "NE", "NE", None, None, "CLE"]


def test_hue_of_colours(spark):
    df = spark.createDataFrame([("#FF3C00",), ("#002244",), ("#777777",), ("#00FF00",)], "h string")
    rgb = colour.hex_to_rgb(F.col("h"))
    got = [r[0] for r in df.select(colour.rgb_to_hue(rgb["r"], rgb["g"], rgb["b"])).collect()]
    assert got == [7, 105, 0, 60]


def test_dominant_hue(spark):
    pixels = [(1, 1, 7.0, 200.0)] * 6 + [(1, 2, 60.0, 200.0)] * 9 + [(1, 3, 7.0, 200.0)] * 4 + [(1, 4, 7.0, 10.0)] * 9
    df = spark.createDataFrame(pixels, "frame_id int, box_id int, h double, s double")
    assert {r["box_id"]: r["hue"] for r in vision.dominant_hue(df).collect()} == {1: 7.0, 2: None, 3: None, 4: None}


def test_homography_and_rectangles(spark):
    df = spark.createDataFrame([(50.0, 50.0)], "x double, y double")
    matrix = [F.lit(v) for v in (0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0)]
    x, y = geometry.project(F.col("x"), F.col("y"), matrix)
    assert tuple(df.select(x, y).first()) == (pytest.approx(5.0), pytest.approx(5.0))
    missing = [F.lit(None).cast("double")] * 9
    assert tuple(df.select(*geometry.project(F.col("x"), F.col("y"), missing)).first()) == (None, None)
    rect = [F.lit(v) for v in (180, 635, 1080, 675)]
    half = df.select(geometry.scale_rectangle(*rect, F.lit(640), F.lit(360)).alias("r")).first()["r"]
    assert tuple(half) == (90, 317, 540, 337)
    assert df.select(geometry.scale_rectangle(*rect, F.lit(640), F.lit(0)).alias("r")).first()["r"] is None


def by_columns(ordered):
    """The classes and fields of tokens by the column functions, one token at a time."""
    cleaned = F.transform(ordered, lambda t: F.struct(t["x"], text.normalise_token(t["text"]).alias("clean")))
    known = F.transform(cleaned, lambda t: F.struct(t["x"], t["clean"], tokens.early_rule(t["clean"]).alias("early"), text.team_text(t["clean"]).alias("team")))
    team = lambda t: F.when(t["early"].isNull(), t["team"])
    ruled = F.transform(known, lambda t: F.struct(t["x"], t["clean"], team(t).alias("team"), tokens.late_rule(t["clean"], t["early"], team(t)).alias("rule")))
    return F.transform(ruled, lambda t: F.struct(t["x"], t["rule"], *[
        c.alias(n) for n, c in tokens.token_fields(t["clean"], t["rule"], t["team"]).items()]))


def test_tokens_read_in_batches_say_what_the_columns_say(spark):
    parts = ["", "1", "ST", "ND", "ZND", "4TH", "OT", " & 7", "&", "12:05", "9.59", "KC", "CLE", "CLX", "CHIE", "straße", "ı", "07", "123", "é9"]
    texts = [None, *[a + b for a in parts for b in parts]]
    rows = [(0, None), (1, []), (2, [None, (1.0, None)]), *[(i + 3, [(1.0, t), (0.0, "x")]) for i, t in enumerate(texts)]]
    df = spark.createDataFrame(rows, TOKENS).repartition(3)
    both = df.select("f", tokens.order_tokens(F.col("tokens")).alias("o")).select(
        "f", tokens.token_hits(F.col("o")).alias("hits"), by_columns(F.col("o")).alias("plain")).collect()
    assert len(both) == len(rows) and all(r["hits"] == r["plain"] for r in both)


def test_a_text_shown_by_many_frames_is_read_once(monkeypatch):
    import pyarrow as pa
    frames = pa.array([[{"x": 0.0, "text": "KC"}, {"x": 1.0, "text": "7"}]] * 500, pa.list_(pa.struct([("x", pa.float64()), ("text", pa.string())])))
    read, plain = [], tokens.read_token
    monkeypatch.setattr(tokens, "read_token", lambda t, teams: read.append(t) or plain(t, teams))
    hits = tokens.read_arrays(frames.slice(100), ("KC", "only here"))
    assert sorted(read) == ["7", "KC"] and len(hits) == 400
    assert [h["team"] for h in hits[399].as_py()] == ["KC", None] and [h["score"] for h in hits[0].as_py()] == [None, 7]


def state_by_columns(frames):
    """State of a frame from its classified tokens, by column functions."""
    ordered = frames.select("f", tokens.order_tokens(F.col("tokens")).alias("o"))
    hits = ordered.select("f", "o", tokens.token_hits(F.col("o")).alias("h"))
    say = lambda field: F.filter("h", lambda h: h[field].isNotNull())
    at = lambda field, place: F.try_element_at(say(field), F.lit(place))
    lone = tokens.lone_team_side(F.size(say("team")), F.size(say("score")), at("team", 1)["x"], at("score", 1)["x"], at("score", 2)["x"])
    return hits.select(
        "f", tokens.raw_text(F.col("o")).alias("raw_text"), at("quarter", -1)["quarter"].alias("quarter"), at("clock", 1)["clock"].alias("clock"),
        at("down", -1)["down"].alias("down"), at("distance", -1)["distance"].alias("distance"),
        F.when(~lone, at("team", 1)["team"]).alias("away_team"), at("score", 1)["score"].alias("away_score"),
        F.when(lone, at("team", 1)["team"]).otherwise(at("team", 2)["team"]).alias("home_team"), at("score", 2)["score"].alias("home_score"))


def test_frames_read_as_arrays_say_what_their_tokens_say(spark):
    import random
    draw = random.Random(5)
    texts = [None, "", "KC", "CLE", "NE", "7", "10", "2ND & 7", "& 3", "1ST 12:00", "4TH", "9.59", "hello", "ZND & 12", "OT"]
    places = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.0, 2.5]
    rows = [(0, None), (1, []), (2, [None, (1.0, None)]), (3, [(None, "KC"), (2.0, "3"), (5.0, "4")]),
            (4, [(float("nan"), "KC"), (2.0, "3"), (5.0, "4")]), (5, [(4.0, "KC"), (2.0, "3"), (5.0, "4")])]
    rows += [(i + 6, [draw.choice([None, *[(draw.choice(places), draw.choice(texts))] * 12]) for _ in range(draw.randrange(9))]) for i in range(600)]
    df = spark.createDataFrame(rows, TOKENS).repartition(3)
    read, plain = tokens.parse_token_frames(df), state_by_columns(df)
    assert read.dtypes == plain.dtypes
    assert sorted(read.collect(), key=lambda r: r["f"]) == sorted(plain.collect(), key=lambda r: r["f"])
    extra = "transform(tokens, t -> struct(t.text as text, 1 as more, cast(t.x as float) as x)) as tokens"
    assert sorted(tokens.parse_token_frames(df.selectExpr("f", extra)).collect(), key=lambda r: r["f"]) == sorted(plain.collect(), key=lambda r: r["f"])


def test_frames_are_read_without_a_walk_through_their_tokens(spark):
    """a row's tokens were sorted, filtered and joined one by one by seven lambdas."""
    df = spark.createDataFrame([(1, [(0.0, "KC")])], TOKENS)
    assert "lambda" not in tokens.parse_token_frames(df)._jdf.queryExecution().toString()
