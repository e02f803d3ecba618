"""Scoreboard tokens made from the words of the documents, clocks and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.catalog.base import query, table
from fieldglass.functions import clock as ck, text as tx
from fieldglass.operators import fusion, tokens as tk

CODES = ",".join(tx.TEAM_CODES)
FRAME = 12

# What a word w at place i becomes; both engines read this text the same way.
TOKEN = f"""case (length(w) * 7 + i) % 11
  when 0 then concat(substr(w, 1, 1), 'ND & ', cast(i % 20 as string))
  when 1 then concat('&', cast(i % 15 as string))
  when 2 then concat(cast(i % 15 as string), ':', lpad(cast(i % 60 as string), 2, '0'))
  when 3 then concat(substr(w, 1, 1), 'ST ', cast(i % 13 as string), '.', lpad(cast(i % 60 as string), 2, '0'))
  when 4 then concat(split_part('{CODES}', ',', cast(i % 32 + 1 as int)), case when length(w) % 3 = 0 then 'X' else '' end)
  when 5 then cast(i % 60 as string)
  else w end"""


def words(spark, folder):
    return table(spark, folder, "documents").repartition("doc_id").select(
        "doc_id", F.split("text", "[ \\n\\t\\r]+").alias("words"),
    )


def word_tokens(spark, folder):
    """One row per token: (doc_id, i, text, clean)."""
    listed = words(spark, folder).select("doc_id", F.posexplode("words").alias("i", "w"))
    tokens = listed.withColumn("text", F.expr(TOKEN)).select("doc_id", "i", "text")
    return tk.computed_once(tokens, tx.normalise_token(F.col("text")), "clean", ["doc_id", "i", "text"])


def frames(spark, folder):
    """One row per twelve words of a document, with its token array."""
    made = words(spark, folder).select(
        "doc_id",
        F.expr(f"transform(words, (w, i) -> struct(cast(i % {FRAME} as double) as x, {TOKEN} as text))").alias("all"),
    )
    numbered = made.withColumn("seg", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / FRAME).cast("int"))))
    return numbered.select("doc_id", "seg", F.slice("all", F.col("seg") * FRAME + 1, FRAME).alias("tokens"))


WORDS_CTE = f"""w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, string_split_regex(text, '[ \\n\\t\\r]+') AS ws FROM documents)),
t AS (SELECT doc_id, CAST(i AS INTEGER) AS i, {TOKEN} AS text FROM w),
c AS (SELECT *, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9&:.]', '', 'g') AS clean FROM t)"""
WITH_TOKENS = f"WITH {WORDS_CTE}"


def closest_sql(token: str, choices: list[str], cutoff: float) -> str:
    listed = ", ".join(f"'{c}'" for c in choices)
    best = (
        f"list_max(list_transform([{listed}], lambda ch: {{'sim': 1 - (2 * levenshtein({token}, ch) "
        f"- abs(length({token}) - length(ch)))::DOUBLE / (length({token}) + length(ch)), 'choice': ch}}))"
    )
    return f"(CASE WHEN {best}.sim >= {cutoff}::DOUBLE - 1e-12 THEN {best}.choice END)"


DOWN_RE, DIST_RE, CLOCK_RE, HEAD_RE = tx.DOWN_DISTANCE, tx.DISTANCE, tx.CLOCK, tx.LEADING_ORDINAL
HEAD_SQL = "regexp_replace(regexp_extract(clean, '^([^:.]*)', 1), '[^A-Z0-9]', '', 'g')"
LETTERS_SQL = "regexp_replace(clean, '[^A-Z]', '', 'g')"
CLASSES_CTE = f"""{WORDS_CTE},
p AS (SELECT *, {HEAD_SQL} AS head, {LETTERS_SQL} AS letters, regexp_matches(clean, '{DOWN_RE}') AS has_down,
    regexp_extract(clean, '{DOWN_RE}', 1) || regexp_extract(clean, '{DOWN_RE}', 2) AS down_token FROM c),
q AS (SELECT *, regexp_matches(head, '{HEAD_RE}') AS has_head,
    regexp_extract(head, '{HEAD_RE}', 1) || regexp_extract(head, '{HEAD_RE}', 2) AS head_token,
    CASE WHEN length(letters) BETWEEN 2 AND 4 THEN {closest_sql('letters', tx.TEAM_CODES, tx.TEAM_CUTOFF)} END AS team_code FROM p),
r AS (SELECT *, CASE WHEN clean = '' THEN 0 WHEN has_down THEN 1 WHEN contains(clean, '&') THEN 2 WHEN has_head THEN 4
    WHEN team_code IS NOT NULL THEN 5 WHEN regexp_matches(clean, '^\\d{{1,2}}$') THEN 6 ELSE 7 END AS rule FROM q),
h AS (SELECT doc_id, i // {FRAME} AS seg, i % {FRAME} AS x, i, text, rule,
    CASE WHEN rule >= 4 AND regexp_matches(clean, '{CLOCK_RE}')
      THEN regexp_extract(clean, '{CLOCK_RE}', 1) || ':' || regexp_extract(clean, '{CLOCK_RE}', 2) END AS clock,
    CASE WHEN rule = 1 THEN CASE {closest_sql('down_token', tx.ORDINALS[:4], tx.DOWN_CUTOFF)}
      WHEN '1ST' THEN 1 WHEN '2ND' THEN 2 WHEN '3RD' THEN 3 WHEN '4TH' THEN 4 END END AS down,
    CASE WHEN rule = 1 THEN TRY_CAST(regexp_extract(clean, '{DOWN_RE}', 3) AS INTEGER)
      WHEN rule = 2 THEN TRY_CAST(regexp_extract(clean, '{DIST_RE}', 1) AS INTEGER) END AS distance,
    CASE WHEN rule = 4 THEN {closest_sql('head_token', tx.ORDINALS, tx.QUARTER_CUTOFF)} END AS quarter,
    CASE WHEN rule = 5 THEN team_code END AS team,
    CASE WHEN rule = 6 THEN CAST(clean AS INTEGER) END AS score FROM r)"""
STATES_CTE = f"""{CLASSES_CTE},
g AS (SELECT doc_id, CAST(seg AS INTEGER) AS seg, string_agg(text, ' ' ORDER BY i) AS raw_text,
    arg_max(quarter, i) FILTER (WHERE quarter IS NOT NULL) AS quarter, arg_min(clock, i) FILTER (WHERE clock IS NOT NULL) AS clock,
    arg_max(down, i) FILTER (WHERE down IS NOT NULL) AS down, arg_max(distance, i) FILTER (WHERE distance IS NOT NULL) AS distance,
    list({{'x': x, 'v': team}} ORDER BY i) FILTER (WHERE team IS NOT NULL) AS teams,
    list({{'x': x, 'v': score}} ORDER BY i) FILTER (WHERE score IS NOT NULL) AS scores FROM h GROUP BY doc_id, seg),
lone AS (SELECT *, coalesce(len(teams) = 1 AND len(scores) = 2
    AND abs(teams[1].x - scores[1].x) > abs(teams[1].x - scores[2].x), false) AS lone_home FROM g),
states AS (SELECT doc_id, seg, raw_text, quarter, clock, down, distance,
    CASE WHEN NOT lone_home THEN teams[1].v END AS away_team, scores[1].v AS away_score,
    CASE WHEN lone_home THEN teams[1].v ELSE teams[2].v END AS home_team, scores[2].v AS home_score FROM lone)"""
WITH_STATES = f"WITH {STATES_CTE}"


@query("h1_normalised_tokens", f"{WITH_TOKENS} SELECT doc_id, i, clean FROM c")
def h1(spark, folder):
    return word_tokens(spark, folder).select("doc_id", "i", "clean")


@query("h2_down_and_distance", f"""WITH {CLASSES_CTE} SELECT doc_id, i, down, distance FROM h WHERE rule = 1""")
def h2(spark, folder):
    tokens = word_tokens(spark, folder)
    fields = tk.token_fields(F.col("clean"), F.lit(tk.DOWN_DISTANCE), F.lit(None))
    return tokens.where(F.col("clean").rlike(tx.DOWN_DISTANCE)).select(
        "doc_id", "i", fields["down"].alias("down"), fields["distance"].alias("distance"),
    )


@query("h3_distance_only", f"WITH {CLASSES_CTE} SELECT doc_id, i, distance FROM h WHERE rule = 2")
def h3(spark, folder):
    tokens = word_tokens(spark, folder)
    only = ~F.col("clean").rlike(tx.DOWN_DISTANCE) & F.col("clean").contains("&")
    return tokens.where(only).select("doc_id", "i", tx.extract_int(F.col("clean"), tx.DISTANCE, 1).alias("distance"))


@query("h4_clock", f"""{WITH_TOKENS} SELECT doc_id, i, regexp_extract(clean, '{CLOCK_RE}', 1) || ':' || regexp_extract(clean, '{CLOCK_RE}', 2) AS clock
FROM c WHERE regexp_matches(clean, '{CLOCK_RE}')""")
def h4(spark, folder):
    tokens = word_tokens(spark, folder).withColumn("clock", tx.clock_text(F.col("clean")))
    return tokens.where(F.col("clock").isNotNull()).select("doc_id", "i", "clock")


@query("h5_quarter", f"""{WITH_TOKENS}, p AS (SELECT *, {HEAD_SQL} AS head FROM c),
q AS (SELECT *, regexp_extract(head, '{HEAD_RE}', 1) || regexp_extract(head, '{HEAD_RE}', 2) AS head_token
  FROM p WHERE regexp_matches(head, '{HEAD_RE}'))
SELECT doc_id, i, {closest_sql('head_token', tx.ORDINALS, tx.QUARTER_CUTOFF)} AS quarter FROM q""")
def h5(spark, folder):
    tokens = word_tokens(spark, folder).withColumn("head", tx.ordinal_head(F.col("clean")))
    return tokens.where(F.col("head").rlike(tx.LEADING_ORDINAL)).select(
        "doc_id", "i", tx.quarter_text(F.col("head")).alias("quarter"),
    )


@query("h6_team_token", f"""{WITH_TOKENS}, p AS (SELECT *, {LETTERS_SQL} AS letters FROM c)
SELECT doc_id, i, {closest_sql('letters', tx.TEAM_CODES, tx.TEAM_CUTOFF)} AS team FROM p WHERE length(letters) BETWEEN 2 AND 4""")
def h6(spark, folder):
    letters = tk.computed_once(word_tokens(spark, folder), tx.letters_only(F.col("clean")), "letters", ["doc_id", "i", "clean"])
    return letters.where(F.length("letters").between(2, 4)).select(
        "doc_id", "i", tx.team_text(F.col("clean")).alias("team"),
    )


@query("h7_scores", f"{WITH_STATES} SELECT doc_id, seg, away_score, home_score FROM states")
def h7(spark, folder):
    return tk.parse_token_frames(frames(spark, folder)).select("doc_id", "seg", "away_score", "home_score")


@query("h8_parsed_frames", f"{WITH_STATES} SELECT * FROM states")
def h8(spark, folder):
    return tk.parse_token_frames(frames(spark, folder))


@query("h14_raw_text", f"""{WITH_TOKENS} SELECT doc_id, CAST(i // {FRAME} AS INTEGER) AS seg, string_agg(text, ' ' ORDER BY i) AS raw_text
FROM c GROUP BY 1, 2""")
def h14(spark, folder):
    return frames(spark, folder).select("doc_id", "seg", tk.raw_text(tk.order_tokens(F.col("tokens"))).alias("raw_text"))


@query("f6_token_order", f"""{WITH_TOKENS} SELECT doc_id, i, text, CAST(row_number() OVER (
  PARTITION BY doc_id, i // {FRAME} ORDER BY -(i % {FRAME})) AS INTEGER) AS place FROM c""")
def f6(spark, folder):
    """Places right to left: the given order is reversed first, so the sort has work to do."""
    mirrored = frames(spark, folder).withColumn(
        "tokens", F.transform("tokens", lambda t: F.struct((-t["x"]).alias("x"), t["text"].alias("text"))),
    )
    listed = mirrored.select("doc_id", "seg", F.posexplode(tk.order_tokens(F.col("tokens"))).alias("pos", "t"))
    return listed.select(
        "doc_id", (F.col("seg") * FRAME - F.col("t.x")).cast("int").alias("i"), F.col("t.text").alias("text"),
        (F.col("pos") + 1).alias("place"),
    )


@query("c15_fuzzy_lookup", f"""WITH m AS (SELECT c_custkey, upper(substr(c_mktsegment, 1 + CAST(c_custkey % 3 AS INTEGER))) || CAST(c_custkey % 2 AS VARCHAR) AS seen FROM customer)
SELECT c_custkey, seen, {closest_sql('seen', ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], 0.75)} AS matched FROM m""")
def c15(spark, folder):
    misread = F.concat(
        F.upper(F.substr("c_mktsegment", (1 + F.col("c_custkey") % 3).cast("int"))),
        (F.col("c_custkey") % 2).cast("string"),
    )
    rows = table(spark, folder, "customer").select("c_custkey", misread.alias("seen"))
    choices = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return rows.withColumn("matched", tx.closest_match(F.col("seen"), choices, 0.75))


@query("c21_lone_team_side", f"""{WITH_STATES} SELECT l.doc_id, l.seg, l.lone_home FROM lone l
WHERE len(teams) = 1 AND len(scores) = 2""")
def c21(spark, folder):
    hits = tk.computed_once(frames(spark, folder), tk.token_hits(tk.order_tokens(F.col("tokens"))), "hits", ["doc_id", "seg"])
    parsed = hits.select(
        "doc_id", "seg", F.filter("hits", lambda h: h["team"].isNotNull()).alias("teams"),
        F.filter("hits", lambda h: h["score"].isNotNull()).alias("scores"),
    ).where((F.size("teams") == 1) & (F.size("scores") == 2))
    side = tk.lone_team_side(
        F.size("teams"), F.size("scores"), F.col("teams")[0]["x"], F.col("scores")[0]["x"], F.col("scores")[1]["x"],
    )
    return parsed.select("doc_id", "seg", side.alias("lone_home"))


STATE_SCORE_SQL = " + ".join(f"CAST({f} IS NOT NULL AS INTEGER)" for f in tk.STATE_FIELDS)


@query("d16_state_score", f"{WITH_STATES} SELECT doc_id, seg, {STATE_SCORE_SQL} AS known FROM states")
def d16(spark, folder):
    return tk.parse_token_frames(frames(spark, folder)).select("doc_id", "seg", tk.state_score().alias("known"))


@query("e10_best_region", f"""{WITH_STATES}, ranked AS (SELECT doc_id, CAST(seg // 2 AS INTEGER) AS frame, seg % 2 AS region,
    row_number() OVER (PARTITION BY doc_id, seg // 2 ORDER BY {STATE_SCORE_SQL} DESC, seg % 2) AS place, raw_text, clock, away_team
  FROM states)
SELECT doc_id, frame, region, raw_text, clock, away_team FROM ranked WHERE place = 1""")
def e10(spark, folder):
    states = tk.parse_token_frames(frames(spark, folder)).withColumns({
        "frame": F.floor(F.col("seg") / 2).cast("int"), "region": F.col("seg") % 2,
    })
    best = tk.best_region(states, ["doc_id", "frame"], "region")
    return best.select("doc_id", "frame", "region", "raw_text", "clock", "away_team")


@query("b14_state_features", f"""{WITH_STATES}, k AS (SELECT *, CASE quarter WHEN '1ST' THEN 1 WHEN '2ND' THEN 2 WHEN '3RD' THEN 3
    WHEN '4TH' THEN 4 WHEN 'OT' THEN 5 END AS qtr,
    CAST(split_part(clock, ':', 1) AS INTEGER) * 60 + CAST(split_part(clock, ':', 2) AS INTEGER) AS secs FROM states
  WHERE quarter IS NOT NULL AND clock IS NOT NULL AND down IS NOT NULL AND distance IS NOT NULL AND away_team IS NOT NULL
    AND away_score IS NOT NULL AND home_team IS NOT NULL AND home_score IS NOT NULL)
SELECT doc_id, seg, qtr, distance AS ydstogo, 50 AS yardline_100, away_score - home_score AS score_differential,
  secs + CASE WHEN qtr IN (1, 3) THEN 900 ELSE 0 END AS half_seconds_remaining,
  secs + greatest(0, 4 - qtr) * 900 AS game_seconds_remaining, 3 AS posteam_timeouts_remaining,
  3 AS defteam_timeouts_remaining, 0 AS is_home FROM k""")
def b14(spark, folder):
    states = tk.parse_token_frames(frames(spark, folder))
    features = [c for c in fusion.WIN_PROB_FEATURES if c != "down"]
    return fusion.state_features(states).select("doc_id", "seg", *features)


@query("b15_scenario_features", """SELECT event_id, CAST(event_id % 5 + 1 AS INTEGER) AS qtr,
  CAST((event_id % 15) * 60 + user_id % 60 + CASE WHEN event_id % 5 + 1 IN (1, 3) THEN 900 ELSE 0 END AS BIGINT) AS half_seconds_remaining,
  CAST((event_id % 15) * 60 + user_id % 60 + greatest(0, 3 - event_id % 5) * 900 AS BIGINT) AS game_seconds_remaining,
  value - 50 AS score_differential FROM events""")
def b15(spark, folder):
    scenarios = table(spark, folder, "events").select(
        "event_id", (F.col("event_id") % 5 + 1).cast("int").alias("qtr"), (F.col("event_id") % 15).alias("minutes"),
        (F.col("user_id") % 60).alias("seconds"), F.col("value").alias("posteam_score"), F.lit(50).alias("defteam_score"),
    )
    return fusion.scenario_features(scenarios).select(
        "event_id", "qtr", "half_seconds_remaining", "game_seconds_remaining", "score_differential",
    )


@query("b16_situation_text", """SELECT event_id, format('Q{} {} | {}&{} | {} {} - {} {}', event_type, strftime(ts, '%M:%S'),
  event_id % 4 + 1, user_id % 20, event_type, CAST(floor(value) AS BIGINT), 'home', user_id) AS situation FROM events""")
def b16(spark, folder):
    text = ck.situation_text(
        F.col("event_type"), F.date_format("ts", "mm:ss"), F.col("event_id") % 4 + 1, F.col("user_id") % 20,
        F.col("event_type"), F.floor("value"), F.lit("home"), F.col("user_id"),
    )
    return table(spark, folder, "events").select("event_id", text.alias("situation"))


@query("b17_rounded_pair", """SELECT event_id, round_even(value / 97, 4) AS posteam_win_prob,
  round_even(1 - value / 97, 4) AS defteam_win_prob FROM events""")
def b17(spark, folder):
    ours, theirs = ck.rounded_pair(F.col("value") / 97)
    return table(spark, folder, "events").select(
        "event_id", ours.alias("posteam_win_prob"), theirs.alias("defteam_win_prob"),
    )


QUARTERS = "CASE event_id % 6 WHEN 0 THEN '1ST' WHEN 1 THEN '2ND' WHEN 2 THEN '3RD' WHEN 3 THEN '4TH' WHEN 4 THEN 'OT' ELSE 'HALF' END"


@query("h9_ordinal_numbers", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END AS quarter_no,
  CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS down_no FROM events""")
def h9(spark, folder):
    rows = table(spark, folder, "events").selectExpr("event_id", f"{QUARTERS} AS quarter")
    return rows.select(
        "event_id", ck.quarter_number(F.col("quarter")).alias("quarter_no"), ck.down_number(F.col("quarter")).alias("down_no"),
    )


@query("h10_clock_seconds", "SELECT event_id, CAST(minute(ts) * 60 + second(ts) AS INTEGER) AS seconds FROM events")
def h10(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", ck.clock_seconds(F.date_format("ts", "mm:ss")).alias("seconds"),
    )


@query("h11_seconds_remaining", """SELECT event_id,
  CAST(user_id + CASE WHEN event_id % 5 + 1 IN (1, 3) THEN 900 ELSE 0 END AS BIGINT) AS half_seconds,
  CAST(user_id + greatest(0, 3 - event_id % 5) * 900 AS BIGINT) AS game_seconds FROM events""")
def h11(spark, folder):
    number = (F.col("event_id") % 5 + 1).cast("int")
    return table(spark, folder, "events").select(
        "event_id", ck.half_seconds(number, F.col("user_id")).alias("half_seconds"),
        ck.game_seconds(number, F.col("user_id")).alias("game_seconds"),
    )
