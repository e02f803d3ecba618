"""Scoreboard tokens to game state.

A frame arrives as one row with an array of tokens, so parsing is a map inside the row: it needs
no shuffle in batch and no state in streaming.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import text as tx
from fieldglass.functions.clock import DOWN_NUMBERS, lookup
from fieldglass.functions.nulls import nonnull_count

STATE_FIELDS = [
    "quarter", "clock", "down", "distance", "away_team", "away_score", "home_team", "home_score",
]
# Token classes, in order of precedence.
EMPTY, DOWN_DISTANCE, DISTANCE, QUARTER, TEAM, SCORE, OTHER = 0, 1, 2, 4, 5, 6, 7


def gather_tokens(
    tokens: DataFrame, keys: Sequence[str], x: str = "x", text: str = "text", order: str | None = None,
) -> DataFrame:
    """Fold a long token table into one row per frame; a frame holds only what one image shows."""
    entry = F.struct(
        F.col(x).cast("double").alias("x"),
        (F.col(order) if order else F.lit(0)).cast("long").alias("ix"),
        F.col(text).alias("text"),
    )
    return tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("tokens"))


def order_tokens(tokens: Column) -> Column:
    """Left to right; tokens at the same place keep their given order."""
    indexed = F.transform(
        tokens,
        lambda t, i: F.struct(t["x"].cast("double").alias("x"), i.alias("ix"), t["text"].alias("text")),
    )
    return F.sort_array(indexed)


def raw_text(ordered: Column) -> Column:
    """Texts of ordered tokens in one line."""
    return F.array_join(F.transform(ordered, lambda t: t["text"]), " ")


def early_rule(clean: Column) -> Column:
    """Class of a normalised token by its pattern alone; null where a team or score may follow."""
    marked = clean.contains("&")
    return (
        F.when(clean == "", EMPTY)
        .when(marked & clean.rlike(tx.DOWN_DISTANCE), DOWN_DISTANCE)
        .when(marked, DISTANCE)
        .when(clean.rlike(tx.LEADING_ORDINAL), QUARTER)
    )


def late_rule(clean: Column, early: Column, team: Column) -> Column:
    """The whole class, in order of precedence."""
    return (
        F.when(early.isNotNull(), early)
        .when(team.isNotNull(), TEAM)
        .when(clean.rlike(tx.SCORE), SCORE)
        .otherwise(OTHER)
    )


def token_fields(clean: Column, rule: Column, team: Column) -> dict[str, Column]:
    """Everything one normalised token says; null where its class does not say it."""
    timed = (rule >= QUARTER) & (clean.contains(":") | clean.contains("."))
    return {
        "clock": F.when(timed, tx.clock_text(clean)),
        "down": F.when(rule == DOWN_DISTANCE, lookup(tx.down_text(clean), DOWN_NUMBERS)),
        "distance": F.when(rule == DOWN_DISTANCE, tx.extract_int(clean, tx.DOWN_DISTANCE, 3))
        .when(rule == DISTANCE, tx.extract_int(clean, tx.DISTANCE, 1)),
        "quarter": F.when(rule == QUARTER, tx.quarter_text(clean)),
        "team": team,
        "score": F.when(rule == SCORE, tx.score_value(clean)),
    }


# What a token says: its class, then what its class lets it say.
SAID = {
    "rule": pa.int32(), "clock": pa.string(), "down": pa.int32(), "distance": pa.int32(), "quarter": pa.string(),
    "team": pa.string(), "score": pa.int32(),
}
SILENT = (OTHER, None, None, None, None, None, None)
HITS = "array<struct<x:double,rule:int,clock:string,down:int,distance:int,quarter:string,team:string,score:int>>"
KNOWN_TEXTS = 1 << 17  # token texts a worker remembers
# What a frame says before the lone team's side is known; places are those of the tokens read.
SEEN = {
    "raw_text": pa.string(), "quarter": pa.string(), "clock": pa.string(), "down": pa.int32(), "distance": pa.int32(),
    "team1": pa.string(), "team2": pa.string(), "score1": pa.int32(), "score2": pa.int32(),
    "team_x": pa.float64(), "away_x": pa.float64(), "home_x": pa.float64(), "n_teams": pa.int32(), "n_scores": pa.int32(),
}
SEEN_SCHEMA = (
    "struct<raw_text:string,quarter:string,clock:string,down:int,distance:int,team1:string,team2:string,score1:int,score2:int,"
    "team_x:double,away_x:double,home_x:double,n_teams:int,n_scores:int>"
)
_UNCLEAN, _UNLETTERED = re.compile("[^A-Z0-9&:.]"), re.compile("[^A-Z]")
_PLACED, _DISTANCE, _ORDINAL = re.compile(tx.DOWN_DISTANCE), re.compile(tx.DISTANCE), re.compile(tx.LEADING_ORDINAL)
_SCORE, _CLOCK = re.compile(tx.SCORE), re.compile(tx.CLOCK)


@lru_cache(maxsize=KNOWN_TEXTS)
def _closest(token: str, choices: tuple[str, ...], cutoff: float) -> str | None:
    """`closest_text`, remembered: different texts come down to the same few letters."""
    return tx.closest_text(token, choices, cutoff)


def read_token(text: str, teams: Sequence[str] = tx.TEAM_CODES) -> tuple:
    """What one token says, in the order of `SAID`: the rules of `early_rule`, `late_rule` and `token_fields`."""
    clean = _UNCLEAN.sub("", text.upper())
    clock = down = distance = quarter = team = score = None
    if not clean:
        rule = EMPTY
    elif "&" in clean:
        placed = _PLACED.search(clean)
        rule = DOWN_DISTANCE if placed else DISTANCE
        after = placed[3] if placed else (_DISTANCE.search(clean) or ("", ""))[1]
        distance = int(after) if after else None
        down = DOWN_NUMBERS.get(_closest(placed[1] + placed[2], tuple(tx.ORDINALS[:4]), tx.DOWN_CUTOFF)) if placed else None
    elif ordinal := _ORDINAL.search(clean):
        rule, quarter = QUARTER, _closest(ordinal[1] + ordinal[2], tuple(tx.ORDINALS), tx.QUARTER_CUTOFF)
    else:
        letters = _UNLETTERED.sub("", clean)
        if letters in teams or 2 <= len(letters) <= 4:
            team = _closest(letters, tuple(teams), tx.TEAM_CUTOFF)
        score = int(clean) if not team and _SCORE.search(clean) else None
        rule = TEAM if team else OTHER if score is None else SCORE
    shown = _CLOCK.search(clean) if rule >= QUARTER else None
    if shown:
        clock = f"{shown[1]}:{shown[2]}"
    return rule, clock, down, distance, quarter, team, score


@lru_cache(maxsize=8)
def _reader(teams: tuple[str, ...]) -> Callable[[str], tuple]:
    """`read_token` for one dictionary, remembering the texts seen last."""
    return lru_cache(maxsize=KNOWN_TEXTS)(partial(read_token, teams=teams))


def _read_texts(texts: pa.Array, teams: tuple[str, ...]) -> tuple[dict[str, tuple], pa.Array]:
    """What each different text says, first what a null says, by field; and the place of every text among them."""
    read = _reader(teams)
    seen = texts.dictionary_encode()
    said = [SILENT, *[read(text) for text in seen.dictionary.to_pylist()]]
    return dict(zip(SAID, zip(*said))), pc.fill_null(pc.add(seen.indices, 1), 0)


def read_arrays(ordered: pa.Array, teams: tuple[str, ...]) -> pa.Array:
    """Classified tokens of many frames; a text that many of them show is read once."""
    tokens = ordered.flatten()
    said, place = _read_texts(pc.struct_field(tokens, "text"), teams)
    fields = [pa.array(said[field], kind).take(place) for field, kind in SAID.items()]
    hits = pa.StructArray.from_arrays([pc.struct_field(tokens, "x"), *fields], ["x", *SAID])
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ordered), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0)), hits, mask=ordered.is_null())


def token_hits(ordered: Column, teams: Sequence[str] = tx.TEAM_CODES) -> Column:
    """Classified tokens of a frame, from its ordered tokens.

    Frames come in Arrow batches. Screens show the same texts again and again, so the patterns and dictionaries
    are tried once for a text, not once for a token.
    """
    listed = tuple(teams)

    def classify(batch: pa.Array) -> pa.Array:
        return read_arrays(batch, listed)

    return F.arrow_udf(classify, HITS)(ordered)


def computed_once(df: DataFrame, value: Column, name: str, keep: Sequence[str]) -> DataFrame:
    """Add a costly column so that later filters and repeated uses read its result.

    A plain projection would be copied into every filter above it; a generator is not.
    """
    return df.select(*keep, F.inline(F.array(F.struct(value.alias(name)))))


def _left_to_right(frame: np.ndarray, x: pa.Array) -> np.ndarray | None:
    """The order of `order_tokens` within each frame: unknown places first, NaN last; None if it is the given one."""
    known = x.is_valid().to_numpy(zero_copy_only=False)
    value = x.fill_null(0.0).to_numpy(zero_copy_only=False)
    if known.all() and ((frame[1:] != frame[:-1]) | (value[1:] >= value[:-1])).all():
        return None
    return np.lexsort((value, known, frame))


def read_frames(tokens: pa.Array, teams: tuple[str, ...]) -> pa.Array:
    """What each of many frames says, in the fields of `SEEN`, from arrays of tokens with `x` and `text`."""
    n, flat = len(tokens), tokens.flatten()
    frame = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    x, text = pc.struct_field(flat, "x"), pc.struct_field(flat, "text")
    order = _left_to_right(frame, x)
    if order is not None:
        x, text = x.take(pa.array(order)), text.take(pa.array(order))
    shown = np.bincount(frame[text.is_valid().to_numpy(zero_copy_only=False)], minlength=n)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(shown, dtype=np.int32)])
    lines = pa.ListArray.from_arrays(pa.array(ends), text.drop_null(), mask=tokens.is_null())
    out = {"raw_text": pc.binary_join(lines, " ")}

    said, place = _read_texts(text, teams)
    place = place.to_numpy(zero_copy_only=False)

    def holders(field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that say the field, and where those of each frame begin and end among them."""
        saying = np.flatnonzero(np.array([value is not None for value in said[field]])[place])
        starts = np.searchsorted(frame[saying], np.arange(n + 1))
        return saying, starts[:-1], starts[1:]

    def at(saying: np.ndarray, places: np.ndarray, there: np.ndarray) -> pa.Array:
        """Token numbers, null where a frame has none."""
        tokens_at = np.zeros(n, np.int64)
        tokens_at[there] = saying[places[there]]
        return pa.array(tokens_at, mask=~there)

    def value(field: str, token: pa.Array) -> pa.Array:
        return pa.array(said[field], SAID[field]).take(pa.array(place).take(token))

    for field in ("quarter", "clock", "down", "distance"):
        saying, starts, stops = holders(field)
        out[field] = value(field, at(saying, starts if field == "clock" else stops - 1, stops > starts))
    for field, (first, second) in {"team": ("team_x", None), "score": ("away_x", "home_x")}.items():
        saying, starts, stops = holders(field)
        for number, at_x in ((1, first), (2, second)):
            token = at(saying, starts + number - 1, stops - starts >= number)
            out[f"{field}{number}"] = value(field, token)
            if at_x:
                out[at_x] = x.take(token)
        out[f"n_{field}s"] = pa.array((stops - starts).astype(np.int32))
    return pa.StructArray.from_arrays([out[name].cast(kind) for name, kind in SEEN.items()], list(SEEN))


def with_state(
    frames: DataFrame, tokens: str = "tokens", out: str = "state", teams: Sequence[str] = tx.TEAM_CODES,
) -> DataFrame:
    """Add struct `out` with the raw text and the eight state fields of a token array.

    Frames come in Arrow batches; a batch is ordered, read and gathered by frame with arrays, so no row walks its
    tokens one by one and only the fields of a frame come back, not those of its tokens.
    """
    keep, listed = frames.columns, tuple(teams)

    def read(batch: pa.Array) -> pa.Array:
        return read_frames(batch, listed)

    given = F.transform(tokens, lambda t: F.struct(t["x"].cast("double").alias("x"), t["text"].cast("string").alias("text")))
    plain = frames.select(tokens).schema[0].dataType.simpleString() == "array<struct<x:double,text:string>>"
    seen = computed_once(frames, F.arrow_udf(read, SEEN_SCHEMA)(F.col(tokens) if plain else given), "_seen", keep)
    see = F.col("_seen")
    lone_is_home = lone_team_side(see["n_teams"], see["n_scores"], see["team_x"], see["away_x"], see["home_x"])
    state = F.struct(
        see["raw_text"].alias("raw_text"),
        see["quarter"].alias("quarter"), see["clock"].alias("clock"),
        see["down"].alias("down"), see["distance"].alias("distance"),
        F.when(~lone_is_home, see["team1"]).alias("away_team"),
        see["score1"].alias("away_score"),
        F.when(lone_is_home, see["team1"]).otherwise(see["team2"]).alias("home_team"),
        see["score2"].alias("home_score"),
    )
    return seen.select(*keep, state.alias(out))


def parse_token_frames(
    frames: DataFrame, tokens: str = "tokens", teams: Sequence[str] = tx.TEAM_CODES,
) -> DataFrame:
    """Replace the token array by the raw text and the state fields."""
    kept = [c for c in frames.columns if c != tokens]
    return with_state(frames, tokens, "_state", teams).select(*kept, "_state.*")


def read_regions(
    frames: DataFrame, regions: Sequence[str], teams: Sequence[str] = tx.TEAM_CODES,
) -> DataFrame:
    """Parse one token column per screen region and keep the state with most known fields.

    The first region wins a tie. All regions of a frame sit in its row, so a stream needs no state.
    """
    kept = [c for c in frames.columns if c not in regions]
    out = frames
    for number, region in enumerate(regions):
        out = with_state(out, region, f"_state{number}", teams)
    scored = [
        F.struct(
            nonnull_count(*[F.col(f"_state{i}")[f] for f in STATE_FIELDS]).alias("score"),
            F.lit(-i).alias("place"), F.col(f"_state{i}").alias("state"),
        )
        for i in range(len(regions))
    ]
    best = F.array_max(F.transform(F.array(*scored), lambda s: F.struct(s["score"], s["place"])))
    pick = F.coalesce(*[
        F.when(best["place"] == -i, F.col(f"_state{i}")) for i in range(len(regions))
    ])
    return out.select(*kept, pick.alias("_state")).select(*kept, "_state.*")


def lone_team_side(
    n_teams: Column, n_scores: Column, team_x: Column, away_x: Column, home_x: Column,
) -> Column:
    """True when the only team seen stands nearer to the second of exactly two scores."""
    nearer_home = F.abs(team_x - away_x) > F.abs(team_x - home_x)
    return F.coalesce((n_teams == 1) & (n_scores == 2) & nearer_home, F.lit(False))


def state_score() -> Column:
    """Number of known state fields."""
    return nonnull_count(*[F.col(f) for f in STATE_FIELDS])


def best_region(states: DataFrame, frame: Sequence[str], region: str) -> DataFrame:
    """Per frame the region with most known fields; the first region wins a tie.

    A maximum over structs combines before the shuffle, so a frame never gathers in one task.
    """
    payload = F.struct(*[F.col(c) for c in states.columns if c not in frame])
    ranked = states.groupBy(*frame).agg(
        F.min_by(payload, F.struct(-state_score(), F.col(region))).alias("_best"),
    )
    return ranked.select(*frame, "_best.*")
