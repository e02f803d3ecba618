"""Scoreboard token text: normalising, patterns and fuzzy dictionary lookup."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns, dictionaries and match cutoffs.
ORDINALS = ["1ST", "2ND", "3RD", "4TH", "OT"]
TEAM_CODES = [
    "ARI", "ATL", "BAL", "BUF", "CAR", "CHI", "CIN", "CLE", "DAL", "DEN",
    "DET", "GB", "HOU", "IND", "JAX", "KC", "LA", "LAC", "LV", "MIA",
    "MIN", "NE", "NO", "NYG", "NYJ", "PHI", "PIT", "SEA", "SF", "TB",
    "TEN", "WAS",
]
DOWN_DISTANCE = r"([A-Z0-9]{1,3})(ST|ND|RD|TH).{0,3}&\s*(\d{1,2})"
DISTANCE = r"&\s*(\d{1,2})"
CLOCK = r"(\d{1,2})[:.](\d{2})"
LEADING_ORDINAL = r"^([A-Z0-9]{1,2})(ST|ND|RD|TH)"
SCORE = r"^\d{1,2}$"
DOWN_CUTOFF = 0.3
QUARTER_CUTOFF = 0.4
TEAM_CUTOFF = 0.75
FLOAT_SLACK = 1e-12


def normalise_token(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9&:.]", "")


def similarity(a: Column, b: Column) -> Column:
    """Share of matching characters of both texts, from edit distance and lengths."""
    total = F.length(a) + F.length(b)
    edits = 2 * F.levenshtein(a, b) - F.abs(F.length(a) - F.length(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - edits / total)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def _allowed_edits(token_length: int, choice_length: int, cutoff: float) -> int:
    """Most edits with which texts of these lengths still reach the cutoff; -1 if none can."""
    gap, total = abs(token_length - choice_length), token_length + choice_length
    edits = math.floor(((1 - cutoff) * total + gap) / 2 + FLOAT_SLACK)
    return edits if edits >= gap else -1


def _best_of(token: Column, candidates: Column, cutoff: float) -> Column:
    scored = F.transform(
        candidates, lambda c: F.struct(similarity(token, c).alias("sim"), c.alias("choice")),
    )
    return F.array_max(F.filter(scored, lambda s: s["sim"] >= cutoff - FLOAT_SLACK))["choice"]


def _within(token: Column, choices: Sequence[str], edits: int) -> Column:
    return F.filter(
        F.array(*[F.lit(c) for c in choices]), lambda c: F.levenshtein(token, c, edits) >= 0,
    )


def _near_choices(token: Column, length: int, choices: Sequence[str], cutoff: float) -> Column | None:
    """Choices within the edits allowed for a token of known length, by a bounded edit distance."""
    near = []
    for size in sorted({len(c) for c in choices}):
        edits = _allowed_edits(length, size, cutoff)
        if edits >= 1:
            near.append(_within(token, [c for c in choices if len(c) == size], edits))
    return F.concat(*near) if near else None


def closest_match(
    token: Column, choices: Sequence[str], cutoff: float, lengths: Sequence[int] | None = None,
) -> Column:
    """Most similar choice at or above the cutoff; the largest text wins a tie.

    The dictionary is a short literal array, searched inside the row. Where the possible token
    lengths are known, each length is compared only with the choices it can match.
    """
    def match(t: Column) -> Column:
        found = F.when(t.isin(*choices), t)
        if lengths is None:
            return found.otherwise(_best_of(t, F.array(*[F.lit(c) for c in choices]), cutoff))
        for length in lengths:
            near = _near_choices(t, length, choices, cutoff)
            if near is not None:
                found = found.when(F.length(t) == length, _best_of(t, near, cutoff))
        return found

    return let(token, match)


def edit_distance(a: str, b: str) -> int:
    """Fewest inserted, deleted or replaced characters."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def closest_text(token: str, choices: Sequence[str], cutoff: float) -> str | None:
    """`closest_match` of one text, for tasks that read many tokens at once."""
    if token in choices:
        return token
    near = []
    for choice in choices:
        gap, total = abs(len(token) - len(choice)), len(token) + len(choice)
        # A gap in length alone costs its share, so most choices need no distance.
        if total and 1 - gap / total >= cutoff - FLOAT_SLACK:
            likeness = 1 - (2 * edit_distance(token, choice) - gap) / total
            if likeness >= cutoff - FLOAT_SLACK:
                near.append((likeness, choice))
    return max(near)[1] if near else None


def extract_int(text: Column, pattern: str, group: int) -> Column:
    """Integer of a regex group, null without a match."""
    return F.regexp_extract(text, pattern, group).try_cast("int")


def down_text(clean: Column) -> Column:
    """Fuzzy ordinal of a down-and-distance token, null without one."""
    ordinal = F.concat(
        F.regexp_extract(clean, DOWN_DISTANCE, 1), F.regexp_extract(clean, DOWN_DISTANCE, 2),
    )
    return F.when(clean.rlike(DOWN_DISTANCE), closest_match(ordinal, ORDINALS[:4], DOWN_CUTOFF, range(3, 6)))


def clock_text(clean: Column) -> Column:
    """`m:ss` found anywhere in the token; a dot counts as the colon."""
    return F.when(
        clean.rlike(CLOCK),
        F.concat_ws(":", F.regexp_extract(clean, CLOCK, 1), F.regexp_extract(clean, CLOCK, 2)),
    )


def ordinal_head(clean: Column) -> Column:
    """Letters and digits before the first colon or dot."""
    return F.regexp_replace(F.regexp_extract(clean, r"^([^:.]*)", 1), "[^A-Z0-9]", "")


def quarter_text(head: Column) -> Column:
    ordinal = F.concat(
        F.regexp_extract(head, LEADING_ORDINAL, 1), F.regexp_extract(head, LEADING_ORDINAL, 2),
    )
    return F.when(head.rlike(LEADING_ORDINAL), closest_match(ordinal, ORDINALS, QUARTER_CUTOFF, range(3, 5)))


def letters_only(clean: Column) -> Column:
    return F.regexp_replace(clean, "[^A-Z]", "")


def team_text(clean: Column, teams: Sequence[str] = TEAM_CODES) -> Column:
    return closest_match(letters_only(clean), teams, TEAM_CUTOFF, range(2, 5))


def score_value(clean: Column) -> Column:
    return F.when(clean.rlike(SCORE), clean.try_cast("int"))
