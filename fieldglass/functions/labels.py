"""Readable labels: sides, badges, reasons, clip names, feed status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldglass.functions.clock import lookup

# Texts shown to users, by code.
CONFIDENCE_BADGES = {
    "confirmed_healthy": "✅ egészséges kezdő",
    "inferred_due_to_injury": "⚠️ sérülés miatt becsült tartalék",
    "starter_injured_no_known_backup": "❓ kezdő sérült, tartalék ismeretlen",
    "no_history": "❓ nincs historikus adat",
}
FEATURE_DESCRIPTIONS = {
    "qb_weather_epa": "az irányító időjárás-kondicionált EPA-hatékonysága",
    "qb_weather_cpoe": "az irányító célzási pontossága (CPOE) ilyen időjárásban",
    "qb_out": "a kezdő irányító sérülés miatt hiányzik",
    "adj_off_epa": "az ellenfél-korrigált támadó hatékonyság",
    "adj_def_epa": "az ellenfél-korrigált védekező hatékonyság",
    "off_epa_pass_ema5": "a passzjáték elmúlt formája (EPA/play)",
    "off_epa_rush_ema5": "a futójáték elmúlt formája (EPA/play)",
    "def_epa_pass_ema5": "a passz-védekezés elmúlt formája",
    "def_epa_rush_ema5": "a fut-védekezés elmúlt formája",
    "edsr_ema5": "a korai down (1-2. down) siker-arány",
    "is_dome": "fedett stadion (nincs időjárási hatás)",
    "injury_burden": "a csapat összesített sérülés-terhe",
    "rest_advantage_home": "pihenőnap-előny",
}
STRONG_CONTRIBUTION = 0.1
PRE_ROLL = 15.0
POST_ROLL = 20.0
STALE_AFTER = 15.0


def side_label(team: Column, possessing_team: Column) -> Column:
    """offense, defense, or null for an unassigned player."""
    return F.when(
        team.isNotNull(), F.when(team.eqNullSafe(possessing_team), "offense").otherwise("defense"),
    )


def confidence_badge(code: Column) -> Column:
    known = lookup(code, CONFIDENCE_BADGES)
    fallback = F.when(code.isNull() | (code == ""), "?").otherwise(code)
    return F.coalesce(known, fallback)


def strip_prefix(name: Column, *prefixes: str) -> Column:
    return F.regexp_replace(name, "^(" + "|".join(prefixes) + ")", "")


def reason_text(
    feature: Column, contribution: Column, home: Column, away: Column,
    descriptions: dict[str, str] | None = None,
) -> Column:
    """Sentence for one feature contribution."""
    base = strip_prefix(feature, "home_", "away_", "diff_")
    described = F.coalesce(lookup(base, descriptions or FEATURE_DESCRIPTIONS), base)
    favoured = F.when(contribution > 0, home).otherwise(away)
    strength = F.when(F.abs(contribution) > STRONG_CONTRIBUTION, "erősen").otherwise("enyhén")
    ending = F.concat(F.lit(" - "), strength, F.lit(" "), favoured, F.lit(" felé billenti az esélyt"))
    subject = F.when(feature.startswith("home_"), home).when(feature.startswith("away_"), away)
    return F.when(
        subject.isNotNull(), F.concat(subject, F.lit(": "), described, ending),
    ).otherwise(F.concat(described, F.lit(" különbsége"), ending))


def is_hit(probability: Column, home_won: Column) -> Column:
    """The prediction rule: strictly above one half means a home win."""
    return (probability > 0.5) == home_won


def feed_status(last_seen: Column, now: Column, stale_after: float = STALE_AFTER) -> Column:
    """waiting without a record, live within `stale_after` seconds, else stale."""
    return (
        F.when(last_seen.isNull(), "waiting")
        .when(now - last_seen < stale_after, "live")
        .otherwise("stale")
    )


def clip_start(trigger: Column, pre_roll: float = PRE_ROLL) -> Column:
    return F.greatest(F.lit(0.0), trigger - pre_roll)


def clip_tag(confirmed: Column) -> Column:
    return F.when(confirmed, "confirmed").otherwise("audio_only")


def clip_name(trigger: Column, confirmed: Column) -> Column:
    return F.format_string("highlight_%ds_%s", F.bround(trigger, 0).cast("long"), clip_tag(confirmed))
