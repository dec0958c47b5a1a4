"""Filters over actions: scope, period, clock, players, kinds and flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import action_category, is_three, normalize_period

SHOTS = ["TwoPointShotMade", "TwoPointShotMissed", "ThreePointShotMade", "ThreePointShotMissed", "FreeThrowMade", "FreeThrowMissed"]
KINDS = {
    "shots": SHOTS,
    "makes": [s for s in SHOTS if s.endswith("Made")],
    "rebounds": ["OffensiveRebound", "DefensiveRebound"],
    "fouls": ["OffensiveFoul", "DefensiveFoul", "UnsportsmanlikeFoul", "TechnicalFoul", "BenchFoul", "CoachFoul"],
    "substitutions": ["PlayerIn", "PlayerOut"],
    "timeouts": ["Timeout", "TimeoutTV"],
}
FLAGS = {"fast_break": "is_fast_break", "second_chance": "is_second_chance", "from_turnover": "is_from_turnover"}


def in_scope(acts: DataFrame, seasons: str = "ALL", games: str = "ALL") -> DataFrame:
    """Comma lists of season and game codes; ALL doesn't filter. A game needs exactly one season."""
    def codes(s: str) -> list[str]:
        return [c.strip() for c in s.split(",") if c.strip() and c.strip() != "ALL"]

    s, g = codes(seasons), codes(games)
    if bad := [c for c in s if not re.fullmatch(r"E\d{4}", c)] + [c for c in g if not c.isdigit()]:
        raise ValueError(f"bad codes: {bad}")
    if g and len(s) != 1:
        raise ValueError("a game needs exactly one season")
    acts = acts.where(F.col("season_code").isin(s)) if s else acts
    return acts.where(F.col("game_code").isin(g)) if g else acts


def in_period(period: str) -> Column:
    """One period, or OT for any overtime."""
    p = normalize_period("period")
    return p.rlike("OT$") if period == "OT" else p == period


def in_clock(start_minute: float | None, end_minute: float | None, overtime: bool = False) -> Column:
    """Remaining time from start_minute down to end_minute; both or neither; 10 minutes at most, 5 in overtime."""
    if start_minute is None and end_minute is None:
        return F.lit(True)
    most = 5 if overtime else 10
    if start_minute is None or end_minute is None or not 0 <= end_minute <= start_minute <= most:
        raise ValueError(f"clock limits must be {most} >= start >= end >= 0")
    return F.col("seconds_remaining").between(end_minute * 60, start_minute * 60)


def refereed_by(acts: DataFrame, referees: DataFrame, referee: str) -> DataFrame:
    """Actions of games of referees(game_id, referee_id) with the referee."""
    return acts.join(referees.where(F.col("referee_id") == referee).select("game_id"), "game_id", "left_semi")


def by_player(acts: DataFrame, labels: DataFrame, player: str) -> DataFrame:
    """Actions by the player of that id, or by players one of whose labels(player_id, name) holds all words of it."""
    if re.fullmatch(r"P\d+", player):
        return acts.where(F.col("player_id") == player)
    tokens = [t for t in re.split(r"[^\w]+", player.lower()) if t]
    hit = F.forall(F.array(*map(F.lit, tokens)), lambda t: F.lower("name").contains(t))
    return acts.join(labels.where(hit).select("player_id"), "player_id", "left_semi")


def name_match(name: str, column: str = "name") -> Column:
    """Whole words, any case."""
    return F.col(column).rlike(rf"(?i)(^|[^A-Za-z0-9]){re.escape(name)}([^A-Za-z0-9]|$)")


def assisted_by(acts: DataFrame, player: str) -> DataFrame:
    """Scoring actions whose assist, by assist_id, is the player's."""
    own = acts.where((F.col("action_class") == "Assist") & (F.col("player_id") == player)).select(F.col("action_id").alias("assist_id"))
    return acts.join(own, "assist_id", "left_semi")


def by_kind(kind: str) -> Column:
    return F.col("action_class").isin(KINDS[kind])


def by_flag(flag: str) -> Column:
    return F.coalesce(F.col(FLAGS[flag]), F.lit(False))


def in_half(half: int) -> Column:
    return normalize_period("period").isin(*(("1st", "2nd") if half == 1 else ("3rd", "4th")))


def clutch(margin: int = 5) -> Column:
    return (normalize_period("period") == "4th") & (F.abs(F.col("home_score") - F.col("road_score")) <= margin)


def last_seconds(n: int) -> Column:
    return F.col("seconds_remaining") <= n


def score_tied() -> Column:
    return F.col("home_score") == F.col("road_score")


def plausible_comeback() -> Column:
    """Timeouts of the fourth period, 60 to 300 seconds left, margin at most 6 and at most a point per 30 seconds."""
    margin = F.abs(F.col("home_score") - F.col("road_score"))
    return by_kind("timeouts") & (normalize_period("period") == "4th") & F.col("seconds_remaining").between(60, 300) & margin.between(1, 6) & (margin * 30 <= F.col("seconds_remaining"))


def trailing_side() -> Column:
    return F.when(F.col("home_score") < F.col("road_score"), "home").when(F.col("home_score") > F.col("road_score"), "road")


def filter_shots(acts: DataFrame, team: str | None = None, made: bool | None = None, periods: list[str] | None = None, players: list[str] | None = None, rules: dict[str, dict[str, bool]] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Shots by team, result, periods, players and, per side, kinds that are switched off.

    rules: {"home": {"three": False, ...}} with the kinds two, three, free,
    fast_break, second_chance and from_turnover; a kind can only exclude. An
    empty list or id table keeps nothing, None doesn't filter.
    """
    shots = acts.where(by_kind("shots"))
    for column, values in ((F.col("team_id"), [team] if team else None), (normalize_period("period"), periods), (F.col("player_id"), players)):
        if values is not None:
            shots = shots.where(column.isin(values) if values else F.lit(False))
    if made is not None:
        shots = shots.where(F.col("action_class").contains("Made") == made)
    kinds = {"three": is_three("action_class"), "free": F.col("action_class").contains("FreeThrow"), "two": F.col("action_class").contains("TwoPoint"), **{f: by_flag(f) for f in FLAGS}}
    for side, rule in (rules or {}).items():
        for kind, wanted in rule.items():
            if not wanted:
                shots = shots.where(~((F.col("team_id") == F.col(f"{side}_team")) & kinds[kind]))
    return shots.join(ids.select("action_id"), "action_id", "left_semi") if ids is not None else shots


def filter_actions(acts: DataFrame, ids: DataFrame | None = None, categories: list[str] | None = None, player: str | None = None, period: str | None = None) -> DataFrame:
    if ids is not None:
        acts = acts.join(ids.select("action_id"), "action_id", "left_semi")
    if categories is not None:
        acts = acts.where(action_category("action_class").isin(categories) if categories else F.lit(False))
    if player is not None:
        acts = acts.where(F.col("player_id") == player)
    return acts.where(in_period(period)) if period is not None else acts


def any_match(df: DataFrame) -> DataFrame:
    """One row: whether df has any."""
    return df.limit(1).agg((F.count("*") > 0).alias("any_match"))


def positive_only(df: DataFrame, stat: str) -> DataFrame:
    return df.where(F.col(stat) > 0)


def videos_in_season(catalog: DataFrame, timelines: DataFrame, season: str) -> DataFrame:
    """Enabled catalogue rows of the season that have a video and a timeline of one reading at least."""
    rows = catalog.where((F.col("season_code") == season) & F.coalesce("enabled", F.lit(True)) & (F.length(F.trim("youtube_id")) > 0))
    return rows.join(timelines.select("season_code", "game_code").distinct(), ["season_code", "game_code"], "left_semi")
