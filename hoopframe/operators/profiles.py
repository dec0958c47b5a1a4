"""Player profiles as paragraphs, and late-game scenarios with the side to coach, its roster and what followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_prose, country_name, first_sentences, long_date
from .candidates import seeded
from .lineups import roster_seen
from .scope import plausible_comeback, trailing_side

BIO_SENTENCES, ACHIEVEMENT_SENTENCES = 7, 5
NO_BIOGRAPHY = "Only limited biographical information is known of this player."


def player_profiles(players: DataFrame) -> DataFrame:
    """(player_id, name, position, country, paragraphs) of players(player_id, name, position, birth_date, country, bio, achievements).

    The first paragraph says what the player plays and, if that is a date, when
    they were born; then come the first sentences of bio and achievements,
    cleaned, or a note if there are none. A player without a name has no
    profile.
    """
    plays = F.coalesce(F.nullif(F.lower("position"), F.lit("")), F.lit("player"))
    born = long_date("birth_date")
    opening = F.concat("name", F.lit(" is a basketball "), plays, F.when(born.isNotNull(), F.concat(F.lit(", born on "), born)).otherwise(""), F.lit("."))
    told = [F.nullif(first_sentences(clean_prose(c), n), F.lit("")) for c, n in (("bio", BIO_SENTENCES), ("achievements", ACHIEVEMENT_SENTENCES))]
    known = players.where("name is not null and name <> ''").withColumns({"_opening": opening, "_bio": told[0], "_achievements": told[1]})
    rest = F.when(F.col("_bio").isNull() & F.col("_achievements").isNull(), F.array(F.lit(NO_BIOGRAPHY))).otherwise(F.array_compact(F.array("_bio", "_achievements")))
    return known.select("player_id", "name", F.coalesce("position", F.lit("")).alias("position"), country_name("country").alias("country"), F.concat(F.array("_opening"), rest).alias("paragraphs"))


def late_scenarios(acts: DataFrame, seed: int = 0) -> DataFrame:
    """One row per plausible comeback of acts with lineups: action_id, game_id, clock, user_team, opponent, user_score,
    opp_score, roster, user_final, opp_final, came_back.

    The user coaches the trailing side, or one that the seed picks where the
    scores are level; roster has its players of the game, sorted. came_back:
    the user's side won in the end.
    """
    last = acts.groupBy("game_id").agg(F.max_by(F.struct("home_score", "road_score"), "seq").alias("end"))
    roster = roster_seen(acts).groupBy("game_id", F.col("team_id").alias("user_team")).agg(F.array_sort(F.collect_set("player_id")).alias("roster"))
    home = F.coalesce(trailing_side() == "home", seeded(F.col("action_id"), seed) % 2 == 0)
    a = acts.where(plausible_comeback()).withColumn("_home", home).join(last, "game_id")

    def side(of_home: str, of_road: str, own: bool) -> Column:
        return F.when(F.col("_home") == F.lit(own), F.col(of_home)).otherwise(F.col(of_road))

    cols = {f"{who}_{what}": side(f"{pre}home_{col}", f"{pre}road_{col}", own) for who, own in (("user", True), ("opp", False)) for what, pre, col in (("score", "", "score"), ("final", "end.", "score"))}
    a = a.withColumns({"user_team": side("home_team", "road_team", True), "opponent": side("home_team", "road_team", False), **cols})
    out = a.join(roster, ["game_id", "user_team"], "left")
    return out.select("action_id", "game_id", "clock", "user_team", "opponent", "user_score", "opp_score", F.coalesce("roster", F.array().cast("array<string>")).alias("roster"), "user_final", "opp_final", (F.col("user_final") > F.col("opp_final")).alias("came_back"))


def season_shots(acts: DataFrame, players: DataFrame) -> DataFrame:
    """Shots with who took and assisted them: one row per shot of acts with links, names by a late join, running number in the game."""
    names = players.select("player_id", "name")
    shots = acts.where(F.col("action_code").isin("2FGM", "2FGA", "3FGM", "3FGA", "FTM", "FTA"))
    shots = shots.withColumn("number", F.row_number().over(Window.partitionBy("game_id").orderBy("seq")))
    passer = acts.where("action_code = 'AS'").select(F.col("action_id").alias("assist_id"), F.col("player_id").alias("passer_id"))
    named = shots.join(passer, "assist_id", "left").join(names, "player_id", "left").withColumnRenamed("name", "shooter")
    named = named.join(names.select(F.col("player_id").alias("passer_id"), F.col("name").alias("passer")), "passer_id", "left")
    side = F.when(F.col("team_id") == F.col("home_team"), "home").when(F.col("team_id") == F.col("road_team"), "road").otherwise("neutral")
    return named.select("game_id", "number", "action_id", "period", "clock", side.alias("side"), "shooter", "passer", F.col("action_code").endswith("M").alias("is_made"), F.col("action_code").startswith("3").alias("is_three"), "shot_zone", "coord_x", "coord_y", "is_fast_break", "is_second_chance", "is_from_turnover")
