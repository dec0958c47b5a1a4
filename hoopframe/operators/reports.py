"""Reports over actions: leaders, shares, rankings and the competency questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import game_label, game_stage, height_cm, is_made, period_order
from . import scope


def distinct_then_aggregate(rows: DataFrame, keys: list[str], aggs: dict[str, Column], order: str | None = None, n: int | None = None, value: str = "points") -> DataFrame:
    """Distinct (keys, action_id, value) first, so that joins that repeat actions don't count them twice, then the
    aggregates; the n best by order, ties by keys."""
    out = rows.select(*keys, "action_id", value).distinct().groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])
    if order:
        out = out.orderBy(F.desc(order), *keys)
    return out.limit(n) if n else out


def assist_duos(acts: DataFrame, n: int | None = 10) -> DataFrame:
    """Passer and scorer by points scored from the passer's assists."""
    a = acts.where("action_class = 'Assist'").select(F.col("action_id").alias("assist_id"), F.col("player_id").alias("passer"))
    rows = acts.where("points is not null").withColumnRenamed("player_id", "scorer").join(a, "assist_id")
    return distinct_then_aggregate(rows, ["passer", "scorer"], {"points": F.sum("points"), "assists": F.count("*")}, "points", n)


def points_by(acts: DataFrame, keys: list[str], where: Column | None = None, n: int | None = 10) -> DataFrame:
    rows = acts.where("points is not null")
    rows = rows.where(where) if where is not None else rows
    return distinct_then_aggregate(rows, keys, {"points": F.sum("points"), "scoring_actions": F.count("*")}, "points", n)


def second_chance_points(acts: DataFrame, n: int | None = 10) -> DataFrame:
    return points_by(acts, ["player_id"], scope.by_flag("second_chance"), n)


def fast_break_points(acts: DataFrame, n: int | None = 10) -> DataFrame:
    return points_by(acts, ["player_id"], scope.by_flag("fast_break"), n)


def points_off_turnovers(acts: DataFrame) -> DataFrame:
    """By the scoring action's own team."""
    return points_by(acts, ["team_id"], scope.by_flag("from_turnover"), None)


def scorers(acts: DataFrame, n: int | None = 20) -> DataFrame:
    """The n players of the most points, in that order; with None all that scored, in no order."""
    scored = scope.positive_only(points_by(acts, ["player_id"], None, None), "points")
    return scored if n is None else scored.orderBy(F.desc("points"), "player_id").limit(n)


def clutch_performers(acts: DataFrame, n: int | None = 10) -> DataFrame:
    return points_by(acts, ["player_id"], scope.clutch(), n)


def linked_counts(acts: DataFrame, cls: str, link: str, n: int | None = 10) -> DataFrame:
    """Who is at the far end of a link, and how often: (player_id, other, n). Actions without the link count with a null other."""
    other = acts.select(F.col("action_id").alias(link), F.col("player_id").alias("other"))
    rows = acts.where(F.col("action_class").rlike(cls)).join(other, link, "left")
    return distinct_then_aggregate(rows, ["player_id", "other"], {"n": F.count("*")}, "n", n, value="points")


def fouls_drawn(acts: DataFrame, n: int | None = 10) -> DataFrame:
    """Players by fouls drawn, with who fouled them where that is known."""
    return linked_counts(acts, "^FoulDrawn$", "fouled_by", n)


def blocks(acts: DataFrame, n: int | None = 10) -> DataFrame:
    """(blocker, shooter, n): shots blocked; shooter is null for a block without its shot."""
    shots = acts.where("blocked_by is not null").select(F.col("blocked_by").alias("action_id"), F.col("player_id").alias("shooter"))
    rows = acts.where("action_class = 'Block'").select("action_id", F.col("player_id").alias("blocker"), "points").join(shots, "action_id", "left")
    return distinct_then_aggregate(rows, ["blocker", "shooter"], {"n": F.count("*")}, "n", n)


def shooting_percentage(acts: DataFrame, keys: list[str], kind: str = "PointShot", at_least: int = 0) -> DataFrame:
    """Makes, attempts and percentage of distinct shots of the kind, groups with at_least attempts."""
    shots = acts.where(F.col("action_class").rlike(kind)).select(*keys, "action_id", is_made("action_class").alias("made")).distinct()
    out = shots.groupBy(*keys).agg(F.count_if("made").alias("makes"), F.count("*").alias("attempts")).where(F.col("attempts") >= at_least)
    return out.withColumn("percentage", F.round(100.0 * F.col("makes") / F.col("attempts"), 2))


def collapse_multivalued(attrs: DataFrame) -> DataFrame:
    """One row per player of player_attrs(player_id, attr, value): least label and image, distinct positions joined."""
    def least(attr: str) -> Column:
        return F.min(F.when(F.col("attr") == attr, F.col("value"))).alias(attr)

    positions = F.array_join(F.array_sort(F.collect_set(F.when(F.col("attr") == "position", F.col("value")))), " / ")
    return attrs.groupBy("player_id").agg(least("label"), least("image"), positions.alias("position"))


def count_distinct(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("n"))


def dataset_totals(acts: DataFrame) -> DataFrame:
    return acts.agg(F.count_distinct("game_id").alias("games"), F.count_distinct("action_id").alias("actions"), F.count_distinct("player_id").alias("players"), F.count_distinct("team_id").alias("teams"))


def dataset_statistics(acts: DataFrame) -> DataFrame:
    """(level, key, n_actions): distinct actions by season, by class and by game, in one pass over the table."""
    sets = acts.groupingSets([["season_code"], ["action_class"], ["game_id"]], "season_code", "action_class", "game_id")
    rows = sets.agg(F.count_distinct("action_id").alias("n_actions"), F.grouping("season_code").alias("s"), F.grouping("action_class").alias("c"))
    level = F.when(F.col("s") == 0, "season").when(F.col("c") == 0, "class").otherwise("game")
    return rows.select(level.alias("level"), F.coalesce("season_code", "action_class", "game_id").alias("key"), "n_actions")


def with_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with the group's total beside each row."""
    return df.withColumn("total", F.sum(value).over(Window.partitionBy(*keys)))


def summary_by_class(acts: DataFrame) -> DataFrame:
    return acts.groupBy("action_class").agg(F.count("*").alias("n"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"))


def summary_by_period(acts: DataFrame) -> DataFrame:
    return acts.groupBy("period").agg(F.count("*").alias("n"), F.coalesce(F.sum("points"), F.lit(0)).alias("points")).withColumn("place", period_order("period")).orderBy("place")


def shot_summary(acts: DataFrame) -> DataFrame:
    """Shots, makes, shots with a location and the percentage made."""
    shots = acts.where(scope.by_kind("shots"))
    out = shots.agg(F.count("*").alias("shots"), F.count_if(is_made("action_class")).alias("made"), F.count_if(~((F.col("coord_x") == -1) & (F.col("coord_y") == -1))).alias("mapped"))
    return out.withColumn("percentage", F.round(100.0 * F.col("made") / F.nullif("shots", F.lit(0)), 2))


def available_periods(*frames: DataFrame) -> DataFrame:
    rows = frames[0].select("period")
    for f in frames[1:]:
        rows = rows.unionByName(f.select("period"))
    return rows.distinct().withColumn("place", period_order("period")).orderBy("place")


def team_logos(teams: DataFrame) -> DataFrame:
    """One label and logo per team: the least of each."""
    return teams.groupBy("team_id").agg(F.min("label").alias("label"), F.min("image").alias("image"))


def game_list(games: DataFrame, n: int | None = None) -> DataFrame:
    """Games with stage and label, latest code first."""
    stage = game_stage("phase", "phase_group")
    out = games.select("game_id", "season_code", "game_code", "home_score", "road_score", stage.alias("stage"), game_label("game_code", stage, F.lit(None).cast("string"), F.concat_ws(" v ", "home_team", "road_team")).alias("label"))
    out = out.orderBy("season_code", F.desc(F.col("game_code").cast("int")), "game_id")
    return out.limit(n) if n else out


def play_by_play(acts: DataFrame, game_id: str, linked: bool = True) -> DataFrame:
    """A game's actions in order, with the players at the other end of their links."""
    a = acts.where(F.col("game_id") == game_id)
    for link in [c for c in ("assist_id", "blocked_by") if linked and c in a.columns]:
        a = a.join(acts.select(F.col("action_id").alias(link), F.col("player_id").alias(f"{link}_player")), link, "left")
    return a.orderBy(F.coalesce("seq", F.lit(9999)), "action_id")


def play_order(acts: DataFrame) -> DataFrame:
    """acts with place, its number in the game's order of play.

    Periods come in order, and in a period actions with a sequence number
    above 0 by that. One without is placed by its clock: before the earliest
    numbered action that has less time left or, at the same clock, a larger
    id; several of one such place by clock from high to low, then id.
    """
    numbered = F.col("seq") > 0
    clock, ident = F.coalesce("seconds_remaining", F.lit(-1)), F.col("action_id")
    a = acts.withColumns({"_period": period_order("period"), "_clock": clock})
    later = Window.partitionBy("game_id", "_period").orderBy(F.desc("_clock"), ident).rowsBetween(1, Window.unboundedFollowing)
    a = a.withColumn("_slot", F.when(numbered, F.col("seq")).otherwise(F.min(F.when(numbered, F.col("seq"))).over(later)))
    order = Window.partitionBy("game_id").orderBy("_period", F.asc_nulls_last("_slot"), F.coalesce(numbered, F.lit(False)), F.desc("_clock"), ident)
    return a.withColumn("place", F.row_number().over(order)).drop("_period", "_clock", "_slot")


def capped(df: DataFrame, rows: int = 200) -> DataFrame:
    """At most so many rows of a result, whatever its own limit."""
    return df.limit(rows)


def shots_with_candidates(acts: DataFrame, profiles: DataFrame, n: int = 500) -> DataFrame:
    """The first n shots by id, chosen before the profile join."""
    ids = acts.where(scope.by_kind("shots")).orderBy(F.col("action_id").cast("long")).limit(n)
    return ids.join(profiles.select("player_id", "name"), "player_id", "left").select("action_id", "game_id", "player_id", "name", "action_class", "shot_zone")


def aggregate_then_label(acts: DataFrame, players: DataFrame) -> DataFrame:
    """Points per player with the name joined after the aggregate."""
    return points_by(acts, ["player_id"], None, None).join(players.select("player_id", "name"), "player_id", "left")


def first_available_name(participations: DataFrame, players: DataFrame) -> DataFrame:
    return participations.join(players.select("player_id", "name"), "player_id", "left").select("game_id", "player_id", F.coalesce("name", "jersey_name").alias("name"))


def game_roster(box: DataFrame, participations: DataFrame, attrs: DataFrame) -> DataFrame:
    """(game_id, side, team_id, player_id, name, image, position, is_starter): each player of box(game_id, side, team_id,
    player_id, is_starter) that took part, with the least label and image and all positions; the jersey's name where no label is known."""
    took = participations.groupBy("game_id", "team_id", "player_id").agg(F.min("jersey_name").alias("jersey_name"))
    rows = box.distinct().join(took, ["game_id", "team_id", "player_id"]).join(collapse_multivalued(attrs), "player_id", "left")
    return rows.select("game_id", "side", "team_id", "player_id", F.coalesce("label", "jersey_name").alias("name"), "image", F.coalesce("position", F.lit("")).alias("position"), "is_starter")


# The competency questions.


def q1(acts: DataFrame, season: str) -> DataFrame:
    return points_by(scope.in_scope(acts, season).where(scope.in_period("4th") & scope.last_seconds(120)), ["player_id"], None, None)


def q2(acts: DataFrame) -> DataFrame:
    return count_distinct(acts.where(scope.in_period("4th") & (F.col("action_class") == "ThreePointShotMade")), ["team_id"], "action_id")


def q3(acts: DataFrame) -> DataFrame:
    return count_distinct(acts.where("action_class = 'ThreePointShotMade'"), ["period"], "action_id")


def q4(acts: DataFrame) -> DataFrame:
    return count_distinct(acts.where("action_class = 'Turnover'"), ["period"], "action_id")


def q5(sides: DataFrame, n: int = 20) -> DataFrame:
    """Fourth-period lineups by distinct games, over either_side rows."""
    rows = sides.where(scope.in_period("4th")).select("lineup_team", F.array_join("lineup", "_").alias("lineup"), "game_id")
    return count_distinct(rows, ["lineup_team", "lineup"], "game_id").orderBy(F.desc("n"), "lineup_team", "lineup").limit(n)


def q7(acts: DataFrame) -> DataFrame:
    return count_distinct(acts.where("action_class = 'ThreePointShotMade'"), ["team_id", "shot_zone"], "action_id")


def q8(acts: DataFrame, at_least: int = 30) -> DataFrame:
    return shooting_percentage(acts.where(F.col("shot_zone").isin("A", "B", "C")), ["player_id"], "TwoPointShot", at_least)


def q9(poss: DataFrame, finals: DataFrame) -> DataFrame:
    """Possessions, already those with an offensive rebound, of the final games."""
    return poss.join(finals.select("game_id"), "game_id", "left_semi")


def q10(poss: DataFrame) -> DataFrame:
    return count_distinct(poss.withColumn("p", F.struct("game_id", "possession_seq")), ["team_id"], "p")


def q13(acts: DataFrame, players: DataFrame, country: str) -> DataFrame:
    """Threes of the last minute at a margin under 5, by players of the country under 2.00 m."""
    p = players.where((F.col("country") == country) & (height_cm("height") < 200)).select("player_id")
    rows = acts.where((F.col("action_class") == "ThreePointShotMade") & scope.last_seconds(60) & (F.abs(F.col("home_score") - F.col("road_score")) < 5))
    return rows.join(p, "player_id", "left_semi")


def q14(changes: DataFrame, players: DataFrame, born_after: str = "2000-12-31") -> DataFrame:
    """Lead changes of the last minute by players born after a day, over strict lead changes."""
    young = players.where(F.col("birth_date") > F.lit(born_after).cast("date")).select("player_id")
    return changes.where(scope.last_seconds(60)).join(young, "player_id", "left_semi")


def ranked(df: DataFrame, metric: str, key: str, groups: list[str] | None = None, cut: int = 5) -> DataFrame:
    """df with rank (ties by key), and tie_at_cut: whether the row at the cut equals the next one."""
    order = Window.partitionBy(*(groups or [])).orderBy(F.desc(metric), key)
    out = df.withColumns({"rank": F.row_number().over(order), "_next": F.lead(metric).over(order)})
    tie = F.max(F.when(F.col("rank") == cut, F.col(metric).eqNullSafe(F.col("_next")))).over(Window.partitionBy(*(groups or [])))
    return out.withColumn("tie_at_cut", F.coalesce(tie, F.lit(False))).drop("_next")


def first_made_three(acts: DataFrame) -> DataFrame:
    """Of each game the first made three, its player and its assist."""
    rows = acts.where("action_class = 'ThreePointShotMade'")
    return rows.groupBy("game_id").agg(F.min_by(F.struct("action_id", "player_id", "assist_id"), "seq").alias("f")).select("game_id", "f.*")


def page(df: DataFrame, order: list[Column | str], start: int, size: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(size)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that only key and seed decide."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def evidence(df: DataFrame, order: list[str], rows: int = 15, columns: int = 16, chars: int = 2500) -> DataFrame:
    """The first rows and columns as text cut to chars, with the number of all rows and whether some are missing."""
    total = df.count()
    cut = [F.substring(F.col(c).cast("string"), 1, chars).alias(c) for c in df.columns[:columns]]
    return df.orderBy(*order).limit(rows).select(*cut).withColumns({"total_rows": F.lit(total), "sampled": F.lit(total > rows)})
