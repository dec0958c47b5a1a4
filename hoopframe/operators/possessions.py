"""Possessions: runs of actions under one team's control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUNDARIES = ["PeriodStart", "PeriodEnd", "GameEnd"]
# Classes that show which team has the ball.
CONTROL = [
    "TwoPointShotMade",
    "TwoPointShotMissed",
    "ThreePointShotMade",
    "ThreePointShotMissed",
    "FreeThrowMade",
    "FreeThrowMissed",
    "Turnover",
    "OffensiveRebound",
    "OffensiveFoul",
    "Assist",
    "FoulDrawn",
    "DefensiveRebound",
    "Steal",
]


def possessions(acts: DataFrame) -> DataFrame:
    """(game_id, possession_seq, team_id, starts_after, ends_with, contains_action).

    Period boundaries cut a game into segments and belong to none. A control
    action of another team than the last one's of the segment starts a new
    possession; everything else joins the current one; actions before the
    first control action of a segment belong to none. starts_after is the
    event before the possession's first, ends_with its last. Members are the
    original event ids in order.
    """
    game = Window.partitionBy("game_id").orderBy("seq")
    boundary = F.col("action_class").isin(BOUNDARIES)
    control = F.col("action_class").isin(CONTROL) & F.col("team_id").isNotNull() & ~boundary
    a = acts.select("game_id", "seq", "team_id", "original_event_id", boundary.alias("boundary"), control.alias("control"), F.lag("original_event_id").over(game).alias("previous"))
    a = a.withColumn("segment", F.sum(F.col("boundary").cast("int")).over(game)).where("not boundary")
    segment = Window.partitionBy("game_id", "segment").orderBy("seq")
    holder = F.last(F.when(F.col("control"), F.col("team_id")), ignorenulls=True).over(segment.rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("starts", F.col("control") & ~F.col("team_id").eqNullSafe(holder))
    a = a.withColumn("run", F.sum(F.col("starts").cast("int")).over(segment)).where("run > 0")
    member = F.struct("seq", "original_event_id")
    rows = a.groupBy("game_id", "segment", "run").agg(
        F.min_by("team_id", "seq").alias("team_id"), F.min_by("previous", "seq").alias("starts_after"), F.max_by("original_event_id", "seq").alias("ends_with"), F.array_sort(F.collect_list(member)).alias("m"), F.min("seq").alias("first")
    )
    number = F.row_number().over(Window.partitionBy("game_id").orderBy("first"))
    return rows.select("game_id", number.alias("possession_seq"), "team_id", "starts_after", "ends_with", F.col("m.original_event_id").alias("contains_action"))


def possession_actions(poss: DataFrame) -> DataFrame:
    return poss.select("game_id", "possession_seq", "team_id", F.explode("contains_action").alias("original_event_id"))


def possessions_with(poss: DataFrame, acts: DataFrame, cls: str) -> DataFrame:
    """Possessions that hold an action of the class."""
    hit = possession_actions(poss).join(acts.where(F.col("action_class") == cls).select("game_id", "original_event_id"), ["game_id", "original_event_id"], "left_semi")
    return poss.join(hit.select("game_id", "possession_seq").distinct(), ["game_id", "possession_seq"], "left_semi")
