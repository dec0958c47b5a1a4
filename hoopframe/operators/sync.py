"""Actions and clock observations of a video: nearest and backward matches in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import max_period_seconds, normalize_period

TOLERANCE = 5.0
START_TOLERANCE = 12.0


def first_per_clock(observations: DataFrame) -> DataFrame:
    """The first observation, by video time, of every clock of a game's period."""
    keys = ["game_id", "period", "clock_seconds"]
    rows = observations.withColumn("period", normalize_period("period"))
    return rows.groupBy(*keys).agg(F.min("video_time").alias("video_time"))


def sync_rule(acts: DataFrame) -> DataFrame:
    """acts with sync_seconds and tolerance: an assist follows the score that names it if that is within 5 seconds in the
    same period; period starts and substitutions at full clock and a jump ball in the first second may be farther from an observation."""
    score = acts.where("assist_id is not null and action_code in ('2FGM', '3FGM', 'FTM')")
    anchor = score.groupBy("game_id", normalize_period("period").alias("_p"), F.col("assist_id").alias("action_id")).agg(F.max_by("seconds_remaining", "seq").alias("_score"))
    a = acts.withColumn("_p", normalize_period("period")).join(anchor, ["game_id", "_p", "action_id"], "left")
    near = F.abs(F.col("_score") - F.col("seconds_remaining")) <= 5
    full = F.coalesce(max_period_seconds("period"), F.lit(300))
    start = F.col("action_code").isin("BP", "IN", "OUT") & (F.abs(F.col("seconds_remaining") - full) < 0.001)
    jump = (F.col("action_code") == "JB") & (full - F.col("seconds_remaining")).between(0, 1)
    return a.withColumns({"sync_seconds": F.when(near, F.col("_score")).otherwise(F.col("seconds_remaining")).cast("double"), "tolerance": F.when(start | jump, START_TOLERANCE).otherwise(TOLERANCE)}).drop("_p", "_score")


def nearest_observation(acts: DataFrame, observations: DataFrame, tolerance: float | Column = TOLERANCE, clock: str = "seconds_remaining") -> DataFrame:
    """acts with obs_clock, video_time and difference of the nearest observation by clock in the game's period.

    Both sides are put in clock order once; the last observation below and the
    first above an action are its candidates, so no action meets more than two.
    Ties take the larger clock. Beyond the tolerance video_time is null and
    the difference stays.
    """
    obs = first_per_clock(observations).select("game_id", F.col("period").alias("_p"), F.col("clock_seconds").alias("_c"), F.struct("clock_seconds", "video_time").alias("_o"))
    a = acts.withColumns({"_p": normalize_period("period"), "_c": F.col(clock).cast("double")})
    rows = a.select("game_id", "_p", "_c", F.struct(*acts.columns, (tolerance if isinstance(tolerance, Column) else F.lit(tolerance)).alias("_tol")).alias("_a")).unionByName(obs, allowMissingColumns=True)
    order = Window.partitionBy("game_id", "_p").orderBy("_c").rangeBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("game_id", "_p").orderBy(F.desc("_c")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_lo": F.last("_o", ignorenulls=True).over(order), "_hi": F.last("_o", ignorenulls=True).over(back)}).where("_a is not null")
    low, high = F.col("_c") - F.col("_lo.clock_seconds"), F.col("_hi.clock_seconds") - F.col("_c")
    best = F.when(F.col("_lo").isNull() | (high <= low), F.col("_hi")).otherwise(F.col("_lo"))
    rows = rows.select("_a.*", best.alias("_b"), F.abs(best["clock_seconds"] - F.col("_c")).alias("difference"))
    fits = F.col("difference") <= F.col("_tol")
    return rows.select(*acts.columns, F.when(fits, F.col("_b.clock_seconds")).alias("obs_clock"), F.when(fits, F.col("_b.video_time")).alias("video_time"), "difference")


def current_action(times: DataFrame, placed: DataFrame, within: float = 12.0) -> DataFrame:
    """times(game_id, video_time) with the latest action of placed(game_id, video_time, action_id) at or before it and under within seconds old."""
    rows = placed.select("game_id", "video_time", F.struct(F.col("video_time").alias("at"), "action_id").alias("_x"), F.lit(0).alias("_t"))
    rows = rows.unionByName(times.select("game_id", "video_time", F.lit(1).alias("_t")), allowMissingColumns=True)
    w = Window.partitionBy("game_id").orderBy("video_time", "_t", "_x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_x", F.last("_x", ignorenulls=True).over(w)).where("_t = 1")
    return rows.select("game_id", "video_time", F.when(F.col("video_time") - F.col("_x.at") < within, F.col("_x.action_id")).alias("action_id"))
