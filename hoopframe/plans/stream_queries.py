"""Registered queries of the streaming operators, as batches over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import period_order
from ..streaming import live, tracker
from . import views
from .queries import register


def readings(acts: DataFrame) -> DataFrame:
    """What a broadcast shows around each action: its clock and the two seconds before and after it, each period 720 seconds of
    video, with look-alike letters, cut texts and doubtful readings by the action's number."""
    shown = acts.select("game_id", "original_event_id", period_order("period").alias("p"), "seconds_remaining").repartition("game_id")  # the only shuffle on the way to the tracker
    shown = shown.select("*", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("s"))
    # of the readings of a second that of the first action stays, and is written then
    kept = shown.withColumn("left", F.col("seconds_remaining") - F.col("s")).where("left between 0 and 600").groupBy("game_id", "p", "left")
    kept = kept.agg(F.min_by("s", "original_event_id").alias("s"), F.min("original_event_id").alias("original_event_id"))
    h = F.pmod(F.col("original_event_id") * 31 + F.col("s") * 7, F.lit(100))
    clock = F.format_string("%d:%02d", (F.col("left") / 60).cast("int"), F.col("left") % 60)
    text = F.when(h < 3, F.lit("4:4")).when(h < 8, F.translate(clock, "05", "OS")).otherwise(clock)
    time = (F.col("p") - 1) * 720 + 600 - F.col("left")
    return kept.withColumn("h", h).select("game_id", time.cast("double").alias("video_time"), text.alias("text"), F.when(F.col("h") > 95, 0.1).otherwise(0.9).alias("confidence"))


@register("clock_tracker")
def _tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.track_batch(readings(views.actions(spark, sf_dir)))


@register("clock_tracker_resolved")
def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.resolve_retractions(tracker.track_batch(readings(views.actions(spark, sf_dir))))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("windowed_counts", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.windowed_counts(_events(spark, sf_dir), "event_type", "6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register(
    "session_counts",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.session_counts(_events(spark, sf_dir), "user_id", "6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
