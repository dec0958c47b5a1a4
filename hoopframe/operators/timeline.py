"""Cleaning and checking of clock timelines (game_id, video_time, period, clock_seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ["1st", "2nd", "3rd", "4th"]


def _runs(timeline: DataFrame) -> DataFrame:
    """With run: consecutive rows of one period in video order."""
    order = Window.partitionBy("game_id").orderBy("video_time")
    new = ~F.col("period").eqNullSafe(F.lag("period").over(order))
    return timeline.withColumn("run", F.sum(new.cast("int")).over(order))


def monotonic_timeline(timeline: DataFrame) -> DataFrame:
    """In each run of a period, readings that no later one exceeds; of equal clocks the latest, at 0.1 or less the first."""
    rows = _runs(timeline.where("clock_seconds is not null"))
    after = Window.partitionBy("game_id", "run").orderBy("video_time").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_later", F.max("clock_seconds").over(after)).where("_later is null or _later <= clock_seconds")
    end = F.col("clock_seconds") <= 0.1
    same = Window.partitionBy("game_id", "run", "clock_seconds").orderBy(F.when(end, F.col("video_time")).otherwise(-F.col("video_time")))
    return rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*[F.col(f"`{c}`") for c in timeline.columns])


def drop_impossible(timeline: DataFrame, grace: float = 5.0) -> DataFrame:
    """Drops readings whose clock fell by more than the video time since the last kept reading of the period, plus grace.

    What is kept depends on what was kept before, so a run of readings of one
    period is folded in order; the first of a run always stays.
    """
    columns = [F.col(f"`{c}`") for c in timeline.columns]
    runs = _runs(timeline).groupBy("game_id", "run").agg(F.array_sort(F.collect_list(F.struct("video_time", F.col("clock_seconds").alias("clock"), F.struct(*columns).alias("row")))).alias("rows"))

    def step(state: Column, row: Column) -> Column:
        last = state["last"]
        ok = last.isNull() | F.coalesce(last["clock"] - row["clock"] <= row["video_time"] - last["video_time"] + grace, F.lit(False))
        return F.struct(F.when(ok, row).otherwise(last).alias("last"), F.when(ok, F.array_append(state["kept"], row)).otherwise(state["kept"]).alias("kept"))

    kind = runs.schema["rows"].dataType
    start = F.struct(F.lit(None).cast(kind.elementType).alias("last"), F.array().cast(kind).alias("kept"))
    kept = runs.select(F.inline(F.transform(F.aggregate("rows", start, step, lambda state: state["kept"]), lambda x: x["row"])))
    return kept.select(*columns)


def repair_timeline(timeline: DataFrame) -> DataFrame:
    return drop_impossible(monotonic_timeline(timeline))


def removed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(game_id, removed)."""
    n, m = before.groupBy("game_id").agg(F.count("*").alias("n")), after.groupBy("game_id").agg(F.count("*").alias("m"))
    return n.join(m, "game_id", "left").select("game_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("removed"))


def check_timelines(timeline: DataFrame, min_rows: int = 1200, late_start: float = 15.0, early_end: float = 5.0, gap: float = 10.0) -> DataFrame:
    """(game_id, period, level, problem): one row per problem; period is null for those of a whole game."""
    order = Window.partitionBy("game_id").orderBy("video_time", "clock_seconds")
    own = Window.partitionBy("game_id", "period").orderBy("video_time", "clock_seconds")
    rows = timeline.withColumns({"_t": F.col("video_time") - F.lag("video_time").over(order), "_dt": F.col("video_time") - F.lag("video_time").over(own), "_drop": F.lag("clock_seconds").over(own) - F.col("clock_seconds")})
    length = F.when(F.col("period").isin(REQUIRED), 600).otherwise(300)
    per = rows.groupBy("game_id", "period").agg(
        F.min_by("clock_seconds", "video_time").alias("first"), F.max_by("clock_seconds", "video_time").alias("last"), F.max("clock_seconds").alias("most"), F.max("_drop").alias("gap"),
        F.count_if(F.col("_drop") < 0).alias("rises"), F.count_if(F.col("_drop") > F.col("_dt") + 5).alias("fast"),
    ).withColumn("length", length)
    early, late = F.col("length") - F.col("first"), F.col("last")
    problems = F.array_compact(F.array(
        F.when(F.col("most") > F.col("length") + 1, F.lit("error:clock exceeds the period")),
        F.when(early > 60, F.lit("error:starts too late")).when(early > late_start, F.lit("warning:starts late")),
        F.when(late > 15, F.lit("error:ends too early")).when(late > early_end, F.lit("warning:ends early")),
        F.when(F.col("rises") > 0, F.lit("error:not monotonic")),
        F.when(F.col("gap") > gap, F.lit("warning:coverage gap")),
        F.when(F.col("fast") > 0, F.lit("error:drops faster than video")),
    ))
    found = per.select("game_id", "period", F.explode(problems).alias("p"))
    whole = rows.groupBy("game_id").agg(F.count("*").alias("n"), F.count_if(F.col("_t") <= 0).alias("stuck"), F.collect_set("period").alias("periods"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED)), "periods"), lambda p: F.concat(F.lit("error:missing "), p))
    own_problems = F.concat(missing, F.array_compact(F.array(F.when(F.col("n") < min_rows, F.lit("error:too few rows")), F.when(F.col("stuck") > 0, F.lit("error:video time not increasing")))))
    found = found.unionByName(whole.select("game_id", F.lit(None).cast("string").alias("period"), F.explode(own_problems).alias("p")))
    return found.select("game_id", "period", F.substring_index("p", ":", 1).alias("level"), F.substring_index("p", ":", -1).alias("problem"))


def completeness(timeline: DataFrame, late_start: float = 60.0, early_end: float = 15.0) -> DataFrame:
    """(game_id, period, problem) of the required periods: missing, starts too late, ends too early."""
    games = timeline.select("game_id").distinct().select("game_id", F.explode(F.array(*map(F.lit, REQUIRED))).alias("period"))
    per = timeline.groupBy("game_id", "period").agg(F.min_by("clock_seconds", "video_time").alias("first"), F.max_by("clock_seconds", "video_time").alias("last"))
    p = games.join(per, ["game_id", "period"], "left")
    problems = F.array_compact(F.array(F.when(F.col("first").isNull(), F.lit("missing")), F.when(F.col("first") < 600 - late_start, F.lit("starts too late")), F.when(F.col("last") > early_end, F.lit("ends too early"))))
    return p.select("game_id", "period", F.explode(problems).alias("problem"))
