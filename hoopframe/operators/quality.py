"""Checks of generated tables, and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clock_seconds, max_period_seconds


def check_actions(acts: DataFrame, examples: int = 10) -> DataFrame:
    """(game_id, problem, n, examples): sequences that aren't 1..n, repeated or missing ids, unknown periods, clocks out
    of range or unequal to the seconds; the first ids of each."""
    w = Window.partitionBy("game_id")
    a = acts.withColumns({"_place": F.row_number().over(w.orderBy("seq", "action_id")), "_same": F.count("*").over(Window.partitionBy("game_id", "original_event_id"))})
    most = max_period_seconds("period")
    problems = F.array_compact(F.array(
        F.when(~F.col("seq").eqNullSafe(F.col("_place")), F.lit("sequence")),
        F.when((F.col("_same") > 1) | F.col("original_event_id").isNull(), F.lit("event id")),
        F.when(most.isNull(), F.lit("period")),
        F.when(~F.coalesce(F.col("seconds_remaining").between(0, most), F.lit(False)), F.lit("seconds")),
        F.when(~clock_seconds("clock").eqNullSafe(F.col("seconds_remaining").cast("double")), F.lit("clock")),
    ))
    rows = a.select("game_id", "seq", "action_id", F.explode(problems).alias("problem"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("game_id", "problem").orderBy("seq", "action_id")))
    shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.col("action_id"))))
    return rows.groupBy("game_id", "problem").agg(F.count("*").alias("n"), F.array_join(shown, ",").alias("examples"))


def dangling_references(poss: DataFrame, acts: DataFrame) -> DataFrame:
    """(game_id, possession_seq, original_event_id) that possessions name and actions lack."""
    named = F.array_compact(F.array_union("contains_action", F.array("starts_after", "ends_with")))
    refs = poss.select("game_id", "possession_seq", F.explode(named).alias("original_event_id"))
    return refs.join(acts.select("game_id", "original_event_id"), ["game_id", "original_event_id"], "left_anti")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n): rows beyond the first of each distinct row."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with side and how often they are missing on the other side, as a multiset."""
    keys = left.columns
    both = left.withColumn("_d", F.lit(1)).unionByName(right.select(*keys).withColumn("_d", F.lit(-1))).groupBy(*keys).agg(F.sum("_d").alias("d")).where("d != 0")
    return both.select(*keys, F.when(F.col("d") > 0, "missing").otherwise("unexpected").alias("side"), F.abs("d").alias("n"))


def source_equals_processed(source: DataFrame, processed: DataFrame) -> DataFrame:
    """(game_id, missing, unexpected, in_order): codes of the source feed against those of the actions, in order.

    Both have game_id, seq, action_code; the source's AG rows don't count.
    """
    order = Window.partitionBy("game_id").orderBy("seq")
    s = source.where("action_code <> 'AG'").select("game_id", "action_code", F.row_number().over(order).alias("place"))
    p = processed.select("game_id", "action_code", F.row_number().over(order).alias("place"))
    diff = multiset_difference(s.select("game_id", "action_code"), p.select("game_id", "action_code")).groupBy("game_id").agg(F.coalesce(F.sum(F.when(F.col("side") == "missing", F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("side") != "missing", F.col("n"))), F.lit(0)).alias("unexpected"))
    both = s.withColumnRenamed("action_code", "a").join(p.withColumnRenamed("action_code", "b"), ["game_id", "place"], "full")
    same = both.groupBy("game_id").agg(F.min(F.col("a").eqNullSafe(F.col("b"))).alias("in_order"))
    return same.join(diff, "game_id", "left").select("game_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("unexpected", F.lit(0)).alias("unexpected"), "in_order")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys on one side only, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def matched_only(df: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return df.join(matches.select(key), key, "left_semi")
