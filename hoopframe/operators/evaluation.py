"""Scores of results against ground truth, and summaries of run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ["0-1", "1-2", "2-5", "5-10", "10-30", ">30", "unmapped"]


def score_sync(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth(game_id, action_id, category, truth_seconds) with predicted_seconds and error, both null where the action has no
    time. A truth whose action isn't among predicted is an error when the rows are read."""
    p = predicted.select("game_id", "action_id", F.struct(F.col("video_time").alias("at")).alias("_p"))
    rows = truth.join(p, ["game_id", "action_id"], "left")
    lost = F.raise_error(F.concat(F.lit("no action for the ground truth "), F.coalesce(F.col("game_id"), F.lit("?")), F.lit(" "), F.coalesce(F.col("action_id"), F.lit("?"))))
    at = F.when(F.col("_p").isNull(), lost.cast("double")).otherwise(F.col("_p.at"))
    return rows.withColumn("predicted_seconds", at).drop("_p").withColumn("error", F.abs(F.col("predicted_seconds") - F.col("truth_seconds")))


def _metrics() -> list[Column]:
    total, mapped = F.count("*"), F.count("error")
    share = [F.round(100.0 * F.count_if(F.col("error") <= s) / total, 4).alias(f"within_{s}s") for s in (1, 2, 5)]
    return [total.alias("total"), mapped.alias("mapped"), F.round(100.0 * (total - mapped) / total, 4).alias("unmapped_pct"), F.round(F.avg("error"), 6).alias("mae"), F.median("error").alias("median_error"), *share]


def sync_metrics(scored: DataFrame) -> DataFrame:
    """One row: shares are of all rows, errors of the mapped ones."""
    return scored.agg(*_metrics())


def sync_metrics_by_level(scored: DataFrame) -> DataFrame:
    """(level, key, metrics): overall, by category and by game in one pass."""
    sets = scored.groupingSets([[], ["category"], ["game_id"]], "category", "game_id")
    rows = sets.agg(*_metrics(), F.grouping("category").alias("_c"), F.grouping("game_id").alias("_g"))
    level = F.when(F.col("_c") == 0, "category").when(F.col("_g") == 0, "game").otherwise("overall")
    return rows.select(level.alias("level"), F.coalesce("category", "game_id", F.lit("all")).alias("key"), *[c for c in rows.columns if c not in ("category", "game_id", "_c", "_g")])


def macro_average(levels: DataFrame) -> DataFrame:
    """Mean over the games of their metrics."""
    return levels.where("level = 'game'").agg(F.count("*").alias("games"), F.round(F.avg("mae"), 6).alias("mae"), F.round(F.avg("within_5s"), 4).alias("within_5s"))


def error_band(error: Column) -> Column:
    out = F.when(error.isNull(), "unmapped")
    for top, name in zip((1, 2, 5, 10, 30), BANDS):
        out = out.when(error <= top, name)
    return out.otherwise(">30")


def error_bands(scored: DataFrame) -> DataFrame:
    """(band, n, share) with all bands, empty ones too."""
    n = scored.groupBy(error_band(F.col("error")).alias("band")).agg(F.count("*").alias("n"))
    bands = scored.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, BANDS))).alias("place", "band"))
    rows = bands.join(n, "band", "left").select("place", "band", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("share", F.round(100.0 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), 4))


def coverage(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Actions, linked ones and the share without a link."""
    out = matched.groupBy(*keys).agg(F.count("*").alias("actions"), F.count("video_time").alias("linked"))
    return out.withColumn("unmapped_pct", F.round(100.0 * (F.col("actions") - F.col("linked")) / F.col("actions"), 4))


def timing_summary(log: DataFrame, keys: list[str], value: str = "elapsed_ms", ok: str = "success") -> DataFrame:
    """Runs and successes, and over the successes mean, median, least, most and sample deviation."""
    v = F.when(F.col(ok), F.col(value))
    return log.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(F.col(ok)).alias("successes"), F.round(F.avg(v), 4).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.stddev_samp(v), 4).alias("deviation"))


def run_scorecard(log: DataFrame) -> DataFrame:
    """By provider, model and prompt: runs, completed, safe, scoped, overlay as expected, correct, tokens, cost, latency."""
    def yes(c: str) -> Column:
        return F.count_if(F.lower(F.trim(F.col(c))).isin("yes", "y", "true", "1")).alias(c)

    return log.groupBy("provider", "model", "prompt_variant").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if("query_is_read_only").alias("safe"), F.count_if("query_contains_selected_scope").alias("scoped"),
        F.count_if("playbyplay_filter_matches_expectation").alias("overlay"), yes("query_correct_human"), yes("result_correct_human"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("mean_latency_ms"),
    )


def same_results(result: DataFrame, reference: DataFrame, keys: list[str], id_col: str, total_col: str) -> DataFrame:
    """(keys, same_ids, same_total): equal sets of ids, and totals within 1e-4, per key."""
    def side(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_set(id_col)).alias(f"ids_{n}"), F.sum(total_col).alias(f"total_{n}"))

    both = side(result, "a").join(side(reference, "b"), keys, "full")
    return both.select(*keys, F.col("ids_a").eqNullSafe(F.col("ids_b")).alias("same_ids"), F.coalesce(F.abs(F.col("total_a") - F.col("total_b")) <= 1e-4, F.lit(False)).alias("same_total"))


TOLERANCE = 1e-4


def _close(value: Column, expected: Column) -> Column:
    """Whether a text is a number within TOLERANCE, or a billionth, of what is expected."""
    number = value.try_cast("double")
    return F.coalesce(F.abs(number - expected) <= F.greatest(F.lit(TOLERANCE), 1e-9 * F.greatest(F.abs(number), F.abs(expected))), F.lit(False))


def matches_row(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, matches): whether a question has one row of results, and that row every expected value.

    results(question_id, row, field, value): the rows as fields of text; a
    row without fields has a null field. expected(question_id, field, text,
    number, members): of each field one of a text that is equal, a number, or
    the members that a comma-separated value lists, each once and in any order.
    An absent field is an empty text. Sets are compared by digests of their
    sorted members.
    """
    rows = results.groupBy("question_id").agg(F.count_distinct("row").alias("rows"))
    held = results.where("field is not null").groupBy("question_id", "field").agg(F.min("value").alias("value"))
    both = expected.join(held, ["question_id", "field"], "left").withColumn("value", F.coalesce("value", F.lit("")))
    listed = F.transform(F.split("value", ","), lambda x: F.trim(x))

    def digest(members: Column) -> Column:
        return F.xxhash64(F.array_sort(F.array_distinct(members)))

    same_set = (F.size(listed) == F.size(F.array_distinct(listed))) & (digest(listed) == digest(F.col("members"))) & (F.size(listed) == F.size(F.array_distinct("members")))
    ok = F.when(F.col("members").isNotNull(), same_set).when(F.col("number").isNotNull(), _close(F.col("value"), F.col("number"))).otherwise(F.col("value") == F.col("text"))
    judged = both.groupBy("question_id").agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok"))
    return judged.join(rows, "question_id", "left").select("question_id", (F.col("ok") & (F.coalesce("rows", F.lit(0)) == 1)).alias("matches"))


def matches_ids(results: DataFrame, expected: DataFrame, totals: DataFrame) -> DataFrame:
    """(question_id, matches): whether the ids of results are those expected, and each of its rows has the expected totals.

    results(question_id, row, action_id, values map of text); expected
    (question_id, action_id); totals(question_id, field, number). A question
    with totals and no rows doesn't match.
    """
    sides = results.select("question_id", "action_id", F.lit(1).alias("side")).unionByName(expected.select("question_id", "action_id", F.lit(2).alias("side"))).where("action_id is not null")
    each = sides.groupBy("question_id", "action_id").agg(F.bit_or("side").alias("sides"))
    off = totals.join(results.select("question_id", "values"), "question_id", "left")
    off = off.where(~_close(F.try_element_at("values", F.col("field")), F.col("number")))
    bad = each.where("sides <> 3").select("question_id").unionByName(off.select("question_id")).distinct().withColumn("bad", F.lit(True))
    asked = expected.select("question_id").unionByName(totals.select("question_id")).distinct()
    return asked.join(bad, "question_id", "left").select("question_id", F.col("bad").isNull().alias("matches"))


def summarise_matches(requested: DataFrame, acts: DataFrame) -> DataFrame:
    """Distinct requested ids with their action's class, period and points, and matched."""
    a = acts.select("action_id", "action_class", "period", "points")
    return requested.select("action_id").distinct().join(a, "action_id", "left").withColumn("matched", F.col("action_class").isNotNull())
