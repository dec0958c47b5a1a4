import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hoopframe.functions.columns import clock_seconds
from hoopframe.operators import evaluation, quality, sync, timeline
from hoopframe.streaming import tracker


def frame(spark, rows, period):
    df = spark.createDataFrame([("g", float(t), period, x) for t, x in rows], "game_id string, video_time double, period string, clock string")
    return df.withColumn("clock_seconds", clock_seconds("clock")).drop("clock")


def times(df):
    return sorted(r.video_time for r in df.collect())


def test_clean_up_cases(spark):
    rows = [(100, "7:14"), (101, "7:10"), (130, "7:13"), (131, "7:12"), (132, "7:12")]
    assert times(timeline.monotonic_timeline(frame(spark, rows, "1st"))) == [100, 130, 132]
    assert times(timeline.monotonic_timeline(frame(spark, [(9000, "0.0"), (9010, "0.0"), (9340, "0.0")], "4th"))) == [9000]
    assert times(timeline.drop_impossible(frame(spark, [(100, "5:50"), (101, "5:29"), (121, "5:28")], "2nd"))) == [100, 121]


def test_monotonic_equals_a_stack(spark):
    r = random.Random(2)
    rows = [("g%d" % (i % 3), float(i), r.choice(["1st", "1st", "1st", "2nd"]), float(r.randint(0, 30))) for i in range(400)]
    want = []
    for g in ("g0", "g1", "g2"):
        kept = []
        for row in (x for x in rows if x[0] == g):
            while kept and kept[-1][2] == row[2] and row[3] > kept[-1][3]:
                kept.pop()
            if kept and kept[-1][2] == row[2] and kept[-1][3] == row[3]:
                if row[3] > 0.1:
                    kept[-1] = row
                continue
            kept.append(row)
        want += kept
    df = spark.createDataFrame(rows, "game_id string, video_time double, period string, clock_seconds double")
    assert sorted(tuple(x) for x in timeline.monotonic_timeline(df).collect()) == sorted(want)


def test_nearest(spark):
    acts = spark.createDataFrame([("g", "1OT", 300), ("g", "OT", 280), ("g", "1st", 10)], "game_id string, period string, seconds_remaining int")
    obs = spark.createDataFrame([("g", "OT", 299.0, 7.0), ("g", "OT", 298.0, 8.0), ("g", "OT", 299.0, 9.0)], "game_id string, period string, clock_seconds double, video_time double")
    got = {r.seconds_remaining: (r.obs_clock, r.video_time, r.difference) for r in sync.nearest_observation(acts, obs).collect()}
    assert got == {300: (299.0, 7.0, 1.0), 280: (None, None, 18.0), 10: (None, None, None)}
    tie = spark.createDataFrame([("g", "OT", 3.0, 1.0), ("g", "OT", 5.0, 2.0)], "game_id string, period string, clock_seconds double, video_time double")
    assert sync.nearest_observation(acts.where("seconds_remaining = 10").selectExpr("game_id", "'OT' as period", "4 as seconds_remaining"), tie).first().obs_clock == 5.0


def test_metrics_and_bands(spark):
    scored = spark.createDataFrame([("g", "a", 0.5), ("g", "a", 2.0), ("g", "b", None)], "game_id string, category string, error double")
    m = evaluation.sync_metrics(scored).first()
    assert (m.mapped, m.mae, m.within_1s, m.within_2s, m.within_5s, m.unmapped_pct) == (2, 1.25, 33.3333, 66.6667, 66.6667, 33.3333)
    levels = evaluation.sync_metrics_by_level(scored)
    assert {(r.level, r.key) for r in levels.collect()} == {("overall", "all"), ("category", "a"), ("category", "b"), ("game", "g")}
    assert evaluation.macro_average(levels).first().games == 1
    errors = spark.createDataFrame([(e,) for e in (1.0, 2.0, 5.0, 10.0, 30.0, 31.0, None)], "error double")
    assert [(r.band, r.n) for r in evaluation.error_bands(errors).orderBy("place").collect()] == [(b, 1) for b in evaluation.BANDS]


def test_source_check(spark):
    source = spark.createDataFrame([("g", 1, "BP"), ("g", 2, "AG"), ("g", 3, "TO")], "game_id string, seq int, action_code string")
    good, bad = source.where("action_code <> 'AG'"), source.where("action_code = 'BP'")
    assert tuple(quality.source_equals_processed(source, good).first()) == ("g", 0, 0, True)
    assert tuple(quality.source_equals_processed(source, bad).first()) == ("g", 1, 0, False)


def run(readings, period=0, opened=True):
    t = tracker.Track(open=opened, period=period)
    out, first = [], True
    for time, clock in readings:
        seconds = float(clock.split(":")[0]) * 60 + float(clock.split(":")[1]) if ":" in clock else float(clock)
        now = [float(time), seconds, clock]
        if opened and first:
            first, t.last, t.first, t.count = False, now, now, 1
            out.append((now[0], "append", tracker.PERIODS[period], clock))
            continue
        out += [(at[0], op, p, at[2]) for op, at, p in tracker.step(t, now, tracker.Rules())]
    return t, out


def test_tracker_opens_after_a_running_start():
    _, out = run([(910, "9:54"), (911, "4:00"), (918, "9:54"), (919, "9:53"), (920, "9:52"), (921, "9:51")], opened=False)
    assert [x[0] for x in out] == [920, 921]
    _, out = run([(10, "10:00"), (12, "10:00"), (200, "9:58"), (201, "9:57"), (202, "9:56"), (203, "9:55")], opened=False)
    assert [x[3] for x in out] == ["10:00", "9:55"]


def test_tracker_periods_jumps_and_rebase():
    t, out = run([(100, "0.1"), (101, "5.9"), (200, "10:00"), (201, "9:59")])
    assert [x[2:] for x in out] == [("1st", "0.1"), ("2nd", "10:00"), ("2nd", "9:59")]
    t, out = run([(3932, "0.0"), (4237, "9:22"), (4238, "9:21"), (4239, "9:20"), (4240, "9:19"), (4241, "9:18"), (4865, "9:56"), (4866, "9:55"), (4867, "9:54")], period=1)
    assert tracker.PERIODS[t.period] == "3rd" and out[-1] == (4867.0, "append", "3rd", "9:54")


def test_tracker_takes_back_a_squeezed_period():
    rows = [(3932, "0.0"), (4237, "9:22")] + [(4237 + s * 4, f"{(562 - s * 9) // 60}:{(562 - s * 9) % 60:02d}") for s in range(1, 35)] + [(4865, "9:56")]
    t, out = run(rows, period=1)
    assert ("retract", "3rd") in {(x[1], x[2]) for x in out} and out[-1] == (4865.0, "append", "3rd", "9:56")


def readings(games):
    """A reading every second of each game's regular time, ten minutes of video a period and two between, with noise."""
    r = games.select("game_id", F.explode(F.sequence(F.lit(0), F.lit(2399))).alias("s")).withColumn("left", 600 - F.col("s") % 600)
    h = F.pmod(F.xxhash64("game_id", "s"), F.lit(100))
    clock = F.format_string("%d:%02d", (F.col("left") / 60).cast("int"), F.col("left") % 60)
    text = F.when(h < 3, F.lit("4:4")).when(h < 8, F.translate(clock, "05", "OS")).otherwise(clock)
    time = F.col("s") + F.floor(F.col("s") / 600) * 120
    return r.select("game_id", time.cast("double").alias("video_time"), text.alias("text"), F.when(h > 95, 0.1).otherwise(0.9).alias("confidence"))


def test_retraction_spares_what_comes_after_it(spark):
    rows = [("g", 1, "append", 100.0, "3rd", "9:00", 540.0), ("g", 2, "append", 110.0, "3rd", "8:50", 530.0), ("g", 3, "retract", 105.0, "3rd", "8:55", 535.0), ("g", 4, "append", 120.0, "3rd", "9:50", 590.0), ("g", 5, "append", 130.0, "4th", "9:50", 590.0)]
    got = tracker.resolve_retractions(spark.createDataFrame(rows, tracker.OUTPUT)).collect()
    assert sorted((r.video_time, r.period) for r in got) == [(100.0, "3rd"), (120.0, "3rd"), (130.0, "4th")]


def drain(spark, tmp_path, frames, name, **options):
    """Rows that the tracker puts out for the frames as micro-batches of a stream, and the query's last progress."""
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = tracker.track_stream(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def state_of(spark, tmp_path, variable):
    rows = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", variable).load()
    return {r["key"]["game_id"]: r["value"] for r in rows.select("key", "value").collect()}


START = dt.datetime(2024, 1, 1)


def timed(df):
    return df.withColumn("ts", (F.lit(START.timestamp()) + F.col("video_time")).cast("timestamp"))


def silence(spark, at):
    """A reading of another game that moves the watermark on."""
    row = [(f"z{at}", float(at), "5:00", 0.9, START + dt.timedelta(seconds=at))]
    return spark.createDataFrame(row, "game_id string, video_time double, text string, confidence double, ts timestamp")


def test_shuffled_stream_equals_batch(spark, tmp_path):
    games = spark.createDataFrame([("g1",), ("g2",)], "game_id string")
    rows = timed(readings(games).where("video_time < 1500"))
    late = F.col("video_time") + F.pmod(F.xxhash64("game_id", "video_time"), F.lit(100))  # up to 100 seconds late
    parts = [rows.where((late >= k * 320) & (late < k * 320 + 320)).orderBy(F.xxhash64("video_time", F.lit(7))) for k in range(5)]
    got = drain(spark, tmp_path, [*parts, silence(spark, 3000)], "shuffled", time="ts", late="2 minutes")
    assert got == sorted(map(tuple, tracker.track_batch(rows.drop("ts")).collect())) and len(got) > 1500


def test_a_timer_ends_a_game_and_another_removes_it(spark, tmp_path):
    games = spark.createDataFrame([("g",)], "game_id string")
    rows = timed(readings(games))  # its last reading is at 2759
    got = drain(spark, tmp_path / "a", [rows, silence(spark, 3600)], "short", time="ts", late="10 seconds")
    assert [r[4:6] for r in got][-1] == ("4th", "0:01") and not state_of(spark, tmp_path / "a", "head")["g"]["finished"]
    again = drain(spark, tmp_path / "b", [rows, silence(spark, 3720)], "ended", time="ts", late="10 seconds")
    assert again == got and state_of(spark, tmp_path / "b", "head")["g"]["finished"]
    # what comes after the end doesn't count: it would open an overtime
    overtime = timed(spark.createDataFrame([("g", 3725.0 + s, f"4:{59 - s:02d}", 0.9) for s in range(9)], "game_id string, video_time double, text string, confidence double"))
    assert drain(spark, tmp_path / "c", [rows, silence(spark, 3720), overtime, silence(spark, 3900)], "over", time="ts", late="10 seconds") == got
    drain(spark, tmp_path / "d", [rows, silence(spark, 3720), silence(spark, 4600)], "gone", time="ts", late="10 seconds")
    assert "g" not in state_of(spark, tmp_path / "d", "head")


def test_stream_equals_batch(spark, tmp_path):
    games = spark.createDataFrame([("g1",), ("g2",)], "game_id string")
    rows = readings(games).where("video_time < 1500")
    got = drain(spark, tmp_path, [rows.where("video_time < 500"), rows.where("video_time >= 500")], "tracked")
    want = sorted(map(tuple, tracker.track_batch(rows).collect()))
    assert got == want and len(want) > 1500
    appended = sum(x.op == "append" for x in tracker.track_batch(rows).collect())
    assert tracker.resolve_retractions(tracker.track_batch(rows)).count() == appended


def test_drop_impossible_equals_a_loop(spark):
    r = random.Random(5)
    rows = [(g, float(i), r.choice(["1st", "1st", "1st", "2nd"]), r.choice([None, *map(float, range(0, 60, 4))])) for g in ("g0", "g1") for i in range(0, 300, 2)]
    want, last = [], {}
    for row in rows:
        game, time, period, clock = row
        held = last.get(game)
        if held is None or held[2] != period or (clock is not None and held[3] is not None and held[3] - clock <= time - held[1] + 5):
            want.append(row)
            last[game] = row
    df = spark.createDataFrame(rows, "game_id string, video_time double, period string, clock_seconds double").withColumn("a.b", F.lit(1))
    got = timeline.drop_impossible(df)
    assert got.columns == df.columns and sorted((tuple(x)[:4] for x in got.collect()), key=str) == sorted(want, key=str)
    assert timeline.repair_timeline(df.limit(0)).collect() == []


def test_folds_have_no_python_workers(spark):
    df = spark.createDataFrame([("g", 1.0, "1st", 5.0)], "game_id string, video_time double, period string, clock_seconds double")
    plan = timeline.repair_timeline(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
