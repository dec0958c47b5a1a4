"""Enrichment as actions arrive against its batch form, and windows over streams with late rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hoopframe.functions.columns import action_class
from hoopframe.plans import views
from hoopframe.streaming import live

CODES = ["2FGM", "3FGM", "FTM", "2FGA", "3FGA", "FTA", "AS", "AS", "CM", "RV", "RV", "OF", "CMU", "D", "O", "ST", "FV", "TO", "TO", "IN", "OUT", "TOUT"]
EVENTS = "game_id string, seq int, period string, clock string, seconds_remaining int, action_code string, action_id string, original_event_id int, team_id string, home_team string, road_team string, player_id string, points int, home_score int, road_score int"


def random_games(spark, n_games, n_actions, seed=4):
    r, rows = random.Random(seed), []
    for g in range(n_games):
        left, score = 600, {"H": 0, "R": 0}
        for seq in range(1, n_actions + 1):
            left = max(0, left - r.choice([0, 0, 0, 1, 2, 4]))
            period = "1st" if seq <= n_actions // 2 else "2nd"
            code = "BP" if seq in (1, n_actions // 2 + 1) else r.choice(CODES)
            team = r.choice(["H", "R"]) if code not in ("BP", "TOUT") else None
            points = {"2FGM": 2, "3FGM": 3, "FTM": 1}.get(code)
            if points:
                score[team] += points
            shown = (score["H"], score["R"]) if r.random() < 0.9 and team else (None, None)
            player = f"{team}{r.randrange(8)}" if team else None
            rows.append((f"g{g}", seq, period, f"{left // 60:02d}:{left % 60:02d}", left, code, f"g{g}-{seq}", seq, team, "H", "R", player, points, *shown))
    acts = spark.createDataFrame(rows, EVENTS).withColumn("action_class", action_class("action_code"))
    starters = spark.createDataFrame([(f"g{g}", side, f"{t}{k}") for g in range(n_games) for side, t in (("home", "H"), ("road", "R")) for k in range(5)], "game_id string, side string, player_id string")
    return acts, starters


def drain(spark, tmp_path, acts, starters, parts, name):
    for k, test in enumerate(parts):
        acts.where(test).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.enrich_stream(stream, starters).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def key(rows):
    return sorted((str(r) for r in rows))


def same(acts, changes, starters):
    want = live.enrich_games(acts, acts, starters)
    got = live.resolve_changes(acts, changes).select(*want.columns)
    casts = {c: F.col(c).cast(t) for c, t in want.dtypes}
    return key(got.select(*[v.alias(c) for c, v in casts.items()]).collect()), key(want.collect())


def test_in_any_order_and_any_batches(spark, tmp_path):
    acts, starters = random_games(spark, 12, 90)
    acts = acts.cache()
    part = F.pmod(F.xxhash64("game_id", "seq"), F.lit(4))
    got, want = same(acts, drain(spark, tmp_path, acts, starters, [part == k for k in range(4)], "mixed"), starters)
    assert got == want
    rows = live.enrich_games(acts, acts, starters)
    for link in ("assist_id", "blocked_by", "leads_to_rebound", "caused_by_steal", "caused_by_foul", "fouled_by", "possession_seq"):
        assert rows.where(F.col(link).isNotNull()).count() > 5, link


def test_every_split_of_a_game():
    """What a game puts out doesn't depend on where its state is written and read again."""
    r = random.Random(1)
    events = []
    for seq in range(1, 80):
        code = r.choice(CODES)
        events.append({"seq": seq, "action_id": str(seq), "period": "1st" if seq < 40 else "2nd", "clock": str(seq // 3), "seconds": float(600 - seq // 2), "code": code, "class_name": code, "team": r.choice("HR"), "player": f"p{r.randrange(7)}", "home": r.random() < 0.5, "home_score": seq, "road_score": None})

    def run(cut):
        g, out = live.Game(), []
        for k, e in enumerate(events):
            if k == cut:  # as the state store keeps it
                g = live.Game(g.last_seq, g.home_score, g.road_score, g.period, g.clock, g.holder, g.possession, g.inside, {h: set(p) for h, p in g.court.items()}, list(g.moved), [tuple(c) for c in g.candidates])
            out += live.enrich_next(g, e)
        return out, g

    whole, g = run(-1)
    assert all(run(cut)[0] == whole for cut in range(len(events))) and len(g.candidates) < 20


def test_repeats_and_gaps(spark, tmp_path):
    acts, starters = random_games(spark, 2, 40)
    acts = acts.cache()
    changes = drain(spark, tmp_path, acts, starters, ["seq <= 20", "seq between 10 and 25", "seq > 30"], "gaps")
    assert changes.where("op = 'action'").groupBy("game_id").agg(F.count("*"), F.max("seq")).select("count(1)", "max(seq)").distinct().collect() == [(25, 25)]
    got, want = same(acts.where("seq <= 25"), changes, starters)
    assert got == want


def test_a_table_of_games(spark, tmp_path):
    acts = views.actions(spark, "/root/testdata/sf0.001")
    starters = views.starters(acts)
    got, want = same(acts, drain(spark, tmp_path, acts, starters, [F.col("seq") % 3 == k for k in range(3)], "table"), starters)
    assert got == want and len(want) > 500


def test_sliding_windows_drop_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for k, minutes in enumerate([(0, 3, 7), (30,), (30,), (1, 26), (90,)]):  # minute 1 comes after the watermark has passed its windows
        rows = [("a", start + dt.timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    counts = live.windowed_counts(stream, "k", "10 minutes", "5 minutes", "5 minutes")
    q = counts.writeStream.format("memory").queryName("sliding").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.start - start).total_seconds() / 60: r.n for r in spark.table("sliding").collect()}
    assert got == {-5: 2, 0: 3, 5: 1, 20: 1, 25: 3, 30: 2}
