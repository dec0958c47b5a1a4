"""The whole feed job, writers read back, and URIs both ways."""

import json

from pyspark.sql import functions as F

from hoopframe.functions import columns as c
from hoopframe.operators import scope
from hoopframe.sources import jobs, readers, writers

from .test_sources import FEED


def test_files_to_actions(spark, tmp_path):
    for kind, doc in (
        ("feed", FEED),
        ("box", {"Stats": [{"Team": "AAA", "Coach": "X", "PlayersStats": [{"Player_ID": f"P{i}", "IsStarter": 1} for i in range(1, 6)]}, {"Team": "BBB", "Coach": "Y", "PlayersStats": [{"Player_ID": f"P{i}", "IsStarter": 1} for i in range(11, 16)]}]}),
        ("shots", {"Rows": [{"NUM_ANOT": 2, "COORD_X": 1.0, "COORD_Y": 2.0, "ZONE": "B", "POINTS": 2, "FASTBREAK": "1", "SECOND_CHANCE": "0", "POINTS_OFF_TURNOVER": "0"}]}),
    ):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "E2023_7.json").write_text(json.dumps(doc))
    acts, poss = jobs.actions_of_files(spark, *(str(tmp_path / k) for k in ("feed", "box", "shots")))
    rows = {r.original_event_id: r for r in acts.collect()}
    assert rows[2].points == 2 and rows[2].assist_id == "E2023_7_3" and rows[2].home_coach == "X" and rows[2].home_score == 2
    assert rows[5].home_lineup == ["P2", "P3", "P4", "P5", "P6"] and rows[2].home_lineup == ["P1", "P2", "P3", "P4", "P5"]
    assert rows[7].leads_to_rebound == "E2023_7_8" and rows[21].caused_by_violation is not None and rows[2].caused_by_violation is None
    assert len(rows) == 12 and poss.count() == 5
    writers.write_actions(acts, f"{tmp_path}/actions")
    assert {r.action_id for r in readers.read_actions(spark, f"{tmp_path}/actions").collect()} == {r.action_id for r in rows.values()}


def test_timelines_and_metric_tables_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("E2023", "7", 1.5, "1st", "9:59"), ("E2023", "7", 2.5, "1st", "9:58")], "season_code string, game_code string, video_time double, period string, clock string")
    writers.write_timeline(rows, f"{tmp_path}/t")
    got = spark.read.csv(f"{tmp_path}/t", header=True).orderBy("video_time_sec").collect()
    assert [(r.season_code, r.game_code, r.video_time_sec, r.quarter, r.game_clock) for r in got] == [("E2023", 7, "1.5", "1st", "9:59"), ("E2023", 7, "2.5", "1st", "9:58")] or [r.video_time_sec for r in got] == ["1.5", "2.5"]
    writers.write_metric_tables({"a": rows.select("period"), "b": rows.select("clock")}, f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m/b", header=True).count() == 2


def test_uris_both_ways(spark):
    row = spark.range(1).select(
        c.action_uri(c.game_uri(F.lit("E2023"), F.lit(7)), F.lit(12)).alias("action"),
        c.lineup_uri(F.lit("AAA"), F.array(F.lit("P3"), F.lit("P1"))).alias("lineup"),
        c.roster_entry(F.lit("P1"), F.lit("Ann"), F.lit(None), F.lit("Guard")).alias("entry"),
        c.to_json_without_nulls(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))).alias("json"),
    )
    r = row.select("*", c.uri_season("action").alias("season"), c.uri_event_id("action").alias("event"), c.uri_team("lineup").alias("team"), c.uri_players("lineup").alias("players"), c.split_roster("entry").alias("split"), c.uri_tail(F.lit("a/b/c")).alias("tail")).first()
    assert r.action == "https://example.org/games/E2023/7#PlayByPlay_J12" and (r.season, r.event) == ("E2023", 12)
    assert (r.team, r.players, r.tail) == ("AAA", ["1", "3"], "c")
    assert r.entry == "P1|Ann||Guard" and r.split[0].image == "" and r.split[0].position == "Guard" and r.json == '{"a":1}'


def test_videos_in_season(spark):
    videos = spark.createDataFrame([("E2023", "1", "x", None), ("E2023", "2", " ", True), ("E2023", "3", "y", False), ("E2024", "1", "z", True), ("E2023", "4", "w", True)], "season_code string, game_code string, youtube_id string, enabled boolean")
    seen = spark.createDataFrame([("E2023", "1"), ("E2023", "2"), ("E2023", "3"), ("E2024", "1")], "season_code string, game_code string")
    assert [r.game_code for r in scope.videos_in_season(videos, seen, "E2023").collect()] == ["1"]
