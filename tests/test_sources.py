import json

import pytest

from hoopframe.operators import links, lineups, possessions
from hoopframe.sources import readers, writers


def event(n, code, team="", player="", clock="", a=None, b=None, info=""):
    return {"NUMBEROFPLAY": n, "PLAYTYPE": code, "CODETEAM": team, "PLAYER_ID": player, "MARKERTIME": clock, "POINTS_A": a, "POINTS_B": b, "PLAYINFO": info}


FEED = {
    "CodeTeamA": "AAA ",
    "CodeTeamB": "BBB",
    "FirstQuarter": [event(1, "BP"), event(2, "2FGM", "AAA", "P1", "09:50", 2, 0), event(3, "AS", "AAA", "P2", "09:50"), event(4, "AG"), event(5, "IN", "AAA", "P6", "09:00"), event(6, "OUT", "AAA", "P1", "09:00"), event(7, "3FGA", "BBB", "P11", "08:50"), event(8, "D", "AAA", "P2", "08:48"), event(9, "EP", clock="-00:-01")],
    "ExtraTime": [event(20, "BP"), event(21, "TO", "BBB", "P11", "04:00", info="Travelling"), event(22, "BP"), event(23, "FTM", "AAA", "P2", "01:00", 3, 0)],
}


def load(spark, tmp_path):
    (tmp_path / "E2023_7.json").write_text(json.dumps(FEED))
    return readers.read_feed(spark, str(tmp_path / "E2023_7.json"))


def test_feed(spark, tmp_path):
    rows = load(spark, tmp_path).orderBy("seq").collect()
    assert [(r.seq, r.original_event_id) for r in rows] == list(enumerate([1, 2, 3, 5, 6, 7, 8, 9, 20, 21, 22, 23], 1))
    assert [r.period for r in rows] == ["1st"] * 8 + ["OT"] * 2 + ["2OT"] * 2
    by = {r.original_event_id: r for r in rows}
    assert (by[1].clock, by[9].clock, by[20].clock) == ("10:00", "00:00", "05:00") and by[2].seconds_remaining == 590
    assert (rows[0].season_code, rows[0].game_code, rows[0].home_team) == ("E2023", "7", "AAA")


def test_feed_to_possessions(spark, tmp_path):
    a = load(spark, tmp_path).selectExpr("*", "concat(season_code, '_', game_code) as game_id", "cast(original_event_id as string) as action_id")
    from hoopframe.functions.columns import action_class

    a = links.carry_score(a.withColumn("action_class", action_class("action_code")))
    assert [r.home_score for r in a.orderBy("seq").collect()] == [0] + [2] * 10 + [3]
    starters = spark.createDataFrame([("E2023_7", "home", f"P{i}") for i in range(1, 6)] + [("E2023_7", "road", f"P{i}") for i in range(11, 16)], "game_id string, side string, player_id string")
    court = {r.original_event_id: r for r in lineups.settle_substitutions(lineups.lineup_at_action(a, starters)).collect()}
    assert court[3].home_lineup == ["P1", "P2", "P3", "P4", "P5"] and court[5].home_lineup == court[6].home_lineup == ["P2", "P3", "P4", "P5", "P6"]
    linked = {r.original_event_id: r for r in links.link_actions(a).collect()}
    assert linked[2].assist_id == "3" and linked[7].leads_to_rebound == "8"
    got = [(r.team_id, r.starts_after, r.ends_with, r.contains_action) for r in possessions.possessions(a).orderBy("possession_seq").collect()]
    assert got == [("AAA", 1, 6, [2, 3, 5, 6]), ("BBB", 6, 7, [7]), ("AAA", 7, 8, [8]), ("BBB", 20, 21, [21]), ("AAA", 22, 23, [23])]


def test_boxscore_and_shots(spark, tmp_path):
    (tmp_path / "E2023_7.json").write_text(json.dumps({"Stats": [{"Team": "A", "Coach": "X", "PlayersStats": [{"Player_ID": "P1 ", "IsStarter": 1}, {"Player_ID": "P9", "IsStarter": 0}]}, {"Team": "B", "Coach": "Y", "PlayersStats": []}]}))
    starters, coaches = readers.read_boxscore(spark, str(tmp_path / "E2023_7.json"))
    assert [tuple(r) for r in starters.collect()] == [("E2023", "7", "home", "P1")]
    assert {(r.side, r.coach) for r in coaches.collect()} == {("home", "X"), ("road", "Y")}
    shots = tmp_path / "shots"
    shots.mkdir()
    (shots / "E2023_7.json").write_text(json.dumps({"Rows": [{"NUM_ANOT": 2, "COORD_X": 1.0, "COORD_Y": 2.0, "ZONE": "B", "POINTS": 2, "FASTBREAK": "1", "SECOND_CHANCE": "0", "POINTS_OFF_TURNOVER": "0"}]}))
    (tmp_path / "feed").mkdir()
    joined = {r.original_event_id: r for r in readers.join_shot_points(load(spark, tmp_path / "feed"), readers.read_shot_points(spark, str(shots))).collect()}
    assert (joined[2].points, joined[2].shot_zone, joined[2].is_fast_break) == (2, "B", True) and joined[7].points is None


def test_triples_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'say "hi"\\\n', 3), ("2", None, None)], "id string, name string, n int")
    from pyspark.sql import functions as F

    lines = writers.entity_triples(rows, F.concat(F.lit("http://x/"), "id"), "http://x/C", {"http://x/name": writers.literal(F.col("name")), "http://x/n": writers.literal(F.col("n"), "integer")})
    writers.write_ntriples(lines.union(spark.createDataFrame([("broken line",)], "line string")), f"{tmp_path}/t")
    triples, bad = readers.read_ntriples(spark, f"{tmp_path}/t")
    assert bad.count() == 1 and triples.count() == 4
    got = {r.s: (r.name, r.n) for r in readers.triples_to_entities(triples, writers.RDF_TYPE, "http://x/C", {"name": ("http://x/name", "string"), "n": ("http://x/n", "int")}).collect()}
    assert got == {"http://x/1": ('say "hi"\\\n', 3), "http://x/2": (None, None)}


def test_catalog_timeline_truth_scope(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"games": [{"season_code": "E2023", "game_code": "7"}, {"season_code": "E2023", "game_code": "8", "enabled": False}]}))
    assert [r.enabled for r in readers.read_video_catalog(spark, str(tmp_path / "v.json")).orderBy("game_code").collect()] == [True, False]
    (tmp_path / "E2023_7.csv").write_text("video_time_sec,quarter,game_clock\n5.0,1,9:59\n4.0,1,10:00\n")
    t = readers.read_timeline(spark, str(tmp_path / "E2023_7.csv")).orderBy("observation_seq").collect()
    assert [(r.period, r.clock_seconds, r.game_id) for r in t] == [("1st", 600.0, "E2023_7"), ("1st", 599.0, "E2023_7")]
    (tmp_path / "truth.csv").write_text("season_code,game_code,original_event_id,action_category,annotation_status,ground_truth_video_seconds\nE2023,7,1,shot, Annotated ,3.5\nE2023,7,2,shot,,\n")
    assert [r.status for r in readers.read_ground_truth(spark, str(tmp_path / "truth.csv")).orderBy("original_event_id").collect()] == ["annotated", "pending"]
    assert readers.scope_games(spark, "E2023", max_games=3).count() == 3 and readers.scope_games(spark, "E2023", game=9).first().game_code == "9"
    assert readers.discover_artifacts(spark, str(tmp_path / "E*.csv")).first().game_code == "7"


def test_csv_is_safe(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2), ("ok", -3)], "a string, b int")
    writers.export_csv(df, f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect() if "a" not in r.value.split(",")[0]) == ['"\'=1+1","2"', '"ok","-3"']


HEADER = "season_code,game_code,original_event_id,action_category,annotation_status,ground_truth_video_seconds,note"


def truth(spark, folder, *lines, header=HEADER, name="t.csv"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")
    return readers.read_ground_truth(spark, str(folder))


def test_ground_truth_rows(spark, tmp_path):
    rows = truth(spark, tmp_path / "a", "E1,7,1,shot,Completed,3.5,x", "E1,7,1,,skip me,,", "E1,7,2,foul,EXCLUDE,-1,", "E1,7,x,foul,,oops,")
    got = [(r.status, r.original_event_id, r.action_category, r.ground_truth_video_seconds, r.note) for r in rows.collect() if r.status == "annotated"]
    assert got == [("annotated", 1, "shot", 3.5, "x")] and rows.columns == [*HEADER.split(","), "status"]
    assert sorted(r.status for r in rows.collect()) == ["annotated", "excluded", "pending", "pending"]
    assert {r.action_category for r in rows.where("status = 'pending'").collect()} == {"other", "foul"}


@pytest.mark.parametrize(("lines", "problem"), [
    (["E1,7,1,shot,annotated,-0.5,"], "negative time at E1_7_1"), (["E1,7,1,shot,annotated,1,", "E1,7,1,shot,complete,2,"], "repeated key E1_7_1"),
    (["E1,7,1,shot,annotated,soon,"], "no number at E1_7_1"), (["E1,7,one,shot,annotated,1,"], "no number at E1_7"),
])
def test_ground_truth_errors(spark, tmp_path, lines, problem):
    with pytest.raises(Exception, match=problem):
        truth(spark, tmp_path / "b", *lines).collect()


def test_ground_truth_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks the columns action_category, annotation_status"):
        truth(spark, tmp_path / "c", header="season_code,game_code,original_event_id,ground_truth_video_seconds")
    truth(spark, tmp_path / "d", "E1,7,1,shot,annotated,1,")
    with pytest.raises(Exception, match="(?i)header"):
        truth(spark, tmp_path / "d", "E1,8,shot,1,annotated,1,", header="season_code,game_code,action_category,original_event_id,annotation_status,ground_truth_video_seconds,note", name="u.csv").collect()
