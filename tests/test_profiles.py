from pyspark.sql import functions as F

from hoopframe.operators import profiles

PLAYERS = "player_id string, name string, position string, birth_date string, country string, bio string, achievements string"


def test_profiles(spark):
    rows = [
        ("P1", "Ann", "Guard", "2001-02-03", "https://x/GRE", "<b>Grew up here.</b>Moved  away. " + "One. " * 9, "Named best."), ("P2", "Bo", None, "soon", "XX", None, ""), ("P3", None, "Guard", None, None, "x.", None), ("P4", "", None, None, None, None, None),
    ]
    got = {r.player_id: r for r in profiles.player_profiles(spark.createDataFrame(rows, PLAYERS)).collect()}
    assert set(got) == {"P1", "P2"}
    assert got["P1"].paragraphs == ["Ann is a basketball guard, born on 3 February 2001.", "He grew up here. He moved away. One. One. One. One. One.", "He was named best."] and got["P1"].country == "Greece"
    assert got["P2"].paragraphs == ["Bo is a basketball player.", profiles.NO_BIOGRAPHY] and (got["P2"].country, got["P2"].position) == ("XX", "")


def test_scenarios(spark):
    def row(game, seq, code, sec, home, road, lineup):
        return (game, f"{game}{seq}", seq, "4th", f"0{sec // 60}:{sec % 60:02d}", sec, code, home, road, "H", "R", lineup, ["R1"])

    rows = [row("g", 1, "IN", 500, 0, 0, ["H1", "H2"]), row("g", 2, "TOUT", 200, 70, 72, ["H1"]), row("g", 3, "TOUT", 200, 70, 80, ["H1"]), row("g", 4, "2FGM", 1, 75, 72, ["H3"]), row("h", 1, "TOUT", 120, 9, 6, None), row("h", 2, "EP", 0, 9, 6, None)]
    schema = "game_id string, action_id string, seq int, period string, clock string, seconds_remaining int, action_code string, home_score int, road_score int, home_team string, road_team string, home_lineup array<string>, road_lineup array<string>"
    acts = spark.createDataFrame(rows, schema).withColumn("action_class", F.when(F.col("action_code") == "TOUT", "Timeout").otherwise("x"))
    got = {r.action_id: r for r in profiles.late_scenarios(acts).collect()}
    assert set(got) == {"g2", "h1"}
    assert (got["g2"].user_team, got["g2"].user_score, got["g2"].opp_score, got["g2"].roster, got["g2"].user_final, got["g2"].came_back) == ("H", 70, 72, ["H1", "H2", "H3"], 75, True)
    assert (got["h1"].user_team, got["h1"].opponent, got["h1"].came_back) == ("R", "H", False)
