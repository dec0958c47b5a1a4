"""Members on court are judged once a game, not once an action."""

from pyspark.sql import functions as F

from hoopframe.operators import lineups

ACTS = "game_id string, action_id string, team_id string, player_id string, home_team string, road_team string, home_lineup array<string>, road_lineup array<string>"


def test_each_row_of_an_action_is_judged_by_itself(spark):
    row = ("g", "1", "A", "P1", "A", "B", ["P1", "P2"], ["P3"])
    acts = spark.createDataFrame([row, row, ("g", "2", "B", "P3", "A", "B", ["P1", "P4"], ["P3"]), ("g", "3", "A", "P1", "A", "B", ["P1"], []), ("h", "4", "A", "P1", "A", "B", [], [])], ACTS)
    players = spark.createDataFrame([("P1", "X", 2.0), ("P2", "Y", 2.1), ("P3", "X", 1.9), ("P4", "Z", None)], "player_id string, name string, height double")
    tall = F.col("height") >= 2.0
    assert sorted(r[0] for r in lineups.count_members(acts, players, "ten", tall, 2).select("action_id").collect()) == ["1", "1"]
    assert sorted(r[0] for r in lineups.count_members(acts, players, "teammates", tall, 0).select("action_id").collect()) == []
    assert sorted(r[0] for r in lineups.all_members(acts, players, "own", tall).select("action_id").collect()) == ["1", "1", "3"]
    assert sorted(r[0] for r in lineups.all_members(acts, players, "opponents", tall).select("action_id").collect()) == []
    got = {tuple(r) for r in lineups.mean_height_on_court(acts, players).collect()}
    assert got == {("1", 2.0, "X, Y"), ("2", 1.95, "X"), ("3", 2.0, "X")}


def test_no_aggregate_holds_an_entry_an_action(spark):
    acts = spark.createDataFrame([("g", "1", "A", "P1", "A", "B", ["P1"], ["P3"])], ACTS)
    players = spark.createDataFrame([("P1", "X", 2.0)], "player_id string, name string, height double")
    for df in (lineups.all_members(acts, players, "ten", F.col("height") > 1), lineups.count_members(acts, players, "own", F.col("height") > 1, 1), lineups.mean_height_on_court(acts, players)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Aggregate [" in line and "action_id" in line], plan


def test_columns_that_nobody_reads_are_not_carried_with_the_lineups(spark):
    acts = spark.createDataFrame([("g", 1, "1", "IN", "A", "P1", "A", "B", 7.0), ("g", 2, "2", "2FGM", "A", "P1", "A", "B", 7.0)], "game_id string, seq int, action_id string, action_code string, team_id string, player_id string, home_team string, road_team string, coord_x double")
    starters = spark.createDataFrame([("g", "road", "P3")], "game_id string, side string, player_id string")
    lined = lineups.lineup_at_action(acts, starters)
    assert lined.columns == [*acts.columns, "home_lineup", "road_lineup"]
    assert sorted(tuple(r)[2:] for r in lined.collect()) == [("1", "IN", "A", "P1", "A", "B", 7.0, ["P1"], ["P3"]), ("2", "2FGM", "A", "P1", "A", "B", 7.0, ["P1"], ["P3"])]
    plan = lined.select("action_id", "home_lineup")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "coord_x" in line and "LogicalRDD" not in line], plan
