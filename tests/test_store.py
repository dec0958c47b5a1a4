import pytest
from pyspark.sql import functions as F

from hoopframe.sources import store


def frames(spark, games, mark="a"):
    rows = [(s, g, i, mark) for s, g, n in games for i in range(n)]
    a = spark.createDataFrame(rows, "season_code string, game_id string, seq int, mark string")
    return {"actions": a, "triples": a.where("seq % 2 = 0").select("season_code", "game_id", F.concat("mark", F.col("seq").cast("string")).alias("line"))}


def held(spark, root, name="actions"):
    return sorted(tuple(r) for r in store.read_games(spark, root, name).groupBy("game_id", "run").count().collect())


GAMES = [("E1", "a", 3), ("E1", "b", 2), ("E2", "c", 4)]


def test_only_new_games_are_written(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert store.write_games(frames(spark, GAMES[:2]), root) == 1
    assert store.write_games(frames(spark, GAMES), root) == 2
    assert store.write_games(frames(spark, GAMES), root) is None
    assert held(spark, root) == [("a", 1, 3), ("b", 1, 2), ("c", 2, 4)]
    assert held(spark, root, "triples") == [("a", 1, 2), ("b", 1, 1), ("c", 2, 2)]


def test_a_forced_season_replaces_the_old_rows(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store.write_games(frames(spark, GAMES), root)
    assert store.write_games(frames(spark, GAMES, "b"), root, F.col("season_code") == "E1") == 2
    assert held(spark, root) == [("a", 2, 3), ("b", 2, 2), ("c", 1, 4)]
    assert {(r.game_id, r.mark) for r in store.read_games(spark, root, "actions").collect()} == {("a", "b"), ("b", "b"), ("c", "a")}
    plan = store.read_games(spark, root, "actions")
    assert plan.where("season_code = 'E1'").select("run").distinct().collect()[0].run == 2
    # one game of a folder again: the others of the folder stand
    store.write_games(frames(spark, GAMES, "c"), root, F.col("game_id") == "a")
    assert {(r.game_id, r.mark) for r in store.read_games(spark, root, "actions").collect()} == {("a", "c"), ("b", "b"), ("c", "a")}
    assert store.write_games(frames(spark, GAMES, "d"), root, True) == 4
    assert {r.mark for r in store.read_games(spark, root, "actions").collect()} == {"d"}


@pytest.mark.parametrize("left", ["one output", "both outputs"])
def test_a_broken_run_is_done_again(spark, tmp_path, monkeypatch, left):
    root = f"file://{tmp_path}/s"
    store.write_games(frames(spark, GAMES[:1]), root)
    broken = frames(spark, GAMES, "broken")
    if left == "one output":
        broken["triples"] = broken["triples"].withColumn("line", F.raise_error(F.lit("broken")))
    else:
        monkeypatch.setattr(store, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("broken")))
    with pytest.raises(Exception, match="broken"):
        store.write_games(broken, root)
    monkeypatch.undo()
    assert held(spark, root) == [("a", 1, 3)]  # what it left isn't read
    assert store.write_games(frames(spark, GAMES[:2]), root) == 2  # and game c, which it had too, stays away
    assert held(spark, root) == [("a", 1, 3), ("b", 2, 2)]
    assert {r.mark for r in store.read_games(spark, root, "actions").collect()} == {"a"}
    assert store.write_games(frames(spark, GAMES), root) == 3
    assert held(spark, root) == [("a", 1, 3), ("b", 2, 2), ("c", 3, 4)]


def test_a_lost_output_is_made_again(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store.write_games(frames(spark, GAMES), root)
    (tmp_path / "s/triples/season_code=E2").rename(tmp_path / "gone")
    assert store.write_games(frames(spark, GAMES), root) == 2
    assert held(spark, root, "triples") == [("a", 1, 2), ("b", 1, 1), ("c", 2, 2)] and ("c", 2, 4) in held(spark, root)


def test_bad_outputs(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert store.write_games(frames(spark, [("E1", "a", 0)]), root) is None
    with pytest.raises(ValueError, match="run"):
        store.write_games({"a": spark.range(1).selectExpr("'s' season_code", "'g' game_id", "1 run")}, root)
    with pytest.raises(Exception, match="without game_id"):
        store.write_games({"a": spark.createDataFrame([("E1", None)], "season_code string, game_id string")}, root)
