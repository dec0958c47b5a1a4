"""What a query asks for more than once is made once, and running windows run one way."""

from pyspark.sql import functions as F

from hoopframe.operators import candidates
from hoopframe.plans import queries, source_queries, stream_queries, sync_queries  # noqa: F401
from hoopframe.sources import store
from hoopframe.streaming import tracker

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_with_lineup_makes_lineups_once(spark):
    df = queries.QUERIES["with_lineup"](spark, SF)
    assert "Window" not in plan(df) and "Join" not in plan(df)


def test_multiple_choice_asks_each_round_once(spark):
    players = spark.createDataFrame([(f"P{i}", f"Ann{i} Bee{i}") for i in range(40)], "player_id string, name string")
    answers = spark.createDataFrame([(f"q{i}", f"P{i}") for i in range(9)], "question_id string, player_id string")
    df = candidates.multiple_choice(answers, players, 3)
    assert "Join" not in plan(df)
    rows = df.collect()
    assert len(rows) == 36 and {(r.question_id, r.player_id) for r in rows if r.correct} == {(f"q{i}", f"P{i}") for i in range(9)}
    assert all(len({r.name for r in rows if r.question_id == f"q{i}"}) == 4 for i in range(9))


def test_action_terms_links_written_actions(spark):
    df = queries.QUERIES["action_terms"](spark, SF)
    assert "Window" not in plan(df) and "Aggregate" not in plan(df)


def test_incremental_write_hands_on_written_outputs(spark, monkeypatch):
    seen, write = [], store.write_games
    monkeypatch.setattr(store, "write_games", lambda outputs, *a, **k: seen.extend(outputs.values()) or write(outputs, *a, **k))
    queries.QUERIES["incremental_write"](spark, SF)
    assert len(seen) == 6 and not [df for df in seen if "Window" in plan(df)]


ACTS = "game_id string, original_event_id long, period string, seconds_remaining int"


def test_readings_of_a_second_are_those_of_the_first_action(spark):
    acts = [("g", 1, "1st", 600), ("g", 4, "1st", 599), ("g", 3, "1st", 597), ("g", 9, "4th", 1), ("h", 7, "2nd", 0), ("h", 8, "OT", 300)]
    best = {}
    for game, e, period, left in acts:
        p = {"OT": 5}.get(period) or int(period[0])
        for s in range(-2, 3):
            at, h = left - s, (e * 31 + s * 7) % 100
            if 0 <= at <= 600:
                clock = f"{at // 60}:{at % 60:02d}"
                text = "4:4" if h < 3 else clock.translate(str.maketrans("05", "OS")) if h < 8 else clock
                key = (game, (p - 1) * 720 + 600.0 - at)
                best[key] = min(best.get(key, (99,)), (e, text, 0.1 if h > 95 else 0.9))
    got = stream_queries.readings(spark.createDataFrame(acts, ACTS)).collect()
    assert sorted((r.game_id, r.video_time, r.text, r.confidence) for r in got) == sorted((*k, *v[1:]) for k, v in best.items())


def test_the_tracker_of_actions_shuffles_once(spark):
    rows = tracker.track_batch(stream_queries.readings(spark.createDataFrame([("g", 1, "1st", 600)], ACTS)))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_retractions_are_resolved_by_a_running_minimum(spark):
    rows = [(1, "append", 5.0), (2, "append", 9.0), (3, "retract", 6.0), (4, "append", 9.0), (5, "append", 12.0), (6, "retract", 10.0), (7, "append", 13.0)]
    df = spark.createDataFrame([("g", n, op, at, "2nd", "1:00", 60.0) for n, op, at in rows], tracker.OUTPUT)
    out = tracker.resolve_retractions(df)
    assert sorted(r.video_time for r in out.collect()) == [5.0, 9.0, 13.0]
    assert "unboundedfollowing" not in plan(out)
