"""Questions, rosters and foul links against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from hoopframe.operators import candidates, evaluation, links, reports
from hoopframe.plans import views

SF = "/root/testdata/sf0.001"


def test_multiple_choice_finds_all_options_there_are(spark):
    names = ["Doe, Jo"] * 30 + ["Roe, Al", "ROE, ÁL", "Poe, Ed", "Loe, Bo", "Jo Doe"]
    players = spark.createDataFrame([(f"P{i}", n) for i, n in enumerate(names)], "player_id string, name string")
    answers = spark.createDataFrame([("q1", "P0"), ("q2", "P32"), ("q3", "P99")], "question_id string, player_id string")
    rows = candidates.multiple_choice(answers, players, 3).collect()
    of = {q: sorted(r.name for r in rows if r.question_id == q and not r.correct) for q in ("q1", "q2", "q3")}
    assert [n.upper().replace("Á", "A") for n in of["q1"]] == ["LOE, BO", "POE, ED", "ROE, AL"]  # the one other spelling of an option isn't a second one
    assert len(of["q2"]) == 3 and "Poe, Ed" not in of["q2"] and of["q3"] == []
    assert sorted(r.place for r in rows if r.question_id == "q1") == [1, 2, 3, 4]
    assert {(r.question_id, r.player_id) for r in rows if r.correct} == {("q1", "P0"), ("q2", "P32")}


def brute_fouls(rows):
    """{drawn foul: foul} of rows (game, period, seq, seconds, code, id), one ordered pass over whole games."""
    taken, seen = {}, []
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        if r[4] in ("CM", "OF", "CMU"):
            for p in reversed(seen):
                if p[:2] != r[:2] or abs(p[3] - r[3]) > 3:
                    break
                if p[4] == "RV" and p[5] not in taken:
                    taken[p[5]] = r[5]
                    break
        seen.append(r)
    return taken


@pytest.mark.parametrize("seed", range(2))
def test_foul_links_equal_one_ordered_pass(spark, seed):
    r = random.Random(seed)
    rows, clock = [], 600
    for n in range(400):
        clock = clock - r.choice([0, 0, 1, 2, 5]) if n % 100 else 600
        rows.append((f"g{n // 200}", f"{n % 200 // 100 + 1}st", n + 1, clock, r.choice(["RV", "CM", "OF", "CMU", "2FGA", "RV"]), f"a{n}"))
    acts = spark.createDataFrame(rows, "game_id string, period string, seq int, seconds_remaining int, action_code string, action_id string")
    assert {x.action_id: x.fouled_by for x in links.foul_links(acts).collect()} == brute_fouls(rows)


@pytest.mark.parametrize("seed", range(2))
def test_reach_of_steals_and_fouls_with_clocks_in_any_order(spark, seed):
    r = random.Random(seed)
    rows = [("g", "1st", n + 1, max(0, 600 - n // 3 + r.choice([0, 0, 0, 5, -5])), r.choice(["ST", "TO", "OF", "2FGA"]), f"a{n}", r.choice(["T1", "T2"]), "T1") for n in range(300)]
    acts = spark.createDataFrame(rows, "game_id string, period string, seq int, seconds_remaining int, action_code string, action_id string, team_id string, home_team string")
    steal, foul = {}, {}
    for i, s in enumerate(rows):
        for a in reversed(rows[:i]):
            if abs(a[3] - s[3]) > 3:
                break
            if s[4] == "ST" and a[4] == "TO" and a[6] != s[6]:
                steal[a[5]] = s[5]
                break
            if s[4] == "TO" and a[4] == "OF":
                foul[s[5]] = a[5]
                break
    got = links.link_actions(acts, ("caused_by_steal", "caused_by_foul")).collect()
    assert {x.action_id: x.caused_by_steal for x in got if x.caused_by_steal} == steal and steal
    assert {x.action_id: x.caused_by_foul for x in got if x.caused_by_foul} == foul and foul


def test_unmatched_truth_is_an_error(spark):
    truth = spark.createDataFrame([("g", "a", "Shot", 1.0), ("g", "b", "Shot", 2.0)], "game_id string, action_id string, category string, truth_seconds double")
    known = spark.createDataFrame([("g", "a", 1.5), ("g", "b", None)], "game_id string, action_id string, video_time double")
    assert {r.action_id: r.error for r in evaluation.score_sync(truth, known).collect()} == {"a": 0.5, "b": None}
    with pytest.raises(Exception, match="no action for the ground truth g b"):
        evaluation.score_sync(truth, known.where("action_id = 'a'")).collect()


def test_roster_and_fragments(spark):
    box = spark.createDataFrame([("g", "home", "T1", "P1", True), ("g", "home", "T1", "P2", False), ("g", "road", "T2", "P3", True)], "game_id string, side string, team_id string, player_id string, is_starter boolean")
    took = spark.createDataFrame([("g", "T1", "P1", "ONE"), ("g", "T1", "P2", "TWO")], "game_id string, team_id string, player_id string, jersey_name string")
    attrs = spark.createDataFrame([("P1", "label", "B"), ("P1", "label", "A"), ("P1", "position", "Guard"), ("P1", "position", "Center")], "player_id string, attr string, value string")
    got = {r.player_id: (r.name, r.image, r.position, r.is_starter) for r in reports.game_roster(box, took, attrs).collect()}
    assert got == {"P1": ("A", None, "Center / Guard", True), "P2": ("TWO", None, "", False)}
    players = spark.createDataFrame([("P1", "Ann")], "player_id string, name string")
    assert {r.player_id: r.name for r in reports.first_available_name(took, players).collect()} == {"P1": "Ann", "P2": "TWO"}
    teams = spark.createDataFrame([("T1", "b", "y"), ("T1", "a", "z")], "team_id string, label string, image string")
    assert [tuple(r) for r in reports.team_logos(teams).collect()] == [("T1", "a", "y")]
    rows = spark.range(40).select(F.col("id"), F.repeat(F.lit("x"), 3000).alias("t"))
    shown = reports.evidence(rows, ["id"]).collect()
    assert len(shown) == 15 and shown[0].sampled and shown[0].total_rows == 40 and len(shown[0].t) == 2500
    assert reports.seeded_sample(rows, "id", 5, 1).collect() == reports.seeded_sample(rows.repartition(3), "id", 5, 1).collect()
