import random

import pytest
from pyspark.sql import functions as F

from hoopframe.operators import candidates, evaluation, reports

PLAYERS = [("P1", "Doe, Jo"), ("P2", "José Álvarez Jr"), ("P3", "Ann Van Dyk"), ("P4", "ROE"), ("P5", "POE"), ("P6", "Li")]
CATALOG = ["Roe, Al", "Ed Poe", "Di Poe"]


def fits(spark, *guesses):
    df = spark.createDataFrame(list(enumerate(guesses)), "guess_id int, guess string")
    players = spark.createDataFrame(PLAYERS, "player_id string, name string")
    catalog = spark.createDataFrame([(n,) for n in CATALOG], "name string")
    got = {}
    for r in candidates.match_names(df, players, catalog).collect():
        got.setdefault(guesses[r.guess_id], set()).add(r.player_id)
    return got


def test_each_rule_of_names(spark):
    guesses = ["doe jo", "Jo Doe", "DOE", "jose alvarez", "Alvarez José", "álvarez iii", "van dyk", "dyk", "Al Roe", "roe al", "roe", "Ed Poe", "poe", "L", "li", "jo", "", "ann van", "al poe"]
    assert fits(spark, *guesses) == {
        "doe jo": {"P1"}, "Jo Doe": {"P1"}, "DOE": {"P1"}, "jose alvarez": {"P2"}, "Alvarez José": {"P2"}, "álvarez iii": {"P2"}, "van dyk": {"P3"}, "dyk": {"P3"},
        "Al Roe": {"P4"}, "roe al": {"P4"}, "roe": {"P4"}, "poe": {"P5"}, "li": {"P6"},
    }


@pytest.mark.parametrize(("guess", "fit"), [("Doe & Dyk", True), ("dyk AND doe", True), ("dyk + al roe", False), ("doe", False), ("doe & doe", False), ("doe & dyk & li", False), ("sandy doe & dyk", False)])
def test_pairs(spark, guess, fit):
    df = spark.createDataFrame([(7, guess)], "guess_id int, guess string")
    answers = spark.createDataFrame([(7, "P1", "P3")], "guess_id int, a string, b string")
    got = candidates.match_pairs(df, answers, spark.createDataFrame(PLAYERS, "player_id string, name string"))
    assert (got.count() == 1) == fit


def test_the_first_name_takes_the_first_it_fits(spark):
    players = spark.createDataFrame([("A", "Jo Doe"), ("B", "Al Doe")], "player_id string, name string")
    answers = spark.createDataFrame([(1, "A", "B"), (2, "A", "B")], "guess_id int, a string, b string")
    df = spark.createDataFrame([(1, "doe & al doe"), (2, "doe & jo doe")], "guess_id int, guess string")
    assert [r.guess_id for r in candidates.match_pairs(df, answers, players).collect()] == [1]


def test_play_order_places_unnumbered_actions_by_clock(spark):
    rows = [("g", "1st", 1, 600, "a"), ("g", "1st", 5, 500, "b"), ("g", "1st", 9, 500, "d"), ("g", "1st", None, 500, "c"), ("g", "1st", 0, 550, "x"), ("g", "1st", None, 550, "w"), ("g", "1st", 0, 100, "e"), ("g", "2nd", None, 600, "f"), ("g", "2nd", 2, 600, "g")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "game_id string, period string, seq int, seconds_remaining int, action_id string")
    assert [r.action_id for r in reports.play_order(df).orderBy("place").collect()] == ["a", "w", "x", "b", "c", "d", "e", "f", "g"]


RESULTS = "question_id string, row int, field string, value string"
EXPECTED = "question_id string, field string, text string, number double, members array<string>"


def row_matches(spark, results, expected):
    r = spark.createDataFrame([("q", *x) for x in results], RESULTS)
    e = spark.createDataFrame([("q", *x) for x in expected], EXPECTED)
    return evaluation.matches_row(r, e).first().matches


def test_rows(spark):
    members = [("who", None, None, ["A B", "C"])]
    assert row_matches(spark, [(1, "who", "C , A B"), (1, "more", "x")], members)
    for wrong in ("C", "C, A B, C", "C, A B, D", "", None):
        assert not row_matches(spark, [(1, "who", wrong)], members)
    number = [("n", None, 7.5, None)]
    assert row_matches(spark, [(1, "n", "7.50009")], number) and not row_matches(spark, [(1, "n", "7.502")], number) and not row_matches(spark, [(1, "n", "many")], number)
    assert not row_matches(spark, [(1, "n", "7.5"), (2, "n", "7.5")], number) and not row_matches(spark, [], number)
    assert row_matches(spark, [(1, None, None)], [("t", "", None, None)]) and not row_matches(spark, [(1, "t", "a")], [("t", "b", None, None)])


def test_ids(spark):
    r = spark.createDataFrame([(q, k, a, {"t": v}) for q, k, a, v in [("q", 1, "a", "3"), ("q", 2, "b", "3.00001"), ("r", 1, "a", "3"), ("s", 1, "a", "4")]], "question_id string, row int, action_id string, values map<string,string>")
    e = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("r", "a"), ("r", "b"), ("s", "a"), ("u", "a")], "question_id string, action_id string")
    t = spark.createDataFrame([(q, "t", 3.0) for q in ("q", "r", "s", "v")], "question_id string, field string, number double")
    assert {x.question_id: x.matches for x in evaluation.matches_ids(r, e, t).collect()} == {"q": True, "r": False, "s": False, "u": False, "v": False}
