import pytest
from pyspark.sql import functions as F

from hoopframe.functions import columns as c


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


CASES = {
    "clock_seconds": (lambda: c.clock_seconds("x"), ["07:24", "15.9", "x", None, "-1:-5", ":", "5"], [444.0, 15.9, None, None, -65.0, None, 5.0]),
    "clock_strict": (lambda: c.clock_seconds("x", strict=True), ["7:24", "7:60"], [444.0, None]),
    "clamp": (lambda: c.clamp_clock("x"), ["-00:01", "03:04", None, "-1:-5"], ["-00:01", "03:04", "", "00:00"]),
    "period": (lambda: c.normalize_period("x"), ["1", "Q2", "3RD", "4th", "OT1", "1ot", "OT", "OT2", "3OT", "ExtraTime2", "ForthQuarter", "half", None], ["1st", "2nd", "3rd", "4th", "OT", "OT", "OT", "2OT", "3OT", "2OT", "4th", "half", ""]),
    "order": (lambda: c.period_order("x"), ["4th", "OT", "2OT", "?"], [4, 5, 6, 99]),
    "length": (lambda: c.period_length("x"), ["1st", "2OT", "ExtraTime"], [600, 300, 300]),
    "max_seconds": (lambda: c.max_period_seconds("x"), ["1st", "3OT", "?"], [600, 300, None]),
    "class": (lambda: c.action_class("x"), ["2FGM", "??"], ["TwoPointShotMade", "??"]),
    "category": (lambda: c.action_category("x"), ["DefensiveRebound", "BenchFoul", "FoulDrawn", "Steal", "Challenge"], ["rebounds", "fouls", "fouls", "steals", "other"]),
    "team": (lambda: c.entity_uri("coaches", "x"), ["Doe, Jane Ann", " "], ["https://example.org/coaches/-/doe-jane-ann", None]),
    "event": (lambda: c.uri_event_id("x"), ["g#PlayByPlay_J12", "g"], [12, None]),
    "players": (lambda: c.uri_players("x"), ["t#Lineup_1_2", "t#Lineup_"], [["1", "2"], []]),
    "season": (lambda: c.season_label("x"), ["E2023", "E2099", "2023"], ["2023-24", "2099-00", None]),
    "bool": (lambda: c.to_bool("x", default=True), ["1", "true", "True", "0", None], [True, True, True, False, True]),
    "violation": (lambda: c.is_violation("x"), ["TRAVELLING", "bad pass", None], [True, False, False]),
    "stage": (lambda: c.game_stage("x", F.lit("3rd Place-Game")), ["x"], ["Third-place game"]),
    "phase": (lambda: c.game_stage("x", F.lit(None)), ["PLAY OFFS", "Cup"], ["Playoffs", "Cup"]),
    "name": (lambda: c.normalize_name("x"), ["Dončić,  Luka", "Müller-Łé"], ["doncic luka", "muller e"]),
    "display": (lambda: c.display_name("x"), ["Doe, Jane", "Jane", None], ["Jane Doe", "Jane", "Unknown player"]),
    "prose": (lambda: c.clean_prose("x"), ["<b>A.</b>B  c", "He's still playing there. Yes"], ["A. B c", "Yes"]),
    "sentences": (lambda: c.first_sentences("x", 2), ["Grew up. Named best. Third.", "He said."], ["He grew up. He was named best.", "He said."]),
    "signed": (lambda: c.first_sentences("x", 1), ["Signed for the 2020 season by Rome."], ["He joined Rome for the 2020 season."]),
    "country": (lambda: c.country_name("x"), ["GRE", "http://x/USA", "XXX"], ["Greece", "United States", "XXX"]),
    "date": (lambda: c.long_date("x"), ["2000-01-01", "bad"], ["1 January 2000", None]),
    "ocr": (lambda: c.clean_ocr_clock("x"), ["7.24", "IO:OO", "15.9", "741", "1O01", "7:61", "abc", "61.5"], ["7:24", "10:00", "15.9", "7:41", "10:01", None, None, None]),
    "kind": (lambda: c.tag_question("x"), ["Most ASSISTS?", "three-point shots", "αση points", "hi", None], ["assists", "shots", "points", "", ""]),
    "styles": (lambda: c.tag_shot_styles("x"), ["dunks and lay-ups", "none"], [["dunks", "layups"], []]),
    "subject": (lambda: c.profile_subject("x"), ["Who is Jane Doe?", "Jane Doe biography", "give me some info about Jane", "who is the best scorer", "hello"], ["Jane Doe", "Jane Doe", "Jane", None, None]),
    "script": (lambda: c.contains_script("x"), ["καλά", "good", None], [True, False, False]),
    "band": (lambda: c.hint_band(F.length("x"), 5), ["abcdefg"], [5]),
}


@pytest.mark.parametrize("name", CASES)
def test_text_columns(spark, name):
    column, inputs, want = CASES[name]
    assert values(spark, column(), inputs) == want


def test_number_columns(spark):
    assert values(spark, c.height_cm("x"), [1.9499999, 2.0, None], "double") == [195, 200, None]
    assert values(spark, c.decimal_text("x"), [1.5, 2.0, 0.1234], "double") == ["1.5", "2.0", "0.123"]
    assert values(spark, c.playback_lead("x", F.lit("Assist")), [None, 3.0, 20.0], "double") == [9.0, 9.0, 15.0]
    assert values(spark, c.seek_position("x", F.lit(5.0)), [3.0, 9.0], "double") == [0.0, 4.0]


def test_shots_and_rosters(spark):
    xy = values(spark, c.shot_xy("x"), ["1,2.5", "a,b", "1", "NaN,1", None])
    assert [(r.x, r.y) for r in xy] == [(1.0, 2.5)] + [(-1.0, -1.0)] * 4
    roster = values(spark, c.split_roster("x"), ["1|A|i|C@@2|B"])[0]
    assert [(r.id, r.name, r.position) for r in roster] == [("1", "A", "C"), ("2", "B", "")]
    assert values(spark, c.lineup_uri(F.lit("T"), F.split("x", ",")), ["P2,P1", ""])[0] == "https://example.org/teams/-/T#Lineup_1_2"
    at = values(spark, c.court_position(F.lit(0.0), F.lit(0.0), "x"), ["home", "road"])
    assert [r.along for r in at] == [12.425, -12.425]
    regions = [("H", -700, 100), ("H", -100, 100), ("B", 0, 0), ("", 0, 0)]
    df = spark.createDataFrame(regions, "z string, x int, y int")
    assert [r.r for r in df.select(c.shot_region("z", "x", "y").alias("r")).collect()] == ["left corner", "left perimeter", "paint", None]


def test_cost(spark):
    log = spark.createDataFrame([("a", "m", 1_000_000, 500_000, 100), ("a", "?", 1, 0, 1)], "provider string, model string, input_tokens long, cached_input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("a", "m", 2.0, 1.0, 10.0)], "provider string, model string, input double, cached double, output double")
    got = {r.model: r.cost_usd for r in c.estimate_cost(log, prices).collect()}
    assert got == {"m": pytest.approx(1.501), "?": None}
