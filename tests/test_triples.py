import pytest
from pyspark.sql import functions as F

from hoopframe.sources import readers, triples, writers

V, B = "https://example.org/v#", "https://example.org"
ACTS = "season_code string, game_code string, game_id string, seq int, original_event_id int, action_id string, action_class string, period string, points int, home_team string, home_lineup array<string>, coach string, caused_by_violation boolean, assist_id string"
G = f"{B}/games/E1/7"


@pytest.fixture(scope="module")
def acts(spark):
    rows = [("E1", "7", "g", 1, 11, "a", "Turnover", 'q"1', None, "T", ["P2", "P1"], "Doe, Jo", True, None), ("E1", "7", "g", 2, 12, "b", "TwoPointShotMade", None, 2, "T", [], None, None, "c"), ("E1", "7", "g", 3, 13, "c", "Assist", None, None, "T", None, None, None, "gone")]
    return spark.createDataFrame(rows, ACTS)


def test_every_term_of_an_action(acts):
    got = {r.line for r in triples.action_lines(acts, V, B).collect()}
    x = "http://www.w3.org/2001/XMLSchema#"
    of_first = {
        f"<{G}> <{V}hasPlayByPlayAction> <{G}#PlayByPlay_J11> .", f"<{G}#PlayByPlay_J11> <{writers.RDF_TYPE}> <{V}Turnover> .", f'<{G}#PlayByPlay_J11> <{V}hasPlayByPlaySequence> "1" .', f'<{G}#PlayByPlay_J11> <{V}quarter> "q\\"1" .',
        f"<{G}#PlayByPlay_J11> <{V}runningHomeTeamLineup> <{B}/teams/-/T#Lineup_1_2> .", f"<{G}#PlayByPlay_J11> <{V}actionCoach> <{B}/coaches/-/doe-jo> .", f'<{G}#PlayByPlay_J11> <{V}causedByViolation> "true"^^<{x}boolean> .',
    }
    assert {line for line in got if "J11" in line} == of_first
    assert f"<{G}#PlayByPlay_J12> <{V}hasAssist> <{G}#PlayByPlay_J13> ." in got and f'<{G}#PlayByPlay_J12> <{V}pointsAwarded> "2"^^<{x}integer> .' in got
    assert not any("gone" in line or "J12> <" + V + "quarter" in line for line in got)


def checked(spark, lines, acts):
    good, bad = readers.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))
    return {(r.game, r.problem): r.n for r in triples.check_lines(good, bad, acts, V, B).collect()}


def test_an_export_checks_and_faults_are_told(spark, acts):
    lines = [r.line for r in triples.action_lines(acts, V, B).collect()]
    assert checked(spark, [*lines, "", f'<{G}> <{V}label> "x"@en-GB .'], acts) == {}
    assert checked(spark, [], acts) == {(G, "missing link"): 3, (G, "missing type"): 3, (G, "missing sequence"): 3}
    other = f"<{B}/games/E1/8> <{V}hasPlayByPlayAction> <{B}/games/E1/8#PlayByPlay_J1> ."
    extra = [f"<{G}#PlayByPlay_J12> <{writers.RDF_TYPE}> <{V}Other> .", other, other, "<x> y", f'<{G}> <{V}hasPlayByPlayAction> "{G}#PlayByPlay_J99" .']
    assert checked(spark, lines + extra, acts) == {(G, "unexpected type"): 1, (f"{B}/games/E1/8", "unexpected link"): 1, (f"{B}/games/E1/8", "duplicate"): 1, (None, "malformed"): 1}
    assert checked(spark, lines, acts.limit(0)) == {(G, "unexpected link"): 3}


def test_videos(spark):
    videos = spark.createDataFrame([("E1", "g", "7", "https://v/1", None, 4.25, False)], "season_code string, game_id string, game_code string, youtube_url string, ocr_profile string, playback_lead_seconds double, enabled boolean")
    m = spark.createDataFrame([("g", 11, 5, 12.5, "1st", "9:59"), ("g", 12, 5, 12.5, "1st", "9:59"), ("g", 13, None, None, "1st", None)], "game_id string, original_event_id int, observation_seq int, video_time double, period string, clock string")
    got = [r.line for r in triples.video_lines(videos, m, V, B).collect()]
    assert len(got) == len(set(got)) == 1 + 5 + 5 + 1 + 2
    assert f"<{G}#PlayByPlay_J12> <{V}correspondsToOCRObservation> <{G}#BroadcastVideo_Observation_5> ." in got and any('"4.25"' in x for x in got) and any('"false"' in x for x in got)
    with pytest.raises(Exception, match="no video address for g"):
        triples.video_lines(videos.withColumn("youtube_url", F.lit("ftp://x")), m, V, B).collect()


def test_documents_with_drifting_fields(spark):
    docs = [("g", '{"AllActions":[{"original_event_id":"7","period":"1st","seconds_remaining":"12","points":2.0,"new":[1]},{"original_event_id":8,"period":"1st","seconds_remaining":3,"points":"x"}],"Possessions":[{"possession_seq":1,"contains_action":[7,"8"]}]}'), ("h", '{"AllActions":[]}')]
    acts, poss = readers.read_documents(spark.createDataFrame(docs, "game_id string, document string"), "original_event_id int, period string, seconds_remaining int, points int, team_id string")
    assert sorted(tuple(r) for r in acts.collect()) == [("g", 7, "1st", 12, 2, None), ("g", 8, "1st", 3, None, None)]
    assert [(r.game_id, r.possession_seq, r.contains_action, r.team_id) for r in poss.collect()] == [("g", 1, [7, 8], None)]


@pytest.mark.parametrize(("text", "problem"), [('{"Possessions":[]}', "no list AllActions in the document of g"), ("not json", "no list AllActions"), ('{"AllActions":[{"original_event_id":1,"period":"1st","seconds_remaining":1},{"period":"1st","seconds_remaining":1}]}', "no original_event_id in action 2 of g")])
def test_bad_documents(spark, text, problem):
    docs = spark.createDataFrame([("g", text)], "game_id string, document string")
    with pytest.raises(Exception, match=problem):
        readers.read_documents(docs, "original_event_id int, period string, seconds_remaining int")[0].collect()
