"""Registered queries over the derived play-by-play tables, each with the DuckDB SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineups, links, possessions, reports, scope
from . import views
from .views import ACTIONS_SQL, GAMES_SQL, LINEUPS_SQL, PLAYERS_SQL, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINKS_SQL = """
assist_l AS (SELECT game_id, seq, max_by(src, s_seq) AS assist_id FROM (SELECT a.game_id, a.seq AS s_seq, a.action_id AS src, max(b.seq) AS seq FROM actions a JOIN actions b
  ON a.game_id = b.game_id AND a.period = b.period AND a.team_id = b.team_id AND b.seq < a.seq WHERE a.action_code = 'AS' AND b.action_code IN ('2FGM', '3FGM', 'FTM') GROUP BY 1, 2, 3) GROUP BY 1, 2),
block_l AS (SELECT game_id, seq, max_by(src, s_seq) AS blocked_by FROM (SELECT a.game_id, a.seq AS s_seq, a.action_id AS src, max(b.seq) AS seq FROM actions a JOIN actions b
  ON a.game_id = b.game_id AND a.period = b.period AND a.team_id <> b.team_id AND b.seq < a.seq WHERE a.action_code = 'FV' AND b.action_code IN ('2FGA', '3FGA') GROUP BY 1, 2, 3) GROUP BY 1, 2),
rebound_l AS (SELECT game_id, seq, max_by(src, s_seq) AS leads_to_rebound FROM (SELECT a.game_id, a.seq AS s_seq, a.action_id AS src, max(b.seq) AS seq FROM actions a JOIN actions b
  ON a.game_id = b.game_id AND b.seq < a.seq WHERE a.action_code IN ('O', 'D') AND b.action_code IN ('2FGA', '3FGA', 'FTA') GROUP BY 1, 2, 3) GROUP BY 1, 2),
reach AS (SELECT a.game_id, a.seq AS s_seq, a.action_id AS src, a.action_code, b.seq, b.action_id AS dst, abs(a.seconds_remaining - b.seconds_remaining) > 3 AS far,
  CASE a.action_code WHEN 'ST' THEN b.action_code = 'TO' AND a.team_id <> b.team_id ELSE b.action_code = 'OF' END AS hit
  FROM actions a JOIN actions b ON a.game_id = b.game_id AND a.period = b.period AND b.seq < a.seq WHERE a.action_code IN ('ST', 'TO')),
near AS (SELECT game_id, s_seq, src, action_code, max(seq) FILTER (hit AND NOT far) AS seq, max_by(dst, seq) FILTER (hit AND NOT far) AS dst, max(seq) FILTER (far) AS stop FROM reach GROUP BY ALL),
steal_l AS (SELECT game_id, seq, max_by(src, s_seq) AS caused_by_steal FROM near WHERE action_code = 'ST' AND seq IS NOT NULL AND (stop IS NULL OR seq > stop) GROUP BY 1, 2),
foul_l AS (SELECT game_id, s_seq AS seq, dst AS caused_by_foul FROM near WHERE action_code = 'TO' AND seq IS NOT NULL AND (stop IS NULL OR seq > stop)),
linked AS (SELECT * FROM actions LEFT JOIN assist_l USING (game_id, seq) LEFT JOIN block_l USING (game_id, seq) LEFT JOIN rebound_l USING (game_id, seq)
  LEFT JOIN steal_l USING (game_id, seq) LEFT JOIN foul_l USING (game_id, seq))"""

POSSESSIONS_SQL = """
p0 AS (SELECT game_id, seq, team_id, original_event_id, action_class IN ('PeriodStart', 'PeriodEnd', 'GameEnd') AS boundary, lag(original_event_id) OVER (PARTITION BY game_id ORDER BY seq) AS previous,
  action_code IN ('2FGM', '2FGA', '3FGM', '3FGA', 'FTM', 'FTA', 'TO', 'O', 'OF', 'AS', 'RV', 'D', 'ST') AS control FROM actions),
p1 AS (SELECT *, sum(boundary::INT) OVER (PARTITION BY game_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment FROM p0),
p2 AS (SELECT *, last_value(CASE WHEN control THEN team_id END IGNORE NULLS) OVER (PARTITION BY game_id, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM p1 WHERE NOT boundary),
p3 AS (SELECT *, sum((control AND team_id IS DISTINCT FROM holder)::INT) OVER (PARTITION BY game_id, segment ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM p2),
possessions AS (SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY min(seq)) AS possession_seq, min_by(team_id, seq) AS team_id, first(previous ORDER BY seq) AS starts_after,
  max_by(original_event_id, seq) AS ends_with, list(original_event_id ORDER BY seq) AS contains_action FROM p3 WHERE run > 0 GROUP BY game_id, segment, run)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def simple(name: str, sql: str, build: Callable[[DataFrame], DataFrame], linked: bool | str = False, lined: bool = False, only: Callable[[], Column] | None = None) -> None:
    """A query over the actions, or over them with their links (all or those named) or lineups (of those actions only)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = views.actions(spark, sf_dir)
        if linked:
            a = links.link_actions(a, links.LINKS if linked is True else tuple(linked.split()))
        if lined:
            a = lineups.lineup_at_action(a, views.starters(a), only() if only else None)
        return build(a)

    parts = [ACTIONS_SQL] + [LINKS_SQL] * bool(linked) + [LINEUPS_SQL] * lined
    register(name, with_(*parts) + sql)(run)


simple("actions", " SELECT * FROM actions", lambda a: a)
simple(
    "assist_duos",
    """ SELECT passer, scorer, sum(points) AS points, count(*) AS assists FROM (SELECT DISTINCT a.player_id AS passer, s.player_id AS scorer, s.action_id, s.points FROM linked s JOIN linked a ON s.assist_id = a.action_id
    WHERE s.points IS NOT NULL) GROUP BY 1, 2 ORDER BY points DESC, passer, scorer LIMIT 10""",
    reports.assist_duos,
    linked="assist_id",
)
_BY = " SELECT {k}, sum(points) AS points, count(*) AS scoring_actions FROM actions WHERE points IS NOT NULL AND {w} GROUP BY 1 ORDER BY points DESC, {k} LIMIT {n}"
simple("second_chance_points", _BY.format(k="player_id", w="is_second_chance", n=10), reports.second_chance_points)
simple("fast_break_points", _BY.format(k="player_id", w="is_fast_break", n=10), reports.fast_break_points)
simple("points_off_turnovers", _BY.format(k="team_id", w="is_from_turnover", n=1000), reports.points_off_turnovers)
simple("scorers", _BY.format(k="player_id", w="points > 0", n=20), reports.scorers)
simple("clutch_performers", _BY.format(k="player_id", w="period = '4th' AND abs(home_score - road_score) <= 5", n=10), reports.clutch_performers)
simple("q1_last_two_minutes", _BY.format(k="player_id", w="season_code = 'E2023' AND period = '4th' AND seconds_remaining <= 120", n=100000), lambda a: reports.q1(a, "E2023"))
_DISTINCT = " SELECT {k}, count(DISTINCT action_id) AS n FROM actions WHERE {w} GROUP BY ALL"
simple("q2_fourth_threes", _DISTINCT.format(k="team_id", w="period = '4th' AND action_class = 'ThreePointShotMade'"), reports.q2)
simple("q3_threes_by_period", _DISTINCT.format(k="period", w="action_class = 'ThreePointShotMade'"), reports.q3)
simple("q4_turnovers_by_period", _DISTINCT.format(k="period", w="action_class = 'Turnover'"), reports.q4)
simple("q7_threes_by_zone", _DISTINCT.format(k="team_id, shot_zone", w="action_class = 'ThreePointShotMade'"), reports.q7)
_PCT = """ SELECT {k}, makes, attempts, round(100.0 * makes / attempts, 2) AS percentage FROM (SELECT {k}, count(*) FILTER (contains(action_class, 'Made')) AS makes, count(*) AS attempts
  FROM (SELECT DISTINCT {k}, action_id, action_class FROM actions WHERE {w}) GROUP BY {k}) WHERE attempts >= {n}"""
simple("q8_paint_percentage", _PCT.format(k="player_id", w="shot_zone IN ('A', 'B', 'C') AND contains(action_class, 'TwoPointShot')", n=3), lambda a: reports.q8(a, 3))
simple("shooting_percentage", _PCT.format(k="team_id", w="contains(action_class, 'PointShot')", n=0), lambda a: reports.shooting_percentage(a, ["team_id"]))
simple(
    "blocks",
    """ SELECT b.player_id AS blocker, s.player_id AS shooter, count(DISTINCT b.action_id) AS n FROM linked b LEFT JOIN linked s ON s.blocked_by = b.action_id WHERE b.action_class = 'Block' GROUP BY ALL
    ORDER BY n DESC, blocker, shooter NULLS FIRST LIMIT 10""",
    reports.blocks,
    linked="blocked_by",
)
simple("dataset_totals", " SELECT count(DISTINCT game_id) AS games, count(DISTINCT action_id) AS actions, count(DISTINCT player_id) AS players, count(DISTINCT team_id) AS teams FROM actions", reports.dataset_totals)
simple(
    "dataset_statistics",
    """ SELECT 'season' AS level, season_code AS key, count(DISTINCT action_id) AS n_actions FROM actions GROUP BY 2 UNION ALL SELECT 'class', action_class, count(DISTINCT action_id) FROM actions GROUP BY 2
    UNION ALL SELECT 'game', game_id, count(DISTINCT action_id) FROM actions GROUP BY 2""",
    reports.dataset_statistics,
)
simple("summary_by_class", " SELECT action_class, count(*) AS n, coalesce(sum(points), 0) AS points FROM actions GROUP BY 1", reports.summary_by_class)
simple("summary_by_period", " SELECT period, count(*) AS n, coalesce(sum(points), 0) AS points, CAST(left(period, 1) AS INTEGER) AS place FROM actions GROUP BY 1", reports.summary_by_period)
simple(
    "shot_summary",
    """ SELECT count(*) AS shots, count(*) FILTER (contains(action_class, 'Made')) AS made, count(*) FILTER (NOT (coord_x = -1 AND coord_y = -1)) AS mapped,
    round(100.0 * count(*) FILTER (contains(action_class, 'Made')) / count(*), 2) AS percentage FROM actions WHERE action_code IN ('2FGM', '2FGA', '3FGM', '3FGA', 'FTM', 'FTA')""",
    reports.shot_summary,
)
simple("available_periods", " SELECT DISTINCT period, CAST(left(period, 1) AS INTEGER) AS place FROM actions", lambda a: reports.available_periods(a.where(scope.by_kind("shots")), a))
simple("points_with_total", " SELECT team_id, player_id, points, sum(points) OVER (PARTITION BY team_id) AS total FROM (SELECT team_id, player_id, sum(points) AS points FROM actions WHERE points IS NOT NULL GROUP BY ALL)", lambda a: reports.with_total(reports.points_by(a, ["team_id", "player_id"], None, None).drop("scoring_actions"), ["team_id"], "points"))
simple(
    "ranked_scorers",
    """, p AS (SELECT game_id, player_id, sum(points) AS points FROM actions WHERE points IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rank, lead(points) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY game_id ORDER BY points DESC, player_id))
    SELECT game_id, player_id, points, rank, coalesce(max(CASE WHEN rank = 5 THEN points IS NOT DISTINCT FROM nxt END) OVER (PARTITION BY game_id), FALSE) AS tie_at_cut FROM r""",
    lambda a: reports.ranked(reports.points_by(a, ["game_id", "player_id"], None, None).drop("scoring_actions"), "points", "player_id", ["game_id"]),
)
simple(
    "first_made_three",
    " SELECT game_id, min_by(action_id, seq) AS action_id, min_by(player_id, seq) AS player_id, min_by(coalesce(assist_id, '-'), seq) AS assist_id FROM linked WHERE action_class = 'ThreePointShotMade' GROUP BY 1",
    lambda a: reports.first_made_three(a.withColumn("assist_id", F.coalesce("assist_id", F.lit("-")))),
    linked="assist_id",
)
simple("play_by_play_page", " SELECT action_id, seq, period, clock, action_class FROM actions WHERE game_id = '2024-01-10' ORDER BY seq LIMIT 50 OFFSET 50", lambda a: reports.page(reports.play_by_play(a, "2024-01-10", linked=False).select("action_id", "seq", "period", "clock", "action_class"), ["seq"], 50))
simple(
    "plausible_comebacks",
    """ SELECT action_id, CASE WHEN home_score < road_score THEN 'home' WHEN home_score > road_score THEN 'road' END AS trailing FROM actions WHERE action_code = 'TOUT' AND period = '4th' AND seconds_remaining BETWEEN 60 AND 300
    AND abs(home_score - road_score) BETWEEN 1 AND 6 AND abs(home_score - road_score) * 30 <= seconds_remaining""",
    lambda a: a.where(scope.plausible_comeback()).select("action_id", scope.trailing_side().alias("trailing")),
)
simple("in_scope_clock", " SELECT action_id FROM actions WHERE season_code = 'E2023' AND game_code IN ('3', '4') AND period IN ('3rd', '4th') AND seconds_remaining BETWEEN 120 AND 300", lambda a: scope.in_scope(a, "E2023", "3,4").where(scope.in_half(2) & scope.in_clock(5, 2)).select("action_id"))
simple("score_tied", " SELECT action_id FROM actions WHERE home_score = road_score AND seconds_remaining <= 60", lambda a: a.where(scope.score_tied() & scope.last_seconds(60)).select("action_id"))
simple(
    "filter_shots",
    """ SELECT action_id FROM actions WHERE action_code IN ('2FGM', '3FGM', 'FTM') AND period IN ('1st', '2nd') AND NOT (team_id = home_team AND contains(action_class, 'ThreePoint')) AND NOT (team_id = road_team AND is_fast_break)""",
    lambda a: scope.filter_shots(a, made=True, periods=["1st", "2nd"], rules={"home": {"three": False, "two": True}, "road": {"fast_break": False}}).select("action_id"),
)
simple("filter_actions", " SELECT action_id FROM actions WHERE action_code IN ('O', 'D', 'ST') AND period = '2nd'", lambda a: scope.filter_actions(a, categories=["rebounds", "steals"], period="2nd").select("action_id"))
simple("any_match", " SELECT count(*) > 0 AS any_match FROM actions WHERE home_score = 3 AND road_score = 3", lambda a: scope.any_match(a.where("home_score = 3 and road_score = 3")))

_LINKED_COLS = "action_id, assist_id, blocked_by, leads_to_rebound, caused_by_steal, caused_by_foul"
simple("link_actions", f" SELECT {_LINKED_COLS} FROM linked", lambda a: a.select(*_LINKED_COLS.split(", ")), linked=True)
simple(
    "misses_rebounded",
    " SELECT s.action_id, s.player_id FROM linked s JOIN linked r ON s.leads_to_rebound = r.action_id WHERE r.action_class = 'OffensiveRebound'",
    lambda a: links.misses_rebounded(a, "OffensiveRebound").select("action_id", "player_id"),
    linked="leads_to_rebound",
)
simple("assists_near_scores", " SELECT a.action_id AS assist_id, s.action_id AS score_id FROM linked a JOIN linked s ON s.assist_id = a.action_id AND s.period = a.period AND s.game_id = a.game_id WHERE abs(a.seconds_remaining - s.seconds_remaining) <= 5", links.assists_near_scores, linked="assist_id")
simple(
    "resolve_assists",
    " SELECT action_id, action_id AS assist_id FROM linked WHERE action_class = 'Assist' UNION SELECT action_id, assist_id FROM linked WHERE assist_id IS NOT NULL",
    lambda a: links.resolve_assists(a, a),
    linked="assist_id",
)
simple(
    "linked_pairs",
    " SELECT t.action_id AS turnover, s.player_id AS thief FROM linked t JOIN linked s ON t.caused_by_steal = s.action_id",
    lambda a: links.linked_pairs(a, "caused_by_steal").select(F.col("action.action_id").alias("turnover"), F.col("other.player_id").alias("thief")),
    linked="caused_by_steal",
)
simple("assisted_by", " SELECT s.action_id FROM linked s JOIN linked a ON s.assist_id = a.action_id WHERE a.player_id = 'P8'", lambda a: scope.assisted_by(a, "P8").select("action_id"), linked="assist_id")
_WAS = ", d AS (SELECT *, home_score - road_score AS now, coalesce(lag(home_score - road_score) OVER (PARTITION BY game_id ORDER BY seq), 0) AS was FROM actions)"
simple("q12_lead_taken", _WAS + " SELECT action_id FROM d WHERE points IS NOT NULL AND period = '4th' AND ((was <= 0 AND now > 0) OR (was >= 0 AND now < 0))", lambda a: links.lead_changes(a).where(scope.in_period("4th")).select("action_id"))
simple("lead_flips", _WAS + " SELECT action_id FROM d WHERE points IS NOT NULL AND sign(was) * sign(now) < 0", lambda a: links.lead_changes(a, strict=True).select("action_id"))

_LINE = "coalesce(home_lineup, '') AS home_lineup, coalesce(road_lineup, '') AS road_lineup"
simple("lineup_at_action", f" SELECT action_id, {_LINE} FROM actions LEFT JOIN lineup_at USING (game_id, seq)", lambda a: a.select("action_id", F.array_join("home_lineup", "_").alias("home_lineup"), F.array_join("road_lineup", "_").alias("road_lineup")), lined=True)
simple("player_on_court", " SELECT DISTINCT action_id FROM actions JOIN on_court o USING (game_id, seq) WHERE o.player_id = 'P3'", lambda a: lineups.player_on_court(a, "P3").select("action_id"), lined=True)
simple("player_not_on_court", " SELECT action_id FROM actions WHERE (game_id, seq) NOT IN (SELECT (game_id, seq) FROM on_court WHERE player_id = 'P3')", lambda a: lineups.player_not_on_court(a, "P3").select("action_id"), lined=True)
simple("all_present", " SELECT action_id FROM actions JOIN on_court o USING (game_id, seq) WHERE o.player_id IN ('P0', 'P1', 'P2') GROUP BY 1 HAVING count(DISTINCT o.player_id) = 3", lambda a: lineups.all_present(a, ["P0", "P1", "P2"]).select("action_id"), lined=True)
simple(
    "q11_opposing",
    """ SELECT action_id FROM actions a WHERE points IS NOT NULL AND EXISTS (SELECT 1 FROM on_court x JOIN on_court y ON x.game_id = y.game_id AND x.seq = y.seq AND x.side <> y.side
    WHERE x.game_id = a.game_id AND x.seq = a.seq AND x.player_id = 'P2' AND y.player_id = 'P1')""",
    lambda a: lineups.opposing(a, "P2", "P1").select("action_id"),
    lined=True,
    only=lambda: F.col("points").isNotNull(),
)
SIDES_SQL = ", sides AS (SELECT a.*, 'home' AS lside, home_team AS lineup_team, home_lineup AS lineup FROM actions a LEFT JOIN lineup_at USING (game_id, seq) UNION ALL SELECT a.*, 'road', road_team, road_lineup FROM actions a LEFT JOIN lineup_at USING (game_id, seq))"
simple("top_lineups", SIDES_SQL + " SELECT lineup_team, lineup, sum(points) AS points FROM sides WHERE lineup_team = team_id AND points IS NOT NULL GROUP BY ALL ORDER BY points DESC, lineup_team, lineup LIMIT 10", lineups.top_lineups, lined=True, only=lambda: F.col("points").isNotNull())
simple("q5_fourth_lineups", SIDES_SQL + " SELECT lineup_team, lineup, count(DISTINCT game_id) AS n FROM sides WHERE period = '4th' GROUP BY ALL ORDER BY n DESC, lineup_team, lineup LIMIT 20", lambda a: reports.q5(lineups.either_side(a)), lined=True, only=lambda: scope.in_period("4th"))
_PM = "coalesce(sum(points) FILTER (team_id = lineup_team), 0) AS points_for, coalesce(sum(points) FILTER (team_id <> lineup_team), 0) AS points_against, count(*) AS n_actions, coalesce(sum(points) FILTER (team_id = lineup_team), 0) - coalesce(sum(points) FILTER (team_id <> lineup_team), 0) AS difference"
simple("lineup_plus_minus", SIDES_SQL + f" SELECT lineup_team, {_PM} FROM sides WHERE list_has_all(string_split(lineup, '_'), ['P0', 'P2']) GROUP BY 1", lambda a: lineups.lineup_plus_minus(a, ["P0", "P2"]), lined=True)
simple("rank_lineups", SIDES_SQL + f" SELECT lineup_team, lineup, {_PM} FROM sides WHERE len(string_split(lineup, '_')) = 5 GROUP BY ALL ORDER BY difference DESC, lineup_team, lineup LIMIT 10", lambda a: lineups.rank_lineups(a, "difference"), lined=True)
simple("roster_seen", " SELECT DISTINCT o.game_id, CASE o.side WHEN 'home' THEN a.home_team ELSE a.road_team END AS team_id, o.player_id FROM on_court o JOIN actions a USING (game_id, seq)", lineups.roster_seen, lined=True)
simple(
    "team_points_with_player",
    " SELECT team_id, sum(points) AS points FROM actions a WHERE team_id = 'T1' AND points IS NOT NULL AND EXISTS (SELECT 1 FROM on_court o WHERE o.game_id = a.game_id AND o.seq = a.seq AND o.player_id = 'P0') GROUP BY 1",
    lambda a: lineups.team_points_with_player(a, "T1", "P0"),
    lined=True,
    only=lambda: (F.col("team_id") == "T1") & F.col("points").isNotNull(),
)
simple(
    "q6_shooting_by_teammate",
    """ SELECT teammate, makes, attempts, round(100.0 * makes / attempts, 2) AS percentage FROM (SELECT o.player_id AS teammate, count(*) FILTER (contains(action_class, 'Made')) AS makes, count(*) AS attempts
    FROM actions a JOIN on_court o ON o.game_id = a.game_id AND o.seq = a.seq AND o.side = CASE WHEN a.team_id = a.home_team THEN 'home' ELSE 'road' END AND o.player_id <> a.player_id
    WHERE a.player_id = 'P0' AND contains(action_class, 'PointShot') GROUP BY 1)""",
    lambda a: lineups.shooting_by_teammate(a, "P0"),
    lined=True,
    only=lambda: (F.col("player_id") == "P0") & F.col("action_class").contains("PointShot"),
)
simple(
    "starting_lineup_on_court",
    """, f AS (SELECT game_id, side, player_id FROM on_court WHERE seq = 1) SELECT action_id FROM actions a WHERE (a.home_team = 'T2' AND NOT EXISTS (SELECT 1 FROM f WHERE f.game_id = a.game_id AND f.side = 'home'
    AND NOT EXISTS (SELECT 1 FROM on_court o WHERE o.game_id = a.game_id AND o.seq = a.seq AND o.side = 'home' AND o.player_id = f.player_id)))""",
    lambda a: lineups.starting_lineup_on_court(a, "T2").select("action_id"),
    lined=True,
)


def _with_players(name: str, sql: str, build: Callable[[DataFrame, DataFrame], DataFrame], lined: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = views.actions(spark, sf_dir)
        if lined:
            a = lineups.lineup_at_action(a, views.starters(a))
        return build(a, views.players(spark, sf_dir))

    register(name, with_(ACTIONS_SQL, PLAYERS_SQL, *[LINEUPS_SQL] * lined) + sql)(run)


_CM = "CAST(round(CAST(height AS DECIMAL(10, 4)) * 100) AS INTEGER)"
_with_players("all_members", f" SELECT action_id FROM actions a JOIN on_court o USING (game_id, seq) LEFT JOIN players p ON p.player_id = o.player_id GROUP BY 1 HAVING bool_and(coalesce({_CM} >= 176, FALSE))", lambda a, p: lineups.all_members(a, p, "ten", (F.round(F.col("height").cast("decimal(10,4)") * 100).cast("int") >= 176)).select("action_id"), lined=True)
_with_players(
    "count_members",
    f""" SELECT action_id FROM actions a JOIN on_court o ON o.game_id = a.game_id AND o.seq = a.seq AND o.side <> CASE WHEN a.team_id = a.home_team THEN 'home' ELSE 'road' END LEFT JOIN players p ON p.player_id = o.player_id
    GROUP BY 1 HAVING count(*) FILTER ({_CM} > 200) >= 3 AND count(*) FILTER (height IS NULL) = 0""",
    lambda a, p: lineups.count_members(a, p, "opponents", F.round(F.col("height").cast("decimal(10,4)") * 100).cast("int") > 200, 3, exactly=False).select("action_id"),
    lined=True,
)
_with_players("mean_height_on_court", " SELECT action_id, ((2 * sum({0}) + count(*)) // (2 * count(*))) / 100.0 AS mean_height, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM actions JOIN on_court o USING (game_id, seq) JOIN players p ON p.player_id = o.player_id AND height IS NOT NULL GROUP BY 1".replace("{0}", _CM), lineups.mean_height_on_court, lined=True)
_with_players("q13_late_threes", f" SELECT action_id FROM actions JOIN players USING (player_id) WHERE country = 'NATION_6' AND {_CM} < 200 AND action_class = 'ThreePointShotMade' AND seconds_remaining <= 60 AND abs(home_score - road_score) < 5", lambda a, p: reports.q13(a, p, "NATION_6").select("action_id"))
_with_players("q14_young_lead_changes", _WAS + " SELECT action_id FROM d JOIN players USING (player_id) WHERE points IS NOT NULL AND sign(was) * sign(now) < 0 AND seconds_remaining <= 60 AND birth_date > DATE '1995-12-31'", lambda a, p: reports.q14(links.lead_changes(a, strict=True), p, "1995-12-31").select("action_id"))
_with_players("scorers_with_names", " SELECT player_id, points, scoring_actions, name FROM (SELECT player_id, sum(points) AS points, count(*) AS scoring_actions FROM actions WHERE points IS NOT NULL GROUP BY 1) LEFT JOIN players USING (player_id)", reports.aggregate_then_label)
_with_players("by_player_name", " SELECT action_id FROM actions JOIN players USING (player_id) WHERE contains(lower(name), 'customer') AND contains(lower(name), '000000012')", lambda a, p: scope.by_player(a, p, "customer 000000012").select("action_id"))
_with_players("name_match", " SELECT player_id FROM players WHERE name = 'Customer#000000007'", lambda a, p: p.where(scope.name_match("customer#000000007")).select("player_id"))
_with_players(
    "shots_with_candidates",
    " SELECT s.action_id, game_id, s.player_id, name, action_class, shot_zone FROM (SELECT * FROM actions WHERE action_code IN ('2FGM', '2FGA', '3FGM', '3FGA', 'FTM', 'FTA') ORDER BY CAST(action_id AS BIGINT) LIMIT 500) s LEFT JOIN players USING (player_id)",
    reports.shots_with_candidates,
)


@register("possessions", with_(ACTIONS_SQL, POSSESSIONS_SQL) + " SELECT game_id, possession_seq, team_id, starts_after, ends_with, array_to_string(contains_action, ',') AS contains_action FROM possessions")
def _possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = possessions.possessions(views.actions(spark, sf_dir))
    return p.withColumn("contains_action", F.array_join(F.transform("contains_action", lambda x: x.cast("string")), ","))


_OR = ", hit AS (SELECT DISTINCT p.game_id, p.possession_seq, p.team_id FROM (SELECT game_id, possession_seq, team_id, unnest(contains_action) AS e FROM possessions) p JOIN actions a ON a.game_id = p.game_id AND a.original_event_id = p.e AND a.action_class = 'OffensiveRebound')"


@register("q9_final_possessions", with_(ACTIONS_SQL, POSSESSIONS_SQL, GAMES_SQL) + _OR + " SELECT game_id, possession_seq, team_id FROM hit WHERE game_id IN (SELECT game_id FROM games WHERE phase_group = 'Championship Game')")
def _q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    hit = possessions.possessions_with(possessions.possessions(a), a, "OffensiveRebound")
    return reports.q9(hit, views.games(a).where("phase_group = 'Championship Game'")).select("game_id", "possession_seq", "team_id")


@register("q10_team_possessions", with_(ACTIONS_SQL, POSSESSIONS_SQL) + _OR + " SELECT team_id, count(*) AS n FROM hit GROUP BY 1")
def _q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return reports.q10(possessions.possessions_with(possessions.possessions(a), a, "OffensiveRebound"))


@register(
    "fast_breaks_after_turnovers",
    with_(ACTIONS_SQL, POSSESSIONS_SQL) + """ SELECT t.action_id AS turnover_id, s.action_id AS score_id FROM (SELECT game_id, starts_after, unnest(contains_action) AS e FROM possessions) p
    JOIN actions s ON s.game_id = p.game_id AND s.original_event_id = p.e AND s.points IS NOT NULL AND s.is_fast_break JOIN actions t ON t.game_id = p.game_id AND t.original_event_id = p.starts_after AND t.action_code = 'TO'""",
)
def _fast_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return links.fast_breaks_after_turnovers(a, possessions.possessions(a))


@register("game_list", with_(ACTIONS_SQL, GAMES_SQL) + """ SELECT game_id, season_code, game_code, home_score, road_score, stage, concat_ws(' · ', 'Game ' || game_code, stage, home_team || ' v ' || road_team) AS label
  FROM (SELECT *, CASE WHEN phase_group = 'Championship Game' THEN 'Final' WHEN phase_group = 'Semi-Finals' THEN 'Semi-final' WHEN phase = 'Final Four' THEN 'Final Four' ELSE 'Regular season' END AS stage FROM games)""")
def _game_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.game_list(views.games(views.actions(spark, sf_dir)))


#: Of each foul the drawn fouls it may take, latest first; then foul by foul what is left of them.
FOULS_SQL = """
fo AS (SELECT *, row_number() OVER (PARTITION BY game_id, period ORDER BY seq) AS k FROM actions WHERE action_code IN ('CM', 'OF', 'CMU')),
far AS (SELECT f.game_id, f.seq, coalesce(max(b.seq), 0) AS stop FROM fo f LEFT JOIN actions b ON b.game_id = f.game_id AND b.period = f.period AND b.seq < f.seq AND abs(b.seconds_remaining - f.seconds_remaining) > 3 GROUP BY ALL),
may AS (SELECT f.game_id, f.period, f.k, f.action_id, coalesce(list(d.action_id ORDER BY d.seq DESC) FILTER (d.action_id IS NOT NULL), []) AS drawn FROM fo f JOIN far x ON x.game_id = f.game_id AND x.seq = f.seq
  LEFT JOIN actions d ON d.game_id = f.game_id AND d.period = f.period AND d.action_code = 'RV' AND d.seq < f.seq AND d.seq > x.stop GROUP BY ALL),
took AS (SELECT game_id, period, k, action_id, drawn[1] AS got, CASE WHEN len(drawn) > 0 THEN [drawn[1]] ELSE [] END AS used FROM may WHERE k = 1
  UNION ALL SELECT game_id, period, k, action_id, n AS got, CASE WHEN n IS NULL THEN used ELSE list_append(used, n) END FROM (SELECT m.game_id, m.period, m.k, m.action_id, t.used, list_filter(m.drawn, lambda x: NOT list_contains(t.used, x))[1] AS n
    FROM took t JOIN may m ON m.game_id = t.game_id AND m.period = t.period AND m.k = t.k + 1)),
drawn_l AS (SELECT game_id, got AS action_id, action_id AS fouled_by FROM took WHERE got IS NOT NULL)"""


@register("foul_links", "WITH RECURSIVE" + ",".join([ACTIONS_SQL, FOULS_SQL]) + " SELECT * FROM drawn_l")
def _foul_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.foul_links(views.actions(spark, sf_dir))
