"""The library from SQL: views over a session's tables, and functions and table functions that take parameters.

    sql.register(spark, acts, starters, players)
    spark.sql("select * from scorers('E2023', 10)")

The functions are SQL functions, so Spark plans through them: their filters
reach the scan of the actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.lineups import either_side, lineup_at_action
from .operators.links import link_actions
from .operators.possessions import possessions

VIEWS = ("actions", "linked_actions", "lineup_actions", "lineup_members", "possessions", "possession_actions", "games", "players")


def register(spark: SparkSession, acts: DataFrame, starters: DataFrame, players: DataFrame) -> None:
    """Makes VIEWS of the session's actions, starters (game_id, side, player_id) and players, and the functions of FUNCTIONS.

    The views are plans, not copies; what a query doesn't ask for isn't computed.
    """
    acts.createOrReplaceTempView("actions")
    players.createOrReplaceTempView("players")
    link_actions(acts).createOrReplaceTempView("linked_actions")
    sides = either_side(lineup_at_action(acts, starters))
    sides.createOrReplaceTempView("lineup_actions")
    spark.sql("create or replace temporary view lineup_members as select game_id, seq, action_id, side, lineup_team, explode(lineup) as player_id from lineup_actions")
    possessions(acts).createOrReplaceTempView("possessions")
    spark.sql("create or replace temporary view possession_actions as select game_id, possession_seq, team_id, explode(contains_action) as original_event_id from possessions")
    spark.sql("create or replace temporary view games as select game_id, season_code, game_code, home_team, road_team, count(*) as n_actions, max(home_score) as home_score, max(road_score) as road_score from actions group by all")
    for text in FUNCTIONS.values():
        spark.sql("create or replace temporary function " + text)


_SCOPE = "(season is null or season_code = season)"
_LAST = "period = '4th' and abs(home_score - road_score)"



def _first(columns: str, order: str) -> str:
    """The first n rows of t with their rank, which Spark takes as a top-n of each task and then of all."""
    return f"select {columns}, rank from (select *, row_number() over (order by {order}) as rank from t) where rank <= n"


# name: signature and body. A null season stands for all.
FUNCTIONS = {
    "period_place": "period_place(period string) returns int return case when period rlike '^[1-4](st|nd|rd|th)$' then cast(left(period, 1) as int) when period = 'OT' then 5 when period rlike '^[0-9]+OT$' then 4 + cast(rtrim('OT', period) as int) else 99 end",
    "shot_region": """shot_region(zone string, x double, y double) returns string return case when zone in ('A', 'B', 'C') then 'paint' when zone in ('D', 'E', 'F', 'G') then 'mid-range'
        when zone = 'H' and x <= -600 and y <= 175 then 'left corner' when zone = 'H' then 'left perimeter' when zone = 'I' then 'right perimeter' when zone = 'J' then 'very long' end""",
    "scorers": f"""scorers(season string, n int) returns table (player_id string, points bigint, scoring_actions bigint, rank int) return
        with t as (select player_id, sum(points) as points, count(*) as scoring_actions from (select distinct player_id, action_id, points from actions where points > 0 and {_SCOPE}) group by player_id)
        {_first("player_id, points, scoring_actions", "points desc, player_id")}""",
    "shooting": f"""shooting(season string, kind string, zones string, least int) returns table (player_id string, makes bigint, attempts bigint, percentage double) return
        select player_id, makes, attempts, round(100.0D * makes / attempts, 2) from (select player_id, count_if(action_class like '%Made') as makes, count(*) as attempts
        from (select distinct player_id, action_id, action_class from actions where contains(action_class, kind) and (zones is null or contains(zones, nullif(shot_zone, ''))) and {_SCOPE}) group by player_id) where attempts >= least""",
    "clutch_points": f"""clutch_points(season string, margin int) returns table (player_id string, points bigint, actions bigint) return
        select player_id, sum(points), count(*) from (select distinct player_id, action_id, points from actions where points is not null and {_LAST} <= margin and {_SCOPE}) group by player_id""",
    "passing_pairs": f"""passing_pairs(season string, n int) returns table (passer string, scorer string, points bigint, assists bigint, rank int) return
        with t as (select a.player_id as passer, s.player_id as scorer, sum(s.points) as points, count(*) as assists
        from (select * from linked_actions where assist_id is not null and points is not null and {_SCOPE}) s join actions a on a.action_id = s.assist_id group by all)
        {_first("passer, scorer, points, assists", "points desc, passer, scorer")}""",
    "points_with": f"""points_with(season string, player string) returns table (lineup_team string, points bigint) return
        select lineup_team, sum(points) from lineup_actions where array_contains(lineup, player) and team_id = lineup_team and points is not null and {_SCOPE} group by lineup_team""",
    "possessions_with": """possessions_with(wanted string) returns table (team_id string, n bigint) return
        select p.team_id, count(distinct p.game_id, p.possession_seq) from possession_actions p join actions a on a.game_id = p.game_id and a.original_event_id = p.original_event_id where a.action_class = wanted group by p.team_id""",
}
