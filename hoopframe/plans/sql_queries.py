"""Registered queries that SQL alone answers, over the views and table functions of hoopframe.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import sql
from . import views
from .queries import LINKS_SQL, POSSESSIONS_SQL, SIDES_SQL, register
from .views import ACTIONS_SQL, LINEUPS_SQL, with_


def asked(name: str, text: str, oracle: str) -> None:
    """A query that is one SQL statement in Spark, and its DuckDB SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = views.actions(spark, sf_dir)
        sql.register(spark, a, views.starters(a), views.players(spark, sf_dir))
        return spark.sql(text)

    register(name, oracle)(run)


asked(
    "sql_scorers",
    "select s.rank, s.player_id, p.country, s.points, s.scoring_actions from scorers('E2023', 25) s left join players p using (player_id)",
    with_(ACTIONS_SQL) + """, t AS (SELECT player_id, sum(points) AS points, count(*) AS scoring_actions FROM actions WHERE points > 0 AND season_code = 'E2023' GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY points DESC, player_id) AS rank FROM t)
    SELECT rank, player_id, n_name AS country, points, scoring_actions FROM r LEFT JOIN (SELECT 'P' || c_custkey AS player_id, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) USING (player_id) WHERE rank <= 25""",
)
asked(
    "sql_shooting_by_region",
    """select shot_region(shot_zone, coord_x, coord_y) as region, min(period_place(period)) as first_period, count_if(action_class like '%Made') as makes, count(*) as attempts
    from actions where shot_zone <> '' group by 1""",
    with_(ACTIONS_SQL) + """ SELECT CASE WHEN shot_zone IN ('A', 'B', 'C') THEN 'paint' WHEN shot_zone IN ('D', 'E', 'F', 'G') THEN 'mid-range' WHEN shot_zone = 'H' AND coord_x <= -600 AND coord_y <= 175 THEN 'left corner'
    WHEN shot_zone = 'H' THEN 'left perimeter' WHEN shot_zone = 'I' THEN 'right perimeter' ELSE 'very long' END AS region, min(CAST(left(period, 1) AS INTEGER)) AS first_period, count(*) FILTER (contains(action_class, 'Made')) AS makes, count(*) AS attempts
    FROM actions WHERE shot_zone <> '' GROUP BY 1""",
)
asked(
    "sql_paint_shooting",
    "select * from shooting(null, 'TwoPointShot', 'ABC', 3)",
    with_(ACTIONS_SQL) + """, t AS (SELECT player_id, count(*) FILTER (contains(action_class, 'Made')) AS makes, count(*) AS attempts FROM actions WHERE contains(action_class, 'TwoPointShot') AND shot_zone IN ('A', 'B', 'C') GROUP BY 1)
    SELECT player_id, makes, attempts, round(100.0 * makes / attempts, 2) AS percentage FROM t WHERE attempts >= 3""",
)
asked(
    "sql_passing_pairs",
    "select p.passer, p.scorer, p.points, p.assists, c.points as clutch_points from passing_pairs('E2024', 20) p left join clutch_points('E2024', 5) c on c.player_id = p.scorer",
    with_(ACTIONS_SQL, LINKS_SQL) + """, t AS (SELECT a.player_id AS passer, s.player_id AS scorer, sum(s.points) AS points, count(*) AS assists FROM linked s JOIN linked a ON s.assist_id = a.action_id WHERE s.points IS NOT NULL AND s.season_code = 'E2024' GROUP BY 1, 2),
    c AS (SELECT player_id, sum(points) AS clutch_points FROM actions WHERE points IS NOT NULL AND season_code = 'E2024' AND period = '4th' AND abs(home_score - road_score) <= 5 GROUP BY 1)
    SELECT passer, scorer, points, assists, clutch_points FROM (SELECT *, row_number() OVER (ORDER BY points DESC, passer, scorer) AS rank FROM t) LEFT JOIN c ON c.player_id = scorer WHERE rank <= 20""",
)
asked(
    "sql_points_with",
    "select w.lineup_team, w.points, p.n from points_with(null, 'P12') w join possessions_with('OffensiveRebound') p on p.team_id = w.lineup_team",
    with_(ACTIONS_SQL, LINEUPS_SQL, POSSESSIONS_SQL) + SIDES_SQL + """, w AS (SELECT lineup_team, sum(points) AS points FROM sides WHERE list_contains(string_split(lineup, '_'), 'P12') AND team_id = lineup_team AND points IS NOT NULL GROUP BY 1),
    m AS (SELECT game_id, possession_seq, team_id, unnest(contains_action) AS original_event_id FROM possessions), p AS (SELECT m.team_id, count(DISTINCT (m.game_id, m.possession_seq)) AS n FROM m JOIN actions a USING (game_id, original_event_id) WHERE a.action_class = 'OffensiveRebound' GROUP BY 1)
    SELECT lineup_team, points, n FROM w JOIN p ON p.team_id = lineup_team""",
)
