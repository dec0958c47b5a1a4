"""Registered queries of profiles, late-game scenarios, shots, and lineups in every scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import height_cm
from ..operators import lineups, links, profiles
from . import views
from .queries import LINKS_SQL, SIDES_SQL, register, simple
from .views import ACTIONS_SQL, LINEUPS_SQL, PLAYERS_SQL, with_

# Prose of three kinds: with verbs to complete and stale parts, achievements alone, and none.
_PROFILE_SQL = f"""WITH {PLAYERS_SQL}, n AS (SELECT *, CAST(substr(player_id, 2) AS INTEGER) AS k FROM players), p AS (SELECT player_id, name, country, CASE k % 4 WHEN 0 THEN 'Guard' WHEN 1 THEN 'Center' WHEN 2 THEN '' END AS position,
  CASE WHEN k % 5 <> 0 THEN ', born on ' || strftime(birth_date, '%-d %B %Y') ELSE '' END AS born, k FROM n)
  SELECT player_id, name, coalesce(position, '') AS position, country, [name || ' is a basketball ' || CASE WHEN coalesce(position, '') = '' THEN 'player' ELSE lower(position) END || born || '.'] || CASE k % 3
    WHEN 0 THEN ['He grew up in ' || country || '. He won ' || k || ' games. He joined Town for the 2020 season. He was named best. Fifth. Sixth. Seventh.'] WHEN 1 THEN ['Best scorer, ' || k || ' points. Champion.'] ELSE ['{profiles.NO_BIOGRAPHY}'] END AS paragraphs FROM p"""


@register("player_profiles", _PROFILE_SQL)
def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("player_id", 2, 20).cast("int")
    bio = F.concat(F.lit("<p>Grew up in "), "country", F.lit(".Won  "), n.cast("string"), F.lit(" games. He signed for the 2020 season by Town. Named best. He is still playing there. Fifth. Sixth.\nSeventh. Eighth.</p>"))
    p = views.players(spark, sf_dir).select(
        "player_id", "name", "country", F.when(n % 4 == 0, "Guard").when(n % 4 == 1, "Center").when(n % 4 == 2, "").alias("position"), F.when(n % 5 != 0, F.col("birth_date").cast("string")).otherwise("unknown").alias("birth_date"),
        F.when(n % 3 == 0, bio).when(n % 3 == 1, F.lit(" ")).alias("bio"), F.when(n % 3 == 1, F.concat(F.lit("Best scorer, "), n.cast("string"), F.lit(" points. <b>Champion.</b>"))).alias("achievements"),
    )
    return profiles.player_profiles(p)


simple(
    "late_scenarios",
    SIDES_SQL + """, t AS (SELECT *, home_score < road_score AS h FROM actions WHERE action_code = 'TOUT' AND period = '4th' AND seconds_remaining BETWEEN 60 AND 300 AND abs(home_score - road_score) BETWEEN 1 AND 6 AND abs(home_score - road_score) * 30 <= seconds_remaining),
    e AS (SELECT game_id, max_by(home_score, seq) AS hf, max_by(road_score, seq) AS rf FROM actions GROUP BY 1),
    m AS (SELECT DISTINCT game_id, lineup_team, unnest(string_split(lineup, '_')) AS player_id FROM sides WHERE lineup IS NOT NULL), r AS (SELECT game_id, lineup_team, list(player_id ORDER BY player_id) AS roster FROM m GROUP BY ALL)
    SELECT action_id, t.game_id, clock, CASE WHEN h THEN home_team ELSE road_team END AS user_team, CASE WHEN h THEN road_team ELSE home_team END AS opponent, CASE WHEN h THEN home_score ELSE road_score END AS user_score, CASE WHEN h THEN road_score ELSE home_score END AS opp_score,
      coalesce(roster, []) AS roster, CASE WHEN h THEN hf ELSE rf END AS user_final, CASE WHEN h THEN rf ELSE hf END AS opp_final, CASE WHEN h THEN hf > rf ELSE rf > hf END AS came_back
    FROM t JOIN e ON e.game_id = t.game_id LEFT JOIN r ON r.game_id = t.game_id AND r.lineup_team = CASE WHEN h THEN home_team ELSE road_team END""",
    profiles.late_scenarios,
    lined=True,
)


@register(
    "season_shots",
    with_(ACTIONS_SQL, LINKS_SQL, PLAYERS_SQL) + """ SELECT s.game_id, row_number() OVER (PARTITION BY s.game_id ORDER BY s.seq) AS number, s.action_id, s.period, s.clock, CASE WHEN s.team_id = s.home_team THEN 'home' ELSE 'road' END AS side, p.name AS shooter, q.name AS passer,
    s.action_code LIKE '%M' AS is_made, s.action_code LIKE '3%' AS is_three, s.shot_zone, s.coord_x, s.coord_y, s.is_fast_break, s.is_second_chance, s.is_from_turnover
    FROM linked s LEFT JOIN actions a ON a.action_id = s.assist_id LEFT JOIN players p ON p.player_id = s.player_id LEFT JOIN players q ON q.player_id = a.player_id WHERE s.action_code IN ('2FGM', '2FGA', '3FGM', '3FGA', 'FTM', 'FTA')""",
)
def _season_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.season_shots(links.link_actions(views.actions(spark, sf_dir), ("assist_id",)), views.players(spark, sf_dir))


_OWN = "o.side = CASE WHEN a.team_id = a.home_team THEN 'home' ELSE 'road' END"
_SCOPES = {"own": _OWN, "teammates": f"{_OWN} AND o.player_id <> a.player_id", "opponents": f"NOT ({_OWN})", "ten": "TRUE"}
_TALL = "CAST(round(CAST(height AS DECIMAL(10, 4)) * 100) AS INTEGER)"


def _of_scope(scope: str, above: int, k: int) -> None:
    members = f" FROM actions a JOIN on_court o ON o.game_id = a.game_id AND o.seq = a.seq AND {_SCOPES[scope]} LEFT JOIN players p ON p.player_id = o.player_id GROUP BY a.action_id"

    def of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        a = views.actions(spark, sf_dir)
        return lineups.lineup_at_action(a, views.starters(a)), views.players(spark, sf_dir)

    def all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, p = of(spark, sf_dir)
        return lineups.all_members(a, p, scope, height_cm("height") >= 180).select("action_id")

    def count_of(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, p = of(spark, sf_dir)
        return lineups.count_members(a, p, scope, height_cm("height") > above, k).select("action_id")

    base = with_(ACTIONS_SQL, PLAYERS_SQL, LINEUPS_SQL)
    register(f"all_members_{scope}", base + f" SELECT a.action_id{members} HAVING bool_and(coalesce({_TALL} >= 180, FALSE))")(all_of)
    register(f"count_members_{scope}", base + f" SELECT a.action_id{members} HAVING count(*) FILTER ({_TALL} > {above}) = {k} AND count(*) FILTER (height IS NULL) = 0")(count_of)


for _scope in _SCOPES:
    _of_scope(_scope, *((190, 5) if _scope == "ten" else (200, 2)))
simple(
    "all_present_one_lineup",
    " SELECT DISTINCT action_id FROM actions JOIN on_court o USING (game_id, seq) WHERE o.player_id IN ('P2', 'P4', 'P6') GROUP BY action_id, o.side HAVING count(DISTINCT o.player_id) = 3",
    lambda a: lineups.all_present(a, ["P2", "P4", "P6"], one_lineup=True).select("action_id"),
    lined=True,
)
