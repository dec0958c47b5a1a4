"""The play-by-play tables of the library, derived from the driver's tables, and the same derivation as DuckDB SQL.

The events of a day by GAME_USERS users are a game, so that games keep their size as the table grows; integer
arithmetic only, so that both agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import action_class, points_of

GAME_USERS = 150


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _pick(key: Column, *values: str) -> Column:
    out = F.when(key == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, v)
    return out


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions table: one row per event, in order within its game."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    block = F.floor(F.col("user_id") / GAME_USERS)
    game = F.concat(F.to_date("ts").cast("string"), F.when(block > 0, F.concat(F.lit("-"), block.cast("string"))).otherwise(""))
    e = e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), game.alias("game_id"), F.dayofmonth("ts").alias("day"), block.alias("block"), second.alias("second"))
    code = (
        F.when(F.col("event_type") == "purchase", _pick(F.col("k") % 6, "2FGM", "3FGM", "FTM", "2FGA", "3FGA", "FTA"))
        .when(F.col("event_type") == "view", _pick(F.col("k") % 5, "AS", "AS", "CM", "RV", "OF"))
        .when(F.col("event_type") == "click", _pick(F.col("k") % 4, "D", "O", "ST", "FV"))
        .when(F.col("event_type") == "error", F.when(F.col("k") % 10 == 0, "TOUT").when(F.col("k") % 10 == 1, "EP").when(F.col("k") % 10 == 2, "BP").otherwise("TO"))
        .otherwise(_pick(F.col("k") % 2, "IN", "OUT"))
    )
    order = Window.partitionBy("game_id").orderBy("ts", "event_id")
    remaining = 600 - F.floor((F.col("second") % 21600) / 36).cast("int")
    home, road = F.concat(F.lit("T"), (F.col("day") % 4).cast("string")), F.concat(F.lit("T"), (4 + F.col("day") % 4).cast("string"))
    shot = F.col("action_code").isin("2FGM", "3FGM", "FTM", "2FGA", "3FGA", "FTA")
    field = F.col("action_code").isin("2FGM", "3FGM", "2FGA", "3FGA")
    e = e.withColumn("action_code", code).withColumn("seq", F.row_number().over(order))  # the window keeps the code from being inlined below
    a = e.withColumns({ "period": _pick(F.floor(F.col("second") / 21600), "1st", "2nd", "3rd", "4th"), "seconds_remaining": remaining, "home_team": home, "road_team": road})
    a = a.withColumns({
        "season_code": F.when(F.col("day") <= 15, "E2023").otherwise("E2024"),
        "game_code": (F.col("day") + 100 * F.col("block")).cast("string"),
        "action_id": F.col("event_id").cast("string"),
        "action_class": action_class("action_code"),
        "team_id": F.when(F.col("user_id") % 2 == 0, F.col("home_team")).otherwise(F.col("road_team")),
        "player_id": F.concat(F.lit("P"), F.col("user_id").cast("string")),
        "clock": F.format_string("%02d:%02d", (F.col("seconds_remaining") / 60).cast("int"), F.col("seconds_remaining") % 60),
    })
    points = F.nullif(points_of("action_class"), F.lit(0))
    a = a.withColumn("points", points)
    running = Window.partitionBy("game_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    for side in ("home", "road"):
        own = F.when(F.col("team_id") == F.col(f"{side}_team"), F.coalesce("points", F.lit(0))).otherwise(0)
        a = a.withColumn(f"{side}_score", F.sum(own).over(running).cast("int"))
    return a.select(
        "season_code", "game_code", "game_id", "action_id", "seq", F.col("event_id").alias("original_event_id"), "period", "clock", "seconds_remaining", "action_code", "action_class", "team_id", "player_id", "home_team", "road_team", "home_score", "road_score", "points",
        F.when(field, F.chr(65 + F.col("k") % 10)).otherwise("").alias("shot_zone"),
        F.when(field, F.col("k") * 37 % 1500 - 750).otherwise(-1).cast("double").alias("coord_x"),
        F.when(field, F.col("k") * 53 % 1400 - 100).otherwise(-1).cast("double").alias("coord_y"),
        (shot & (F.col("k") % 3 == 0)).alias("is_fast_break"),
        (shot & (F.col("k") % 5 == 0)).alias("is_second_chance"),
        (shot & (F.col("k") % 7 == 0)).alias("is_from_turnover"),
    )


def starters(acts: DataFrame) -> DataFrame:
    """(game_id, side, player_id): for each side its five players with the smallest numbers."""
    side = F.when(F.col("team_id") == F.col("home_team"), "home").otherwise("road")
    players = acts.select("game_id", side.alias("side"), "player_id").distinct()
    order = Window.partitionBy("game_id", "side").orderBy(F.substring("player_id", 2, 20).cast("int"))
    return players.withColumn("n", F.row_number().over(order)).where("n <= 5").drop("n")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the players: height in metres, date of birth, country; every fifteenth has no height."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("P"), n.cast("string")).alias("player_id"),
        F.col("c_name").alias("name"),
        F.when(n % 15 != 0, (175 + n * 7 % 45) / F.lit(100.0)).alias("height"),
        F.date_add(F.lit("1990-01-01").cast("date"), (n * 61 % 5000).cast("int")).alias("birth_date"),
        F.col("n_name").alias("country"),
    )


def games(acts: DataFrame) -> DataFrame:
    return acts.groupBy("game_id", "season_code", "game_code", "home_team", "road_team").agg(
        *[F.coalesce(F.sum(F.when(F.col("team_id") == F.col(f"{side}_team"), F.col("points"))), F.lit(0)).alias(f"{side}_score") for side in ("home", "road")],
        F.when(F.col("game_code").cast("int") % 10 == 0, "Final Four").otherwise("Regular Season").alias("phase"),
        F.when(F.col("game_code").cast("int") % 10 == 0, F.when(F.col("game_code").cast("int") % 20 == 0, "Championship Game").otherwise("Semi-Finals")).otherwise("").alias("phase_group"),
    )


def observations(acts: DataFrame) -> DataFrame:
    """Every seventh action's clock as read from the broadcast, by video second of the day."""
    video = (F.when(F.col("period") == "1st", 0).when(F.col("period") == "2nd", 1).when(F.col("period") == "3rd", 2).otherwise(3)) * 1000 + (600 - F.col("seconds_remaining"))
    return acts.where("seq % 7 = 0").select("game_id", "period", F.col("seconds_remaining").cast("double").alias("clock_seconds"), video.cast("double").alias("video_time"), "seq")


ACTIONS_SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
       strftime(ts, '%Y-%m-%d') || CASE WHEN user_id >= 150 THEN '-' || (user_id // 150) ELSE '' END AS game_id, user_id // 150 AS block, CAST(day(ts) AS INTEGER) AS day, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INTEGER) AS sec FROM events),
coded AS (SELECT *, CASE event_type
  WHEN 'purchase' THEN CASE k % 6 WHEN 0 THEN '2FGM' WHEN 1 THEN '3FGM' WHEN 2 THEN 'FTM' WHEN 3 THEN '2FGA' WHEN 4 THEN '3FGA' ELSE 'FTA' END
  WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 'AS' WHEN 1 THEN 'AS' WHEN 2 THEN 'CM' WHEN 3 THEN 'RV' ELSE 'OF' END
  WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'O' WHEN 2 THEN 'ST' ELSE 'FV' END
  WHEN 'error' THEN CASE k % 10 WHEN 0 THEN 'TOUT' WHEN 1 THEN 'EP' WHEN 2 THEN 'BP' ELSE 'TO' END
  ELSE CASE k % 2 WHEN 0 THEN 'IN' ELSE 'OUT' END END AS action_code,
  row_number() OVER (PARTITION BY game_id ORDER BY ts, event_id) AS seq,
  CASE sec // 21600 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' WHEN 2 THEN '3rd' ELSE '4th' END AS period,
  600 - (sec % 21600) // 36 AS seconds_remaining, 'T' || (day % 4) AS home_team, 'T' || (4 + day % 4) AS road_team FROM ev),
named AS (SELECT *, CASE action_code WHEN '2FGM' THEN 'TwoPointShotMade' WHEN '2FGA' THEN 'TwoPointShotMissed' WHEN '3FGM' THEN 'ThreePointShotMade' WHEN '3FGA' THEN 'ThreePointShotMissed'
  WHEN 'FTM' THEN 'FreeThrowMade' WHEN 'FTA' THEN 'FreeThrowMissed' WHEN 'AS' THEN 'Assist' WHEN 'CM' THEN 'DefensiveFoul' WHEN 'RV' THEN 'FoulDrawn' WHEN 'OF' THEN 'OffensiveFoul'
  WHEN 'D' THEN 'DefensiveRebound' WHEN 'O' THEN 'OffensiveRebound' WHEN 'ST' THEN 'Steal' WHEN 'FV' THEN 'Block' WHEN 'TOUT' THEN 'Timeout' WHEN 'EP' THEN 'PeriodEnd' WHEN 'BP' THEN 'PeriodStart'
  WHEN 'TO' THEN 'Turnover' WHEN 'IN' THEN 'PlayerIn' ELSE 'PlayerOut' END AS action_class,
  CASE WHEN user_id % 2 = 0 THEN home_team ELSE road_team END AS team_id, 'P' || user_id AS player_id,
  CASE action_code WHEN '2FGM' THEN 2 WHEN '3FGM' THEN 3 WHEN 'FTM' THEN 1 END AS points,
  action_code IN ('2FGM', '3FGM', '2FGA', '3FGA') AS field, action_code IN ('2FGM', '3FGM', 'FTM', '2FGA', '3FGA', 'FTA') AS shot FROM coded),
actions AS (SELECT CASE WHEN day <= 15 THEN 'E2023' ELSE 'E2024' END AS season_code, CAST(day + 100 * block AS VARCHAR) AS game_code, game_id, CAST(event_id AS VARCHAR) AS action_id, seq,
  event_id AS original_event_id, period, lpad(CAST(seconds_remaining // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(seconds_remaining % 60 AS VARCHAR), 2, '0') AS clock, seconds_remaining,
  action_code, action_class, team_id, player_id, home_team, road_team,
  sum(CASE WHEN team_id = home_team THEN coalesce(points, 0) ELSE 0 END) OVER w AS home_score, sum(CASE WHEN team_id = road_team THEN coalesce(points, 0) ELSE 0 END) OVER w AS road_score, points,
  CASE WHEN field THEN chr(65 + k % 10) ELSE '' END AS shot_zone, CAST(CASE WHEN field THEN k * 37 % 1500 - 750 ELSE -1 END AS DOUBLE) AS coord_x, CAST(CASE WHEN field THEN k * 53 % 1400 - 100 ELSE -1 END AS DOUBLE) AS coord_y,
  shot AND k % 3 = 0 AS is_fast_break, shot AND k % 5 = 0 AS is_second_chance, shot AND k % 7 = 0 AS is_from_turnover
  FROM named WINDOW w AS (PARTITION BY game_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""

#: Who is on court: intervals of sequence numbers between a player's changes; starters begin at 0.
LINEUPS_SQL = """
sided AS (SELECT *, CASE WHEN team_id = home_team THEN 'home' ELSE 'road' END AS side FROM actions),
firsts AS (SELECT game_id, side, player_id FROM (SELECT game_id, side, player_id, row_number() OVER (PARTITION BY game_id, side ORDER BY CAST(substr(player_id, 2) AS INTEGER)) AS n
  FROM (SELECT DISTINCT game_id, side, player_id FROM sided)) WHERE n <= 5),
changes AS (SELECT game_id, side, player_id, 0 AS seq, TRUE AS is_on FROM firsts
  UNION ALL SELECT game_id, side, player_id, seq, action_code = 'IN' FROM sided WHERE action_code IN ('IN', 'OUT')),
stints AS (SELECT *, coalesce(lead(seq) OVER (PARTITION BY game_id, side, player_id ORDER BY seq), 1000000000) AS until FROM changes),
on_court AS (SELECT a.game_id, a.seq, s.side, s.player_id FROM actions a JOIN stints s ON a.game_id = s.game_id AND s.is_on AND s.seq <= a.seq AND a.seq < s.until),
lineup_at AS (SELECT game_id, seq, string_agg(player_id, '_' ORDER BY player_id) FILTER (side = 'home') AS home_lineup, string_agg(player_id, '_' ORDER BY player_id) FILTER (side = 'road') AS road_lineup FROM on_court GROUP BY game_id, seq)"""

PLAYERS_SQL = """
players AS (SELECT 'P' || c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 15 <> 0 THEN (175 + c_custkey * 7 % 45) / 100.0 END AS height,
  CAST(DATE '1990-01-01' + CAST(c_custkey * 61 % 5000 AS INTEGER) AS DATE) AS birth_date, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

GAMES_SQL = """
games AS (SELECT game_id, season_code, game_code, home_team, road_team, max(home_score) AS home_score, max(road_score) AS road_score,
  CASE WHEN CAST(game_code AS INTEGER) % 10 = 0 THEN 'Final Four' ELSE 'Regular Season' END AS phase,
  CASE WHEN CAST(game_code AS INTEGER) % 20 = 0 THEN 'Championship Game' WHEN CAST(game_code AS INTEGER) % 10 = 0 THEN 'Semi-Finals' ELSE '' END AS phase_group FROM actions GROUP BY ALL)"""

OBSERVATIONS_SQL = """
observations AS (SELECT game_id, period, CAST(seconds_remaining AS DOUBLE) AS clock_seconds,
  CAST(CASE period WHEN '1st' THEN 0 WHEN '2nd' THEN 1 WHEN '3rd' THEN 2 ELSE 3 END * 1000 + 600 - seconds_remaining AS DOUBLE) AS video_time, seq FROM actions WHERE seq % 7 = 0)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
