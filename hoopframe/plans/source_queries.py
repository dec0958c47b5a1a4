"""Registered queries that send the derived tables through the library's formats and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lineups, links, possessions, sync
from ..sources import readers, store, triples, writers
from . import views
from .queries import FOULS_SQL, LINKS_SQL, POSSESSIONS_SQL, SIDES_SQL, register, simple
from .sync_queries import NEAREST_SQL
from .views import ACTIONS_SQL, LINEUPS_SQL, OBSERVATIONS_SQL, with_

V = "https://example.org/vocabulary#"


def triples_of(acts: DataFrame) -> DataFrame:
    subject = F.concat(F.lit("https://example.org/games/"), "game_id", F.lit("#PlayByPlay_J"), F.col("original_event_id").cast("string"))
    return writers.entity_triples(acts, subject, f"{V}Action", {f"{V}id": writers.literal(F.col("action_id")), f"{V}points": writers.literal(F.col("points"), "integer"), f"{V}team": writers.iri(F.concat(F.lit("https://example.org/teams/-/"), "team_id"))})


simple(
    "action_triples",
    """ SELECT '<' || s || '> <' || p || '> ' || o || ' .' AS line FROM (SELECT 'https://example.org/games/' || game_id || '#PlayByPlay_J' || original_event_id AS s, action_id, points, team_id FROM actions),
    LATERAL (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '<https://example.org/vocabulary#Action>'), ('https://example.org/vocabulary#id', '"' || action_id || '"'),
    ('https://example.org/vocabulary#points', '"' || points || '"^^<http://www.w3.org/2001/XMLSchema#integer>'), ('https://example.org/vocabulary#team', '<https://example.org/teams/-/' || team_id || '>')) v(p, o) WHERE o IS NOT NULL""",
    triples_of,
)
_B, _LINE = "https://example.org", "'<' || s || '> <' || p || '> ' || o || ' .'"
_TYPE = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"
simple(
    "membership_triples",
    f""", g AS (SELECT DISTINCT '{_B}/games/' || season_code || '/' || game_code AS s, home_team, road_team FROM actions)
    SELECT {_LINE} AS line FROM (SELECT s, {_TYPE} AS p, '<{V}Game>' AS o FROM g UNION ALL SELECT s, '{V}homeTeam', '<{_B}/teams/-/' || home_team || '>' FROM g UNION ALL SELECT s, '{V}roadTeam', '<{_B}/teams/-/' || road_team || '>' FROM g
    UNION ALL SELECT '{_B}/games/' || season_code || '/' || game_code, '{V}contains', '<{_B}/games/' || season_code || '/' || game_code || '#PlayByPlay_J' || original_event_id || '>' FROM actions)""",
    lambda a: writers.membership_triples(a, V, _B),
)
simple(
    "lineup_triples",
    SIDES_SQL + f""", f AS (SELECT DISTINCT lineup_team, lineup FROM sides WHERE len(string_split(lineup, '_')) = 5),
    u AS (SELECT *, '{_B}/teams/-/' || lineup_team || '#Lineup_' || array_to_string(list_sort(list_transform(string_split(lineup, '_'), lambda x: substr(x, 2))), '_') AS s FROM f)
    SELECT {_LINE} AS line FROM (SELECT s, {_TYPE} AS p, '<{V}Lineup>' AS o FROM u UNION ALL SELECT s, '{V}team', '<{_B}/teams/-/' || lineup_team || '>' FROM u
    UNION ALL SELECT s, '{V}hasPlayer', '<{_B}/players/-/' || substr(x, 2) || '>' FROM (SELECT s, unnest(string_split(lineup, '_')) AS x FROM u))""",
    lambda a: writers.lineup_triples(lineups.either_side(a), V, _B),
    lined=True,
)


@register(
    "possession_triples",
    with_(ACTIONS_SQL, POSSESSIONS_SQL) + f""", q AS (SELECT *, '{_B}/games/' || game_id AS g, '{_B}/games/' || game_id || '#Possession_' || possession_seq AS s FROM possessions)
    SELECT {_LINE} AS line FROM (SELECT s, {_TYPE} AS p, '<{V}Possession>' AS o FROM q UNION ALL SELECT s, '{V}team', '<{_B}/teams/-/' || team_id || '>' FROM q
    UNION ALL SELECT s, '{V}startsAfter', '<' || g || '#PlayByPlay_J' || starts_after || '>' FROM q WHERE starts_after IS NOT NULL UNION ALL SELECT s, '{V}endsWith', '<' || g || '#PlayByPlay_J' || ends_with || '>' FROM q
    UNION ALL SELECT s, '{V}containsAction', '<' || g || '#PlayByPlay_J' || e || '>' FROM (SELECT s, g, unnest(contains_action) AS e FROM q))""",
)
def _possession_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.possession_triples(possessions.possessions(views.actions(spark, sf_dir)), V, F.concat(F.lit(f"{_B}/games/"), "game_id"))


simple("spreadsheet_safe", " SELECT action_id, CASE WHEN coord_x < 0 THEN '''' ELSE '' END || CAST(CAST(coord_x AS INTEGER) AS VARCHAR) AS x FROM actions", lambda a: writers.spreadsheet_safe(a.select("action_id", F.col("coord_x").cast("int").cast("string").alias("x"))))
simple("incremental", " SELECT action_id FROM actions WHERE season_code = 'E2024'", lambda a: writers.incremental(a, a.where("season_code = 'E2023'"), ["game_id"]).select("action_id"))


@register("flatten_bindings", with_(ACTIONS_SQL) + " SELECT player_id AS player, CAST(points AS VARCHAR) AS points FROM actions")
def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    docs = a.groupBy("game_id").agg(F.to_json(F.collect_list(F.struct(F.struct(F.col("player_id").alias("value")).alias("player"), F.when(F.col("points").isNotNull(), F.struct(F.col("points").cast("string").alias("value"))).alias("points")))).alias("bindings"))
    return readers.flatten_bindings(docs, ["player", "points"])


@register("game_documents", with_(ACTIONS_SQL, POSSESSIONS_SQL) + " SELECT game_id, count(*) AS n_actions, (SELECT count(*) FROM possessions p WHERE p.game_id = a.game_id) AS n_possessions FROM actions a GROUP BY 1")
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    d = writers.game_documents(a, possessions.possessions(a))
    return d.select("game_id", F.size(F.from_json(F.get_json_object("document", "$.AllActions"), "array<struct<seq:int>>")).cast("long").alias("n_actions"), F.size(F.from_json(F.get_json_object("document", "$.Possessions"), "array<struct<possession_seq:int>>")).cast("long").alias("n_possessions"))


def _documents_read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Actions and possessions written as documents and read again; in one season numbers have become text and a field is new."""
    a = views.actions(spark, sf_dir)
    seasons = a.select("game_id", "season_code").distinct()
    d = writers.game_documents(a.drop("season_code"), possessions.possessions(a)).join(seasons, "game_id")
    changed = F.regexp_replace(F.regexp_replace("document", r'"seconds_remaining":(\d+)', '"seconds_remaining":"$1"'), '"team_id":', '"since":{"v":[2]},"team_id":')
    path = f"{store.scratch_dir(spark)}/hoopframe/documents-{uuid.uuid4().hex}"
    d.select("game_id", F.when(F.col("season_code") == "E2024", changed).otherwise(F.col("document")).alias("document")).write.parquet(path)
    fields = ", ".join(f"{c} {t}" for c, t in a.dtypes if c not in ("game_id", "season_code"))
    return readers.read_documents(spark.read.parquet(path), fields)


@register("documents_actions", with_(ACTIONS_SQL) + " SELECT * EXCLUDE (season_code) FROM actions")
def _documents_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_read(spark, sf_dir)[0]


@register("documents_possessions", with_(ACTIONS_SQL, POSSESSIONS_SQL) + " SELECT * FROM possessions")
def _documents_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_read(spark, sf_dir)[1]


@register(
    "incremental_write",
    with_(ACTIONS_SQL, POSSESSIONS_SQL) + """ SELECT season_code, game_id, count(*) AS n_actions, CAST(sum(seq) AS BIGINT) AS sum_seq, (SELECT count(*) FROM possessions p WHERE p.game_id = a.game_id) AS n_possessions,
    CASE season_code WHEN 'E2023' THEN 1 ELSE 3 END AS run FROM actions a GROUP BY season_code, game_id""",
)
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One season, then all, then the other season once more; what is read back, and by which run it was written."""
    a = views.actions(spark, sf_dir)
    a = store.stash(a, "actions")  # each run reads its outputs several times
    p = store.stash(possessions.possessions(a).join(a.select("game_id", "season_code").distinct(), "game_id"), "possessions")
    root = f"{store.scratch_dir(spark)}/hoopframe/games-{uuid.uuid4().hex}"
    first = F.col("season_code") == "E2023"
    store.write_games({"actions": a.where(first), "possessions": p.where(first)}, root)
    store.write_games({"actions": a, "possessions": p}, root)
    store.write_games({"actions": a, "possessions": p}, root, ~first)
    n = store.read_games(spark, root, "possessions").groupBy("game_id").agg(F.count("*").alias("n_possessions"))
    per = store.read_games(spark, root, "actions").groupBy("season_code", "game_id", "run").agg(F.count("*").alias("n_actions"), F.sum("seq").alias("sum_seq"))
    return per.join(n, "game_id", "left").select("season_code", "game_id", "n_actions", "sum_seq", F.coalesce("n_possessions", F.lit(0)).alias("n_possessions"), "run")


_J = f"'{_B}/games/' || season_code || '/' || game_code || '#PlayByPlay_J'"
_XSD = "http://www.w3.org/2001/XMLSchema#"


def _sql_line(term: str, value: str) -> str:
    return f"('{V}{term}', {value})"


def _sql_terms() -> str:
    """The terms of an action as VALUES of (predicate, term or null)."""
    out = [f"({_TYPE}, '<{V}' || action_class || '>')"]
    for term, c, kind in triples.ACTION_TERMS:
        if c in ("coach", "caused_by_violation", "shot_coords"):
            continue
        if kind == "lineup":
            team = c.replace("lineup", "team")
            out.append(_sql_line(term, f"'<{_B}/teams/-/' || {team} || '#Lineup_' || array_to_string(list_sort(list_transform(string_split({c}, '_'), lambda x: substr(x, 2))), '_') || '>'"))
        elif kind in ("teams", "players"):
            out.append(_sql_line(term, f"'<{_B}/{kind}/-/' || {c if kind == 'teams' else f'substr({c}, 2)'} || '>'"))
        else:
            out.append(_sql_line(term, f"""'"' || CAST({c} AS VARCHAR) || '"{'' if kind == 'string' else f'^^<{_XSD}{kind}>'}'"""))
    out += [_sql_line(term, f"'<' || {_J} || {c} || '>'") for term, c in triples.LINK_TERMS.items()]
    return ", ".join(out)


@register(
    "action_terms",
    "WITH RECURSIVE" + ",".join([ACTIONS_SQL, LINEUPS_SQL, LINKS_SQL, FOULS_SQL]) + f""", f AS (SELECT l.*, d.fouled_by, c.home_lineup, c.road_lineup FROM linked l LEFT JOIN drawn_l d USING (game_id, action_id) LEFT JOIN lineup_at c USING (game_id, seq))
    SELECT '<' || s || '> <' || p || '> ' || o || ' .' AS line FROM (SELECT *, {_J} || original_event_id AS s FROM f), LATERAL (VALUES {_sql_terms()}) v(p, o) WHERE o IS NOT NULL
    UNION ALL SELECT '<{_B}/games/' || season_code || '/' || game_code || '> <{V}hasPlayByPlayAction> <' || {_J} || original_event_id || '> .' FROM actions""",
)
def _action_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the links read the actions of lineups seven times, their lines the linked ones twice
    a = store.stash(views.actions(spark, sf_dir), "actions")
    lined = store.stash(lineups.lineup_at_action(a, views.starters(a)), "lined-actions")
    full = store.stash(links.with_foul_links(links.link_actions(lined)), "linked-actions")
    return triples.action_lines(full, V, _B).select("line")


@register(
    "video_triples",
    with_(ACTIONS_SQL, OBSERVATIONS_SQL, NEAREST_SQL) + f""", o AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY video_time, seq) AS n FROM observations),
    g AS (SELECT DISTINCT game_id, '{_B}/games/' || season_code || '/' || game_code AS g, 'https://video.example.org/' || game_code AS url FROM actions),
    w AS (SELECT g.*, g || '#BroadcastVideo' AS v FROM g),
    m AS (SELECT w.game_id, w.v, w.g || '#PlayByPlay_J' || a.original_event_id AS s, o.n, o.video_time, o.period, o.clock_seconds FROM matched x JOIN actions a ON a.action_id = x.action_id JOIN w ON w.game_id = a.game_id
      JOIN (SELECT game_id, period, clock_seconds, min(n) AS n, min(video_time) AS video_time FROM o GROUP BY ALL) o ON o.game_id = x.game_id AND o.period = a.period AND o.clock_seconds = x.obs_clock),
    seen AS (SELECT DISTINCT v, v || '_Observation_' || n AS ob, n, video_time, period, clock_seconds FROM m),
    t AS (SELECT g AS s, '{V}hasBroadcastVideo' AS p, '<' || v || '>' AS o FROM w
      UNION ALL SELECT v, p, o FROM w, LATERAL (VALUES ({_TYPE}, '<{V}BroadcastVideo>'), ('{V}youtubeURL', '<' || url || '>'), ('{V}ocrProfile', '""'), ('{V}playbackLeadSeconds', '"5.0"^^<{_XSD}decimal>'), ('{V}isVideoEnabled', '"true"^^<{_XSD}boolean>')) z(p, o)
      UNION ALL SELECT ob, p, o FROM seen, LATERAL (VALUES ({_TYPE}, '<{V}OCRObservation>'), ('{V}ocrSequence', '"' || n || '"^^<{_XSD}integer>'), ('{V}videoTimeSeconds', '"' || CAST(CAST(video_time AS BIGINT) AS VARCHAR) || '.0"^^<{_XSD}decimal>'),
        ('{V}ocrQuarter', '"' || period || '"'), ('{V}ocrClock', '"' || CAST(CAST(clock_seconds AS BIGINT) AS VARCHAR) || '"')) z(p, o)
      UNION ALL SELECT v, '{V}hasOCRObservation', '<' || ob || '>' FROM seen UNION ALL SELECT s, '{V}correspondsToOCRObservation', '<' || v || '_Observation_' || n || '>' FROM m)
    SELECT {_LINE} AS line FROM t""",
)
def _video_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("game_id").orderBy("video_time", "seq"))
    obs = views.observations(a).withColumn("observation_seq", number)
    first = obs.groupBy("game_id", "period", F.col("clock_seconds").alias("obs_clock")).agg(F.min("observation_seq").alias("observation_seq"))
    m = sync.nearest_observation(a, obs).where("video_time is not null").select("game_id", "period", "original_event_id", "obs_clock", "video_time")
    m = m.join(first, ["game_id", "period", "obs_clock"]).withColumn("clock", F.col("obs_clock").cast("long").cast("string"))
    videos = a.select("season_code", "game_id", "game_code").distinct().select("*", F.concat(F.lit("https://video.example.org/"), "game_code").alias("youtube_url"), F.lit(None).cast("string").alias("ocr_profile"), F.lit(None).cast("double").alias("playback_lead_seconds"), F.lit(None).cast("boolean").alias("enabled"))
    return triples.video_lines(videos, m, V, _B).select("line")


def _faulty(lines: DataFrame) -> DataFrame:
    """Lines with faults planted by the number of their action: each of eight kinds at one number of every twenty."""
    mark = "#PlayByPlay_J"  # the number goes up to the bracket
    event = F.substring_index(F.substring("line", F.locate(mark, F.col("line")) + len(mark), 1 << 30), ">", 1).cast("long")
    kind = F.when(F.contains("line", F.lit(triples.HAS_ACTION)), "link").when(F.contains("line", F.lit("22-rdf-syntax-ns#type")), "type").when(F.contains("line", F.lit(triples.SEQUENCE)), "sequence").otherwise("")
    rows = lines.select("line", (event % 20).alias("k"), kind.alias("kind"))
    gone = ((F.col("k") == 1) & (F.col("kind") == "link")) | ((F.col("k") == 3) & (F.col("kind") == "type")) | ((F.col("k") == 6) & (F.col("kind") == "sequence"))
    other = F.regexp_replace("line", f"<{V}[A-Za-z]+> [.]$", f"<{V}Other> .")
    more = F.when((F.col("k") == 2) & (F.col("kind") == "link"), F.regexp_replace("line", "#PlayByPlay_J", "#PlayByPlay_J9000")).when((F.col("k") == 5) & (F.col("kind") == "type"), other).when((F.col("k") == 7) & (F.col("kind") == "link"), F.col("line")).when((F.col("k") == 8) & (F.col("kind") == "link"), F.lit("<a> <b> ."))
    shown = F.when((F.col("k") == 4) & (F.col("kind") == "type"), other).otherwise(F.col("line"))
    # no filter, which would be pushed down and build each line again for every mention of it
    return rows.select(F.explode(F.array_compact(F.array(F.when(~gone, shown), F.when(~gone, more)))).alias("value"))


@register(
    "check_triples",
    with_(ACTIONS_SQL) + f""", f AS (SELECT '{_B}/games/' || season_code || '/' || game_code AS game, original_event_id % 20 AS k FROM actions)
    SELECT game, problem, count(*) AS n FROM f JOIN (VALUES (1, 'missing link'), (2, 'unexpected link'), (3, 'missing type'), (4, 'wrong type'), (4, 'unexpected type'), (5, 'unexpected type'), (6, 'missing sequence'), (7, 'duplicate')) z(k, problem) USING (k) GROUP BY ALL
    UNION ALL SELECT NULL, 'malformed', count(*) FROM f WHERE k = 8""",
)
def _check_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return triples.check_parsed(readers.parse_lines(_faulty(triples.action_lines(a, V, _B))), a, V, _B)
