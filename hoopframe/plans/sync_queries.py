"""Registered queries for video sync, timelines, checks, evaluation, candidates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import candidates, evaluation, links, lineups, possessions, quality, reports, scope, sync, timeline
from ..sources.store import stash
from . import views
from .queries import FOULS_SQL, POSSESSIONS_SQL, SIDES_SQL, register, simple
from .views import ACTIONS_SQL, LINEUPS_SQL, OBSERVATIONS_SQL, PLAYERS_SQL, with_

# Nearest observation by brute force: every clock of the period, least distance, then the larger clock.
NEAREST_SQL = """
firsts_o AS (SELECT game_id, period, clock_seconds, min(video_time) AS video_time FROM observations GROUP BY ALL),
near_o AS (SELECT a.game_id, a.seq, a.action_id, a.action_class, min_by(o.clock_seconds, (abs(o.clock_seconds - a.seconds_remaining), -o.clock_seconds)) AS oc,
  min_by(o.video_time, (abs(o.clock_seconds - a.seconds_remaining), -o.clock_seconds)) AS ov, min(abs(o.clock_seconds - a.seconds_remaining)) AS difference
  FROM actions a LEFT JOIN firsts_o o ON a.game_id = o.game_id AND a.period = o.period GROUP BY ALL),
matched AS (SELECT *, CASE WHEN difference <= 5 THEN oc END AS obs_clock, CASE WHEN difference <= 5 THEN ov END AS video_time FROM near_o)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return sync.nearest_observation(a, views.observations(a))


@register("nearest_observation", with_(ACTIONS_SQL, OBSERVATIONS_SQL, NEAREST_SQL) + " SELECT action_id, obs_clock, video_time, difference FROM matched")
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("action_id", "obs_clock", "video_time", "difference")


@register(
    "current_action",
    with_(ACTIONS_SQL, OBSERVATIONS_SQL, NEAREST_SQL) + """, placed AS (SELECT game_id, video_time, action_id FROM matched WHERE video_time IS NOT NULL), ticks AS (SELECT DISTINCT game_id, video_time + 3 AS video_time FROM placed),
    best AS (SELECT t.game_id, t.video_time, max((p.video_time, p.action_id)) AS m FROM ticks t JOIN placed p ON p.game_id = t.game_id AND p.video_time <= t.video_time GROUP BY ALL)
    SELECT game_id, video_time, CASE WHEN video_time - m[1] < 12 THEN m[2] END AS action_id FROM best""",
)
def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _matched(spark, sf_dir).where("video_time is not null").select("game_id", "video_time", "action_id")
    return sync.current_action(placed.select("game_id", (F.col("video_time") + 3).alias("video_time")).distinct(), placed)


simple(
    "sync_rule",
    """, s AS (SELECT game_id, period, assist_id AS action_id, max_by(seconds_remaining, seq) AS sc FROM linked WHERE assist_id IS NOT NULL AND action_code IN ('2FGM', '3FGM', 'FTM') GROUP BY ALL)
    SELECT a.action_id, CAST(CASE WHEN abs(sc - seconds_remaining) <= 5 THEN sc ELSE seconds_remaining END AS DOUBLE) AS sync_seconds, CASE WHEN action_code IN ('BP', 'IN', 'OUT') AND seconds_remaining = 600 THEN 12.0 ELSE 5.0 END AS tolerance
    FROM linked a LEFT JOIN s ON s.game_id = a.game_id AND s.period = a.period AND s.action_id = a.action_id""",
    lambda a: sync.sync_rule(a).select("action_id", "sync_seconds", "tolerance"),
    linked="assist_id",
)
# A timeline with faults: some clocks are read too high or too low.
_TIMELINE_SQL = """
timeline AS (SELECT game_id, video_time, period, clock_seconds FROM (SELECT game_id, seq * 2.0 AS video_time, period, CAST(CASE WHEN seq % 31 = 0 THEN seconds_remaining + 40 WHEN seq % 37 = 0 THEN seconds_remaining - 60 ELSE seconds_remaining END AS DOUBLE) AS clock_seconds FROM actions) WHERE clock_seconds >= 0)"""


def _timeline(acts: DataFrame) -> DataFrame:
    clock = F.when(F.col("seq") % 31 == 0, F.col("seconds_remaining") + 40).when(F.col("seq") % 37 == 0, F.col("seconds_remaining") - 60).otherwise(F.col("seconds_remaining"))
    return acts.select("game_id", (F.col("seq") * 2.0).alias("video_time"), "period", clock.cast("double").alias("clock_seconds")).where("clock_seconds >= 0")


_MONOTONIC_SQL = """
    r AS (SELECT *, CASE WHEN period IS DISTINCT FROM lag(period) OVER w THEN 1 ELSE 0 END AS new FROM timeline WINDOW w AS (PARTITION BY game_id ORDER BY video_time)),
    r2 AS (SELECT *, sum(new) OVER (PARTITION BY game_id ORDER BY video_time) AS run FROM r),
    r3 AS (SELECT a.* FROM r2 a WHERE NOT EXISTS (SELECT 1 FROM r2 b WHERE b.game_id = a.game_id AND b.run = a.run AND b.video_time > a.video_time AND b.clock_seconds > a.clock_seconds)),
    monotonic AS (SELECT game_id, CASE WHEN clock_seconds <= 0.1 THEN min(video_time) ELSE max(video_time) END AS video_time, period, clock_seconds FROM r3 GROUP BY game_id, run, period, clock_seconds)"""
#: Reading by reading of a game: the last one kept, and whether this one is.
_KEPT_SQL = """
    m AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY video_time) AS k FROM monotonic),
    kept AS (SELECT game_id, k, video_time, period, clock_seconds, TRUE AS ok, video_time AS t, period AS p, clock_seconds AS c FROM m WHERE k = 1
      UNION ALL SELECT game_id, k, video_time, period, clock_seconds, ok, CASE WHEN ok THEN video_time ELSE t END, CASE WHEN ok THEN period ELSE p END, CASE WHEN ok THEN clock_seconds ELSE c END
      FROM (SELECT m.game_id, m.k, m.video_time, m.period, m.clock_seconds, s.t, s.p, s.c, s.p <> m.period OR s.c - m.clock_seconds <= m.video_time - s.t + 5 AS ok FROM kept s JOIN m ON m.game_id = s.game_id AND m.k = s.k + 1))"""
_REPAIR_SQL = "WITH RECURSIVE" + ",".join([ACTIONS_SQL, _TIMELINE_SQL, _MONOTONIC_SQL, _KEPT_SQL])


@register("monotonic_timeline", with_(ACTIONS_SQL, _TIMELINE_SQL, _MONOTONIC_SQL) + " SELECT * FROM monotonic")
def _monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.monotonic_timeline(_timeline(views.actions(spark, sf_dir)))


@register("repair_timeline", _REPAIR_SQL + " SELECT game_id, video_time, period, clock_seconds FROM kept WHERE ok")
def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.repair_timeline(_timeline(views.actions(spark, sf_dir)))


@register("repair_timeline_removed", _REPAIR_SQL + ", n AS (SELECT game_id, count(*) AS n FROM timeline GROUP BY 1), l AS (SELECT game_id, count(*) AS l FROM kept WHERE ok GROUP BY 1) SELECT game_id, n - coalesce(l, 0) AS removed FROM n LEFT JOIN l USING (game_id)")
def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _timeline(views.actions(spark, sf_dir))
    return timeline.removed_counts(before, timeline.repair_timeline(before))


@register(
    "check_timelines",
    with_(ACTIONS_SQL, _TIMELINE_SQL) + """, t AS (SELECT *, video_time - lag(video_time) OVER g AS dt0, video_time - lag(video_time) OVER o AS dt, lag(clock_seconds) OVER o - clock_seconds AS drp FROM timeline
      WINDOW g AS (PARTITION BY game_id ORDER BY video_time, clock_seconds), o AS (PARTITION BY game_id, period ORDER BY video_time, clock_seconds)),
    p AS (SELECT game_id, period, min_by(clock_seconds, video_time) AS f, max_by(clock_seconds, video_time) AS l, max(clock_seconds) AS most, max(drp) AS gap, count(*) FILTER (drp < 0) AS rises, count(*) FILTER (drp > dt + 5) AS fast FROM t GROUP BY ALL),
    w AS (SELECT game_id, count(*) AS n FROM t GROUP BY 1)
    SELECT game_id, period, 'error' AS level, 'clock exceeds the period' AS problem FROM p WHERE most > 601 UNION ALL SELECT game_id, period, 'error', 'starts too late' FROM p WHERE 600 - f > 60
    UNION ALL SELECT game_id, period, 'warning', 'starts late' FROM p WHERE 600 - f > 15 AND 600 - f <= 60 UNION ALL SELECT game_id, period, 'error', 'ends too early' FROM p WHERE l > 15
    UNION ALL SELECT game_id, period, 'warning', 'ends early' FROM p WHERE l > 5 AND l <= 15 UNION ALL SELECT game_id, period, 'error', 'not monotonic' FROM p WHERE rises > 0
    UNION ALL SELECT game_id, period, 'warning', 'coverage gap' FROM p WHERE gap > 10 UNION ALL SELECT game_id, period, 'error', 'drops faster than video' FROM p WHERE fast > 0
    UNION ALL SELECT game_id, NULL, 'error', 'too few rows' FROM w WHERE n < 1200
    UNION ALL SELECT g.game_id, NULL, 'error', 'missing ' || q FROM w g, (VALUES ('1st'), ('2nd'), ('3rd'), ('4th')) v(q) WHERE NOT EXISTS (SELECT 1 FROM timeline x WHERE x.game_id = g.game_id AND x.period = q)""",
)
def _check_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.check_timelines(_timeline(views.actions(spark, sf_dir)))


@register(
    "timeline_completeness",
    with_(ACTIONS_SQL, _TIMELINE_SQL) + """, p AS (SELECT game_id, period, min_by(clock_seconds, video_time) AS f, max_by(clock_seconds, video_time) AS l FROM timeline GROUP BY ALL)
    SELECT game_id, period, 'starts too late' AS problem FROM p WHERE f < 540 UNION ALL SELECT game_id, period, 'ends too early' FROM p WHERE l > 15
    UNION ALL SELECT g.game_id, q, 'missing' FROM (SELECT DISTINCT game_id FROM timeline) g, (VALUES ('1st'), ('2nd'), ('3rd'), ('4th')) v(q) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.game_id = g.game_id AND p.period = q)""",
)
def _completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.completeness(_timeline(views.actions(spark, sf_dir)))


# Ground truth: every action at its observation's time, off by a few seconds.
_TRUTH_SQL = """
scored AS (SELECT game_id, action_id, action_class AS category, abs(video_time - (seq % 13 * 3 + coalesce(ov, 0))) AS error FROM matched)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir)
    a = views.actions(spark, sf_dir)
    free = sync.nearest_observation(a, views.observations(a), 1e9)
    truth = free.select("game_id", "action_id", F.col("action_class").alias("category"), (F.col("seq") % 13 * 3 + F.coalesce("video_time", F.lit(0.0))).alias("truth_seconds"))
    return evaluation.score_sync(truth, m)


_METRICS = """count(*) AS total, count(error) AS mapped, round(100.0 * (count(*) - count(error)) / count(*), 4) AS unmapped_pct, round(avg(error), 6) AS mae, median(error) AS median_error,
 round(100.0 * count(*) FILTER (error <= 1) / count(*), 4) AS within_1s, round(100.0 * count(*) FILTER (error <= 2) / count(*), 4) AS within_2s, round(100.0 * count(*) FILTER (error <= 5) / count(*), 4) AS within_5s"""
_SCORED = with_(ACTIONS_SQL, OBSERVATIONS_SQL, NEAREST_SQL, _TRUTH_SQL)


@register("sync_metrics", _SCORED + f" SELECT {_METRICS} FROM scored")
def _sync_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sync_metrics(_scored(spark, sf_dir))


@register("sync_metrics_by_level", _SCORED + f" SELECT 'overall' AS level, 'all' AS key, {_METRICS} FROM scored UNION ALL SELECT 'category', category, {_METRICS} FROM scored GROUP BY category UNION ALL SELECT 'game', game_id, {_METRICS} FROM scored GROUP BY game_id")
def _sync_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sync_metrics_by_level(_scored(spark, sf_dir))


@register("error_bands", _SCORED + """, b AS (SELECT CASE WHEN error IS NULL THEN 'unmapped' WHEN error <= 1 THEN '0-1' WHEN error <= 2 THEN '1-2' WHEN error <= 5 THEN '2-5' WHEN error <= 10 THEN '5-10' WHEN error <= 30 THEN '10-30' ELSE '>30' END AS band FROM scored)
  SELECT place, v.band, count(b.band) AS n, round(100.0 * count(b.band) / (SELECT count(*) FROM b), 4) AS share FROM (VALUES (0, '0-1'), (1, '1-2'), (2, '2-5'), (3, '5-10'), (4, '10-30'), (5, '>30'), (6, 'unmapped')) v(place, band) LEFT JOIN b USING (band) GROUP BY ALL""")
def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_bands(_scored(spark, sf_dir))


@register("coverage", with_(ACTIONS_SQL, OBSERVATIONS_SQL, NEAREST_SQL) + " SELECT game_id, count(*) AS actions, count(video_time) AS linked, round(100.0 * (count(*) - count(video_time)) / count(*), 4) AS unmapped_pct FROM matched GROUP BY 1")
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.coverage(_matched(spark, sf_dir), ["game_id"])


@register("timing_summary", """SELECT l_returnflag, l_linestatus, count(*) AS runs, count(*) FILTER (l_quantity > 5) AS successes, round(avg(l_extendedprice) FILTER (l_quantity > 5), 4) AS mean, median(l_extendedprice) FILTER (l_quantity > 5) AS median,
  min(l_extendedprice) FILTER (l_quantity > 5) AS least, max(l_extendedprice) FILTER (l_quantity > 5) AS most, round(stddev_samp(l_extendedprice) FILTER (l_quantity > 5), 4) AS deviation FROM lineitem GROUP BY ALL""")
def _timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.read(spark, sf_dir, "lineitem").withColumn("success", F.col("l_quantity") > 5)
    return evaluation.timing_summary(log, ["l_returnflag", "l_linestatus"], "l_extendedprice")


@register("fan_out_distinct", """SELECT l_suppkey, sum(q) AS quantity, count(*) AS lines FROM (SELECT DISTINCT l_suppkey, l_orderkey || '-' || l_linenumber AS action_id, l_quantity AS q FROM lineitem) GROUP BY 1 ORDER BY quantity DESC, l_suppkey LIMIT 10""")
def _fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "lineitem").select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("action_id"), "l_quantity")
    return reports.distinct_then_aggregate(rows, ["l_suppkey"], {"quantity": F.sum("l_quantity"), "lines": F.count("*")}, "quantity", 10, "l_quantity")


# Actions with faults of each kind that the checks look for.
_FAULTY_SQL = """, faulty AS (SELECT game_id, action_id, row_number() OVER (PARTITION BY game_id ORDER BY seq) AS place, CASE WHEN seq >= 150 THEN seq + 1 ELSE seq END AS seq,
  CASE WHEN seq % 101 = 0 THEN NULL WHEN seq % 53 = 0 THEN -1 ELSE original_event_id END AS original_event_id, CASE WHEN seq % 103 = 0 THEN 'interval' ELSE period END AS period,
  CASE WHEN seq % 107 = 0 THEN 700 ELSE seconds_remaining END AS seconds_remaining, clock, seconds_remaining AS clock_s FROM actions),
  flagged AS (SELECT *, count(*) OVER (PARTITION BY game_id, original_event_id) AS same FROM faulty),
  problems AS (SELECT game_id, seq, action_id, 'sequence' AS problem FROM flagged WHERE seq <> place UNION ALL SELECT game_id, seq, action_id, 'event id' FROM flagged WHERE same > 1 OR original_event_id IS NULL
  UNION ALL SELECT game_id, seq, action_id, 'period' FROM flagged WHERE period = 'interval' UNION ALL SELECT game_id, seq, action_id, 'seconds' FROM flagged WHERE period = 'interval' OR seconds_remaining > 600
  UNION ALL SELECT game_id, seq, action_id, 'clock' FROM flagged WHERE seconds_remaining <> clock_s),
  placed AS (SELECT *, row_number() OVER (PARTITION BY game_id, problem ORDER BY seq, action_id) AS n FROM problems)"""


def _faulty(a: DataFrame) -> DataFrame:
    n = F.col("n_")
    return a.withColumn("n_", F.col("seq")).withColumns({
        "seq": F.when(n >= 150, n + 1).otherwise(n),
        "original_event_id": F.when(n % 101 == 0, None).when(n % 53 == 0, -1).otherwise(F.col("original_event_id")),
        "period": F.when(n % 103 == 0, "interval").otherwise(F.col("period")),
        "seconds_remaining": F.when(n % 107 == 0, 700).otherwise(F.col("seconds_remaining")),
    }).drop("n_")


simple(
    "check_actions",
    _FAULTY_SQL + " SELECT game_id, problem, count(*) AS n, string_agg(action_id, ',' ORDER BY action_id) FILTER (n <= 10) AS examples FROM placed GROUP BY ALL",
    lambda a: quality.check_actions(_faulty(a)),
)


@register("dangling_references", with_(ACTIONS_SQL, POSSESSIONS_SQL) + """, n AS (SELECT game_id, possession_seq, unnest(list_distinct(list_concat(contains_action, [starts_after, ends_with]))) AS original_event_id FROM possessions)
  SELECT DISTINCT game_id, possession_seq, original_event_id FROM n WHERE original_event_id IS NOT NULL AND (game_id, original_event_id) NOT IN (SELECT (game_id, original_event_id) FROM actions WHERE seq % 50 <> 0)""")
def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return quality.dangling_references(possessions.possessions(a), a.where("seq % 50 <> 0")).select("game_id", "possession_seq", "original_event_id")


simple(
    "source_equals_processed",
    " SELECT game_id, count(*) FILTER (seq % 97 = 0) AS missing, 0 AS unexpected, count(*) FILTER (seq % 97 = 0) = 0 AS in_order FROM actions GROUP BY 1",
    lambda a: quality.source_equals_processed(a.select("game_id", "seq", "action_code"), a.where("seq % 97 <> 0").select("game_id", "seq", "action_code")),
)
simple(
    "matched_only",
    " SELECT action_id FROM actions WHERE player_id IN (SELECT player_id FROM actions WHERE action_class = 'ThreePointShotMade' AND period = '4th')",
    lambda a: quality.matched_only(a, a.where("action_class = 'ThreePointShotMade' and period = '4th'").select("player_id").distinct(), "player_id").select("action_id"),
)
simple(
    "set_difference",
    """, l AS (SELECT DISTINCT player_id, action_class FROM actions WHERE season_code = 'E2023'), r AS (SELECT DISTINCT player_id, action_class FROM actions WHERE season_code = 'E2024')
    SELECT player_id, action_class, 'missing' AS side FROM (FROM l EXCEPT FROM r) UNION ALL SELECT player_id, action_class, 'unexpected' FROM (FROM r EXCEPT FROM l)""",
    lambda a: quality.set_difference(a.where("season_code = 'E2023'"), a.where("season_code = 'E2024'"), ["player_id", "action_class"]),
)


@register("duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n FROM lineitem")
def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


_POINTS = ", pts AS (SELECT game_id, player_id, sum(points) AS points FROM actions WHERE points IS NOT NULL GROUP BY ALL)"


def _points(a: DataFrame) -> DataFrame:
    return reports.points_by(a, ["game_id", "player_id"], None, None).drop("scoring_actions")


simple("comparison_pairs", _POINTS + " SELECT a.game_id, a.player_id AS a, b.player_id AS b, a.points AS a_points, b.points AS b_points, b.points - a.points AS gap FROM pts a JOIN pts b ON a.game_id = b.game_id AND b.points - a.points BETWEEN 2 AND 3", lambda a: candidates.comparison_pairs(_points(a), 2, 3))
simple(
    "top_sets",
    _POINTS + """, r AS (SELECT *, row_number() OVER w AS rank, lead(points) OVER w AS nxt FROM pts WINDOW w AS (PARTITION BY game_id ORDER BY points DESC, player_id))
    SELECT game_id, player_id, points, rank FROM r WHERE rank <= 3 AND game_id NOT IN (SELECT game_id FROM r WHERE rank = 3 AND points IS NOT DISTINCT FROM nxt)""",
    lambda a: candidates.top_sets(_points(a), 3),
)


#: Names of every kind, guesses of every kind, and the rules of matching, each player against each guess.
_NAMES_SQL = """
base AS (SELECT c_custkey AS k, 'Fir' || c_nationkey AS f FROM customer),
named AS (SELECT 'P' || k AS player_id, k, f, CASE k % 5 WHEN 0 THEN 'Sur' || k || 'É, ' || f WHEN 1 THEN f || ' Sür' || k || ' Jr' WHEN 2 THEN f || ' De Sur' || k WHEN 3 THEN 'Sur' || k ELSE f || ' Sur' || k END AS name FROM base),
catalog AS (SELECT name FROM named WHERE k % 5 <> 3 UNION ALL SELECT f || ' Sur' || k FROM named WHERE k % 5 = 3 UNION ALL SELECT 'Other Sur' || k FROM named WHERE k % 35 = 3),
asked AS (SELECT k AS guess_id, CASE k % 7 WHEN 0 THEN upper(f) || ' sur' || k || CASE WHEN k % 5 = 0 THEN 'e' ELSE '' END WHEN 1 THEN 'Sur' || k || ' ' || f WHEN 2 THEN 'sur' || k || CASE WHEN k % 5 = 0 THEN 'e' ELSE '' END WHEN 3 THEN 'de sur' || k
  WHEN 4 THEN f || '  Súr' || k || ' III' WHEN 5 THEN 's' ELSE f || ' de ' || 'Sur' || (k + 1) END AS guess FROM base),
norm AS (SELECT *, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS plain FROM named),
ident AS (SELECT *, regexp_replace(plain, '\\s+(jr|sr|ii|iii|iv)$', '') AS a FROM norm),
cplain AS (SELECT name, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS plain FROM catalog),
csur AS (SELECT *, regexp_replace(plain, '\\s+(jr|sr|ii|iii|iv)$', '') AS a, CASE WHEN contains(name, ',') THEN trim(regexp_replace(lower(strip_accents(split_part(name, ',', 1))), '[^a-z0-9]+', ' ', 'g')) ELSE string_split(plain, ' ')[-1] END AS sur FROM cplain),
uniq AS (SELECT sur, min(name) AS name, min(a) AS a FROM csur GROUP BY sur HAVING count(*) = 1),
forms AS (SELECT player_id, a, name, FALSE AS expanded FROM ident UNION ALL SELECT player_id, u.a, u.name, TRUE FROM ident i JOIN uniq u ON u.sur = i.a WHERE NOT contains(i.a, ' ')),
words AS (SELECT *, string_split(a, ' ') AS w, CASE WHEN contains(name, ',') THEN trim(regexp_replace(lower(strip_accents(split_part(name, ',', 1))), '[^a-z0-9]+', ' ', 'g')) ELSE string_split(a, ' ')[-1] END AS sur FROM forms),
said AS (SELECT guess_id, regexp_replace(trim(regexp_replace(lower(strip_accents(guess)), '[^a-z0-9]+', ' ', 'g')), '\\s+(jr|sr|ii|iii|iv)$', '') AS g FROM {asked}),
fits AS (SELECT DISTINCT guess_id, player_id FROM said, words WHERE len(g) >= 2 AND (NOT expanded OR contains(g, ' ')) AND (a = g OR (len(w) = len(string_split(g, ' ')) AND list_sort(w) = list_sort(string_split(g, ' ')))
  OR (len(g) >= 3 AND (g = sur OR (len(w) > 2 AND g = array_to_string(w[2:], ' '))))))"""


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(players, catalog, guesses): names with commas, suffixes, accents, compound surnames and of one word; guesses of each kind."""
    k, mod, n = F.col("k"), F.col("k") % 7, F.col("k").cast("string")
    base = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("Fir"), F.col("c_nationkey").cast("string")).alias("f"))
    five = [F.concat(F.lit("Sur"), n, F.lit("É, "), "f"), F.concat("f", F.lit(" Sür"), n, F.lit(" Jr")), F.concat("f", F.lit(" De Sur"), n), F.concat(F.lit("Sur"), n), F.concat("f", F.lit(" Sur"), n)]
    named = base.select("k", "f", F.concat(F.lit("P"), n).alias("player_id"), F.element_at(F.array(*five), (k % 5 + 1).cast("int")).alias("name"))
    other = named.where("k % 5 = 3").select(F.concat("f", F.lit(" Sur"), n).alias("name")).unionByName(named.where("k % 35 = 3").select(F.concat(F.lit("Other Sur"), n).alias("name")))
    e = F.when(k % 5 == 0, "e").otherwise("")
    seven = [F.concat(F.upper("f"), F.lit(" sur"), n, e), F.concat(F.lit("Sur"), n, F.lit(" "), "f"), F.concat(F.lit("sur"), n, e), F.concat(F.lit("de sur"), n), F.concat("f", F.lit("  Súr"), n, F.lit(" III")), F.lit("s"), F.concat("f", F.lit(" de Sur"), (k + 1).cast("string"))]
    guesses = base.select(k.alias("guess_id"), F.element_at(F.array(*seven), (mod + 1).cast("int")).alias("guess"))
    return named.select("player_id", "name"), named.where("k % 5 <> 3").select("name").unionByName(other), guesses


@register("match_names", "WITH " + _NAMES_SQL.replace("{asked}", "asked") + " SELECT guess_id, player_id FROM fits")
def _match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, catalog, guesses = _names(spark, sf_dir)
    return candidates.match_names(guesses, players, catalog)


# A pair is a customer and the next; every third guess has them the wrong way round, every fourth is of one name only.
_PAIRS_SQL = """, two AS (SELECT x.guess_id, CASE WHEN x.guess_id % 4 = 0 THEN x.guess WHEN x.guess_id % 3 = 0 THEN y.guess || CASE WHEN x.guess_id % 2 = 0 THEN ' & ' ELSE ' AND ' END || x.guess ELSE x.guess || ' + ' || y.guess END AS guess
  FROM asked x JOIN asked y ON y.guess_id = x.guess_id + 1),
parts AS (SELECT guess_id * 2 + i - 1 AS guess_id, p[i] AS guess FROM (SELECT guess_id, string_split_regex(guess, '(?i)\\s*(?:&|\\band\\b|\\+)\\s*') AS p FROM two), LATERAL (VALUES (1), (2)) z(i) WHERE len(p) = 2)"""


@register(
    "match_pairs",
    "WITH " + _NAMES_SQL.replace("\nnorm AS", _PAIRS_SQL.lstrip(", ") + ",\nnorm AS").replace("{asked}", "parts") + """, h AS (SELECT t.guess_id, bool_or(f.guess_id % 2 = 0 AND f.player_id = 'P' || t.guess_id) AS a0, bool_or(f.guess_id % 2 = 1 AND f.player_id = 'P' || t.guess_id) AS a1,
    bool_or(f.guess_id % 2 = 0 AND f.player_id = 'P' || (t.guess_id + 1)) AS b0, bool_or(f.guess_id % 2 = 1 AND f.player_id = 'P' || (t.guess_id + 1)) AS b1 FROM two t JOIN fits f ON f.guess_id // 2 = t.guess_id GROUP BY 1)
    SELECT guess_id FROM h WHERE (a0 AND b1) OR (NOT a0 AND b0 AND a1)""",
)
def _match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, catalog, guesses = _names(spark, sf_dir)
    k = F.col("guess_id")
    two = guesses.join(guesses.select((k - 1).alias("guess_id"), F.col("guess").alias("next")), "guess_id")
    both = F.when(k % 4 == 0, F.col("guess")).when(k % 3 == 0, F.concat("next", F.when(k % 2 == 0, " & ").otherwise(" AND "), "guess")).otherwise(F.concat("guess", F.lit(" + "), "next"))
    answers = two.select("guess_id", F.concat(F.lit("P"), k.cast("string")).alias("a"), F.concat(F.lit("P"), (k + 1).cast("string")).alias("b"))
    return candidates.match_pairs(two.select("guess_id", both.alias("guess")), answers, players, catalog)


# Questions of a game: who scored, how much and in which season. By the event that opens it a result is right, or wrong in one way.
_ANSWERS_SQL = """, g AS (SELECT game_id, season_code, list(DISTINCT player_id) AS who, CAST(sum(points) AS DOUBLE) AS total, (ascii(md5(game_id)[1]) + ascii(md5(game_id)[2])) % 8 AS k FROM actions WHERE points IS NOT NULL GROUP BY ALL)"""


@register("matches_row", with_(ACTIONS_SQL) + _ANSWERS_SQL + " SELECT game_id AS question_id, k IN (0, 1, 2) AS matches FROM g")
def _matches_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir).where("points is not null")
    h = F.md5(F.col("game_id").cast("binary"))
    g = a.groupBy("game_id", "season_code").agg(F.collect_set("player_id").alias("who"), F.sum("points").cast("double").alias("total")).withColumn("k", (F.ascii(F.substring(h, 1, 1)) + F.ascii(F.substring(h, 2, 1))) % 8)
    k, who = F.col("k"), F.array_sort("who")
    listed = F.when(k == 1, F.reverse(who)).when(k == 3, F.concat(who, F.slice(who, 1, 1))).when(k == 4, F.slice(who, 2, 1000)).otherwise(who)
    total = F.when(k == 2, F.col("total") + 0.00005).when(k == 5, F.col("total") + 0.01).otherwise(F.col("total"))
    season = F.when(k != 6, F.col("season_code"))
    g = g.withColumns({"shown_who": F.array_join(listed, " , "), "shown_total": total.cast("string"), "shown_season": season})
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"shown_{n}").alias("value")) for n in ("who", "total", "season")])
    rows = F.when(k == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    results = g.select(F.col("game_id").alias("question_id"), F.explode(rows).alias("row"), fields.alias("fields")).select("question_id", "row", F.inline("fields")).where("value is not null")
    none = {"text": F.lit(None).cast("string"), "number": F.lit(None).cast("double"), "members": F.lit(None).cast("array<string>")}
    want = F.array(*[F.struct(F.lit(n).alias("field"), *[own.get(c, v).alias(c) for c, v in none.items()]) for n, own in (("who", {"members": F.col("who")}), ("total", {"number": F.col("total")}), ("season", {"text": F.col("season_code")}))])
    return evaluation.matches_row(results, g.select(F.col("game_id").alias("question_id"), F.inline(want)))


@register("matches_ids", with_(ACTIONS_SQL) + _ANSWERS_SQL + " SELECT game_id AS question_id, k NOT IN (3, 5) AS matches FROM g")
def _matches_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring actions of a game, with the game's points beside each; some results lack one, or have another sum."""
    a = views.actions(spark, sf_dir).where("points is not null")
    h = F.md5(F.col("game_id").cast("binary"))
    k = (F.ascii(F.substring(h, 1, 1)) + F.ascii(F.substring(h, 2, 1))) % 8
    g = a.groupBy("game_id").agg(F.sum("points").cast("double").alias("number"), F.min("action_id").alias("least")).withColumn("k", k)
    rows = a.join(g, "game_id").where("not (k = 3 and action_id = least)")
    shown = F.when(F.col("k") == 5, F.col("number") + 1).when(F.col("k") == 6, F.col("number") + 0.00001).otherwise(F.col("number"))
    results = rows.select(F.col("game_id").alias("question_id"), F.col("seq").alias("row"), "action_id", F.create_map(F.lit("total"), shown.cast("string")).alias("values"))
    return evaluation.matches_ids(results, a.select(F.col("game_id").alias("question_id"), "action_id"), g.select(F.col("game_id").alias("question_id"), F.lit("total").alias("field"), "number"))


_SEEDED = "CAST('0x' || substr(md5({0} || ':{1}'), 1, 8) AS BIGINT)"


@register(
    "hidden_member",
    with_(ACTIONS_SQL, PLAYERS_SQL, LINEUPS_SQL) + """, l AS (SELECT DISTINCT unnest([home_lineup, road_lineup]) AS lineup_id FROM lineup_at), m AS (SELECT lineup_id, unnest(string_split(lineup_id, '_')) AS player_id FROM l WHERE lineup_id IS NOT NULL),
    r AS (SELECT m.*, CASE WHEN p.player_id IS NOT NULL THEN ['Center', 'Forward', 'Guard', 'Guard / Forward'][CAST(substr(p.player_id, 2) AS INTEGER) % 4 + 1] END AS position FROM m LEFT JOIN players p USING (player_id))
    SELECT lineup_id, player_id, position, row_number() OVER (PARTITION BY lineup_id ORDER BY CASE WHEN position = 'Center' THEN 0 WHEN contains(position, 'Forward') THEN 1 WHEN position = 'Guard' THEN 2 ELSE 3 END, player_id) AS place,
    row_number() OVER (PARTITION BY lineup_id ORDER BY {h}, player_id) = 1 AS hidden FROM r""".replace("{h}", _SEEDED.format("player_id", 0)),
)
def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    sides = lineups.either_side(lineups.lineup_at_action(a, views.starters(a))).where(F.size("lineup") > 0)
    seen = sides.select(F.array_join("lineup", "_").alias("lineup_id"), F.col("lineup").alias("player_ids")).distinct()
    roles = views.players(spark, sf_dir).select("player_id", F.element_at(F.array(*map(F.lit, ("Center", "Forward", "Guard", "Guard / Forward"))), F.substring("player_id", 2, 9).cast("int") % 4 + 1).alias("position"))
    return candidates.hidden_member(seen, roles)


@register("multiple_choice")
def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    first = reports.first_made_three(links.link_actions(a, ("assist_id",))).select(F.col("game_id").alias("question_id"), "player_id")
    return candidates.multiple_choice(first, views.players(spark, sf_dir), 3)


@register(
    "two_options",
    with_(ACTIONS_SQL) + """, f AS (SELECT player_id AS key, sum(points) AS value, {h} AS h FROM actions WHERE points > 0 GROUP BY 1)
    SELECT key, value, CASE WHEN h % 2 = 0 AND value >= 3 THEN value - 3 ELSE value + 3 END AS distractor, h // 2 % 2 = 0 AS answer_first, FROM f""".replace("{h}", _SEEDED.format("player_id", 0)),
)
def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return candidates.two_options(reports.scorers(a, None).select(F.col("player_id").alias("key"), F.col("points").alias("value")), 3)


# Rosters, names of lineups, play order and references by name.


def _attributes(p: DataFrame) -> DataFrame:
    """player_attrs rows of players: two labels, an image, and roles of which one repeats."""
    n = F.substring("player_id", 2, 9).cast("int")
    roles = F.when(n % 3 == 0, F.array(F.lit("Guard"), F.lit("Forward"), F.lit("Guard"))).when(n % 3 == 1, F.array(F.lit("Guard"))).otherwise(F.array(F.lit("Center")))
    p = p.select("player_id", "name", n.alias("n"), roles.alias("roles"))
    label = p.select("player_id", F.lit("label").alias("attr"), F.explode(F.array("name", F.concat(F.lit("Customer "), F.col("n").cast("string")))).alias("value"))
    image = p.select("player_id", F.lit("image").alias("attr"), F.concat(F.lit("img/"), "player_id").alias("value"))
    return label.unionByName(image).unionByName(p.select("player_id", F.lit("position").alias("attr"), F.explode("roles").alias("value")))


@register(
    "game_roster",
    with_(ACTIONS_SQL, PLAYERS_SQL, LINEUPS_SQL) + """, b AS (SELECT DISTINCT game_id, side, team_id, player_id FROM sided WHERE action_code <> 'TOUT'), took AS (SELECT DISTINCT game_id, team_id, player_id FROM sided WHERE points IS NOT NULL OR action_code = 'AS')
    SELECT game_id, side, team_id, player_id, coalesce('Customer ' || CAST(substr(p.player_id, 2) AS INTEGER), 'J' || substr(b.player_id, 2)) AS name, CASE WHEN p.player_id IS NOT NULL THEN 'img/' || p.player_id END AS image,
    CASE WHEN p.player_id IS NULL THEN '' ELSE CASE CAST(substr(p.player_id, 2) AS INTEGER) % 3 WHEN 0 THEN 'Forward / Guard' WHEN 1 THEN 'Guard' ELSE 'Center' END END AS position, f.player_id IS NOT NULL AS is_starter
    FROM b JOIN took USING (game_id, team_id, player_id) LEFT JOIN (SELECT player_id FROM players) p USING (player_id) LEFT JOIN firsts f USING (game_id, side, player_id)""",
)
def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    side = F.when(F.col("team_id") == F.col("home_team"), "home").otherwise("road")
    first = views.starters(a).withColumn("is_starter", F.lit(True))
    box = a.where("action_code <> 'TOUT'").select("game_id", side.alias("side"), "team_id", "player_id").distinct()
    box = box.join(first, ["game_id", "side", "player_id"], "left").withColumn("is_starter", F.coalesce("is_starter", F.lit(False)))
    took = a.where("points is not null or action_code = 'AS'").select("game_id", "team_id", "player_id", F.concat(F.lit("J"), F.expr("substring(player_id, 2)")).alias("jersey_name"))
    return reports.game_roster(box, took, _attributes(views.players(spark, sf_dir)))


@register(
    "ranked_lineup_names",
    with_(ACTIONS_SQL, PLAYERS_SQL, LINEUPS_SQL) + SIDES_SQL + """, top AS (SELECT lineup_team, lineup, coalesce(sum(points) FILTER (team_id = lineup_team), 0) AS points_for FROM sides WHERE len(string_split(lineup, '_')) = 5 GROUP BY ALL ORDER BY points_for DESC, lineup_team, lineup LIMIT 10),
    m AS (SELECT *, unnest(string_split(lineup, '_')) AS player_id FROM top) SELECT lineup_team, lineup, points_for, string_agg(coalesce(name, player_id), ', ' ORDER BY player_id) AS names FROM m LEFT JOIN players USING (player_id) GROUP BY ALL""",
)
def _named_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    best = lineups.rank_lineups(lineups.lineup_at_action(a, views.starters(a)), "points_for").select("lineup_team", "lineup", "points_for")
    return lineups.name_lineups(best, views.players(spark, sf_dir))


@register("player_name_on_court", with_(ACTIONS_SQL, PLAYERS_SQL, LINEUPS_SQL) + " SELECT DISTINCT action_id FROM actions JOIN on_court o USING (game_id, seq) JOIN players p ON p.player_id = o.player_id WHERE p.name = 'Customer#000000003'")
def _named_on_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return lineups.player_on_court(lineups.lineup_at_action(a, views.starters(a)), "customer 000000003", views.players(spark, sf_dir)).select("action_id")


@register("with_lineup", with_(ACTIONS_SQL, LINEUPS_SQL) + SIDES_SQL + " SELECT DISTINCT action_id FROM sides WHERE lineup = (SELECT max(lineup) FROM sides WHERE len(string_split(lineup, '_')) = 5)")
def _with_lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    a = stash(lineups.lineup_at_action(a, views.starters(a)).select("action_id", "home_team", "road_team", "home_lineup", "road_lineup"), "lineups")
    most = lineups.either_side(a).where(F.size("lineup") == 5).agg(F.max(F.array_join("lineup", "_"))).first()[0]
    return lineups.with_lineup(a, (most or "").split("_")).select("action_id")


simple(
    "play_order",
    """, n AS (SELECT *, CASE WHEN original_event_id % 4 <> 0 THEN seq ELSE 0 END AS sq, CAST(left(period, 1) AS INTEGER) AS p FROM actions),
    s AS (SELECT u.*, CASE WHEN u.sq > 0 THEN u.sq ELSE (SELECT min(x.sq) FROM n x WHERE x.game_id = u.game_id AND x.p = u.p AND x.sq > 0 AND (x.seconds_remaining < u.seconds_remaining OR (x.seconds_remaining = u.seconds_remaining AND x.action_id > u.action_id))) END AS slot FROM n u)
    SELECT action_id, row_number() OVER (PARTITION BY game_id ORDER BY p, slot NULLS LAST, CAST(sq > 0 AS INTEGER), seconds_remaining DESC, action_id) AS place FROM s""",
    lambda a: reports.play_order(a.withColumn("seq", F.when(F.col("original_event_id") % 4 != 0, F.col("seq")).otherwise(0))).select("action_id", "place"),
)
simple("capped", " SELECT action_id FROM actions ORDER BY original_event_id LIMIT 200", lambda a: reports.capped(a.orderBy("original_event_id")).select("action_id"))
simple(
    "requested_actions",
    """, r AS (SELECT action_id FROM actions UNION SELECT player_id FROM actions) SELECT action_id, action_class, period, points, action_class IS NOT NULL AS matched FROM r LEFT JOIN actions USING (action_id)""",
    lambda a: evaluation.summarise_matches(a.select("action_id").unionByName(a.select(F.col("player_id").alias("action_id"))), a),
)


@register(
    "fouls_drawn",
    "WITH RECURSIVE" + ",".join([ACTIONS_SQL, FOULS_SQL]) + """ SELECT d.player_id, f.player_id AS other, count(*) AS n FROM actions d LEFT JOIN drawn_l l ON l.action_id = d.action_id LEFT JOIN actions f ON f.action_id = l.fouled_by
    WHERE d.action_class = 'FoulDrawn' GROUP BY ALL""",
)
def _fouls_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fouls_drawn(links.with_foul_links(views.actions(spark, sf_dir)), None)


@register("player_pool", with_(ACTIONS_SQL, LINEUPS_SQL) + ", chosen AS (SELECT game_id FROM (SELECT DISTINCT game_id FROM actions) ORDER BY {h}, game_id LIMIT 5) SELECT DISTINCT player_id FROM on_court WHERE game_id IN (SELECT game_id FROM chosen)".replace("{h}", _SEEDED.format("game_id", 3)))
def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return candidates.player_pool(lineups.roster_seen(lineups.lineup_at_action(a, views.starters(a))), a, 5, 3)


# Scalar functions over whole tables.
simple(
    "clock_columns",
    """ SELECT action_id, CAST(seconds_remaining AS DOUBLE) AS clock_s, 600 AS length, CASE action_code WHEN 'BP' THEN '10:00' WHEN 'EP' THEN '00:00' ELSE '' END AS default_clock, CAST(left(period, 1) AS INTEGER) AS place,
    CASE WHEN contains(action_class, 'TwoPointShot') THEN 'two-pointers' WHEN contains(action_class, 'ThreePointShot') THEN 'three-pointers' WHEN contains(action_class, 'FreeThrow') THEN 'free-throws'
    WHEN contains(action_class, 'Rebound') THEN 'rebounds' WHEN contains(action_class, 'Assist') THEN 'assists' WHEN contains(action_class, 'Turnover') THEN 'turnovers' WHEN contains(action_class, 'Foul') THEN 'fouls'
    WHEN contains(action_class, 'Steal') THEN 'steals' WHEN contains(action_class, 'Block') THEN 'blocks' WHEN action_class IN ('PlayerIn', 'PlayerOut') THEN 'substitutions' WHEN action_class = 'Timeout' THEN 'timeouts' ELSE 'periods' END AS category,
    'https://example.org/players/-/' || substr(player_id, 2) AS player_uri, CASE season_code WHEN 'E2023' THEN '2023-24' ELSE '2024-25' END AS season FROM actions""",
    lambda a: a.select(
        "action_id", c.clock_seconds("clock").alias("clock_s"), c.period_length("period").alias("length"), c.default_clock("action_code", "period").alias("default_clock"), c.period_order("period").alias("place"),
        c.action_category("action_class").alias("category"), c.entity_uri("players", "player_id").alias("player_uri"), c.season_label("season_code").alias("season"),
    ),
)
simple(
    "shot_columns",
    """ SELECT action_id, coord_x AS x, coord_y AS y, NOT (coord_x = -1 AND coord_y = -1) AS located, CASE WHEN shot_zone IN ('A', 'B', 'C') THEN 'paint' WHEN shot_zone IN ('D', 'E', 'F', 'G') THEN 'mid-range'
    WHEN shot_zone = 'H' AND coord_x <= -600 AND coord_y <= 175 THEN 'left corner' WHEN shot_zone = 'H' THEN 'left perimeter' WHEN shot_zone = 'I' THEN 'right perimeter' WHEN shot_zone = 'J' THEN 'very long' END AS region,
    contains(action_class, 'Made') AS made, contains(action_class, 'ThreePoint') AS three, CASE WHEN team_id = home_team THEN 'home' ELSE 'road' END AS side, coalesce(points, 0) AS pts FROM actions""",
    lambda a: a.withColumn("xy", c.shot_xy(F.concat_ws(",", "coord_x", "coord_y"))).select(
        "action_id", "xy.x", "xy.y", c.has_location("coord_x", "coord_y").alias("located"), c.shot_region("shot_zone", "coord_x", "coord_y").alias("region"), c.is_made("action_class").alias("made"), c.is_three("action_class").alias("three"),
        c.team_side("team_id", "home_team", "road_team").alias("side"), c.points_of("action_class").alias("pts"),
    ),
)


@register("text_columns", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '([.!?])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')) AS prose, regexp_matches(text, '[\\x{370}-\\x{3ff}\\x{1f00}-\\x{1fff}]') AS greek,
  trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents""")
def _text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.read(spark, sf_dir, "documents")
    return d.select("doc_id", c.clean_prose("text").alias("prose"), c.contains_script("text").alias("greek"), c.normalize_name("text").alias("plain"))


@register("tag_questions")
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.read(spark, sf_dir, "conversations")
    return q.select("conv_id", "turn", c.tag_question("text").alias("kind"), F.array_join(c.tag_shot_styles("text"), ",").alias("styles"), c.profile_subject("text").alias("subject"), c.first_sentences("text", 2).alias("opening"))



# Attributes, referees and run logs derived from the tables.
@register(
    "collapse_multivalued",
    with_(ACTIONS_SQL, PLAYERS_SQL) + """ SELECT player_id, 'Customer ' || CAST(substr(player_id, 2) AS INTEGER) AS label, 'img/' || player_id AS image,
    CASE CAST(substr(player_id, 2) AS INTEGER) % 3 WHEN 0 THEN 'Forward / Guard' WHEN 1 THEN 'Guard' ELSE 'Center' END AS position FROM players""",
)
def _collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.collapse_multivalued(_attributes(views.players(spark, sf_dir)))


def _refereed(a: DataFrame) -> DataFrame:
    referees = a.select("game_id", F.concat(F.lit("R"), (F.col("game_code").cast("int") % 5).cast("string")).alias("referee_id")).distinct()
    return scope.refereed_by(a, referees, "R3").select("action_id")


simple("refereed_by", " SELECT action_id FROM actions WHERE CAST(game_code AS INTEGER) % 5 = 3", _refereed)
simple(
    "same_results",
    """, l AS (SELECT team_id, list_sort(list_distinct(list(player_id))) AS ids, sum(points) AS t FROM actions WHERE season_code = 'E2023' AND points IS NOT NULL GROUP BY 1),
    r AS (SELECT team_id, list_sort(list_distinct(list(player_id))) AS ids, sum(points) AS t FROM actions WHERE points IS NOT NULL GROUP BY 1)
    SELECT team_id, l.ids IS NOT DISTINCT FROM r.ids AS same_ids, coalesce(abs(l.t - r.t) <= 1e-4, FALSE) AS same_total FROM l FULL JOIN r USING (team_id)""",
    lambda a: evaluation.same_results(a.where("season_code = 'E2023' and points is not null"), a.where("points is not null"), ["team_id"], "player_id", "points"),
)


@register(
    "run_scorecard",
    """WITH g AS (SELECT lang AS provider, source AS model, CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS prompt_variant, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))
    SELECT provider, model, prompt_variant, count(*) AS runs, count(*) FILTER (quality = 1) AS completed, count(*) FILTER (toxic = 0) AS safe, count(*) FILTER (n_chars > 1000) AS scoped, count(*) FILTER (toxic = quality) AS overlay,
    count(*) FILTER (quality = 1) AS query_correct_human, count(*) FILTER (toxic = 0) AS result_correct_human, sum(n_chars) AS input_tokens, sum(n_chars // 10) AS output_tokens,
    sum(n_chars) AS cost_units, sum(n_chars) / count(*) AS mean_latency_ms FROM g GROUP BY ALL""",
)
def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels"), "doc_id")
    log = d.select(
        F.col("lang").alias("provider"), F.col("source").alias("model"), F.when(F.col("quality") == 1, "long").otherwise("short").alias("prompt_variant"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"),
        (F.col("toxic") == 0).alias("query_is_read_only"), (F.col("n_chars") > 1000).alias("query_contains_selected_scope"), (F.col("toxic") == F.col("quality")).alias("playbyplay_filter_matches_expectation"),
        F.when(F.col("quality") == 1, "Yes").otherwise("no").alias("query_correct_human"), F.when(F.col("toxic") == 0, "1").otherwise("0").alias("result_correct_human"),
        F.col("n_chars").alias("input_tokens"), F.floor(F.col("n_chars") / 10).alias("output_tokens"), F.col("n_chars").alias("cost_usd"), F.col("n_chars").cast("double").alias("latency_ms"),
    )
    return evaluation.run_scorecard(log).withColumnRenamed("cost_usd", "cost_units")
