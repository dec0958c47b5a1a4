"""All triples of actions, links and observations, and the check of a file of them against the actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BASE_URI, action_uri, decimal_text, entity_uri, game_uri, lineup_uri
from .writers import RDF_TYPE, TYPES, iri, literal

# The terms of an action in the vocabulary, the column that each comes from, and its kind of value.
ACTION_TERMS = [
    ("hasPlayByPlaySequence", "seq", "string"),
    ("quarter", "period", "string"),
    ("clock", "clock", "string"),
    ("quarterSecondsRemaining", "seconds_remaining", "integer"),
    ("runningHomeTeamScore", "home_score", "integer"),
    ("runningRoadTeamScore", "road_score", "integer"),
    ("runningHomeTeamLineup", "home_lineup", "lineup"),
    ("runningRoadTeamLineup", "road_lineup", "lineup"),
    ("actionTeam", "team_id", "teams"),
    ("actionPlayer", "player_id", "players"),
    ("actionCoach", "coach", "coaches"),
    ("pointsAwarded", "points", "integer"),
    ("shotCoords", "shot_coords", "string"),
    ("shotZone", "shot_zone", "string"),
    ("isFastBreak", "is_fast_break", "boolean"),
    ("isSecondChance", "is_second_chance", "boolean"),
    ("isFromTurnover", "is_from_turnover", "boolean"),
    ("causedByViolation", "caused_by_violation", "boolean"),
]
# The terms of links, and the column that names the other action.
LINK_TERMS = {"hasAssist": "assist_id", "leadsToRebound": "leads_to_rebound", "blockedBy": "blocked_by", "occuredByFoul": "fouled_by", "causedByFoul": "caused_by_foul", "causedBySteal": "caused_by_steal"}
HAS_ACTION, SEQUENCE = "hasPlayByPlayAction", "hasPlayByPlaySequence"
KEYS = ["season_code", "game_id"]


def _line(s: Column, p: Column, o: Column) -> Column:
    return F.concat(iri(s), F.lit(" "), iri(p), F.lit(" "), o, F.lit(" ."))


def _term(column: str, kind: str, base: str) -> tuple[Column, str]:
    """The text of a value, and "iri" or what follows the literal."""
    if kind == "lineup":
        return F.nullif(lineup_uri(F.col(column.replace("lineup", "team")), column, base), F.lit("")), "iri"
    if kind in ("teams", "players", "coaches"):
        return entity_uri(kind, column, base), "iri"
    whole = F.col(column).cast("long") if kind == "integer" else F.col(column)
    return whole.cast("string"), "" if kind == "string" else f"^^<{TYPES}{kind}>"


def action_lines(acts: DataFrame, vocabulary: str, base: str = BASE_URI) -> DataFrame:
    """(season_code, game_id, line): each action's game link, type, properties and links; null values have no line.

    Of ACTION_TERMS and LINK_TERMS those count whose columns acts has. A link
    to an action that isn't in acts has no line.
    """
    game = game_uri("season_code", "game_code", base)
    own = acts.withColumns({"_game": game, "_s": action_uri(game, "original_event_id")})
    told_of = [("_game", HAS_ACTION, (F.col("_s"), "iri")), ("_s", None, (F.concat(F.lit(vocabulary), "action_class"), "iri"))]
    told_of += [("_s", term, _term(c, kind, base)) for term, c, kind in ACTION_TERMS if c in acts.columns]
    pairs = [F.struct(F.col(s).alias("s"), F.lit(vocabulary + term if term else RDF_TYPE).alias("p"), value.alias("v"), F.lit(kind).alias("kind")) for s, term, (value, kind) in told_of]
    # written after they are stacked: code that writes each of the terms grows too long to be compiled
    o = F.when(F.col("kind") == "iri", iri(F.col("v"))).otherwise(F.concat(literal(F.col("v")), "kind"))
    told = own.select(*KEYS, F.inline(F.array(*pairs))).where("v is not null").select(*KEYS, _line(F.col("s"), F.col("p"), o).alias("line"))
    ends = [F.struct(F.lit(vocabulary + term).alias("p"), F.col(c).alias("other")) for term, c in LINK_TERMS.items() if c in acts.columns]
    if not ends:
        return told
    at = own.select(F.col("action_id").alias("other"), F.col("_s").alias("o"))
    linked = own.select(*KEYS, "_s", F.inline(F.array(*ends))).where("other is not null").join(at, "other").select(*KEYS, _line(F.col("_s"), F.col("p"), iri(F.col("o"))).alias("line"))
    return told.unionByName(linked)


def video_lines(videos: DataFrame, matches: DataFrame, vocabulary: str, base: str = BASE_URI) -> DataFrame:
    """(season_code, game_id, line): each video of a game, the observations that actions are matched to, and these matches.

    videos: season_code, game_id, game_code, youtube_url, ocr_profile,
    playback_lead_seconds, enabled, where a url that isn't one is an error.
    matches: game_id, original_event_id, observation_seq, video_time, period,
    clock, one per action; actions without an observation_seq don't count.
    """
    game = game_uri("season_code", "game_code", base)
    url = F.when(F.col("youtube_url").rlike(r"^https?://[^\s<>]+$"), F.col("youtube_url")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no video address for"), "game_id")))
    v = videos.withColumns({"_game": game, "_video": F.concat(game, F.lit("#BroadcastVideo"))})

    def pair(term: str, o: Column) -> Column:
        return F.struct(F.lit(term if term == RDF_TYPE else vocabulary + term).alias("p"), o.alias("o"))

    def lines(rows: DataFrame, s: str, pairs: list[Column]) -> DataFrame:
        return rows.select(*KEYS, F.col(s).alias("_s"), F.inline(F.array(*pairs))).where("o is not null").select(*KEYS, _line(F.col("_s"), F.col("p"), F.col("o")).alias("line"))

    shown = lines(v, "_video", [
        pair(RDF_TYPE, iri(F.lit(f"{vocabulary}BroadcastVideo"))), pair("youtubeURL", iri(url)), pair("ocrProfile", literal(F.coalesce("ocr_profile", F.lit("")))),
        pair("playbackLeadSeconds", literal(decimal_text(F.coalesce("playback_lead_seconds", F.lit(5.0))), "decimal")), pair("isVideoEnabled", literal(F.coalesce("enabled", F.lit(True)), "boolean")),
    ])
    of_game = lines(v, "_game", [pair("hasBroadcastVideo", iri(F.col("_video")))])
    m = matches.where("observation_seq is not null").join(v.select(*KEYS, "_game", "_video"), "game_id")
    m = m.withColumns({"_s": action_uri("_game", "original_event_id"), "_o": F.concat("_video", F.lit("_Observation_"), F.col("observation_seq").cast("string"))})
    seen = m.select(*KEYS, "_video", "_o", "observation_seq", "video_time", "period", "clock").distinct()
    told = lines(seen, "_o", [
        pair(RDF_TYPE, iri(F.lit(f"{vocabulary}OCRObservation"))), pair("ocrSequence", literal(F.col("observation_seq"), "integer")), pair("videoTimeSeconds", literal(decimal_text("video_time"), "decimal")),
        pair("ocrQuarter", literal(F.col("period"))), pair("ocrClock", literal(F.col("clock"))),
    ])
    of_video = lines(seen, "_video", [pair("hasOCRObservation", iri(F.col("_o")))])
    placed = lines(m, "_s", [pair("correspondsToOCRObservation", iri(F.col("_o")))])
    return of_game.unionByName(shown).unionByName(told).unionByName(of_video).unionByName(placed)


# Problems that check_lines tells, and what each counts.
PROBLEMS = ["malformed", "duplicate", "missing link", "unexpected link", "missing type", "wrong type", "unexpected type", "missing sequence"]


def check_parsed(parsed: DataFrame, acts: DataFrame, vocabulary: str, base: str = BASE_URI) -> DataFrame:
    """(game, problem, n): faults of parse_lines() (s, p, o, o_kind, datatype) as an export of acts; game is a URI, null for malformed lines.

    malformed: lines that are no triples; duplicate: beyond the first of each
    triple; links of a game to actions that are missing or to others; actions
    without a type, with another type only (wrong) and types beyond the right
    one (unexpected; a wrong type is one too); actions without a sequence.

    The lines are read once. Actions and triples meet in one union, with one aggregate per game and
    action; a game's triples never have to be in one place.
    """
    game = game_uri("season_code", "game_code", base)
    want = acts.select(game.alias("game"), action_uri(game, "original_event_id").alias("action"), F.lit("want").alias("tag"), F.concat(F.lit(vocabulary), "action_class").alias("value"))
    once = parsed.groupBy("s", "p", "o", "o_kind", "datatype").agg(F.count("*").alias("copies"))
    of = F.substring_index("s", "#", 1)
    bad = F.col("o_kind").isNull()
    is_link = (F.col("p") == vocabulary + HAS_ACTION) & (F.col("o_kind") == "iri")
    tag = F.when(is_link, F.lit("link")).when((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri"), F.lit("type")).when(F.col("p") == vocabulary + SEQUENCE, F.lit("sequence"))
    said = once.select(of.alias("game"), F.when(is_link, F.col("o")).otherwise(F.col("s")).alias("action"), tag.alias("tag"), F.col("o").alias("value"), F.when(bad, 0).otherwise(F.col("copies") - 1).alias("again"), F.when(bad, F.col("copies")).otherwise(0).alias("malformed"))
    both = want.withColumns({c: F.lit(0).cast("long") for c in ("again", "malformed")}).unionByName(said)

    def any_(name: str) -> Column:
        return F.coalesce(F.max(F.col("tag") == name), F.lit(False))

    each = both.groupBy("game", "action").agg(
        any_("want").alias("wanted"), any_("link").alias("linked"), any_("sequence").alias("sequenced"), F.max(F.when(F.col("tag") == "want", F.col("value"))).alias("right"),
        F.collect_set(F.when(F.col("tag") == "type", F.col("value"))).alias("types"), F.sum("again").alias("again"), F.sum("malformed").alias("malformed"),
    )
    wanted, typed, right = F.col("wanted"), F.size("types") > 0, F.array_contains("types", F.col("right"))
    counts = {
        "malformed": F.col("malformed"),
        "duplicate": F.col("again"),
        "missing link": (wanted & ~F.col("linked")).cast("long"),
        "unexpected link": (~wanted & F.col("linked")).cast("long"),
        "missing type": (wanted & ~typed).cast("long"),
        "wrong type": (wanted & typed & ~right).cast("long"),
        "unexpected type": F.when(wanted, F.size(F.array_except("types", F.array("right"))).cast("long")).otherwise(0),
        "missing sequence": (wanted & ~F.col("sequenced")).cast("long"),
    }
    per_game = each.groupBy("game").agg(*[F.sum(v).alias(k) for k, v in counts.items()])
    told = per_game.select("game", F.inline(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(f"`{k}`").alias("n")) for k in counts])))
    return told.where("n > 0")


def check_lines(triples: DataFrame, malformed: DataFrame, acts: DataFrame, vocabulary: str, base: str = BASE_URI) -> DataFrame:
    """check_parsed() of well-formed and malformed lines that were told apart before."""
    return check_parsed(triples.unionByName(malformed.select(*[F.lit(None).cast("string").alias(c) for c in triples.columns])), acts, vocabulary, base)
