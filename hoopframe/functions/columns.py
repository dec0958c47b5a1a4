"""Scalar functions of the play-by-play domain, all of them built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_URI = "https://example.org"

# The feed's action codes and their classes.
ACTION_CLASSES = {
    "JB": "JumpBall",
    "BP": "PeriodStart",
    "EP": "PeriodEnd",
    "EG": "GameEnd",
    "TOUT_TV": "TimeoutTV",
    "TOUT": "Timeout",
    "2FGM": "TwoPointShotMade",
    "2FGA": "TwoPointShotMissed",
    "3FGM": "ThreePointShotMade",
    "3FGA": "ThreePointShotMissed",
    "FTM": "FreeThrowMade",
    "FTA": "FreeThrowMissed",
    "AS": "Assist",
    "FV": "Block",
    "OF": "OffensiveFoul",
    "CM": "DefensiveFoul",
    "B": "BenchFoul",
    "CMU": "UnsportsmanlikeFoul",
    "CMT": "TechnicalFoul",
    "C": "CoachFoul",
    "RV": "FoulDrawn",
    "TO": "Turnover",
    "O": "OffensiveRebound",
    "D": "DefensiveRebound",
    "ST": "Steal",
    "IN": "PlayerIn",
    "OUT": "PlayerOut",
    "CCH": "Challenge",
}
# The first category whose pattern occurs in the class.
CATEGORIES = [
    ("two-pointers", "TwoPointShot"),
    ("three-pointers", "ThreePointShot"),
    ("free-throws", "FreeThrow"),
    ("rebounds", "Rebound"),
    ("assists", "Assist"),
    ("turnovers", "Turnover"),
    ("fouls", "Foul"),
    ("steals", "Steal"),
    ("blocks", "Block|ShotRejected"),
    ("substitutions", "Substitution|PlayerIn|PlayerOut"),
    ("timeouts", "Timeout"),
    ("jump-balls", "JumpBall"),
    ("periods", "BeginPeriod|EndPeriod|PeriodStart|PeriodEnd|GameEnd|EndGame"),
]
# Words in a play's description that make a turnover a violation.
VIOLATIONS = ["travel", "second", "out of bound", "step", "violation", "carry", "goaltend"]
# Country codes that have a full name.
COUNTRIES = {
    "GRE": "Greece",
    "TUR": "Türkiye",
    "USA": "United States",
    "ESP": "Spain",
    "FRA": "France",
    "SRB": "Serbia",
    "GER": "Germany",
    "ITA": "Italy",
    "LTU": "Lithuania",
    "CRO": "Croatia",
    "SLO": "Slovenia",
    "ARG": "Argentina",
    "BRA": "Brazil",
    "CAN": "Canada",
    "AUS": "Australia",
    "CZE": "Czechia",
    "MNE": "Montenegro",
    "BIH": "Bosnia and Herzegovina",
    "CYP": "Cyprus",
}
# Kinds of question, first match; and shot styles, all matches.
QUESTION_KINDS = [
    ("assists", r"\bassist(?:s|ed|ing)?\b|\basist(?:s)?\b|ασ[ίι]στ"),
    ("rebounds", r"\brebound(?:s|ed|ing)?\b|\bribaund(?:s)?\b|ριμπ[άα]ουντ"),
    ("turnovers", r"\bturnover(?:s)?\b|\blath(?:os|i)\b|λ[άα]θ(?:ος|η)"),
    ("fouls", r"\bfoul(?:s|ed)?\b|\bfaoul\b|φ[άα]ουλ"),
    ("steals", r"\bsteal(?:s)?\b|\bkleps(?:imo|imata)\b|κλ[έε]ψιμο"),
    ("blocks", r"\bblock(?:s|ed)?\b|\btap(?:a|es)\b|τ[άα]πα"),
    ("shots", r"\bshot(?:s)?\b|free[ -]?throw|three[ -]?point|two[ -]?point|\b[23]\s*(?:pt|point)|\bthrees?\b|tripont|dipont|τρ[ίι]ποντ|δ[ίι]ποντ|σουτ"),
    ("points", r"\bpoint(?:s)?\b|\bpont(?:os|oi|ous|a)\b|π[όο]ντ"),
]
SHOT_STYLES = [
    ("alley-oops", r"\b(?:alley|allay|ally)[\s-]*oops?\b"),
    ("dunks", r"\bdunk(?:s|ing|ed)?\b|\bslam[\s-]*dunks?\b"),
    ("layups", r"\blay[\s-]*ups?\b"),
    ("floaters", r"\bfloaters?\b"),
    ("hook shots", r"\b(?:jump[\s-]*)?hooks?(?:\s+shots?)?\b"),
    ("tip-ins", r"\btip[\s-]*ins?\b"),
    ("fadeaways", r"\bfade[\s-]*aways?\b"),
    ("bank shots", r"\bbank[\s-]*shots?\b"),
    ("putback dunks", r"\bput[\s-]*backs?\b"),
]
# The three forms of a request for a profile.
SUBJECT_PATTERNS = [
    r"(.+?)\s+(?:bio(?:graphy)?|profile)",
    r"(?:who is|who was|tell me about|introduce|profile of|bio(?:graphy)? (?:of|for))\s+(.+)",
    r"(?:(?:i (?:want|would like)|give me|show me|can you (?:give|show) me)\s+)?(?:some |more )?(?:info(?:rmation)?|a biography|a bio|a profile|background)(?:\s+(?:about|on|for|of))?\s+(.+)",
]
# What is cleaned out of prose, in order.
PROSE_CLEANING = [("<[^>]*>", ""), (r"(?i)\bHe(?:'s| is) still playing there\.?", ""), (r"(?<=[.!?])(?=[A-Z])", " "), (r"\s+", " ")]
# Verbs that sentences start with, and other starts that are rewritten.
BARE_VERB = r"^(Grew|Signed|Moved|Won|Played)\b"
SENTENCE_REWRITES = [(r"^He signed for the (.+?) season by (.+?)\.$", r"He joined $2 for the $1 season."), (r"^Named\b", "He was named")]
# Names of phases and of groups of games.
PHASES = {"regular season": "Regular season", "playoffs": "Playoffs", "play offs": "Playoffs", "final four": "Final Four", "play in": "Play-in", "play in showdown": "Play-in"}
FINALS = ["championship game", "final", "finals"]
THIRD_PLACES = ["third place game", "third place", "3rd place game", "3rd place"]
# Names of periods in feeds.
FEED_PERIODS = {"FIRSTQUARTER": "1st", "SECONDQUARTER": "2nd", "THIRDQUARTER": "3rd", "FORTHQUARTER": "4th"}
# Words that a subject doesn't have.
SUBJECT_STOPS = r"\b(points?|assists?|rebounds?|scored|most|best|team|season|game|shots?|percentage)\b"
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçĆćČčĎďÈÉÊËĒĖĘĚèéêëēėęěĢģÌÍÎÏĪĮìíîïīįĶķĻļÑñŃńŅņŇňÒÓÔÕÖŐòóôõöőŔŕŘřŚśŠšŞşŤťÙÚÛÜŪŮŰŲùúûüūůűųÝýÿŹźŻżŽžĞğ"
PLAIN = "AAAAAAaaaaaaCcCcCcDdEEEEEEEEeeeeeeeeGgIIIIIIiiiiiiKkLlNnNnNnNnOOOOOOooooooRrRrSsSsSsTtUUUUUUUUuuuuuuuuYyyZzZzZzGg"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def _first(cases: list[tuple[Column, Column | str]], default: Column) -> Column:
    out = reduce(lambda acc, c: F.when(c[0], c[1]) if acc is None else acc.when(c[0], c[1]), cases, None)
    return out.otherwise(default)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clock_seconds(clock: Column | str, strict: bool = False) -> Column:
    """Seconds of MM:SS or of plain decimal seconds; null when it is neither. strict: the seconds part must be under 60."""
    def seconds(c: Column) -> Column:
        minutes = c.rlike(r"^-?\d+:-?\d{1,2}(\.\d+)?$")
        m, s = F.split(c, ":").getItem(0).try_cast("double"), F.get(F.split(c, ":"), F.lit(1)).try_cast("double")
        good = minutes & (s < 60) if strict else minutes
        return F.when(good, m * 60 + s).when(~c.contains(":"), c.try_cast("double"))

    return _let(F.trim(_c(clock)), seconds)


def clamp_clock(clock: Column | str) -> Column:
    """A negative clock becomes 00:00; a null one an empty string."""
    c = F.trim(F.coalesce(_c(clock), F.lit("")))
    return F.when(clock_seconds(c) < 0, F.lit("00:00")).otherwise(c)


def period_length(period: Column | str) -> Column:
    """300 seconds for an overtime, 600 for any other period."""
    return F.when(F.upper(F.coalesce(_c(period), F.lit(""))).rlike("EXTRATIME|OT"), 300).otherwise(600)


def max_period_seconds(period: Column | str) -> Column:
    """600 or 300 for known periods, null for others."""
    p = normalize_period(period)
    return F.when(p.isin("1st", "2nd", "3rd", "4th"), 600).when(p.rlike(r"^(\d+)?OT$"), 300)


def default_clock(code: Column | str, period: Column | str) -> Column:
    """The clock of period boundaries that the feed leaves empty: the length at the start, 00:00 at an end."""
    start = F.format_string("%02d:00", (period_length(period) / 60).cast("int"))
    return F.when(_c(code) == "BP", start).when(_c(code).isin("EP", "EG"), "00:00").otherwise("")


def normalize_period(period: Column | str) -> Column:
    """1, Q1, 1ST → 1st; OT, OT1, 1OT → OT; OT2, 2OT → 2OT; feed names too; anything else in lower case."""
    q = F.upper(F.trim(F.coalesce(_c(period), F.lit(""))))
    names = FEED_PERIODS | {f"{a}{n}{b}": f"{n}{s}" for n, s in ((1, "st"), (2, "nd"), (3, "rd"), (4, "th")) for a, b in (("", ""), ("Q", ""), ("", s.upper()))}
    n = F.regexp_extract(q, r"^(?:OT|EXTRATIME)?(\d*)(?:OT)?$", 1)
    over = q.rlike(r"^(?:OT\d*|\d+OT|EXTRATIME\d*)$")
    return _lookup(names, q, F.when(over, F.when(n.isin("", "1"), "OT").otherwise(F.concat(n, F.lit("OT")))).otherwise(F.lower(q)))


def period_order(period: Column | str) -> Column:
    """1 to 4, 5 for the first overtime, 4 + n for the n-th, 99 for unknown periods."""
    p = normalize_period(period)
    n = F.regexp_extract(p, r"^(\d+)OT$", 1).try_cast("int")
    return F.when(p == "OT", 5).when(n.isNotNull(), n + 4).otherwise(_lookup({"1st": "1", "2nd": "2", "3rd": "3", "4th": "4"}, p, F.lit("99")).cast("int"))


def action_class(code: Column | str) -> Column:
    """The class of a code; unknown codes pass through."""
    return _lookup(ACTION_CLASSES, _c(code), _c(code))


def action_category(cls: Column | str) -> Column:
    c = F.coalesce(_c(cls), F.lit(""))
    return _first([(c.rlike(p), name) for name, p in CATEGORIES], F.lit("other"))


def entity_uri(kind: str, value: Column | str, base: str = BASE_URI) -> Column:
    """URI of a team, player (without P) or coach (Last, First → last-first); null for an empty value."""
    v = F.trim(_c(value))
    tail = {"teams": v, "players": F.regexp_replace(v, "P", ""), "coaches": F.lower(F.replace(F.replace(v, F.lit(", "), F.lit("-")), F.lit(" "), F.lit("-")))}[kind]
    return F.when(F.length(v) > 0, F.concat(F.lit(f"{base}/{kind}/-/"), tail))


def action_uri(game: Column | str, event_id: Column | str) -> Column:
    return F.concat(_c(game), F.lit("#PlayByPlay_J"), _c(event_id).cast("string"))


def lineup_uri(team: Column | str, players: Column | str, base: str = BASE_URI) -> Column:
    """URI of a team's set of players: their sorted ids joined by _; empty for no players."""
    ids = F.array_sort(F.transform(_c(players), lambda p: F.trim(F.regexp_replace(p, "P", ""))))
    return F.when(F.size(ids) > 0, F.concat(F.lit(f"{base}/teams/-/"), _c(team), F.lit("#Lineup_"), F.array_join(ids, "_"))).otherwise("")


def uri_tail(uri: Column | str) -> Column:
    return F.substring_index(_c(uri), "/", -1)


def uri_event_id(uri: Column | str) -> Column:
    return F.regexp_extract(_c(uri), r"#PlayByPlay_J(\d+)", 1).try_cast("int")


def uri_players(uri: Column | str) -> Column:
    return F.filter(F.split(F.regexp_extract(_c(uri), r"#Lineup_(.*)$", 1), "_"), lambda x: x != "")


def uri_team(uri: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(uri), r"teams/-/([^#]*)", 1), F.lit(""))


def uri_season(uri: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(uri), r"/(E\d{4})/", 1), F.lit(""))


def season_label(code: Column | str) -> Column:
    """E2023 → 2023-24; null for other codes."""
    year = F.regexp_extract(_c(code), r"^E(\d{4})$", 1).try_cast("int")
    return F.when(year.isNotNull(), F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")))


def game_uri(season: Column | str, game: Column | str, base: str = BASE_URI) -> Column:
    return F.concat(F.lit(f"{base}/games/"), _c(season), F.lit("/"), _c(game).cast("string"))


def shot_xy(coords: Column | str) -> Column:
    """Struct x, y of "x,y"; -1, -1 for anything that isn't two finite numbers."""
    parts = F.split(F.coalesce(_c(coords), F.lit("")), ",")
    x, y = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))

    def finite(v: Column) -> Column:
        return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))

    good = (F.size(parts) == 2) & finite(x) & finite(y)
    return F.struct(F.when(good, x).otherwise(-1.0).alias("x"), F.when(good, y).otherwise(-1.0).alias("y"))


def has_location(x: Column | str, y: Column | str) -> Column:
    return F.coalesce(~((_c(x) == -1) & (_c(y) == -1)), F.lit(False))


def court_position(x: Column | str, y: Column | str, side: Column | str) -> Column:
    """Rim-relative centimetres to metres on a 28 x 15 court, origin at the centre: clamped, the home side attacks right."""
    along = F.least(F.greatest(12.425 - _c(y) / 100, F.lit(-14.0)), F.lit(14.0))
    across = F.least(F.greatest(_c(x) / 100, F.lit(-7.5)), F.lit(7.5))
    flip = F.when(_c(side) == "home", 1.0).otherwise(-1.0)
    return F.struct((along * flip).alias("along"), (across * flip).alias("across"))


def shot_region(zone: Column | str, x: Column | str, y: Column | str) -> Column:
    z = F.upper(F.trim(_c(zone)))
    corner = (z == "H") & (_c(x) <= -600) & (_c(y) <= 175)
    return _first([(z.isin("A", "B", "C"), "paint"), (z.isin("D", "E", "F", "G"), "mid-range"), (corner, "left corner"), (z == "H", "left perimeter"), (z == "I", "right perimeter"), (z == "J", "very long")], F.lit(None).cast("string"))


def to_bool(value: Column | str, default: bool = False) -> Column:
    """True for 1, true and True; the default for null; else false."""
    v = F.trim(_c(value).cast("string"))
    return F.when(v.isNull(), F.lit(default)).otherwise(v.isin("1", "true", "True"))


def is_violation(play_info: Column | str) -> Column:
    return F.lower(F.coalesce(_c(play_info), F.lit(""))).rlike("|".join(VIOLATIONS))


def is_made(cls: Column | str) -> Column:
    return F.coalesce(_c(cls).contains("Made"), F.lit(False))


def is_three(cls: Column | str) -> Column:
    return F.coalesce(_c(cls).contains("ThreePoint"), F.lit(False))


def team_side(team: Column | str, home: Column | str, road: Column | str) -> Column:
    return F.when(_c(team) == _c(home), "home").when(_c(team) == _c(road), "road").otherwise("neutral")


def points_of(cls: Column | str) -> Column:
    return _first([(_c(cls) == "ThreePointShotMade", F.lit(3)), (_c(cls) == "TwoPointShotMade", F.lit(2)), (_c(cls) == "FreeThrowMade", F.lit(1))], F.lit(0))


def height_cm(metres: Column | str) -> Column:
    """Metres with float noise to whole centimetres: 1.9499999 is 195."""
    return F.round(_c(metres).cast("decimal(10,4)") * 100).cast("int")


def playback_lead(seconds: Column | str, cls: Column | str, assist_seconds: Column | str | None = None) -> Column:
    """Lead before an action, 0 to 15 seconds, 5 if unknown; for assists the lead of their own (9 if unknown) if that is longer."""
    def bounded(c: Column | str | None, default: float) -> Column:
        value = F.lit(default) if c is None else F.coalesce(_c(c).cast("double"), F.lit(default))
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(15.0))

    lead = bounded(seconds, 5.0)
    return F.when(_c(cls) == "Assist", F.greatest(lead, bounded(assist_seconds, 9.0))).otherwise(lead)


def seek_position(video_seconds: Column | str, lead: Column | str) -> Column:
    return F.greatest(_c(video_seconds) - _c(lead), F.lit(0.0))


def game_stage(phase: Column | str, group: Column | str) -> Column:
    """The stage that the phase group names, else the known name of the phase, else the phase."""
    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))

    g, p = plain(_c(group)), plain(_c(phase))
    return _first(
        [(g.isin(FINALS), "Final"), (g.contains("semi"), "Semi-final"), (g.isin(THIRD_PLACES), "Third-place game"), (g.contains("play in"), "Play-in")],
        _lookup(PHASES, p, F.trim(F.coalesce(_c(phase), F.lit("")))),
    )


def game_label(game_code: Column | str, stage: Column | str, round_: Column | str, matchup: Column | str) -> Column:
    def part(c: Column | str, before: str = "") -> Column:
        v = _c(c).cast("string")
        return F.when(F.length(v) > 0, F.concat(F.lit(before), v))

    return F.concat_ws(" · ", F.concat(F.lit("Game "), _c(game_code).cast("string")), part(stage), part(round_, "Round "), part(matchup))


def normalize_name(name: Column | str) -> Column:
    """Latin accents off, lower case, anything but a-z and 0-9 as one blank."""
    plain = F.lower(F.translate(F.coalesce(_c(name), F.lit("")), ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def display_name(name: Column | str) -> Column:
    """Last, First → First Last; null is Unknown player."""
    raw = F.coalesce(F.nullif(_c(name), F.lit("")), F.lit("Unknown player"))
    last, first = F.split(raw, ",").getItem(0), F.array_join(F.slice(F.split(raw, ","), 2, 100), " ")
    return F.when(raw.contains(","), F.trim(F.concat_ws(" ", F.trim(first), F.trim(last)))).otherwise(raw)


def clean_prose(text: Column | str) -> Column:
    """Tags and stale sentences out, a blank after full stops, single blanks."""
    t = F.coalesce(_c(text), F.lit(""))
    for pattern, put in PROSE_CLEANING:
        t = F.regexp_replace(t, pattern, put)
    return F.trim(t)


def first_sentences(text: Column | str, n: int) -> Column:
    """The first n sentences; those that start with a bare verb get their subject."""
    def rewrite(s: Column) -> Column:
        verb = F.regexp_extract(s, BARE_VERB, 1)
        s = F.when(verb != "", F.concat(F.lit("He "), F.lower(verb), F.substring(s, F.length(verb) + 1, F.length(s)))).otherwise(s)
        for pattern, put in SENTENCE_REWRITES:
            s = F.regexp_replace(s, pattern, put)
        return s

    return F.array_join(F.transform(F.slice(F.split(_c(text), r"(?<=[.!?])\s+"), 1, n), rewrite), " ")


def country_name(code: Column | str) -> Column:
    """Name of a country code, or of one at the end of a URI; others pass through."""
    c = uri_tail(code)
    return _lookup(COUNTRIES, c, c)


def long_date(iso: Column | str) -> Column:
    """2000-01-01 → 1 January 2000; null for anything else."""
    return F.date_format(_c(iso).cast("string").try_cast("date"), "d MMMM yyyy")


def clean_ocr_clock(text: Column | str) -> Column:
    """A clock in a reading: look-alike letters as digits; M:SS with : or ., then S.d under a minute, then three or four digits."""
    def clock(t: Column) -> Column:
        mm, ss = (F.regexp_extract(t, r"(?<!\d)(\d{1,2})[.:](\d{2})(?!\d)", i) for i in (1, 2))
        tenth = F.replace(F.regexp_extract(t, r"(?<!\d)(\d{1,2}[.:]\d)(?!\d)", 1), F.lit(":"), F.lit("."))
        digits = F.regexp_extract(t, r"^\d{3,4}$", 0)
        seconds = F.right(digits, F.lit(2))
        compact = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 2), F.lit(":"), seconds)
        return (
            F.when(mm != "", F.when(ss.try_cast("int") < 60, F.concat(mm, F.lit(":"), ss)))
            .when(tenth != "", F.when(tenth.try_cast("double") < 60, tenth))
            .when((digits != "") & (seconds.try_cast("int") < 60), compact)
        )

    return _let(F.translate(F.trim(F.upper(_c(text))), "OISBZ", "01582"), clock)


def tag_question(text: Column | str) -> Column:
    """The kind of action that a question is about, by the first pattern that occurs; empty if none."""
    t = F.coalesce(_c(text), F.lit(""))
    return _first([(t.rlike("(?iu)" + p), kind) for kind, p in QUESTION_KINDS], F.lit(""))


def tag_shot_styles(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike("(?i)" + p), name) for name, p in SHOT_STYLES]))


def profile_subject(text: Column | str) -> Column:
    """Whom a request for a profile is about; null if it is none, too long or about statistics."""
    t = F.trim(F.regexp_replace(F.trim(F.coalesce(_c(text), F.lit(""))), r"[?.!]+$", ""))

    def one(p: str) -> Column:
        s = F.trim(F.regexp_extract(t, f"(?is)^(?:{p})$", 1))
        return F.when((s != "") & (F.length(s) <= 100) & (F.size(F.split(s, r"\s+")) <= 5) & ~s.rlike("(?i)" + SUBJECT_STOPS), s)

    return F.coalesce(*map(one, SUBJECT_PATTERNS))


def contains_script(text: Column | str, ranges: str = r"Ͱ-Ͽἀ-῿") -> Column:
    """Whether a character of the ranges, Greek unless given, occurs."""
    return F.coalesce(_c(text).rlike(f"[{ranges}]"), F.lit(False))


def decimal_text(value: Column | str) -> Column:
    """Three decimals without trailing zeros, but one at least."""
    three = _c(value).cast("decimal(38,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(three, r"0+$", ""), r"\.$", ".0")


def to_json_without_nulls(row: Column | str) -> Column:
    """A struct as JSON; null fields are left out at every level."""
    return F.to_json(_c(row), {"ignoreNullFields": "true"})


def roster_entry(*parts: Column | str) -> Column:
    """id|name|image|position; a null part is empty."""
    return F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def split_roster(roster: Column | str) -> Column:
    """Array of (id, name, image, position) from entries joined by @@."""
    def entry(e: Column) -> Column:
        p = F.split(e, r"\|")
        return F.struct(*[F.coalesce(F.get(p, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("id", "name", "image", "position"))])

    return F.transform(F.filter(F.split(_c(roster), "@@"), lambda e: e != ""), entry)


def estimate_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    """log with cost_usd from prices(provider, model, input, cached, output) per million tokens; null for unknown models."""
    million = F.lit(1_000_000.0)
    fresh = F.col("input_tokens") - F.coalesce("cached_input_tokens", F.lit(0))
    cost = (fresh * F.col("input") + F.coalesce("cached_input_tokens", F.lit(0)) * F.col("cached") + F.col("output_tokens") * F.col("output")) / million
    priced = prices.select("provider", "model", "input", "cached", "output")
    return log.join(priced, ["provider", "model"], "left").withColumn("cost_usd", cost).drop("input", "cached", "output")


def hint_band(value: Column | str, width: float) -> Column:
    return F.floor(_c(value) / width) * width
