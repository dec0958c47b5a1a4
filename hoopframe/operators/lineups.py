"""Who is on court: lineups after substitutions, and conditions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import height_cm, normalize_name

FAR = 1_000_000_000


def court_moves(acts: DataFrame, starters: DataFrame) -> DataFrame:
    """(game_id, side, player_id, seq, is_on): every IN and OUT, and the starters as on from 0."""
    side = F.when(F.col("team_id") == F.col("home_team"), "home").otherwise("road")
    moves = acts.where(F.col("action_code").isin("IN", "OUT")).select("game_id", side.alias("side"), "player_id", "seq", (F.col("action_code") == "IN").alias("is_on"))
    return moves.unionByName(starters.select("game_id", "side", "player_id", F.lit(0).alias("seq"), F.lit(True).alias("is_on")))


def court_stints(acts: DataFrame, starters: DataFrame) -> DataFrame:
    """(game_id, side, player_id, start, until): sequence numbers, until exclusive, in which a player is on court.

    Starters are on from 0; a repeated IN or OUT changes nothing.
    """
    until = F.coalesce(F.lead("seq").over(Window.partitionBy("game_id", "side", "player_id").orderBy("seq")), F.lit(FAR))
    return court_moves(acts, starters).withColumn("until", until).where("is_on").select("game_id", "side", "player_id", F.col("seq").alias("start"), "until")


def lineup_changes(stints: DataFrame, moves: DataFrame) -> DataFrame:
    """(game_id, seq, home_lineup, road_lineup): of each change the lineup of its side after it, sorted; the other side is null."""
    at = moves.select("game_id", "side", "seq").distinct().alias("c")
    inside = (F.col("c.game_id") == F.col("s.game_id")) & (F.col("c.side") == F.col("s.side")) & (F.col("s.start") <= F.col("c.seq")) & (F.col("c.seq") < F.col("s.until"))
    after = at.join(stints.alias("s"), inside, "left").groupBy("c.game_id", "c.side", "c.seq").agg(F.array_sort(F.collect_set("s.player_id")).alias("ids"))
    return after.select("game_id", "seq", *[F.when(F.col("side") == side, F.col("ids")).alias(f"{side}_lineup") for side in ("home", "road")])


def lineup_at_action(acts: DataFrame, starters: DataFrame, only: Column | None = None) -> DataFrame:
    """acts with home_lineup and road_lineup: sorted arrays after every substitution up to and including the action.

    Lineups are made at the changes alone, a fraction of the actions, and
    carried from there in order of sequence. only: the actions to return; the
    others count for their substitutions and go before lineups are carried.
    """
    changes = lineup_changes(court_stints(acts, starters), court_moves(acts, starters))
    asked = acts if only is None else acts.where(only)
    # columns of their own, not one struct: those that nobody reads later are neither shuffled nor sorted
    rows = asked.withColumn("_asked", F.lit(True)).unionByName(changes, allowMissingColumns=True)
    order = Window.partitionBy("game_id").orderBy("seq", F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    none = F.array().cast("array<string>")
    sides = ("home_lineup", "road_lineup")
    rows = rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(order), none) for c in sides})
    return rows.where("_asked").select(*[F.col(f"`{c}`") for c in acts.columns], *sides)


def settle_substitutions(acts: DataFrame) -> DataFrame:
    """Substitutions in a run of actions of one clock take the lineup after the last substitution of that run."""
    order = Window.partitionBy("game_id").orderBy("seq")
    run = F.sum((~F.col("clock").eqNullSafe(F.lag("clock").over(order))).cast("int")).over(order)
    a = acts.withColumn("_run", run)
    whole = Window.partitionBy("game_id", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moves = F.col("action_code").isin("IN", "OUT")
    for c in ("home_lineup", "road_lineup"):
        a = a.withColumn(c, F.when(moves, F.last(F.when(moves, F.col(c)), ignorenulls=True).over(whole)).otherwise(F.col(c)))
    return a.drop("_run")


def either_side(acts: DataFrame) -> DataFrame:
    """Two rows per action: its home and its road lineup with their team."""
    sides = F.array(F.struct(F.lit("home").alias("side"), F.col("home_team").alias("lineup_team"), F.col("home_lineup").alias("lineup")), F.struct(F.lit("road").alias("side"), F.col("road_team").alias("lineup_team"), F.col("road_lineup").alias("lineup")))
    return acts.select("*", F.inline(sides))


def player_on_court(acts: DataFrame, player: str, players: DataFrame | None = None) -> DataFrame:
    """Actions with the player in either lineup: an id or, with players(player_id, name), a name."""
    if players is None:
        return acts.where(F.array_contains("home_lineup", player) | F.array_contains("road_lineup", player))
    named = players.where(normalize_name("name") == normalize_name(F.lit(player))).select(F.col("player_id").alias("member"))
    there = acts.select("action_id", F.explode(F.concat("home_lineup", "road_lineup")).alias("member")).join(named, "member", "left_semi")
    return acts.join(there.select("action_id"), "action_id", "left_semi")


def player_not_on_court(acts: DataFrame, player: str) -> DataFrame:
    return acts.where(~(F.array_contains("home_lineup", player) | F.array_contains("road_lineup", player)))


def with_lineup(acts: DataFrame, lineup: list[str]) -> DataFrame:
    want = F.array_sort(F.array(*map(F.lit, lineup)))
    return acts.where((F.col("home_lineup") == want) | (F.col("road_lineup") == want))


def all_present(acts: DataFrame, players: list[str], one_lineup: bool = False) -> DataFrame:
    """Actions with every player on court, on either side or all in one lineup."""
    want = F.array(*map(F.lit, players))
    if one_lineup:
        return acts.where((F.size(F.array_except(want, "home_lineup")) == 0) | (F.size(F.array_except(want, "road_lineup")) == 0))
    return acts.where(F.size(F.array_except(want, F.concat("home_lineup", "road_lineup"))) == 0)


def opposing(acts: DataFrame, one: str, other: str) -> DataFrame:
    """Actions with the two players in opposing lineups, either way round."""
    def split(a: str, b: str) -> Column:
        return F.array_contains("home_lineup", a) & F.array_contains("road_lineup", b)

    return acts.where(split(one, other) | split(other, one))


def _scope(scope: str) -> Column:
    """Ids of the scope: ten, own, teammates (own without the actor) or opponents."""
    own_home = F.col("team_id") == F.col("home_team")
    own, other = F.when(own_home, F.col("home_lineup")).otherwise(F.col("road_lineup")), F.when(own_home, F.col("road_lineup")).otherwise(F.col("home_lineup"))
    return {"ten": F.concat("home_lineup", "road_lineup"), "own": own, "teammates": F.array_except(own, F.array("player_id")), "opponents": other}[scope]


def _members(acts: DataFrame, scope: str) -> DataFrame:
    """(action_id, member) of the scope."""
    return acts.select("action_id", F.explode(_scope(scope)).alias("member"))


def _with_roster(acts: DataFrame, players: DataFrame, how: str, **lists: Column) -> DataFrame:
    """acts with lists over the members of their game's lineups, which are joined with players(member, ...) once a game and not once an action."""
    seen = acts.select("game_id", F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("home_lineup", "road_lineup")])).alias("member")).distinct()
    rosters = seen.join(players, "member", how).groupBy("game_id").agg(*[F.collect_list(c).alias(name) for name, c in lists.items()])
    return acts.join(rosters, "game_id")


def _whole(ids: Column) -> Column:
    return (F.size(ids) > 0) & (F.size(F.array_compact(ids)) == F.size(ids))


def all_members(acts: DataFrame, players: DataFrame, scope: str, test: Column) -> DataFrame:
    """Actions of which every member of the scope passes test over the columns of players; an unknown value fails, an empty scope too."""
    known = players.select(F.col("player_id").alias("member"), F.coalesce(test, F.lit(False)).alias("ok"))
    judged = _with_roster(acts, known, "left", _failed=F.when(~F.coalesce("ok", F.lit(False)), F.col("member")))
    ids = _scope(scope)
    return judged.where(_whole(ids) & ~F.arrays_overlap(ids, "_failed")).select(acts.columns)


def count_members(acts: DataFrame, players: DataFrame, scope: str, test: Column, k: int, exactly: bool = True) -> DataFrame:
    """Actions with k members (or at least k) that pass the test, all values of the scope being known."""
    known = players.select(F.col("player_id").alias("member"), test.alias("ok"))
    judged = _with_roster(acts, known, "left", _passed=F.when(F.col("ok"), F.col("member")), _unknown=F.when(F.col("ok").isNull(), F.col("member")))
    ids = _scope(scope)
    sides = [F.col("home_lineup"), F.col("road_lineup")] if scope == "ten" else [ids]  # a lineup has a player once
    n = sum((F.size(F.array_intersect(s, "_passed")) for s in sides), F.lit(0))
    return judged.where(_whole(ids) & ~F.arrays_overlap(ids, "_unknown") & (n == k if exactly else n >= k)).select(acts.columns)


def starters_from_actions(acts: DataFrame) -> DataFrame:
    """(game_id, lineup columns): the lineups of each game's first action, as at the first period's start."""
    first = F.min_by(F.struct("home_lineup", "road_lineup"), "seq")
    return acts.groupBy("game_id").agg(first.alias("s")).select("game_id", "s.*")


def starting_lineup_on_court(acts: DataFrame, team: str) -> DataFrame:
    """Actions of either team while all of the team's starters are on court."""
    first = starters_from_actions(acts).toDF("game_id", "_home", "_road")
    a = acts.join(first, "game_id")
    home = (F.col("home_team") == team) & (F.size(F.array_except("_home", "home_lineup")) == 0)
    road = (F.col("road_team") == team) & (F.size(F.array_except("_road", "road_lineup")) == 0)
    return a.where(home | road).select(acts.columns)


def team_points_with_player(acts: DataFrame, team: str, player: str) -> DataFrame:
    """(team_id, points): what the team scores while the player is on court, over distinct actions."""
    rows = player_on_court(acts, player).where((F.col("team_id") == team) & F.col("points").isNotNull()).select("team_id", "action_id", "points").distinct()
    return rows.groupBy("team_id").agg(F.sum("points").alias("points"))


def lineup_plus_minus(acts: DataFrame, players: list[str]) -> DataFrame:
    """Points for and against, difference and observed actions of the lineups that hold all the players, by team."""
    want = F.array(*map(F.lit, players))
    rows = either_side(acts).where(F.size(F.array_except(want, "lineup")) == 0).select("lineup_team", "action_id", "team_id", "points").distinct()
    return _plus_minus(rows.groupBy("lineup_team"))


def _plus_minus(groups) -> DataFrame:
    own = F.col("team_id") == F.col("lineup_team")
    out = groups.agg(F.coalesce(F.sum(F.when(own, F.col("points"))), F.lit(0)).alias("points_for"), F.coalesce(F.sum(F.when(~own, F.col("points"))), F.lit(0)).alias("points_against"), F.count("*").alias("n_actions"))
    return out.withColumn("difference", F.col("points_for") - F.col("points_against"))


def rank_lineups(acts: DataFrame, metric: str, size: int = 5, n: int = 10) -> DataFrame:
    """The n best lineups of exactly size members by points_for, points_against or difference."""
    rows = either_side(acts).where(F.size("lineup") == size).select("lineup_team", F.array_join("lineup", "_").alias("lineup"), "action_id", "team_id", "points").distinct()
    return _plus_minus(rows.groupBy("lineup_team", "lineup")).orderBy(F.desc(metric), "lineup_team", "lineup").limit(n)


def name_lineups(ranking: DataFrame, players: DataFrame) -> DataFrame:
    """rank_lineups rows with names: those of the lineup's members in order of id, an id where no name is known."""
    members = ranking.select("lineup_team", "lineup", F.posexplode(F.split("lineup", "_")).alias("at", "player_id"))
    members = members.join(players.select("player_id", "name"), "player_id", "left")
    named = members.groupBy("lineup_team", "lineup").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "player_id").alias("name")))).alias("m"))
    return ranking.join(named.select("lineup_team", "lineup", F.array_join("m.name", ", ").alias("names")), ["lineup_team", "lineup"])


def top_lineups(acts: DataFrame, n: int = 10) -> DataFrame:
    """The n lineups during which their team scored most."""
    rows = either_side(acts).where("lineup_team = team_id and points is not null").select("lineup_team", F.array_join("lineup", "_").alias("lineup"), "action_id", "points").distinct()
    return rows.groupBy("lineup_team", "lineup").agg(F.sum("points").alias("points")).orderBy(F.desc("points"), "lineup_team", "lineup").limit(n)


def mean_height_on_court(acts: DataFrame, players: DataFrame) -> DataFrame:
    """(action_id, mean_height, names): in metres to the centimetre, of the distinct players on court with a known height; names sorted."""
    known = players.where("height is not null").select(F.col("player_id").alias("member"), "name", height_cm("height").cast("long").alias("cm"))
    rows = _with_roster(acts, known, "inner", _known=F.struct("member", "name", "cm"))
    there = F.filter("_known", lambda m: F.array_contains("home_lineup", m["member"]) | F.array_contains("road_lineup", m["member"]))
    rows = rows.where("home_lineup is not null and road_lineup is not null").select("action_id", there.alias("_there")).where("size(_there) > 0")
    total, n = F.aggregate("_there.cm", F.lit(0).cast("long"), lambda a, cm: a + cm), F.size("_there")
    return rows.select("action_id", (F.floor((2 * total + n) / (2 * n)) / 100.0).alias("mean_height"), F.array_join(F.array_sort(F.array_distinct(F.array_compact("_there.name"))), ", ").alias("names"))


def roster_seen(acts: DataFrame) -> DataFrame:
    """Distinct (game_id, team_id, player_id) that appear in a lineup."""
    return either_side(acts).select("game_id", F.col("lineup_team").alias("team_id"), F.explode("lineup").alias("player_id")).distinct()


def shooting_by_teammate(acts: DataFrame, player: str) -> DataFrame:
    """A player's field goals with each teammate on court: makes, attempts, percentage."""
    shots = acts.where((F.col("player_id") == player) & F.col("action_class").rlike("PointShot"))
    rows = shots.select("action_id", F.col("action_class").contains("Made").alias("made")).distinct().join(_members(shots, "teammates").distinct(), "action_id")
    out = rows.groupBy(F.col("member").alias("teammate")).agg(F.count_if("made").alias("makes"), F.count("*").alias("attempts"))
    return out.withColumn("percentage", F.round(100.0 * F.col("makes") / F.col("attempts"), 2))


