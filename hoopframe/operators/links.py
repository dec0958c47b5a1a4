"""Links between actions of a game: assists, blocks, steals, turnover causes, rebounds, fouls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 3  # seconds within which a steal, a turnover's foul or a drawn foul belongs to what it follows
FIELD = ["2FGA", "3FGA"]


SCORES = ["2FGM", "3FGM", "FTM"]
LINKS = ("assist_id", "blocked_by", "leads_to_rebound", "caused_by_steal", "caused_by_foul")


def _within_reach(acts: DataFrame, source: Column, target: Column, other_team: bool) -> DataFrame:
    """(game_id, seq, s_seq): each source with its latest earlier target of the period, unless an action in between,
    or the target itself, is more than REACH seconds away from the source.

    Source and action meet in blocks of clock time, so only actions near in
    time do: the target counts if all actions since are among them.
    """
    width = REACH + 1
    order = Window.partitionBy("game_id", "period").orderBy("seq")
    rows = acts.select("game_id", "period", "seq", "seconds_remaining", "team_id", F.row_number().over(order).alias("place"), source.alias("_source"), target.alias("_target"))
    block = F.floor(F.col("seconds_remaining") / width)
    s = rows.where("_source").select("game_id", "period", F.col("seq").alias("s_seq"), F.col("seconds_remaining").alias("s_sec"), F.col("team_id").alias("s_team"), F.col("place").alias("s_place"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    near = s.join(rows.withColumn("block", block), ["game_id", "period", "block"]).where(f"seq < s_seq and abs(seconds_remaining - s_sec) <= {REACH}")
    back = F.row_number().over(Window.partitionBy("game_id", "s_seq").orderBy(F.desc("seq")))
    good = near.withColumn("back", back).where("_target and s_place - place = back")
    good = good.where("team_id <> s_team") if other_team else good
    return good.groupBy("game_id", "s_seq").agg(F.max("seq").alias("seq"))


def link_actions(acts: DataFrame, wanted: tuple[str, ...] = LINKS) -> DataFrame:
    """acts with the wanted ones of assist_id, blocked_by, leads_to_rebound (on the shot), caused_by_steal and caused_by_foul
    (on the turnover).

    Assist: the latest make of its team in the period; block: the latest miss
    of the other team in the period; rebound: the latest miss of the game. A
    target that several sources choose keeps the last of them.
    """
    code, home = F.col("action_code"), F.col("team_id") == F.col("home_team")
    makes, misses = code.isin(*SCORES), code.isin(*FIELD)

    def before(test: Column, *keys: str) -> Column:
        window = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return F.last(F.when(test, F.col("seq")), ignorenulls=True).over(window)

    def of_side(test: Column, same: bool) -> Column:
        of_home, of_road = (before(test & c, "game_id", "period") for c in (home, ~home))
        return F.when(home == F.lit(same), of_home).otherwise(of_road)

    targets = {
        "assist_id": (code == "AS", lambda: of_side(makes, True)),
        "blocked_by": (code == "FV", lambda: of_side(misses, False)),
        "leads_to_rebound": (code.isin("O", "D"), lambda: before(misses | (code == "FTA"), "game_id")),
    }
    found = []
    used = [k for k in targets if k in wanted]
    if used:
        rows = acts.select("game_id", "seq", "action_id", *[F.when(targets[k][0], targets[k][1]()).alias(k) for k in used])
        each = F.array(*[F.struct(F.lit(k).alias("link"), F.col(k).alias("at")) for k in used])
        found.append(rows.select("game_id", F.col("seq").alias("by_seq"), F.col("action_id").alias("by"), F.inline(each)).where("at is not null"))
    ids = acts.select("game_id", F.col("seq").alias("by_seq"), F.col("action_id").alias("by"))
    if "caused_by_steal" in wanted:
        steal = _within_reach(acts, code == "ST", code == "TO", True).select("game_id", F.col("s_seq").alias("by_seq"), F.lit("caused_by_steal").alias("link"), F.col("seq").alias("at"))
        found.append(steal.join(ids, ["game_id", "by_seq"]).select("game_id", "by_seq", "by", "link", "at"))
    if "caused_by_foul" in wanted:
        foul = _within_reach(acts, code == "TO", code == "OF", False).select("game_id", F.col("seq").alias("by_seq"), F.lit("caused_by_foul").alias("link"), F.col("s_seq").alias("at"))
        found.append(foul.join(ids, ["game_id", "by_seq"]).select("game_id", "by_seq", "by", "link", "at"))
    if not found:
        return acts
    best = [F.max_by(F.when(F.col("link") == k, F.col("by")), F.when(F.col("link") == k, F.col("by_seq"))).alias(k) for k in LINKS if k in wanted]
    chosen = reduce(DataFrame.unionByName, found).groupBy("game_id", F.col("at").alias("seq")).agg(*best)
    return acts.join(chosen, ["game_id", "seq"], "left")


def _step_of_fouls(state: Column, row: Column) -> Column:
    """open: drawn fouls that no foul took, latest last, with the least and greatest clock since; taken: what fouls took.

    A later drawn foul has seen fewer clocks than an earlier one, so a foul
    that is too far from the last is too far from all.
    """
    open_, taken, sec = state["open"], state["taken"], row["sec"]
    last = F.try_element_at(open_, F.lit(-1))
    hit = F.coalesce(row["foul"] & (last["high"] - sec <= REACH) & (sec - last["low"] <= REACH), F.lit(False))
    left = F.when(hit, F.slice(open_, 1, F.size(open_) - 1)).otherwise(open_)
    seen = F.transform(left, lambda x: F.struct(x["id"].alias("id"), F.least(x["low"], sec).alias("low"), F.greatest(x["high"], sec).alias("high")))
    near = F.filter(seen, lambda x: x["high"] - x["low"] <= 2 * REACH)  # no clock is within reach of both ends otherwise
    own = F.array(F.struct(row["id"].alias("id"), sec.alias("low"), sec.alias("high")))
    pair = F.array(F.struct(last["id"].alias("action_id"), row["id"].alias("fouled_by")))
    return F.struct(F.when(row["drawn"], F.concat(near, own)).otherwise(near).alias("open"), F.when(hit, F.concat(taken, pair)).otherwise(taken).alias("taken"))


def foul_links(acts: DataFrame) -> DataFrame:
    """(game_id, action_id, fouled_by): each foul (CM, OF, CMU) takes the latest drawn foul (RV) of its period that no
    earlier foul took, going back as long as actions are within REACH seconds of it.

    What a foul may take depends on what others took, so a run of actions that
    follow each other in the period within REACH seconds is folded in order;
    no foul reaches beyond its run.
    """
    drawn, foul = F.col("action_code") == "RV", F.col("action_code").isin("CM", "OF", "CMU")
    order = Window.partitionBy("game_id", "period").orderBy("seq")
    gap = F.abs(F.col("seconds_remaining") - F.lag("seconds_remaining").over(order)) > REACH
    rows = acts.select("game_id", "period", "seq", F.col("seconds_remaining").cast("double").alias("sec"), "action_id", drawn.alias("drawn"), foul.alias("foul"), F.coalesce(gap, F.lit(True)).alias("gap"))
    rows = rows.withColumn("run", F.sum(F.col("gap").cast("int")).over(order))
    item = F.struct("seq", "sec", F.col("action_id").cast("string").alias("id"), F.coalesce("drawn", F.lit(False)).alias("drawn"), F.coalesce("foul", F.lit(False)).alias("foul"))
    runs = rows.groupBy("game_id", "period", "run").agg(F.array_sort(F.collect_list(item)).alias("rows"), F.max("drawn").alias("any_drawn"), F.max("foul").alias("any_foul"))
    none = F.struct(F.array().cast("array<struct<id:string,low:double,high:double>>").alias("open"), F.array().cast("array<struct<action_id:string,fouled_by:string>>").alias("taken"))
    return runs.where("any_drawn and any_foul").select("game_id", F.inline(F.aggregate("rows", none, _step_of_fouls, lambda state: state["taken"])))


def with_foul_links(acts: DataFrame) -> DataFrame:
    """acts with fouled_by, the foul that a drawn foul belongs to."""
    return acts.join(foul_links(acts), ["game_id", "action_id"], "left")


def linked_pairs(acts: DataFrame, link: str) -> DataFrame:
    """(action, other) structs of each action and the one that its link column names."""
    a, b = acts.select(F.struct("*").alias("action")), acts.select(F.struct("*").alias("other"))
    return a.join(b, F.col(f"action.{link}") == F.col("other.action_id"))


def misses_rebounded(acts: DataFrame, kind: str) -> DataFrame:
    """Missed shots whose rebound is of the class kind."""
    reb = acts.where(F.col("action_class") == kind).select(F.col("action_id").alias("leads_to_rebound"))
    return acts.join(reb, "leads_to_rebound", "left_semi")


def fast_breaks_after_turnovers(acts: DataFrame, possessions: DataFrame) -> DataFrame:
    """(turnover_id, score_id): turnovers after which a possession starts that holds a fast-break score."""
    inside = possessions.select("game_id", "starts_after", F.explode("contains_action").alias("original_event_id"))
    score = acts.where("points is not null and is_fast_break").select("game_id", "original_event_id", F.col("action_id").alias("score_id"))
    lost = acts.where("action_code = 'TO'").select("game_id", F.col("original_event_id").alias("starts_after"), F.col("action_id").alias("turnover_id"))
    return inside.join(score, ["game_id", "original_event_id"]).join(lost, ["game_id", "starts_after"]).select("turnover_id", "score_id")


def carry_score(acts: DataFrame) -> DataFrame:
    """Missing running scores take the last one before them in the game, 0 at the start."""
    w = Window.partitionBy("game_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return acts.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)) for c in ("home_score", "road_score")})


def lead_changes(acts: DataFrame, strict: bool = False) -> DataFrame:
    """Scoring actions that change the lead. strict: the sign of the difference flips; else the team takes the lead
    from behind or from a tie."""
    w = Window.partitionBy("game_id").orderBy("seq")
    now = F.col("home_score") - F.col("road_score")
    a = acts.withColumn("_was", F.coalesce(F.lag(now).over(w), F.lit(0))).withColumn("_now", now)
    flip = F.signum("_was") * F.signum("_now") < 0
    taken = ((F.col("_was") <= 0) & (F.col("_now") > 0)) | ((F.col("_was") >= 0) & (F.col("_now") < 0))
    return a.where(F.col("points").isNotNull() & (flip if strict else taken)).drop("_was", "_now")


def assists_near_scores(acts: DataFrame, seconds: int = 5) -> DataFrame:
    """(assist_id, score_id): assists and the scoring actions that they are linked to, same period, clocks within seconds."""
    score = acts.where("assist_id is not null").select("game_id", "period", F.col("seconds_remaining").alias("_s"), F.col("action_id").alias("score_id"), F.col("assist_id"))
    assist = acts.where("action_class = 'Assist'").select("game_id", "period", "seconds_remaining", F.col("action_id").alias("assist_id"))
    return assist.join(score, ["game_id", "period", "assist_id"]).where(F.abs(F.col("seconds_remaining") - F.col("_s")) <= seconds).select("assist_id", "score_id")


def resolve_assists(acts: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (action_id, assist_id) for requested ids: an assist is itself, a scoring action its assist."""
    assist = acts.where("action_class = 'Assist'").select("action_id", F.col("action_id").alias("assist_id"))
    score = acts.where("assist_id is not null").select("action_id", "assist_id")
    return assist.unionByName(score).join(ids.select("action_id").distinct(), "action_id", "left_semi").distinct()
