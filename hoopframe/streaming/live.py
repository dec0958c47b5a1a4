"""Live events: windowed counts with watermarks, and enrichment of games as their actions arrive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.lineups import lineup_at_action, settle_substitutions
from ..operators.links import FIELD, LINKS, REACH, SCORES, carry_score, link_actions, with_foul_links
from ..operators.possessions import BOUNDARIES, CONTROL, possessions


def windowed_counts(events: DataFrame, key: str, size: str = "10 minutes", slide: str | None = None, late: str = "5 minutes", time: str = "ts") -> DataFrame:
    """Tumbling or sliding counts per key; events later than the watermark don't count."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "5 minutes", time: str = "ts") -> DataFrame:
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def enrich_games(acts: DataFrame, touched: DataFrame, starters: DataFrame) -> DataFrame:
    """All actions of the touched games with running score, settled lineups, links and the number of their possession."""
    own = acts.join(touched.select("game_id").distinct(), "game_id", "left_semi")
    done = with_foul_links(link_actions(settle_substitutions(lineup_at_action(carry_score(own), starters))))
    inside = possessions(own).select("game_id", "possession_seq", F.explode("contains_action").alias("original_event_id"))
    return done.join(inside, ["game_id", "original_event_id"], "left")


EVENT = "seq long, action_id string, period string, clock string, seconds double, code string, class_name string, team string, player string, home boolean, home_score int, road_score int"
CHANGES = "game_id string, op string, seq long, by_seq long, home_score int, road_score int, home_lineup array<string>, road_lineup array<string>, possession_seq long, link string, by string"
HEAD = "last_seq long, home_score int, road_score int, period string, clock string, holder string, possession long, inside boolean"
CANDIDATE = "kind string, seq long, home boolean, low double, high double, action_id string"
FOULS = ("CM", "OF", "CMU")


@dataclass
class Game:
    """What has to be known of a game to enrich its next action; its size doesn't grow with the game."""

    last_seq: int = 0
    home_score: int = 0
    road_score: int = 0
    period: str | None = None
    clock: str | None = None
    holder: str | None = None  # team of the last control action since a period boundary
    possession: int = 0  # number of the latest possession
    inside: bool = False  # whether a possession is open
    court: dict = field(default_factory=lambda: {True: set(), False: set()})  # players by home
    moved: list = field(default_factory=list)  # substitutions since the clock last changed
    candidates: list = field(default_factory=list)  # actions that a later one may be linked to, as CANDIDATE, in order


def _candidate_kinds(code: str) -> list[str]:
    """Which links an action may be the target of, or for an offensive foul the source."""
    kinds = ["assist_id"] * (code in SCORES) + ["blocked_by"] * (code in FIELD) + ["leads_to_rebound"] * (code in FIELD or code == "FTA")
    return kinds + ["caused_by_steal"] * (code == "TO") + ["caused_by_foul"] * (code == "OF") + ["fouled_by"] * (code == "RV")


# What a code looks for: the link, and whether the target's side is its own (None: either).
LOOKS_FOR = {"AS": ("assist_id", True), "FV": ("blocked_by", False), "O": ("leads_to_rebound", None), "D": ("leads_to_rebound", None), "ST": ("caused_by_steal", False), "TO": ("caused_by_foul", None)} | {c: ("fouled_by", None) for c in FOULS}
NEAR = ("caused_by_steal", "caused_by_foul", "fouled_by")  # links within reach of the clock


def enrich_next(g: Game, e: dict) -> list[tuple]:
    """Moves the game by its next action; (op, seq, by_seq, scores, lineups, possession, link, by) as in CHANGES."""
    out = []
    g.last_seq = e["seq"]
    g.home_score = g.home_score if e["home_score"] is None else e["home_score"]
    g.road_score = g.road_score if e["road_score"] is None else e["road_score"]
    sec = e["seconds"]
    if e["period"] != g.period:
        g.candidates = [c for c in g.candidates if c[0] == "leads_to_rebound"]
    link, same = LOOKS_FOR.get(e["code"], (None, None))
    for c in reversed(g.candidates) if link else ():
        if c[0] != link or (same is not None and (c[2] == e["home"]) != same):
            continue
        if link in NEAR and (sec is None or c[4] - sec > REACH or sec - c[3] > REACH):
            break
        target, source = ((e["seq"], e["action_id"]), (c[1], c[5])) if link == "caused_by_foul" else ((c[1], c[5]), (e["seq"], e["action_id"]))
        out.append(("link", target[0], source[0], None, None, None, None, None, link, source[1]))
        if link == "fouled_by":
            g.candidates.remove(c)
        break
    own = [(k, e["seq"], e["home"], sec, sec, e["action_id"]) for k in _candidate_kinds(e["code"] or "") if k not in NEAR or sec is not None]
    replaced = {(k, k == "leads_to_rebound" or e["home"]) for k, *_ in own if k not in NEAR}
    kept = []
    for c in g.candidates:
        if c[0] in NEAR:
            c = c if sec is None else (*c[:3], min(c[3], sec), max(c[4], sec), c[5])
            if sec is not None and c[4] - c[3] <= 2 * REACH:
                kept.append(c)
        elif (c[0], c[0] == "leads_to_rebound" or c[2]) not in replaced:
            kept.append(c)
    g.candidates = kept + own

    if e["clock"] != g.clock:
        g.moved = []
    moves = e["code"] in ("IN", "OUT")
    if moves and e["player"] is not None:
        (g.court[e["home"]].add if e["code"] == "IN" else g.court[e["home"]].discard)(e["player"])
    lineups = sorted(g.court[True]), sorted(g.court[False])
    if moves:
        out += [("lineup", seq, e["seq"], None, None, *lineups, None, None, None) for seq in g.moved]
        g.moved.append(e["seq"])

    boundary = e["class_name"] in BOUNDARIES
    if boundary:
        g.holder, g.inside = None, False
    elif e["class_name"] in CONTROL and e["team"] is not None and e["team"] != g.holder:
        g.holder, g.inside, g.possession = e["team"], True, g.possession + 1
    g.period, g.clock = e["period"], e["clock"]
    out.append(("action", e["seq"], e["seq"], g.home_score, g.road_score, *lineups, g.possession if g.inside else None, None, None))
    return out


class LiveGames(StatefulProcessor):
    """The games of a stream of actions. Actions wait until those before them in sequence have come; repeats don't count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.court = handle.getListState("court", "home boolean, player string")
        self.moved = handle.getListState("moved", "seq long")
        self.candidates = handle.getListState("candidates", CANDIDATE)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self.court.put([(side == "home", player) for side, player in zip(initialState.side, initialState.player_id)])

    def _load(self) -> Game:
        g = Game(*self.head.get()) if self.head.exists() else Game()
        for home, player in self.court.get():
            g.court[home].add(player)
        g.moved = [seq for (seq,) in self.moved.get()]
        g.candidates = [tuple(c) for c in self.candidates.get()]
        return g

    def _save(self, g: Game) -> None:
        self.head.update((g.last_seq, g.home_score, g.road_score, g.period, g.clock, g.holder, g.possession, g.inside))
        for state, rows in ((self.court, [(home, p) for home in g.court for p in g.court[home]]), (self.moved, [(seq,) for seq in g.moved]), (self.candidates, g.candidates)):
            state.put(rows) if rows else state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in EVENT.split(", ")]
        batch = pd.concat(list(rows))[names].astype(object)
        whole = ("seq", "home_score", "road_score")
        here = [tuple(None if pd.isna(v) else int(v) if n in whole else v for n, v in zip(names, r)) for r in batch.itertuples(index=False)]
        g, out, left = self._load(), [], []
        for r in sorted([*map(tuple, self.waiting.get()), *here], key=lambda r: r[0]):
            if r[0] == g.last_seq + 1:
                out += [(key[0], op, seq, *rest) for op, seq, *rest in enrich_next(g, dict(zip(names, r)))]
            elif r[0] > g.last_seq:
                left.append(r)
        self.waiting.put(left) if left else self.waiting.clear()
        self._save(g)
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in CHANGES.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def enrich_stream(acts: DataFrame, starters: DataFrame) -> DataFrame:
    """A stream of actions as a stream of CHANGES; a batch costs its own actions, whatever came before.

    op "action": score, lineups and possession at an action; "lineup": the
    lineups of an earlier substitution of the same clock, now settled; "link":
    the action `by` at by_seq is linked to seq. seq counts a game's actions
    from 1. starters(game_id, side, player_id) is a table. The session needs
    the RocksDB state store.
    """
    home = F.col("team_id") == F.col("home_team")
    event = acts.select(
        "game_id", F.col("seq").cast("long").alias("seq"), F.col("action_id").cast("string").alias("action_id"), "period", "clock", F.col("seconds_remaining").cast("double").alias("seconds"), F.col("action_code").alias("code"),
        F.col("action_class").alias("class_name"), F.col("team_id").alias("team"), F.col("player_id").alias("player"), F.coalesce(home, F.lit(False)).alias("home"), F.col("home_score").cast("int"), F.col("road_score").cast("int"),
    )
    first = starters.select("game_id", "side", "player_id").groupBy("game_id")
    return event.groupBy("game_id").transformWithStateInPandas(LiveGames(), CHANGES, "append", "None", initialState=first)


def resolve_changes(acts: DataFrame, changes: DataFrame) -> DataFrame:
    """acts as enrich_games gives them, from all changes so far: the latest lineups and links of each action."""
    def latest(value: str, test: str) -> Column:
        return F.max_by(F.when(F.expr(test), F.col(value)), F.when(F.expr(test), F.col("by_seq")))

    shown = [latest(c, "op = 'action'").alias(c) for c in ("home_score", "road_score", "possession_seq")]
    lineups = [latest(c, "op in ('action', 'lineup')").alias(c) for c in ("home_lineup", "road_lineup")]
    links = [latest("by", f"op = 'link' and link = '{link}'").alias(link) for link in (*LINKS, "fouled_by")]
    known = changes.groupBy("game_id", "seq").agg(*shown, *lineups, *links)
    return acts.drop("home_score", "road_score").join(known, ["game_id", "seq"])
