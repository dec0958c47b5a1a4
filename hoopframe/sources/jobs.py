"""From feed files to the table of actions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import action_class, is_violation
from ..operators.lineups import lineup_at_action, settle_substitutions
from ..operators.links import carry_score, link_actions, with_foul_links
from ..operators.possessions import possessions
from .readers import join_shot_points, read_boxscore, read_feed, read_shot_points


def actions_of_files(spark: SparkSession, feeds: str | list[str], boxscores: str | list[str], shots: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(actions, possessions) of games given as play-by-play, box score and shot files.

    Actions have ids, classes, running scores, shot details, settled lineups,
    coaches, all links, and caused_by_violation on turnovers. Games without
    a box score have lineups from their substitutions alone.
    """
    keys = ["season_code", "game_code"]
    game = F.concat_ws("_", *keys)
    starters, coaches = read_boxscore(spark, boxscores)
    bench = coaches.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == side, F.col("coach"))).alias(f"{side}_coach") for side in ("home", "road")])
    acts = join_shot_points(read_feed(spark, feeds), read_shot_points(spark, shots)).join(bench, keys, "left")
    acts = acts.withColumns({"game_id": game, "action_id": F.concat_ws("_", *keys, "original_event_id"), "action_class": action_class("action_code")})
    acts = carry_score(acts)
    lined = settle_substitutions(lineup_at_action(acts, starters.select(game.alias("game_id"), "side", "player_id")))
    done = with_foul_links(link_actions(lined))
    done = done.withColumn("caused_by_violation", F.when(F.col("action_code") == "TO", F.coalesce(is_violation("play_info"), F.lit(False))))
    return done, possessions(acts)
