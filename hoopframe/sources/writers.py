"""Writers of actions, triples, timelines, metric tables and spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BASE_URI, action_uri, entity_uri, game_uri, lineup_uri

TYPES = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def write_actions(acts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by season, rows of a game together and in order."""
    acts.repartition("season_code", "game_id").sortWithinPartitions("season_code", "game_id", "seq").write.mode(mode).partitionBy("season_code").parquet(path)


def game_documents(acts: DataFrame, poss: DataFrame) -> DataFrame:
    """(game_id, document): a game's actions and possessions as one JSON text without nulls."""
    a = acts.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in acts.columns if c not in ("seq", "game_id")]))).alias("AllActions"))
    p = poss.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("possession_seq", *[c for c in poss.columns if c not in ("possession_seq", "game_id")]))).alias("Possessions"))
    return a.join(p, "game_id", "left").select("game_id", F.to_json(F.struct("AllActions", "Possessions")).alias("document"))


def incremental(rows: DataFrame, existing: DataFrame | None, keys: list[str], overwrite: bool = False) -> DataFrame:
    """rows whose keys aren't among the existing ones; all of them if overwrite."""
    return rows if overwrite or existing is None else rows.join(existing.select(*keys).distinct(), keys, "left_anti")


def literal(value: Column, datatype: str | None = None) -> Column:
    escaped = F.replace(F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.concat(quoted, F.lit(f"^^<{TYPES}{datatype}>")) if datatype else quoted


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def entity_triples(rows: DataFrame, subject: Column, cls: str, properties: dict[str, Column]) -> DataFrame:
    """(line): N-Triples of rows: a type, and per property its term (iri() or literal()); null terms have no line."""
    pairs = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(f"<{cls}>").alias("o"))] + [F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in properties.items()]
    stacked = rows.select(subject.alias("s"), F.inline(F.array(*pairs))).where("o is not null")
    return stacked.select(F.concat(iri(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), F.col("o"), F.lit(" .")).alias("line"))


def membership_triples(acts: DataFrame, vocabulary: str, base: str = BASE_URI) -> DataFrame:
    """(line): each game with its type, teams and the actions that it contains."""
    game = game_uri("season_code", "game_code", base)
    teams = {f"{vocabulary}{side}Team": iri(entity_uri("teams", f"{side}_team", base)) for side in ("home", "road")}
    games = acts.select("season_code", "game_code", "home_team", "road_team").distinct()
    inside = acts.select(F.concat(iri(game), F.lit(f" <{vocabulary}contains> "), iri(action_uri(game, "original_event_id")), F.lit(" .")).alias("line"))
    return entity_triples(games, game, f"{vocabulary}Game", teams).unionByName(inside)


def possession_triples(poss: DataFrame, vocabulary: str, game: Column) -> DataFrame:
    """(line): each possession with its type, team, the actions around it and those that it contains."""
    subject = F.concat(game, F.lit("#Possession_"), F.col("possession_seq").cast("string"))
    at = {p: F.when(F.col(c).isNotNull(), iri(action_uri(game, c))) for p, c in ((f"{vocabulary}startsAfter", "starts_after"), (f"{vocabulary}endsWith", "ends_with"))}
    each = poss.select(subject.alias("s"), game.alias("g"), F.explode("contains_action").alias("e"))
    inside = each.select(F.concat(iri(F.col("s")), F.lit(f" <{vocabulary}containsAction> "), iri(action_uri("g", "e")), F.lit(" .")).alias("line"))
    return entity_triples(poss, subject, f"{vocabulary}Possession", {f"{vocabulary}team": iri(entity_uri("teams", "team_id")), **at}).unionByName(inside)


def lineup_triples(sides: DataFrame, vocabulary: str, base: str = BASE_URI) -> DataFrame:
    """(line): each lineup of five of either_side rows with its type, team and players."""
    five = sides.where(F.size("lineup") == 5).select("lineup_team", "lineup").distinct()
    subject = lineup_uri("lineup_team", "lineup", base)
    each = five.select(subject.alias("s"), F.explode("lineup").alias("player"))
    members = each.select(F.concat(iri(F.col("s")), F.lit(f" <{vocabulary}hasPlayer> "), iri(entity_uri("players", "player", base)), F.lit(" .")).alias("line"))
    return entity_triples(five, subject, f"{vocabulary}Lineup", {f"{vocabulary}team": iri(entity_uri("teams", "lineup_team", base))}).unionByName(members)


def write_ntriples(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select("line").write.mode(mode).text(path)


def write_timeline(timeline: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV folders by season and game with the columns that read_timeline takes."""
    rows = timeline.select("season_code", "game_code", F.col("video_time").alias("video_time_sec"), F.col("period").alias("quarter"), F.col("clock").alias("game_clock"))
    rows.repartition("season_code", "game_code").sortWithinPartitions("season_code", "game_code", "video_time_sec").write.mode(mode).partitionBy("season_code", "game_code").csv(path, header=True)


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would read as a formula get a leading apostrophe."""
    text = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(F.col(c).rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c in text})


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    spreadsheet_safe(df).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"')


def write_metric_tables(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    for name, table in tables.items():
        table.write.mode(mode).csv(f"{path}/{name}", header=True)
