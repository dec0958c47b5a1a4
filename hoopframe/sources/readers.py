"""Readers of feeds, box scores, shot details, timelines, catalogues, ground truth, triples and result bindings.

Paths may be globs; season and game come from file names such as E2023_170.json.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema
from ..functions.columns import clamp_clock, clock_seconds, default_clock, normalize_period, to_bool


def file_keys(path: Column) -> list[Column]:
    """season_code and game_code of a file name."""
    return [F.regexp_extract(path, r"(E\d{4})_(\d+)[^/]*$", i).alias(n) for i, n in ((1, "season_code"), (2, "game_code"))]


def _json(spark: SparkSession, paths: str | list[str], fields: str) -> DataFrame:
    return spark.read.schema(fields).json(paths, multiLine=True).withColumn("_path", F.input_file_name())


def read_feed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of play-by-play files in order: season_code, game_code, period, seq, codes, clock and scores.

    Regular periods come in their order, then overtime, cut into OT, 2OT, … at
    each BP. Rows of code AG are left out; seq counts the rest from 1. A
    missing clock at a period boundary is filled in, a negative one is zero.
    """
    f = _json(spark, paths, schema.FEED).select(*file_keys(F.col("_path")), F.trim("CodeTeamA").alias("home_team"), F.trim("CodeTeamB").alias("road_team"), *schema.PERIOD_ARRAYS)
    keys = ["season_code", "game_code", "home_team", "road_team"]
    parts = [f.select(*keys, F.lit(i).alias("part"), F.lit(p).alias("name"), F.posexplode(p).alias("pos", "e")) for i, p in enumerate(schema.PERIOD_ARRAYS)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = Window.partitionBy("season_code", "game_code").orderBy("part", "pos")
    overtime = F.sum(((F.col("name") == "ExtraTime") & (F.col("e.PLAYTYPE") == "BP")).cast("int")).over(order)
    name = F.when(F.col("name") == "ExtraTime", F.concat(F.lit("ExtraTime"), F.greatest(overtime, F.lit(1)).cast("string"))).otherwise(F.col("name"))
    rows = rows.withColumn("period", normalize_period(name)).where("e.PLAYTYPE is null or e.PLAYTYPE <> 'AG'")
    clock = clamp_clock(F.coalesce(F.nullif(F.trim("e.MARKERTIME"), F.lit("")), default_clock("e.PLAYTYPE", "period")))
    return rows.select(
        *keys, "period", F.row_number().over(order).alias("seq"), F.col("e.NUMBEROFPLAY").alias("original_event_id"), F.col("e.PLAYTYPE").alias("action_code"), F.nullif(F.trim("e.CODETEAM"), F.lit("")).alias("team_id"),
        F.nullif(F.trim("e.PLAYER_ID"), F.lit("")).alias("player_id"), clock.alias("clock"), F.coalesce(clock_seconds(clock), F.lit(0.0)).cast("int").alias("seconds_remaining"),
        F.col("e.POINTS_A").alias("home_score"), F.col("e.POINTS_B").alias("road_score"), F.col("e.PLAYINFO").alias("play_info"),
    )


def read_boxscore(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(starters, coaches): players that start, per side (the first team is home), and the coach of each team."""
    b = _json(spark, paths, schema.BOXSCORE).select(*file_keys(F.col("_path")), F.posexplode("Stats").alias("i", "t"))
    b = b.withColumn("side", F.when(F.col("i") == 0, "home").otherwise("road"))
    starters = b.select("season_code", "game_code", "side", F.explode("t.PlayersStats").alias("p")).where("p.IsStarter = 1")
    return starters.select("season_code", "game_code", "side", F.trim("p.Player_ID").alias("player_id")), b.select("season_code", "game_code", "side", F.col("t.Team").alias("team"), F.col("t.Coach").alias("coach"))


def read_shot_points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    r = _json(spark, paths, schema.SHOT_POINTS).select(*file_keys(F.col("_path")), F.explode("Rows").alias("r"))
    return r.select("season_code", "game_code", F.col("r.NUM_ANOT").alias("original_event_id"), F.col("r.COORD_X").alias("coord_x"), F.col("r.COORD_Y").alias("coord_y"), F.col("r.ZONE").alias("shot_zone"), F.col("r.POINTS").alias("points"), to_bool("r.FASTBREAK").alias("is_fast_break"), to_bool("r.SECOND_CHANCE").alias("is_second_chance"), to_bool("r.POINTS_OFF_TURNOVER").alias("is_from_turnover"))


def join_shot_points(events: DataFrame, shots: DataFrame) -> DataFrame:
    """Shot details on the shots that have them; points on makes only; a missed free throw has no location and no flags."""
    shot = F.col("action_code").isin("2FGM", "2FGA", "3FGM", "3FGA", "FTM") & F.col("player_id").isNotNull()
    free = F.col("action_code") == "FTA"
    out = events.join(shots.withColumnRenamed("points", "_points"), ["season_code", "game_code", "original_event_id"], "left")
    out = out.withColumn("points", F.when(shot & F.col("action_code").endswith("M"), F.col("_points"))).drop("_points")
    for c in ("coord_x", "coord_y"):
        out = out.withColumn(c, F.when(shot, F.col(c)).when(free, -1.0))
    out = out.withColumn("shot_zone", F.when(shot, F.col("shot_zone")).when(free, " "))
    return out.withColumns({c: F.when(shot, F.col(c)).when(free, F.lit(False)) for c in ("is_fast_break", "is_second_chance", "is_from_turnover")})


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_timeline(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Clock readings in video order: season_code, game_code, game_id, video_time, period, clock, clock_seconds, observation_seq."""
    t = spark.read.schema(schema.TIMELINE).csv(paths, header=True).select(*file_keys(F.input_file_name()), "*")
    order = Window.partitionBy("season_code", "game_code").orderBy("video_time_sec", "game_clock")
    return t.select(
        "season_code", "game_code", F.concat_ws("_", "season_code", "game_code").alias("game_id"), F.col("video_time_sec").alias("video_time"), normalize_period("quarter").alias("period"), F.col("game_clock").alias("clock"),
        clock_seconds("game_clock", strict=True).alias("clock_seconds"), F.row_number().over(order).alias("observation_seq"),
    )


def read_video_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    v = spark.read.schema(schema.VIDEOS).json(paths, multiLine=True).select(F.inline("games"))
    return v.withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def read_ground_truth(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Annotations of CSV files with a header: the columns of schema.GROUND_TRUTH, others as text, and status.

    status is annotated, excluded or pending, by annotation_status; a missing
    category is other. All files have the same columns. A missing column is an
    error, and so is, of an annotated row, a key or time that isn't a number,
    a negative time or a key that another annotated row has.
    """
    wanted = StructType.fromDDL(schema.GROUND_TRUTH)
    head = spark.read.csv(paths, header=True)
    missing = sorted({f.name for f in wanted} - set(head.columns))
    if missing:
        raise ValueError(f"ground truth lacks the columns {', '.join(missing)}")
    # with the columns given, a file whose header differs is an error
    text = StructType([StructField(c, StringType()) for c in head.columns])
    t = spark.read.csv(paths, header=True, schema=text, enforceSchema=False)
    status = F.lower(F.trim(F.coalesce("annotation_status", F.lit(""))))
    t = t.withColumn("status", F.when(status.isin(schema.ANNOTATED), "annotated").when(status.isin(schema.EXCLUDED), "excluded").otherwise("pending"))
    typed = {f.name: F.trim(f.name) if f.dataType == StringType() else F.trim(f.name).try_cast(f.dataType) for f in wanted}
    typed["action_category"] = F.coalesce(F.nullif(F.trim("action_category"), F.lit("")), F.lit("other"))
    t = t.withColumns(typed)
    keys = ["season_code", "game_code", "original_event_id"]
    counts = F.col("status") == "annotated"
    same = F.count_if(counts).over(Window.partitionBy(*keys))
    t = t.withColumn("_n", same)
    seconds, name = F.col("ground_truth_video_seconds"), F.concat_ws("_", *keys)

    def fails(test: Column, text: str) -> tuple[Column, Column]:
        return counts & test, F.raise_error(F.concat(F.lit(f"{text} "), name))

    ok = F.when(F.lit(False), F.lit(0.0))
    for test, error in (fails(F.col("original_event_id").isNull() | seconds.isNull() | F.isnan(seconds), "no number at"), fails(seconds < 0, "negative time at"), fails(F.col("_n") > 1, "repeated key")):
        ok = ok.when(test, error)
    return t.withColumn("ground_truth_video_seconds", ok.otherwise(seconds)).drop("_n")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(value, s, p, o, o_kind, datatype) of a text column value, one row per line that isn't empty; of a malformed line only value isn't null.

    One match of the pattern says whether a line is well-formed; its parts are
    then cut at angle brackets and quotation marks. Only literals with further
    quotation marks need the pattern's groups.
    """
    lines = lines.where(F.length(F.trim("value")) > 0).select("value", F.trim("value").alias("_t"))
    lines = lines.select("value", F.when(F.col("_t").rlike(schema.TRIPLE), F.col("_t")).alias("_t"))

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.locate(mark, text) + 1, F.length(text))

    # the third part of a split at the first two brackets is the object with what follows it
    cut = lines.select("value", "_t", F.split("_t", ">", 3).alias("_cut")).select("value", "_t", F.get("_cut", F.lit(0)).alias("_s"), F.get("_cut", F.lit(1)).alias("_p"), F.get("_cut", F.lit(2)).alias("_o"))
    bracket, quote = F.locate("<", F.col("_o")), F.locate('"', F.col("_o"))
    iri = (bracket > 0) & ((quote == 0) | (bracket < quote))
    plain = F.length("_o") - F.length(F.replace("_o", F.lit('"'), F.lit(""))) == 2
    body = F.when(plain, F.substring_index(F.substring_index("_o", '"', 2), '"', -1)).otherwise(F.regexp_extract("_t", schema.TRIPLE, 4))
    tail = F.substring_index("_o", '"', -1)
    datatype = F.when(plain, F.when(F.locate("<", tail) > 0, F.substring_index(after(tail, "<"), ">", 1))).otherwise(F.regexp_extract("_t", schema.TRIPLE, 5))
    told = F.when(F.locate("\\", body) > 0, F.replace(F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))).otherwise(body)
    return cut.select(
        "value", F.substring("_s", 2, 1 << 30).alias("s"), after(F.col("_p"), "<").alias("p"),
        F.when(iri, F.substring_index(after(F.col("_o"), "<"), ">", 1)).otherwise(told).alias("o"), F.when(iri, "iri").when(F.col("_t").isNotNull(), "literal").alias("o_kind"), F.nullif(F.when(~iri, datatype), F.lit("")).alias("datatype"),
    )


def parse_ntriples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, malformed) of a text column value: s, p, o, o_kind, datatype of well-formed lines, and the other lines that
    aren't empty. A language tag is left out."""
    parsed = parse_lines(lines)
    return parsed.where("o_kind is not null").drop("value"), parsed.where("o_kind is null").select("value")


def read_ntriples(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """parse_ntriples() of files."""
    return parse_ntriples(spark.read.text(paths))


def read_documents(docs: DataFrame, actions: str, possessions: str = "possession_seq int, team_id string, starts_after bigint, ends_with bigint, contains_action array<bigint>") -> tuple[DataFrame, DataFrame]:
    """(actions, possessions) of game documents (game_id, document), one row per element, with the fields of the two schemas.

    A document is JSON with the lists AllActions and Possessions. Its fields
    may drift: an absent one is null, one of another type is cast (a number as
    text, say), null if it can't be, and others don't count. A document
    without a list of actions is an error, and so is an action without an
    original_event_id, a period or seconds_remaining where the schema has them.
    """
    v = docs.select("game_id", F.try_parse_json("document").alias("v"))

    def rows(path: str, fields: str, needed: list[str], required: bool) -> DataFrame:
        items = F.try_variant_get("v", f"$.{path}", "array<variant>")
        if required:
            items = F.coalesce(items, F.raise_error(F.concat(F.lit(f"no list {path} in the document of "), "game_id")).cast("array<variant>"))
        each = v.select("game_id", F.posexplode(items).alias("place", "e"))
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(fields)}
        got = {name: F.try_variant_get("e", f"$.{name}", kind) for name, kind in kinds.items()}
        for name in needed:
            if name in got:
                bad = F.raise_error(F.concat(F.lit(f"no {name} in action "), (F.col("place") + 1).cast("string"), F.lit(" of "), "game_id"))
                got[name] = F.coalesce(got[name], bad.cast(kinds[name]))
        return each.select("game_id", *[c.alias(name) for name, c in got.items()])

    return rows("AllActions", actions, ["original_event_id", "period", "seconds_remaining"], True), rows("Possessions", possessions, [], False)


def triples_to_entities(triples: DataFrame, type_predicate: str, cls: str, properties: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per subject of the class: properties as {column: (predicate, type)}, the least of repeated values."""
    own = triples.join(triples.where((F.col("p") == type_predicate) & (F.col("o") == cls)).select("s").distinct(), "s", "left_semi")
    return own.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o").try_cast(t))).alias(c) for c, (p, t) in properties.items()])


def discover_artifacts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(season_code, game_code, path, paired_path): artifact files and the triples file that belongs to each."""
    files = spark.read.format("binaryFile").load(paths).select("path", *file_keys(F.col("path")))
    return files.where("season_code <> ''").select("season_code", "game_code", "path", F.regexp_replace("path", r"\.json$", ".nt").alias("paired_path"))


def scope_games(spark: SparkSession, season: str, game: int | None = None, max_games: int | None = None) -> DataFrame:
    """(season_code, game_code): one game, or 1 to max_games."""
    if (game is None) == (max_games is None):
        raise ValueError("give a game or max_games")
    first, last = (game, game) if game is not None else (1, max_games)
    return spark.range(first, last + 1).select(F.lit(season).alias("season_code"), F.col("id").cast("string").alias("game_code"))


def flatten_bindings(results: DataFrame, variables: list[str], column: str = "bindings") -> DataFrame:
    """One row per binding of a JSON array of {variable: {value}}; an absent variable is null."""
    rows = results.select(F.explode(F.from_json(column, "array<map<string,struct<value:string>>>")).alias("b"))
    return rows.select(*[F.try_element_at("b", F.lit(v))["value"].alias(v) for v in variables])
