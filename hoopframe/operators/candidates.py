"""Candidate sets for quizzes: comparisons, rankings, distractors, hidden members, and matching of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalize_name
from ..sources.store import stash
from .reports import ranked

# Suffixes of names that don't count, and the order of roles.
NAME_SUFFIX = r"\s+(?:jr|sr|ii|iii|iv)$"
ROLES = ["Center", "Forward", "Guard"]
RING = 8  # players in a part of the ring that a question takes its options from, about


def seeded(key: Column, seed: int) -> Column:
    """A whole number below 2 ** 32 that only the key and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")


def comparison_pairs(points: DataFrame, low: int, high: int, keys: list[str] | None = None) -> DataFrame:
    """Unordered pairs of players of a game whose points differ by low to high; equal names aren't paired.

    The gap is part of the join: points are put in blocks of high + 1, and a
    player meets the own block and the next.
    """
    keys = keys or ["game_id"]
    width = high + 1
    a = points.select(*keys, F.col("player_id").alias("a"), F.col("points").alias("a_points"), F.explode(F.array(F.floor(F.col("points") / width), F.floor(F.col("points") / width) + 1)).alias("block"))
    b = points.select(*keys, F.col("player_id").alias("b"), F.col("points").alias("b_points"), F.floor(F.col("points") / width).alias("block"))
    gap = F.col("b_points") - F.col("a_points")
    pairs = a.join(b, [*keys, "block"]).where((F.col("a") != F.col("b")) & gap.between(low, high) & ((gap > 0) | (F.col("a") < F.col("b"))))
    return pairs.select(*keys, "a", "b", "a_points", "b_points", gap.alias("gap"))


def top_sets(points: DataFrame, n: int = 5) -> DataFrame:
    """The top n of each game, games without a tie at the cut."""
    return ranked(points, "points", "player_id", ["game_id"], n).where((F.col("rank") <= n) & ~F.col("tie_at_cut")).drop("tie_at_cut")


def two_options(facts: DataFrame, offset: int, seed: int = 0) -> DataFrame:
    """facts(key, value) with a distractor offset above or below, never negative, and whether the answer comes first; by key and seed."""
    h = seeded(F.col("key"), seed)
    down = (h % 2 == 0) & (F.col("value") >= offset)
    return facts.withColumns({"distractor": F.when(down, F.col("value") - offset).otherwise(F.col("value") + offset), "answer_first": F.floor(h / 2) % 2 == 0})


def hidden_member(lineups: DataFrame, roles: DataFrame, seed: int = 0) -> DataFrame:
    """Members of lineups(lineup_id, player_ids) in order of role, one of each hidden, which the seed decides."""
    rows = lineups.select("lineup_id", F.explode("player_ids").alias("player_id")).distinct().join(roles.select("player_id", "position"), "player_id", "left")
    place = F.lit(len(ROLES))
    for i, role in reversed(list(enumerate(ROLES))):
        place = F.when(F.array_contains(F.split(F.coalesce("position", F.lit("")), " / "), role), i).otherwise(place)
    own = Window.partitionBy("lineup_id")
    pick = F.row_number().over(own.orderBy(seeded(F.col("player_id"), seed), "player_id"))
    return rows.select("lineup_id", "player_id", "position", F.row_number().over(own.orderBy(place, "player_id")).alias("place"), (pick == 1).alias("hidden"))


def player_pool(seen: DataFrame, games: DataFrame, n_games: int, seed: int = 0) -> DataFrame:
    """Distinct players of n_games games that a hash picks."""
    some = games.select("game_id").distinct().orderBy(seeded(F.col("game_id"), seed), "game_id").limit(n_games)
    return seen.join(some, "game_id", "left_semi").select("player_id").distinct()


def name_keys(name: Column) -> Column:
    """(rule, key): exact, any order of words, surname, compound surname; suffixes such as jr don't count."""
    n = F.regexp_replace(normalize_name(name), NAME_SUFFIX, "")
    words = F.split(n, " ")
    surname = F.when(name.contains(","), normalize_name(F.split(name, ",").getItem(0))).otherwise(F.element_at(words, -1))
    compound = F.array_join(F.slice(words, 2, 20), " ")
    def key(rule: str, k: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), k.alias("key"))

    return F.filter(F.array(key("exact", n), key("words", F.array_join(F.array_sort(words), " ")), key("surname", surname), key("surname", F.when(F.size(words) > 2, compound))), lambda x: F.length(x["key"]) >= 2)


def guess_keys(guess: Column) -> Column:
    """(rule, key) of a guess: it may be a whole name, its words in any order, or a surname of three letters or more."""
    g = F.regexp_replace(normalize_name(guess), NAME_SUFFIX, "")
    def key(rule: str, k: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), k.alias("key"))

    return F.filter(F.array(key("exact", g), key("words", F.array_join(F.array_sort(F.split(g, " ")), " ")), key("surname", F.when(F.length(g) >= 3, g))), lambda x: F.length(x["key"]) >= 2)


def surname_index(catalog: DataFrame) -> DataFrame:
    """(key, name): surnames that one name of the catalog has, and that name."""
    plain = normalize_name("name")
    surname = F.when(F.contains("name", F.lit(",")), normalize_name(F.split("name", ",").getItem(0))).otherwise(F.element_at(F.split(plain, " "), -1))
    return catalog.select("name", surname.alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1 and key <> ''").select("key", "name")


def match_names(guesses: DataFrame, players: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(guess_id, player_id): guesses(guess_id, guess) that fit a player's name.

    A guess of two letters or more equals the name, without accents and a
    suffix such as jr, or has its words in another order. One of three letters
    or more may be the surname, of one word or all words but the first. Where
    a player is known by one word alone, a longer guess fits if just one name
    of catalog(name) has that surname, and the guess fits that name by the
    other rules. catalog: the players' own names if not given.
    """
    known = players.select("player_id", F.inline(name_keys(F.col("name"))))
    plain = F.regexp_replace(normalize_name("name"), NAME_SUFFIX, "")
    single = players.select("player_id", plain.alias("key")).where("key <> '' and not contains(key, ' ')")
    full = single.join(surname_index(players if catalog is None else catalog), "key").select("player_id", F.inline(name_keys(F.col("name"))), F.lit(True).alias("expanded"))
    names = known.withColumn("expanded", F.lit(False)).unionByName(full)
    words = F.contains(F.regexp_replace(normalize_name("guess"), NAME_SUFFIX, ""), F.lit(" "))
    asked = guesses.select("guess_id", F.inline(guess_keys(F.col("guess"))), words.alias("several"))
    return asked.join(names, ["rule", "key"]).where("several or not expanded").select("guess_id", "player_id").distinct()


def match_pairs(guesses: DataFrame, answers: DataFrame, players: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Guesses of two names (guess_id, guess) that fit the pair of answers(guess_id, a, b), in any order.

    The first name takes the first of the pair that it fits, the second must
    fit the other. Names are parted by &, + or the word and.
    """
    parts = F.split("guess", r"(?i)\s*(?:&|\band\b|\+)\s*")
    two = guesses.where(F.size(parts) == 2).select("guess_id", F.posexplode(parts).alias("place", "guess"))
    hits = match_names(two.select(F.struct("guess_id", "place").alias("guess_id"), "guess"), players, catalog).select("guess_id.*", "player_id")
    both = hits.join(answers.select("guess_id", "a", "b"), "guess_id").groupBy("guess_id")
    fits = {f"{c}{p}": F.max((F.col("place") == p) & (F.col("player_id") == F.col(c))) for p in (0, 1) for c in "ab"}
    both = both.agg(*[v.alias(k) for k, v in fits.items()])
    return both.where("(a0 and b1) or (not a0 and b0 and a1)").select("guess_id")


def multiple_choice(answers: DataFrame, players: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(question_id, player_id, name, correct, place): each answer with n other players, in an order that the seed decides.

    The options of a question differ in name from each other, and none would
    pass for the answer by the rules of match_names. The players lie on a ring
    in parts of a few; a question takes the first that fit from its own start,
    and looks at twice as many parts again until it has n or has seen all.
    """
    parts = max(1, players.count() // RING)
    ring = players.select("player_id", "name", normalize_name("name").alias("plain"), guess_keys(F.col("name")).alias("keys"), (seeded(F.col("player_id"), seed) % parts).alias("part"), seeded(F.col("player_id"), seed + 1).alias("order"))
    own = players.select(F.col("player_id").alias("answer_id"), F.col("name").alias("answer_name"), name_keys(F.col("name")).alias("answer_keys"))
    asked = answers.select("question_id", F.col("player_id").alias("answer_id")).join(own, "answer_id").withColumn("start", seeded(F.col("question_id"), seed) % parts)
    asked = stash(asked, "questions")  # each round asks for it, and so do the options that the rounds before found
    others, span, left = None, 1, asked
    first = Window.partitionBy("question_id")
    while True:
        steps = F.explode(F.sequence(F.lit(0), F.lit(min(span, parts) - 1))).alias("step")
        near = left.select("question_id", "answer_keys", "answer_id", "start", steps).withColumn("part", (F.col("start") + F.col("step")) % parts).join(ring, "part")
        near = near.where((F.col("player_id") != F.col("answer_id")) & ~F.arrays_overlap("keys", "answer_keys"))
        near = near.withColumn("same", F.row_number().over(Window.partitionBy("question_id", "plain").orderBy("step", "order", "player_id"))).where("same = 1")
        near = near.withColumn("n", F.row_number().over(first.orderBy("step", "order", "player_id"))).where(F.col("n") <= n)
        near = near.withColumn("found", F.count("*").over(first))
        full = stash((near if span >= parts else near.where(F.col("found") == n)).select("question_id", "player_id", "name"), "options")
        others = full if others is None else others.unionByName(full)
        if span >= parts:
            break
        left = left.join(full.select("question_id").distinct(), "question_id", "left_anti")
        if left.isEmpty():
            break
        span *= 2
    right = asked.select("question_id", F.col("answer_id").alias("player_id"), F.col("answer_name").alias("name"), F.lit(True).alias("correct"))
    both = right.unionByName(others.select("question_id", "player_id", "name", F.lit(False).alias("correct")))
    return both.withColumn("place", F.row_number().over(first.orderBy(seeded(F.concat_ws("-", "question_id", "player_id"), seed), "player_id")))
