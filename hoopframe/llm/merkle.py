"""Merkle manifest of a dataset: blocks of leaves swap subtree roots in a butterfly, and every row gets its proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, read, stash

FANOUT = 3
HEIGHT = 6  # levels of the tree inside a block: 3 ** 6 leaves are hashed in one row
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OWN = "*"  # the place of the own node among the nodes of its run


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 over the values, each "-" if null, else its UTF-8 byte count, a colon and the value."""
    return F.sha2(F.concat(*map(_encoded, values)), 256)


def ordered_places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place, from 0 within the group in the order given, and group_rows; no group lands in one task.

    Rows are dealt out by ranges of group and order, so a task holds a stretch
    of the whole order; what each stretch has of a group is added up, and only
    those counts meet. Rows that are equal in the order get places all the same.
    """
    # the row number spreads equal rows; it is read from a written table and so stays the same
    dealt = rows.withColumn("_n", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in (group, *order, "_n")]
    # the id's upper bits number the stretches in order, the lower 33 its rows
    dealt = stash(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).drop("_n"), "stretches")
    dealt = dealt.withColumn("_stretch", F.shiftright("_id", 33))
    counts = dealt.groupBy(F.col(group).alias("_group"), "_stretch").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    own = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_group", "_stretch", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("group_rows"))
    joined = dealt.join(counts.withColumnRenamed("_stretch", "_s"), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_stretch") == F.col("_s")))
    return joined.withColumn("place", F.col("_id") + F.col("_shift")).drop("_id", "_stretch", "_s", "_group", "_shift")


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def with_levels(blocks: DataFrame, nodes: str, alone: Column, height: int) -> DataFrame:
    """blocks with level0 to level<height>, node lists from the nodes up, and node, the root of the block.

    alone: the block is the whole tree, which ends where one node remains;
    another block has all levels, be there one node in the last.
    """
    blocks = blocks.withColumn("level0", F.col(nodes))
    for k in range(height):
        level = F.col(f"level{k}")
        blocks = blocks.withColumn(f"level{k + 1}", F.when(alone & (F.size(level) == 1), level).otherwise(_parents(level)))
    return blocks.withColumn("node", F.col(f"level{height}")[0])


def _marked(run: Column, own: Column) -> Column:
    return F.transform(run, lambda x, i: F.when(i == own, F.lit(OWN)).otherwise(x))


def _steps(at: Column, alone: Column, height: int) -> Column:
    """The steps from place `at` of level0 up to the block's root: the nodes of each run, with OWN for the own one."""
    steps = []
    for k in range(height):
        level, p = F.col(f"level{k}"), F.floor(at / FANOUT**k)
        run = F.slice(level, (F.floor(p / FANOUT) * FANOUT + 1).cast("int"), FANOUT)
        steps.append(F.when(~(alone & (F.size(level) == 1)), F.array_join(_marked(run, p % FANOUT), "")))
    return F.array_compact(F.array(*steps)) if steps else F.array().cast("array<string>")


def butterfly(units: DataFrame, group: str, rounds: int) -> DataFrame:
    """(group, place, root, steps): what each unit (group, place, group_rows, node) lacked of its way to the group's root.

    In round r the units below one node of that level hold a copy of its hash
    each. Those of the same rank below the nodes of a run swap copies and all
    hash the parent, so in the end every unit has its whole way up and nothing
    is handed down again. Where the last node of a run has fewer units than its
    neighbours, these serve several ranks in turn. A unit sends at most two
    messages a round on average, and a run has three members, whatever the
    group's size.
    """
    state = units.select(group, "place", "group_rows", "node", F.array().cast("array<string>").alias("steps"))
    for r in range(rounds):
        width, run = FANOUT**r, FANOUT ** (r + 1)
        place, n = F.col("place"), F.col("group_rows")
        first = F.floor(place / run) * run  # of the run
        digit = F.floor((place - first) / width)
        rank = (place - first) % width
        have = F.least(F.lit(width), n - first - digit * width)
        to = [F.array(F.struct(place.alias("place"), F.lit(True).alias("own")))]
        for d in range(FANOUT):
            start = first + d * width
            there = F.least(F.lit(width), n - start)
            served = F.transform(F.sequence(start + rank, start + there - 1, have), lambda p: F.struct(p.alias("place"), F.lit(False).alias("own")))
            to.append(F.when((digit != d) & (n > width) & (rank < there), served).otherwise(F.array().cast("array<struct<place:bigint,own:boolean>>")))
        sent = state.select(group, "group_rows", "node", digit.alias("digit"), "steps", F.inline(F.concat(*to)))
        sent = sent.withColumn("steps", F.when(F.col("own"), F.col("steps")))
        met = sent.groupBy(group, "place", "group_rows").agg(F.array_sort(F.collect_list(F.struct("digit", "node", "own"))).alias("run"), F.max("steps").alias("steps"))
        whole = F.array_join(F.transform("run", lambda x: x["node"]), "")
        step = F.array_join(F.transform("run", lambda x: F.when(x["own"], F.lit(OWN)).otherwise(x["node"])), "")
        grows = F.col("group_rows") > width
        state = met.select(group, "place", "group_rows", F.when(grows, F.sha2(whole, 256)).otherwise(whole).alias("node"), F.when(grows, F.array_append("steps", step)).otherwise(F.col("steps")).alias("steps"))
    return state.select(group, "place", F.col("node").alias("root"), "steps")


def rounds_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    rounds = 0
    while FANOUT**rounds < n:
        rounds += 1
    return rounds


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.replace(step, F.lit(OWN), node), 256))


def merkle_manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """leaves(id, source, leaf) and any other columns, with subroot, root and steps, the proof of each leaf.

    Per source the leaves ascend by id (null first, equal ids by leaf, equal
    leaves in any order, which changes nothing); every three consecutive nodes
    become their hash until one remains, the subroot; the subroots by source
    (null first, bytewise) likewise give the root. steps[i] has the nodes of
    the run at level i with "*" for the own one. An empty table gives no rows.

    A block of 3 ** height leaves of a source is one row; blocks of a source
    and then the sources find their ways up in a butterfly. Only the sources
    are attached to blocks by a join, hot ones by broadcast.
    """
    others = [c for c in leaves.columns if c not in ("id", "source", "leaf")]
    leaves = leaves.select("id", "source", "leaf", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    placed = ordered_places(stash(leaves, "leaves"), "source", ["id", "leaf"])
    size = FANOUT**height
    block = F.floor(F.col("place") / size)
    item = F.struct("place", "id", "leaf", "rest")
    blocks = placed.groupBy("source", block.alias("block"), F.ceil(F.col("group_rows") / size).alias("group_rows")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = stash(blocks, "blocks")
    alone = F.col("group_rows") == 1
    leveled = with_levels(blocks, "items.leaf", alone, height)

    units = stash(leveled.select("source", F.col("block").alias("place"), "group_rows", "node"), "units")
    most, n_units = units.agg(F.max("group_rows"), F.count("*")).first()
    ways = stash(butterfly(units, "source", rounds_of(most or 0)), "ways")
    sources = ways.where("place = 0").select("source", F.col("root").alias("node"))
    ranked = ordered_places(stash(sources.withColumn("all", F.lit(0)), "sources"), "all", ["source"])
    n_sources = ranked.count()
    tops = butterfly(ranked, "all", rounds_of(n_sources)).withColumnRenamed("steps", "top")
    named = ranked.select("source", "place", F.col("node").alias("subroot")).join(tops, "place")
    # a join by source: a null source needs a key of its own
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    n_blocks = units.groupBy(key.alias("key")).agg(F.count("*").alias("blocks"))
    named = stash(named.select(key.alias("key"), "subroot", "root", "top").join(n_blocks, "key"), "tops")
    ways = attach(ways.select("source", "place", "steps", key.alias("key")), named, "key", "blocks", n_units)
    ways = ways.select(F.col("source").alias("_source"), F.col("place").alias("_block"), "subroot", "root", F.concat("steps", "top").alias("above"))

    both = leveled.join(ways, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    rows = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(_steps(i, alone, height), "above").alias("steps")))
    out = both.select("source", "subroot", "root", F.inline(rows))
    return out.select("source", "item.id", "item.leaf", *[F.col(f"item.rest.`{c}`") for c in others], "subroot", "root", "steps")


def tamper_report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Where the crc32 of the id as text is even, the row is tampered with after
    the manifest is made: the newlines of its text go. folded_root is what the
    row as it is then gives with the siblings of its proof; verified says that
    it is the root. A null field hashes as "-"; a row without an id isn't
    tampered with; repeated rows are leaves of their own. The text is read
    once. Other columns of the input are not read.
    """
    values = {c: F.col(f"`{c}`") for c in FIELDS}
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = even & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    after = leaf_hash(*({**values, "text": F.replace("text", F.lit("\n"), F.lit(""))}[c] for c in FIELDS))
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), leaf_hash(*values.values()).alias("leaf"), F.when(changed, after).alias("changed"))
    m = merkle_manifest(leaves, height)
    proof = F.sha2(F.replace(F.array_join("steps", ""), F.lit(OWN), F.lit("")), 256)
    m = m.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle proofs of all documents, and which of them hold after the tampering."""
    return tamper_report(read(spark, sf_dir, "documents"))


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL = """
WITH RECURSIVE given AS (
  SELECT doc_id, source, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
           lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: %s)) AS crc,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(crc, 4294967295) %% 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS now FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (SELECT source, 0 AS level, place, leaf AS h, n FROM placed
  UNION ALL SELECT source, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, place // 3, n),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, place, subroot AS h, n FROM subroots
  UNION ALL SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3, n),
low AS (SELECT p.doc_id, n.level AS level, string_agg(CASE WHEN n.place = p.place // CAST(3 ** n.level AS BIGINT) THEN '*' ELSE n.h END, '' ORDER BY n.place) AS step
  FROM placed p JOIN nodes n ON n.source IS NOT DISTINCT FROM p.source AND n.n > 1 AND n.place // 3 = p.place // CAST(3 ** (n.level + 1) AS BIGINT) GROUP BY p.doc_id, n.level),
high AS (SELECT s.source, t.level, string_agg(CASE WHEN t.place = s.place // CAST(3 ** t.level AS BIGINT) THEN '*' ELSE t.h END, '' ORDER BY t.place) AS step
  FROM subroots s JOIN tops t ON t.n > 1 AND t.place // 3 = s.place // CAST(3 ** (t.level + 1) AS BIGINT) GROUP BY s.source, t.level),
steps AS (SELECT p.doc_id, p.now, p.leaf, s.subroot, coalesce((SELECT list(step ORDER BY level) FROM low l WHERE l.doc_id = p.doc_id), []) || coalesce((SELECT list(step ORDER BY level) FROM high h WHERE h.source IS NOT DISTINCT FROM p.source), []) AS steps
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source),
done AS (SELECT *, (SELECT h FROM tops WHERE n = 1) AS root, list_reduce(list_prepend(now, steps), lambda node, step: sha256(replace(step, '*', node))) AS folded_root FROM steps)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '*', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
""" % _STEP
