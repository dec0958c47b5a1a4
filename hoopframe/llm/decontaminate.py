"""Benchmark decontamination over a distributed positional inverted index of the training tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, read, stash, text_or_empty

WINDOW = 10
SLOP = 3  # words more than a window has, among which all its words count as near
PLACES = 64  # positions of a block in which near words meet
BROADCAST_ROWS = 200_000  # terms, windows or document keys that are broadcast at most; beyond it the join shuffles
END = "\n"  # no word holds it: its posting is at the number of words of a document
NO_ID = -(1 << 63)
DOC = ["d_id", "d_hash"]  # key of a document: rows that repeat an id with another text stay apart


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and characters above U+007F, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def benchmark_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, owners): each distinct run of size words as (wid, terms), and which items hold it as (wid, item_id).

    An item of fewer words, but not none, is one window; null and wordless
    texts have none. A null item id is written as an empty string.
    """
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(text_or_empty(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(size)))).alias("terms"))
    w = stash(w.select(F.xxhash64(F.array_join("terms", " ")).alias("wid"), "item_id", "terms"), "windows")
    return w.dropDuplicates(["wid"]).select("wid", "terms"), w.select("wid", "item_id").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (d_id, d_hash, term, pos) of every token of docs that is in vocabulary(term), and of END.

    Written once, as it is read: no shuffle while the vocabulary is within
    BROADCAST_ROWS. A null text is empty; it has its END posting at 0.
    """
    text = text_or_empty(text_col)
    tokens = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d_id"), F.xxhash64(F.col(id_col), text).alias("d_hash"), F.posexplode(F.concat(words(text), F.array(F.lit(END)))).alias("pos", "term"))
    terms = vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit(END).alias("term")))
    return stash(tokens.join(broadcast_if(terms, n_terms, BROADCAST_ROWS), "term").select(*DOC, "term", "pos"), "postings")


def ranked_terms(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """(wid, size, offset, term, rank): rank 1 is the window's rarest term in the corpus.

    Windows with a term that the corpus lacks can't occur and are left out.
    """
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = windows.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(frequency, "term")
    own = Window.partitionBy("wid")  # at most WINDOW rows each
    terms = terms.withColumn("rank", F.row_number().over(own.orderBy("n", "term", "offset"))).withColumn("present", F.count("*").over(own))
    return terms.where("present = size").drop("present", "n")


def phrase_matches(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences (d_id, d_hash, wid, start, size) of the windows.

    The lists of a window's two rarest terms, less their offsets, are
    intersected on document and start; what remains looks its other terms up
    in the postings of the remaining documents.
    """
    ranked = stash(ranked_terms(postings, windows), "ranked-terms")
    n = ranked.count()

    def starts(rank: int) -> DataFrame:
        own = ranked.where(F.col("rank") == rank).select("term", "wid", "size", "offset")
        found = postings.join(broadcast_if(own, n, BROADCAST_ROWS), "term")
        return found.select(*DOC, "wid", "size", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")

    key = [*DOC, "wid", "size", "start"]
    rarest = starts(1)
    both = rarest.where("size > 1").join(starts(2), key, "left_semi")
    both = stash(both.unionByName(rarest.where("size = 1")).distinct(), "candidates")
    docs = stash(both.where("size > 2").select(*DOC).distinct(), "candidate-docs")
    near = postings.join(broadcast_if(docs, docs.count(), BROADCAST_ROWS), DOC, "left_semi")
    rest = ranked.where("rank > 2").groupBy("wid").agg(F.collect_list(F.struct("offset", "term")).alias("rest"))
    need = both.where("size > 2").join(broadcast_if(rest, n, BROADCAST_ROWS), "wid").select(*key, F.inline("rest"))
    need = need.withColumn("pos", F.col("start") + F.col("offset")).drop("offset")
    full = need.join(near, [*DOC, "pos", "term"]).groupBy(*key).agg(F.count_distinct("pos").alias("n")).where("n = size - 2").drop("n")
    return full.unionByName(both.where("size <= 2"))


def proximity_matches(postings: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """(d_id, d_hash, wid): documents with all distinct words of a window among some size + slop consecutive words, in any order.

    Windows of one distinct word are left out: their phrase is all there is to
    them. The two rarest words meet first, in blocks of positions; where they
    are near each other, the other words are looked up around them.
    """
    span = F.col("size") + slop
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = windows.select("wid", F.size("terms").alias("size"), F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("n_terms"))
    own = Window.partitionBy("wid")  # a window's words at most
    terms = terms.join(frequency, "term").withColumn("rank", F.row_number().over(own.orderBy("n", "term"))).withColumn("present", F.count("*").over(own))
    terms = stash(terms.where("present = n_terms and n_terms > 1").select("wid", "size", "term", "n_terms", "rank"), "near-terms")
    n = terms.count()

    def places(rank: int) -> DataFrame:
        return postings.join(broadcast_if(terms.where(F.col("rank") == rank).select("term", "wid", "size"), n, BROADCAST_ROWS), "term").drop("term")

    reach = F.sequence(F.floor((F.col("at") - span) / PLACES), F.floor((F.col("at") + span) / PLACES))
    first = places(1).withColumnRenamed("pos", "at").withColumn("block", F.explode(reach))
    second = places(2).select(*DOC, "wid", "pos", F.floor(F.col("pos") / PLACES).alias("block"))
    met = first.join(second, [*DOC, "wid", "block"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    met = stash(met.select(*DOC, "wid", "size", "at").distinct(), "near-anchors")
    docs = stash(met.select(*DOC).distinct(), "near-docs")
    there = postings.join(broadcast_if(docs, docs.count(), BROADCAST_ROWS), DOC, "left_semi").withColumn("block", F.floor(F.col("pos") / PLACES))
    need = met.join(broadcast_if(terms.select("wid", "term", "n_terms"), n, BROADCAST_ROWS), "wid").withColumn("block", F.explode(reach))
    found = need.join(there, [*DOC, "term", "block"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    found = found.groupBy(*DOC, "wid", "at", "size", "n_terms").agg(F.collect_set(F.struct("pos", "term")).alias("x")).where(F.size("x") >= F.col("n_terms"))

    def run_from(start: Column) -> Column:
        return F.size(F.array_distinct(F.transform(F.filter("x", lambda y: (y["pos"] >= start["pos"]) & (y["pos"] < start["pos"] + span)), lambda y: y["term"])))

    return found.where(F.exists("x", lambda start: run_from(start) == F.col("n_terms"))).select(*DOC, "wid").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted strings of the items with an occurring window) and
    near_ids (of the items with a window whose distinct words, two or more, all occur among size + SLOP words, in any order).

    A word is hit inside any occurrence of a window. Null and wordless texts
    have no words and no hits; an empty benchmark hits nothing. Rows equal in
    id and text give equal rows. Other columns aren't read.
    """
    windows, owners = benchmark_windows(items, size)
    vocabulary = stash(windows.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    postings = build_index(docs, vocabulary, vocabulary.count() + 1, id_col, text_col)
    matches = stash(phrase_matches(postings.where(F.col("term") != END), windows), "matches")
    places = matches.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hit = places.groupBy(*DOC).agg(F.count("*").alias("n_hit"))

    def items_of(found: DataFrame, name: str) -> DataFrame:
        of = found.select(*DOC, "wid").distinct().join(owners, "wid").select(*DOC, "item_id").distinct()
        return of.groupBy(*DOC).agg(F.array_sort(F.collect_list("item_id")).alias(name))

    of = items_of(matches, "item_ids")
    near = items_of(proximity_matches(postings.where(F.col("term") != END), windows), "near_ids")
    ends = postings.where(F.col("term") == END).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    out = ends.join(hit, DOC, "left").join(of, DOC, "left").join(near, DOC, "left")
    none = F.array().cast("array<string>")
    return out.select(F.nullif("d_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate over documents and benchmark: exact hits, and how many items have words near each other."""
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near_items"), F.sha2(F.array_join("near_ids", ","), 256).alias("near_sha256"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS MATERIALIZED (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS terms
         FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(terms) AS n FROM wins),
docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS terms
          FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (terms)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id),
tokens AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM docs),
freq AS (SELECT term, count(*) AS n FROM tokens GROUP BY term),
wids AS MATERIALIZED (SELECT terms, len(terms) AS size, row_number() OVER (ORDER BY terms) AS wid FROM (SELECT DISTINCT terms FROM wins)),
parts AS (SELECT DISTINCT wid, size, term FROM (SELECT wid, size, unnest(terms) AS term FROM wids)),
ranked AS (SELECT wid, size, term, n, row_number() OVER (PARTITION BY wid ORDER BY n NULLS LAST, term) AS rank, count(*) OVER (PARTITION BY wid) AS n_terms,
           count(n) OVER (PARTITION BY wid) AS present FROM parts LEFT JOIN freq USING (term)),
whole AS MATERIALIZED (SELECT * FROM ranked WHERE present = n_terms AND n_terms > 1),
anchors AS MATERIALIZED (SELECT DISTINCT a.doc_id, a.wid, a.pos AS at, a.size, a.n_terms FROM (SELECT * FROM tokens JOIN whole USING (term) WHERE rank = 1) a
            JOIN (SELECT * FROM tokens JOIN whole USING (term) WHERE rank = 2) b ON a.doc_id = b.doc_id AND a.wid = b.wid AND abs(a.pos - b.pos) < a.size + {SLOP}),
around AS MATERIALIZED (SELECT a.doc_id, a.wid, a.at, a.size, a.n_terms, t.pos, t.term FROM anchors a JOIN whole x ON x.wid = a.wid JOIN tokens t ON t.doc_id = a.doc_id AND t.term = x.term AND abs(t.pos - a.at) < a.size + {SLOP}),
runs AS (SELECT DISTINCT doc_id, wid FROM (SELECT a.doc_id, a.wid, a.at, a.pos, a.n_terms, count(DISTINCT b.term) AS n FROM around a
         JOIN around b ON a.doc_id = b.doc_id AND a.wid = b.wid AND a.at = b.at AND b.pos BETWEEN a.pos AND a.pos + a.size + {SLOP} - 1 GROUP BY ALL) WHERE n = n_terms),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS near_ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM runs JOIN wids USING (wid) JOIN wins USING (terms)) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near_ids, '')) AS near_sha256
FROM docs d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
