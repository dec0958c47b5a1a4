"""Exact dedup: a two-pass Bloom filter finds the rows that may repeat, and only those shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import filter_bits, flag_positions, repeat_filter
from .common import attach, read, stash, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal
    texts the row with the largest id stays; a null id is smaller than any
    other, and of rows with the same id and text exactly one stays. Other
    columns of the input are not read. An empty table gives no rows.

    The text is read once, into a table of digests. The filter has 16 bits a
    row up to MAX_BITS; a fuller filter lets more rows through to the shuffle
    and stays exact. A row that the filter clears is its own group without a
    shuffle.
    """
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("rid"))
    rows = stash(rows, "digests")
    n = rows.count()
    bits = filter_bits(n)
    flagged = flag_positions(rows, stash(repeat_filter(rows.select("h"), bits), "repeat-bits"), bits)
    maybe = flagged.where("maybe").select("doc_id", "sha", "rid")
    groups = stash(maybe.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep")), "groups")
    found = attach(maybe, groups, "sha", "group_size", n)
    found = found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(found)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, text_sha256
FROM d
"""
