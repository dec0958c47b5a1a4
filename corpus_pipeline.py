"""A corpus pipeline over documents: quality, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but
the last return the columns of documents; run() writes each stage's result as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopframe.llm.bloom import without_ids
from hoopframe.llm.byte_bpe import decode_ids, encode_texts
from hoopframe.llm.common import bucket_of, read, stash
from hoopframe.llm.decontaminate import decontaminate
from hoopframe.llm.jaccard_join import jaccard_classes
from hoopframe.llm.line_dedup import drop_repeated_lines
from hoopframe.llm.quality import keep_accepted

ORACLE_SQL = None  # the classifier and the SimHashes have no SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_accepted(docs, read(spark, sf_dir, "labels"), bucket_of("doc_id", 3) == 1)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and n_chars follows; every document stays."""
    left = drop_repeated_lines(docs.select("doc_id", "text", F.struct("*").alias("row")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return left.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, Jaccard 0.8) the one with the smallest id stays."""
    classes = jaccard_classes(docs, k=5, percent=80)
    return without_ids(docs, classes.where("doc_id != component_id").select("doc_id"), "doc_id")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return without_ids(docs, found.where("n_hit > 0").select("doc_id"), "doc_id")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, packed, and whether decoding them gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # written between, so that no task holds an encoding and a decoding worker at once
    coded = decode_ids(stash(encode_texts(docs, path, public_tokenizers.PATTERN), "token-ids"), path)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, lang, source, n_tokens, token_ids and round_trip of what is left."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
