"""Bloom filters as tables of bitmaps, built and read with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BITS_PER_ROW = 16
MAX_BITS = 1 << 30  # 128 MB of bitmaps is the most that is broadcast


def filter_bits(rows: int) -> int:
    """Bits of a filter for so many rows. A fuller filter lets more rows through and misses none."""
    return min(MAX_BITS, 1 << max(15, (BITS_PER_ROW * rows).bit_length()))


def _positions(h: Column, bits: int) -> list[Column]:
    # bitmap_bucket_number counts from 1
    return [F.pmod(h, F.lit(bits)) + 1, F.pmod(F.xxhash64(h, F.lit(1)), F.lit(bits)) + 1]


def _bit_is_set(bitmap: Column, position: Column) -> Column:
    bit = F.bitmap_bit_position(position)
    byte = F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))
    return F.coalesce(F.conv(F.hex(byte), 16, 10).cast("long").bitwiseAND(F.pow(F.lit(2), bit % 8).cast("long")) != 0, F.lit(False))


def _bitmaps(positions: DataFrame) -> DataFrame:
    return positions.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def _exploded(hashes: DataFrame, bits: int) -> DataFrame:
    return hashes.select(F.explode(F.array(*_positions(F.col("h"), bits))).alias("p"))


def position_bitmaps(hashes: DataFrame, bits: int) -> DataFrame:
    """A Bloom filter of the hashes h (bigint) as bitmaps (bucket, bitmap)."""
    return _bitmaps(_exploded(hashes, bits))


def repeat_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """Pass one: a filter of the positions that two or more rows set.

    Counting positions with partial sums keeps a hot hash from landing in one task.
    """
    return _bitmaps(_exploded(hashes, bits).groupBy("p").count().where("count > 1"))


def flag_positions(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Pass two: adds maybe, true where the filter holds every position of the row's hash h."""
    for k, p in enumerate(_positions(F.col("h"), bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"bucket{k}"), F.col("bitmap").alias(f"bitmap{k}")))
        rows = rows.withColumn(f"p{k}", p).withColumn(f"bucket{k}", F.bitmap_bucket_number(f"p{k}")).join(side, f"bucket{k}", "left")
    maybe = _bit_is_set(F.col("bitmap0"), F.col("p0")) & _bit_is_set(F.col("bitmap1"), F.col("p1"))
    return rows.withColumn("maybe", maybe).drop("p0", "p1", "bucket0", "bucket1", "bitmap0", "bitmap1")


def possible(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """rows with maybe, false where the row's hash h is surely not among the n hashes h of wanted."""
    bits = filter_bits(n)
    return flag_positions(rows, stash(position_bitmaps(wanted, bits), "filter-bits"), bits)


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """rows whose id isn't among ids(id_col); only rows that the filter can't clear shuffle. A row without an id stays.

    Rows go through as structs, so their columns may have any names.
    """
    ids = stash(ids.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "ids")
    held = rows.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    flagged = possible(held, ids.select(F.xxhash64("id").alias("h")), ids.count())
    kept = flagged.where("maybe").join(ids, "id", "left_anti")
    return flagged.where("not maybe").select("row.*").unionByName(kept.select("row.*"))
