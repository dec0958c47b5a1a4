"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session leaves it unset, a temporary folder serves, but only in
    local mode, where driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="hoopframe-"))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hoopframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Ask for a broadcast where the counted rows are within the limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def attach(rows: DataFrame, groups: DataFrame, key: str, size_col: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups on key, where size_col says how many of the total rows a group has.

    Groups over a thousandth of the rows, so fewer than a thousand groups, are
    broadcast, and their rows stay where they are; only the rows of smaller
    groups shuffle. groups should be stashed: it is read twice. A left join
    keeps rows without a group.
    """
    hot = F.broadcast(groups.where(F.col(size_col) * 1000 > total))
    cold = groups.where(F.col(size_col) * 1000 <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))
