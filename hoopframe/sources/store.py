"""Games written in runs: a game is done when a run has written all its outputs and entered it in the manifest.

Outputs lie under root/<name>/<partition>=…/run=…, the manifest under
root/manifest/run=…. The manifest is written last, so what a broken run left
behind is never read; the next run has the same number and replaces it,
partition by partition. One writer at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="hoopframe-"))


def stash(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: what is asked of it more than once is made once."""
    path = f"{scratch_dir(df.sparkSession)}/hoopframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path; None if there is none."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per game and run: the keys, run, latest (whether no later run has the game), and n_<output> rows."""
    rows = _read(spark, f"{root}/manifest")
    if rows is None:
        return None
    keys = [c for c in rows.columns if c != "run" and not c.startswith("n_")]
    return rows.withColumn("latest", F.col("run") == F.max("run").over(Window.partitionBy(*keys)))


def _live(spark: SparkSession, root: str, partition: str) -> tuple[DataFrame, DataFrame]:
    """(partitions, superseded): folders (partition, run) that hold a latest game, and the other games in them."""
    m = manifest(spark, root)
    partitions = m.where("latest").select(partition, "run").distinct()
    return partitions, m.where("not latest").join(partitions, [partition, "run"], "left_semi")


def read_games(spark: SparkSession, root: str, name: str, key: str = "game_id", partition: str = "season_code") -> DataFrame:
    """The rows of an output as the latest run of each game wrote them, with run.

    Folders that hold nothing current are pruned; a game that a later run has
    written again while others of its folder stand is left out there.
    """
    partitions, superseded = _live(spark, root, partition)
    rows = _read(spark, f"{root}/{name}").join(F.broadcast(partitions), [partition, "run"], "left_semi")
    return rows.join(superseded.select(key, partition, "run"), [key, partition, "run"], "left_anti")


def done_games(spark: SparkSession, root: str, names: list[str], key: str = "game_id", partition: str = "season_code") -> DataFrame | None:
    """(partition, key) of games in the manifest whose outputs are all there still; None before the first run."""
    m = manifest(spark, root)
    if m is None:
        return None
    m = m.where("latest")
    for name in names:
        rows = _read(spark, f"{root}/{name}")
        n = F.col(f"n_{name}") if f"n_{name}" in m.columns else F.lit(None)
        there = m.where(n == 0)  # a game may have no rows of an output
        if rows is not None:
            there = there.unionByName(m.where(n > 0).join(rows.select(partition, "run").distinct(), [partition, "run"], "left_semi"))
        m = there
    return m.select(partition, key)


def write_games(outputs: dict[str, DataFrame], root: str, overwrite: Column | bool = False, key: str = "game_id", partition: str = "season_code") -> int | None:
    """Writes the games that aren't done, and those done for which overwrite holds; returns the number of the run.

    Every output has the columns partition and key, and none named run. A game
    of some outputs only is written with those. Nothing to write: None, and
    no run is entered. Null keys are an error.
    """
    names = list(outputs)
    spark = outputs[names[0]].sparkSession
    if any("run" in df.columns for df in outputs.values()):
        raise ValueError("an output has a column run")
    keys = [partition, key]
    known = manifest(spark, root)
    run = 1 + ((known.agg(F.max("run")).first()[0] or 0) if known is not None else 0)
    games = reduce(DataFrame.union, [df.select(*keys) for df in outputs.values()]).distinct()
    games = games.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a game without {c}"))).otherwise(F.col(c)).alias(c) for c in keys])
    done = done_games(spark, root, names, key, partition)
    if done is not None:
        again = F.lit(overwrite) if isinstance(overwrite, bool) else F.coalesce(overwrite, F.lit(False))
        done = done.join(games.where(again), keys, "left_anti")
        games = games.join(done, keys, "left_anti")
    # the games of this run are fixed before anything is written
    games.write.mode("overwrite").parquet(f"{root}/planned")
    games = spark.read.schema(games.schema).parquet(f"{root}/planned")
    if games.isEmpty():
        return None
    for name, df in outputs.items():
        rows = df.join(games, keys, "left_semi").withColumn("run", F.lit(run))
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "run").parquet(f"{root}/{name}")
    _enter(spark, games, root, names, run, keys)
    return run


def _enter(spark: SparkSession, games: DataFrame, root: str, names: list[str], run: int, keys: list[str]) -> None:
    """Enters the games of a run in the manifest, with the rows that each output really has."""
    for name in names:
        rows = _read(spark, f"{root}/{name}")
        if rows is None:
            games = games.withColumn(f"n_{name}", F.lit(0).cast("long"))
            continue
        n = rows.where(F.col("run") == run).groupBy(*keys).agg(F.count("*").alias(f"n_{name}"))
        games = games.join(n, keys, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    games.write.mode("overwrite").parquet(f"{root}/manifest/run={run}")
