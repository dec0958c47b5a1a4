"""Joins within cells around pivots: small cells in one task each, large ones split around more pivots first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stash
from .shingles import mix

MEMBERS = 1024  # members of a cell that one task joins
WEIGHT = 1 << 21  # and the sum of their weights
PIVOTS = 16  # of a larger cell, about


class Space:
    """Members of one cell. linked(i, js): which of the members js link with i; to(i): distances of all members to i
    in a metric in which links are at most reach apart, or None without one."""

    reach = 0.0
    weight = 0  # of the items that it holds

    def linked(self, i: int, js: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def to(self, i: int) -> np.ndarray | None:
        return None

    @staticmethod
    def connect_all(cells: list[tuple[Space, np.ndarray]]) -> list[np.ndarray]:
        """The labels of the members of each cell after its links."""
        return [connect(labels, space.linked) for space, labels in cells]


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches and None."""
    yield from batches
    yield None


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches again, one batch for each group of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        bounds = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            here = tuple(values[:, lo])
            if held and here != last:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = here
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def connect(labels: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Labels after all links; members that have one label already aren't compared."""
    labels = np.unique(labels, return_inverse=True)[1]
    for i in range(len(labels) - 1):
        others = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if len(others):
            for j in others[linked(i, others)]:
                if labels[j] != labels[i]:
                    labels[labels == labels[j]] = labels[i]
    return labels


def _stars(keys: np.ndarray, labels: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) for each label: its least key with each other key, but for keys of one label before, which are linked elsewhere."""
    order = np.lexsort((keys, labels))
    k, now, was = keys[order], labels[order], before[order]
    first = np.flatnonzero(np.append(True, now[1:] != now[:-1]))
    lead = np.repeat(first, np.diff(np.append(first, len(k))))
    other = k != k[lead]
    own = was != k  # it has a label from before: that stands for it
    yield k[other & ~own], k[lead][other & ~own]
    # what joins labels from before: the label's own key with the lead
    yield was[other & own], k[lead][other & own]


def _tasks(rows: DataFrame) -> int:
    """As many as a shuffle has: adaptive execution would merge the few bytes of tasks that compute for long."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _joined(rows: DataFrame, items: DataFrame, space: Callable[[pa.Array], Space]) -> DataFrame:
    """Links (a, b) of cells that fit in a task: rows (cell, key, label, rank), central members of a cell by rank first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, Space]] = []
        for group in with_end(grouped(batches, ["cell"])):
            if group is not None:
                keys, before = group.column("key").to_numpy(), group.column("label").to_numpy()
                if (before != before[0]).any():
                    held.append((keys, before, space(group.column("item"))))
            if held and (group is None or sum(len(keys) for keys, _, _ in held) >= 8 * MEMBERS or sum(x.weight for _, _, x in held) >= WEIGHT):
                after = held[0][2].connect_all([(x, before) for _, before, x in held])
                for (keys, before, _), labels in zip(held, after):
                    for a, b in _stars(keys, labels, before):
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held = []

    whole = rows.select("cell", "key", "label", "rank").join(items.select("key", "item"), "key")
    whole = whole.repartition(_tasks(rows), "cell").sortWithinPartitions("cell", "rank", "key").select("cell", "key", "label", "item")
    return stash(whole.mapInArrow(run, "a long, b long"), "links")


def _split(rows: DataFrame, items: DataFrame, space: Callable[[pa.Array], Space], turn: int) -> DataFrame:
    """(cell, fresh, key, label) for the members of large cells in the cells of their pivots, and links as (null, null, a, b).

    The members of a cell are dealt in blocks, each with all pivots of the
    cell. A member goes to the cell of its nearest pivot and of every pivot
    not farther by more than twice the reach: two linked members have one of
    these in common, by the triangle inequality. Without a metric it goes to
    one cell, which doesn't shrink. Members linked to a pivot take its label.
    """
    pivot = F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("size") / PIVOTS)) == 0
    block = F.pmod(F.xxhash64("key", F.lit(-turn)), F.col("parts"))
    dealt = rows.select("cell", "key", "label", F.lit(False).alias("pivot"), block.alias("block"))
    pivots = rows.where(pivot).select("cell", "key", "label", F.lit(True).alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    names = ["cell", "fresh", "key", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["cell", "block"]):
            keys, labels = group.column("key").to_numpy(), group.column("label").to_numpy().copy()
            flags = group.column("pivot").to_numpy(zero_copy_only=False)
            at, members = np.flatnonzero(flags), np.flatnonzero(~flags)
            near, links, cells = space(group.column("item")), [], np.zeros((0, len(keys)))
            far = []
            for i in at:
                distance = near.to(i)
                if distance is not None:
                    far.append(distance)
                hit = np.arange(len(keys))[near.linked(i, np.arange(len(keys)))]
                hit = hit[keys[hit] != keys[i]]
                links.append((np.full(len(hit), keys[i]), keys[hit]))
                labels[hit] = np.minimum(labels[hit], labels[i])
            cell = group.column("cell").to_numpy()
            if far:
                cells = np.stack(far)
                inside = cells[:, members] <= cells[:, members].min(axis=0) + 2 * near.reach + 1e-9
                p, m = np.nonzero(inside)
                fresh = mix((mix(cell[:1].view(np.uint64)) + keys[at][p].view(np.uint64)) ^ np.uint64(turn)).view(np.int64)
            else:
                m = np.arange(len(members))
                fresh = cell[members]
            chosen = members[m]
            yield pa.RecordBatch.from_arrays([pa.array(cell[chosen]), pa.array(fresh), pa.array(keys[chosen]), pa.array(labels[chosen])], names)
            if links:
                a, b = (np.concatenate(x) for x in zip(*links))
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b)], names)

    whole = dealt.unionByName(pivots).join(items.select("key", "item"), "key")
    whole = whole.repartition(_tasks(rows), "cell", "block").sortWithinPartitions("cell", "block").select("cell", "block", "key", "label", "pivot", "item")
    return stash(whole.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "split-cells")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Large cells that no pivots shrink, as cells of two blocks: rows (cell, key, label, rank, size, parts), so that any two
    members meet but those of the cell's most frequent label, which are connected already."""
    frequent = rows.groupBy("cell", "label").agg(F.count("*").alias("n"))
    main = frequent.groupBy("cell").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
    main = stash(main.select("cell", F.when(F.col("main.n") > 1, F.col("main.label")).alias("main"), F.when(F.col("main.n") > 1, F.col("all") - F.col("main.n")).otherwise(F.col("all")).alias("rest")), "main-labels")
    rows = rows.join(main, "cell").where("rest > 0")
    of_all, of_rest = F.col("parts") * 2, F.ceil(F.col("parts") * 2 * F.col("rest") / F.col("size"))
    rows = rows.select("cell", "key", "label", "rank", of_all.alias("blocks"), of_rest.alias("rest_blocks"), (~F.col("label").eqNullSafe(F.col("main"))).alias("apart"))
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).alias("j")
    every = rows.select("cell", "key", "label", "rank", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1).cast("array<bigint>")).alias("i"), own)
    rest = rows.where("apart").select("cell", "key", "label", "rank", F.pmod(F.xxhash64("key", F.lit(8)), F.col("rest_blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<bigint>")).alias("j"))
    return every.unionByName(rest).select(F.xxhash64("cell", "i", "j").alias("cell"), "key", "label", "rank").distinct()


def join_cells(cells: DataFrame, items: DataFrame, space: Callable[[pa.Array], Space]) -> DataFrame:
    """Links (a, b) that connect what the links between members of a cell connect.

    cells: distinct (cell, key, rank). items: (key, weight, item), each key
    once; a task that joins a cell holds its items. Cells over MEMBERS members
    or WEIGHT are split round by round around pivots; where the cells of the
    pivots don't shrink them, blocks of their members meet in pairs.
    """
    rows, links, turn = cells.withColumn("label", F.col("key")), [], 0
    while True:
        turn += 1
        need = F.greatest(F.ceil(F.col("size") / MEMBERS), F.ceil(F.col("weight") / WEIGHT))
        sizes = rows.join(items.select("key", "weight"), "key").groupBy("cell").agg(F.count("*").alias("size"), F.sum("weight").alias("weight"), F.count_distinct("label").alias("labels"))
        sizes = sizes.where("labels > 1").select("cell", "size", F.greatest(F.lit(1), F.least(need, F.floor(F.col("size") / 2))).cast("int").alias("parts"))
        sizes = stash(sizes, "cell-sizes")
        links.append(_joined(rows.join(sizes.where("parts = 1").select("cell"), "cell"), items, space))
        large = sizes.where("parts > 1")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, links)
        rows = stash(rows.join(large, "cell"), "large-cells")
        split = _split(rows, items, space, turn)
        links.append(split.where("cell is null").select(F.col("key").alias("a"), F.col("label").alias("b")))
        split = split.where("cell is not null")
        shrunk = split.groupBy("cell", "fresh").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.max("n").alias("most")).join(large, "cell")
        shrunk = stash(shrunk.where("n <= 2 * size and most <= 0.7 * size").select("cell"), "shrunk-cells")
        ranks = rows.select("cell", "key", "rank", "size", "parts")
        now = split.groupBy("cell", "key").agg(F.min("label").alias("label")).join(ranks, ["cell", "key"])
        whole = _block_pairs(now.join(shrunk, "cell", "left_anti"))
        links.append(_joined(whole, items, space))
        rows = stash(split.join(shrunk, "cell", "left_semi").join(ranks.select("cell", "key", "rank"), ["cell", "key"]).select(F.col("fresh").alias("cell"), "key", "rank", "label"), "cells")


def pivot_cells(members: DataFrame) -> DataFrame:
    """(cell, key, rank): for the members (region, key, rank) of regions of two keys or more the region's member of least
    rank as its pivot, and so as their cell. Members of one region share a cell."""
    pivots = members.groupBy("region").agg(F.min(F.struct("rank", "key")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    pivots = stash(pivots.select("region", F.col("pivot.key").alias("cell"), "size"), "pivots")
    total = pivots.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return stash(attach(members, pivots, "region", "size", total).select("cell", "key", "rank").distinct(), "cells")
