"""N-gram Jaccard join: pivots near in rare shingles make regions, joined exactly and recursively in the Jaccard metric."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import possible
from .cells import PIVOTS, Space, join_cells, pivot_cells, with_end
from .common import attach, read, stash
from .graph import components
from .shingles import chunks, mix, set_keys, shingles


def _prefix(n, percent: int):
    """How many shingles come first: sets of n shingles that link share one of these at least, in any one order of all shingles."""
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n, key, first) per document: hashes of its text and of its set of shingles, and twice the prefix of the set.

    Of equal sets that a task meets together only one has first; an empty set has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for at, data, offsets in chunks(batch.column(2)):
                h, n = shingles(data, offsets, k)
                key = set_keys(h, n)
                once = np.zeros(len(n), bool)
                once[np.unique(key, return_index=True)[1]] = True
                once &= n > 0
                length = np.where(once, np.minimum(n, 2 * _prefix(n, percent)), 0)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                kept = h[place < np.repeat(length, n)]
                first = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(kept.view(np.int64)), mask=pa.array(~once))
                own = slice(at, at + len(n))
                yield pa.RecordBatch.from_arrays([ids[own], hashes[own], pa.array(n, pa.int64()), pa.array(key.view(np.int64)), first], ["doc_id", "h", "n", "key", "first"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    return stash(rows.mapInArrow(run, "doc_id long, h long, n long, key long, first array<long>"), "sets")


def survivors(sets: DataFrame, percent: int) -> DataFrame:
    """(key): sets with enough shingles among their first that another set has, too.

    Two sets that link share one of their prefixes of length p, and as many
    more as the shingles that follow: of the first m shingles in one order at
    least m - p + 1. A task counts the shingles that two of its own sets share
    at once and sends one row for them, so a common one makes no hot group.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            n, lists = batch.column(1).to_numpy()[once], batch.column(2).take(pa.array(once))
            s, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(key)), length)
            order = np.argsort(s, kind="stable")
            s, owner = s[order], owner[order]
            start = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
            run = np.diff(np.append(start, len(s)))
            met = np.repeat(run > 1, run)
            score = np.bincount(owner[met], minlength=len(key)) - (length - _prefix(n, percent) + 1)
            shared = s[start[run > 1]]
            columns = [np.concatenate([s[~met], shared, mix(key.view(np.uint64)).view(np.int64)]), np.concatenate([key[owner[~met]], shared, key]), np.concatenate([np.zeros(len(s) - met.sum(), np.int64), np.zeros(len(shared), np.int64), score])]
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(s) - met.sum(), len(shared), len(key)])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(kind)], ["s", "key", "score", "kind"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in with_end(batches):
            rows = held if batch is None else np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            if batch is not None and held is not None:
                rows = np.concatenate([held, rows], axis=1)
            if rows is None or not rows.shape[1]:
                continue
            cut = rows.shape[1] if batch is None else int(np.searchsorted(rows[0], rows[0, -1]))
            held, rows = rows[:, cut:], rows[:, :cut]
            s, key, score, kind = rows
            sums = [(key[kind == 2], score[kind == 2])]
            s, key, kind = s[kind < 2], key[kind < 2], kind[kind < 2]
            if len(s):
                start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                live = (np.maximum.reduceat(kind, start) == 1) | (np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start))
                key = key[np.repeat(live, np.diff(np.append(start, len(s)))) & (kind == 0)]
                sums.append((key, np.ones(len(key), np.int64)))
            key, score = (np.concatenate(x) for x in zip(*sums))
            if len(key):
                own, at = np.unique(key, return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, at, score)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], ["key", "score"])

    rows = sets.where("first is not null").select("key", "n", "first").mapInArrow(send, "s long, key long, score long, kind byte")
    rows = rows.repartition("s").sortWithinPartitions("s").mapInArrow(meet, "key long, score long")
    return stash(rows.groupBy("key").agg(F.sum("score").alias("score")).where("score >= 0").select("key"), "survivors")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, text_col: str) -> DataFrame:
    """(key, item, weight) for the wanted (key, h): its shingles and their number, each once; only texts that a Bloom filter of h
    lets through are read again."""
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    texts = possible(texts, wanted.select("h"), wanted.count()).where("maybe").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                h, n = shingles(data, offsets, k)
                key = set_keys(h, n)
                once = np.zeros(len(n), bool)
                once[np.unique(key, return_index=True)[1]] = True
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[once])), pa.int32()), pa.array(h[np.repeat(once, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), lists], ["key", "item"])

    sets = texts.mapInArrow(run, "key long, item array<long>").join(wanted.select("key"), "key", "left_semi")
    return stash(sets.dropDuplicates(["key"]).withColumn("weight", F.size("item").cast("long")), "candidate-sets")


def rare_members(sets: DataFrame, percent: int) -> DataFrame:
    """(region, key, rank): each set in the regions of the shingles of its prefix, rarest first; its rank is the share of its
    shingles that no other set has, so that the pivot of a region is a central member."""
    postings = sets.select("key", "weight", F.explode("item").alias("s"))
    frequency = stash(postings.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"), "frequencies")
    shared = postings.join(frequency, "s").groupBy("key", "weight").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("shared"))
    alone = F.col("weight") - F.size("shared")
    left = F.col("weight") - F.ceil(F.col("weight") * percent / 100) + 1 - alone
    members = shared.where(left > 0).select("key", (alone / F.col("weight")).alias("rank"), F.explode(F.slice("shared", 1, left.cast("int"))).alias("x"))
    return stash(members.select(F.col("x.s").alias("region"), "key", "rank"), "rare-members")


class JaccardSpace(Space):
    """Sets of shingles at their Jaccard distance."""

    def __init__(self, sets: pa.ListArray, percent: int):
        self.percent, self.reach = percent, 1 - percent / 100
        self.n = sets.value_lengths().to_numpy().astype(np.int64)
        self.starts, self.weight = np.cumsum(self.n) - self.n, int(self.n.sum())
        self.ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        self.mark = np.zeros(int(self.ids.max(initial=-1)) + 1, bool)
        self.pivots: list[np.ndarray] = []

    def _common(self, i: int, js: np.ndarray | None = None) -> np.ndarray:
        own = self.ids[self.starts[i] : self.starts[i] + self.n[i]]
        self.mark[own] = True
        if js is None or 2 * len(js) > len(self.n):
            common = np.add.reduceat(self.mark[self.ids], self.starts, dtype=np.int64)
            common = common if js is None else common[js]
        else:
            common = np.array([np.count_nonzero(self.mark[self.ids[self.starts[j] : self.starts[j] + self.n[j]]]) for j in js], np.int64)
        self.mark[own] = False
        return common

    def to(self, i: int) -> np.ndarray:
        common = self._common(i)
        return 1 - common / (self.n[i] + self.n - common)

    def linked(self, i: int, js: np.ndarray) -> np.ndarray:
        out = np.minimum(self.n[i], self.n[js]) * 100 >= np.maximum(self.n[i], self.n[js]) * self.percent
        if len(self.pivots) < PIVOTS and len(self.n) > 4:
            self.pivots.append(self.to(i))
        elif self.pivots:  # the triangle inequality's window around each pivot
            far = np.stack(self.pivots)
            out &= (np.abs(far[:, js] - far[:, [i]]) <= self.reach + 1e-9).all(axis=0)
        at = np.flatnonzero(out)
        if len(at):
            common = self._common(i, js[at])
            out[at] = common * 100 >= (self.n[i] + self.n[js[at]] - common) * self.percent
        return out


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id that its links reach.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of k-word shingles; words are runs without ASCII white space, A-Z
    lower-cased. A text of fewer words has one shingle of them all; a null or
    wordless text has none, links with nothing and is its own class. Equal
    sets, as of copies and repeated rows, are one set from the start. Null ids
    come last in a class; other columns aren't read. Shingles and sets are
    known by 64-bit hashes.

    Nearly all documents are at distance 1 from any other, where the triangle
    inequality says nothing. A set therefore only meets pivots with which it
    shares a rare shingle of its prefix: two sets that link share one of these
    shingles, and so that shingle's pivot. The sets of one pivot are a region;
    regions join in the Jaccard metric, large ones after a split.
    """
    sets = shingle_sets(docs, k, percent, id_col, text_col)
    rows = sets.select("doc_id", "h", "n", "key")
    own = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("h").alias("h"))
    own = stash(own, "own")
    wanted = stash(own.select("key", "h").join(survivors(sets, percent), "key", "left_semi"), "wanted-sets")
    near = sets_of(docs, wanted, k, text_col)
    cells = pivot_cells(rare_members(near, percent))
    roots = components(join_cells(cells, near, lambda item: JaccardSpace(item, percent)))
    own = own.select("key", "first_id", "copies").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    own = stash(own, "rooted")
    least = stash(own.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("sets")), "least")
    named = stash(attach(own, least, "root", "sets", own.count()).select("key", "copies", "component_id"), "classes")
    linked = attach(rows.where("n > 0").select("doc_id", "n", "key"), named, "key", "copies", rows.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_classes over documents: shingles of four words, linked from 85 percent on."""
    return jaccard_classes(read(spark, sf_dir, "documents"), k=4, percent=85)
