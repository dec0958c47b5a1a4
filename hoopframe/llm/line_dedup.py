"""Line dedup: SimHashes of normalised lines meet in pigeonhole blocks, MinHashes in bands; of each group of near-equal lines one stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import possible
from .cells import Space, connect, join_cells, with_end
from .common import ascii_lower, attach, read, stash, text_or_empty
from .edits import Texts, within
from .graph import components
from .shingles import chunks, keys, mix, per_text, word_hashes

MIN_WORDS = 5
MAX_BITS_APART = 3
BLOCKS = 4  # of a SimHash's 64 bits: SimHashes up to three bits apart agree on one of four blocks
BLOCK_LINES = 8192  # of a block that one task compares; larger blocks divide by the remaining bits
SAMPLE = 64  # lines of which one counts where large blocks are looked for
FAR_BITS = 24  # by which SimHashes of lines that meet in a band differ at most; those of like lines differ by 22 or less in 999 of 1000 cases
LONG = 4  # bytes of a word that the SimHash counts
FEW = 4
LONGER = 6  # bytes of a word that word bands count: shorter ones are mostly common
WORD_BANDS = 4  # bands of three MinHashes of the longer words
PAIR_BANDS = 2  # bands of two MinHashes of the pairs of neighbouring words
SHORT, SHORT_BANDS = 16, 3  # words below which a line has bands of one MinHash of its pairs besides
SIMILARITY = 0.8
NO_ID = -(1 << 63)
PAIRS = 64  # of a cell, those of the nearest SimHashes, that are compared before links leave pairs out; then twice as many
LINE = ["d_id", "d_hash", "line_no"]  # rows equal in id and text are one document
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LANES = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)


def normalised(line: Column) -> Column:
    """A-Z lower-cased; runs of anything but 0-9, a-z and characters above U+007F are one blank, none at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of the texts, each with its line feed, and the number of lines of each text."""
    feeds = np.flatnonzero(data == 10) + 1
    bounds = np.sort(np.concatenate([offsets[:-1], feeds]), kind="stable")
    return np.append(bounds, len(data)), np.diff(np.searchsorted(feeds, offsets, "right")) + 1


def simhashes(words: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of lines of two words or more, over their words of LONG bytes and more.

    Shorter words are mostly those that all lines share. A line with fewer
    than FEW long words takes the pairs of neighbouring words besides. The
    first feature decides ties.
    """
    line = np.repeat(np.arange(len(counts)), counts)
    long = lengths >= LONG
    few = np.bincount(line[long], minlength=len(counts)) < FEW
    paired = (line[:-1] == line[1:]) & few[line[:-1]]
    pairs = mix(words[:-1] * keys(2)[0] + words[1:] * keys(2)[1])[paired] if len(words) else words
    owner = np.concatenate([line[long], line[:-1][paired]])
    order = np.argsort(owner, kind="stable")
    values, own = np.concatenate([words[long], pairs])[order], np.bincount(owner, minlength=len(counts))
    ends = np.cumsum(own)
    sums = np.zeros((len(counts), 64), np.int64)
    for nibble in range(16):  # four bits at a time, in lanes of 16 bits
        lanes = per_text(np.add, _LANES[((values >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.int64)], own)
        for b in range(4):
            sums[:, 4 * nibble + b] = (lanes >> np.uint64(16 * b)) & np.uint64(0xFFFF)
    bit = np.arange(64, dtype=np.uint64)
    for i in np.flatnonzero(own > 0xFFFF):  # their lanes overflow
        v = values[ends[i] - own[i] : ends[i]]
        sums[i] = [int(((v >> b) & np.uint64(1)).sum()) for b in bit]
    tie = (values[ends - own][:, None] >> bit) & np.uint64(1) if len(values) else np.zeros((0, 64), np.uint64)
    bits = np.where(2 * sums == own[:, None], tie, (2 * sums > own[:, None]).astype(np.uint64))
    return (bits << bit).sum(axis=1, dtype=np.uint64)


def band_hashes(words: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, used), a row for each band and a column for each line: MinHashes of longer words and of neighbouring words.

    Two lines that share a part j of their longer words agree on a band of
    those with probability j ** 3. A line with fewer than three has none.
    """
    n, line, long = len(counts), np.repeat(np.arange(len(counts)), counts), lengths >= LONGER
    paired = line[:-1] == line[1:]
    pairs = mix(words[:-1] * keys(2)[0] + words[1:] * keys(2)[1])[paired] if len(words) else words
    pair_line = line[:-1][paired]
    short = counts[pair_line] < SHORT
    hashes, used, seed = [], [], 2
    kinds = ((words[long], line[long], WORD_BANDS, 3, 3), (pairs, pair_line, PAIR_BANDS, 2, 1), (pairs[short], pair_line[short], SHORT_BANDS, 1, 1))
    for values, owner, bands, width, least in kinds:
        own = np.bincount(owner, minlength=n)
        for _ in range(bands):
            h = np.full(n, seed, np.uint64)
            for _ in range(width):
                h = mix(h * keys(2)[0] + per_text(np.minimum, values * keys(64)[seed], own))
                seed += 1
            hashes.append(h)
            used.append(own >= least)
    return np.array(hashes), np.array(used)


def characters(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Characters of each normalised line: those of its words and the blanks between them."""
    ends = np.append(0, np.cumsum(~_BLANK[data] & ((data & 0xC0) != 0x80)))[bounds]
    return np.diff(ends) + np.maximum(counts - 1, 0)


def spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and bounds with a blank around each character of the scripts that write words without blanks.

    These are Thai, Lao, Myanmar, Khmer, Chinese and Japanese, and full-width forms.
    """
    first, second = data, np.append(data[1:], np.uint8(0))

    def within(lead: int, low: int, high: int) -> np.ndarray:
        return (first == lead) & (second >= low) & (second <= high)

    three = within(0xE0, 0xB8, 0xBB) | within(0xE1, 0x80, 0x82) | within(0xE1, 0x9E, 0x9F) | within(0xEF, 0xA4, 0xAB) | within(0xEF, 0xBC, 0xBE) | ((first >= 0xE3) & (first <= 0xE9))
    three, four = np.flatnonzero(three), np.flatnonzero(within(0xF0, 0xA0, 0xAF))
    if not len(three) + len(four):
        return data, bounds
    at = np.unique(np.concatenate([three, three + 3, four, four + 4]))
    at = at[at < len(data)]
    return np.insert(data, at, 32), bounds + np.searchsorted(at, bounds)


def fingerprint_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(d_id, d_hash, line_no, line, sim, chars, bands) of every line with a word; line: a hash of the normalised line.

    sim, its characters and bands are null for lines of fewer than min_words words, where a
    character of a script without blanks is a word, and for lines that the
    same chunk of texts has before.
    """
    names = [*LINE, "line", "sim", "chars", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(2)):
                bounds, lines = line_bounds(data, offsets)
                words, counts, sizes = word_hashes(data, bounds, _BLANK)
                used = counts > 0
                place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
                line = mix(per_text(np.add, mix(words) * keys(int(counts.max(initial=1)))[place], counts) + counts.astype(np.uint64))
                apart = spaced(data, bounds)
                tokens, n_tokens, sizes = (words, counts, sizes) if apart[0] is data else word_hashes(*apart, _BLANK)
                near = np.zeros(len(counts), bool)
                near[np.unique(line, return_index=True)[1]] = True
                near &= n_tokens >= min_words
                kept = np.repeat(near, n_tokens)
                tokens, sizes, own = tokens[kept], sizes[kept], n_tokens[near]
                sim = np.zeros(len(counts), np.uint64)
                sim[near] = simhashes(tokens, own, sizes)
                hashes, valid = band_hashes(tokens, own, sizes)
                length = np.zeros(len(counts), np.int64)
                length[near] = valid.sum(axis=0)
                text = np.repeat(np.arange(len(lines)), lines)
                number = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
                row = pa.array(text[used] + at)
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[used])), pa.int32()), pa.array(hashes.T[valid.T].view(np.int64)), mask=pa.array(~near[used]))
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(number[used], pa.int64()), pa.array(line[used].view(np.int64)), pa.array(sim[used].view(np.int64), mask=~near[used]), pa.array(characters(data, bounds, counts)[used].astype(np.int32), mask=~near[used]), bands]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = _documents(docs, id_col, text_col)
    return stash(rows.select("d_id", "d_hash", "text").mapInArrow(run, "d_id long, d_hash long, line_no long, line long, sim long, chars int, bands array<long>"), "lines")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(F.col(text_col).cast("string"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d_id"), F.xxhash64(F.col(id_col), text).alias("d_hash"), text.alias("text"), F.struct(*kept).alias("row"))


def near_pairs(region: np.ndarray, line: np.ndarray, sim: np.ndarray, chars: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of two lines of one region that may be alike: by Hamming distance of their SimHashes, MAX_BITS_APART in
    blocks (odd regions) and FAR_BITS in bands, and by length. Rows are sorted by region."""
    most = np.where(region & 1, MAX_BITS_APART, FAR_BITS)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(sim[a] ^ sim[b]) <= most[a]
        a, b = a[near], b[near]
        long = np.maximum(chars[a], chars[b])
        near = (long - np.minimum(chars[a], chars[b]) <= np.floor(long * (1 - similarity) + 1e-9)) & (line[a] != line[b])
        found.append((a[near], b[near]))

    start = np.flatnonzero(np.append(True, region[1:] != region[:-1])[: len(region)])
    size = np.diff(np.append(start, len(region)))
    at, d = np.flatnonzero(np.repeat(size <= 64, size)), 0
    while len(at):  # lines of small regions with the next one, the one after that and so on
        d += 1
        at = at[at + d < len(region)]
        at = at[region[at] == region[at + d]]
        keep(at, at + d)
    for first, n in zip(start[size > 64], size[size > 64]):
        for lo in range(first, first + n, 256):
            own, rest = np.arange(lo, min(lo + 256, first + n)), np.arange(lo, first + n)
            i, j = np.nonzero(np.bitwise_count(sim[own][:, None] ^ sim[rest][None, :]) <= most[first])
            keep(own[i[j > i]], rest[j[j > i]])
    return tuple(np.concatenate(x) for x in zip(*found))


def region_cells(rows: DataFrame, similarity: float) -> DataFrame:
    """(cell, key) for rows (region, line, sim, chars): the lines of a region that near_pairs joins, in the cell of their first.

    In a region of over BLOCK_LINES lines all lines of like length share a
    cell: each is in the cell of its own step of lengths and in the next.
    """
    step = -np.log(similarity)

    def cells(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        region, line, sim, chars = part
        a, b = near_pairs(region, line, sim.view(np.uint64), chars, similarity)
        root, before = np.arange(len(region)), None
        while before is None or (root != before).any():  # the least place that near pairs reach
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
        other = line[root] != line
        return line[root][other], line[other]

    def whole(part: np.ndarray, leads: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        steps = np.floor(np.log(np.maximum(part[3], 1)) / step + 1e-9).astype(int)
        steps, line = np.concatenate([steps, steps + 1]), np.concatenate([part[1]] * 2)
        kinds, first, own = np.unique(steps, return_index=True, return_inverse=True)
        lead = np.array([leads.setdefault(k, int(line[i])) for k, i in zip(kinds.tolist(), first)])[own]
        return lead[lead != line], line[lead != line]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, leads = np.zeros((4, 0), np.int64), None, {}
        for batch in with_end(batches):
            found = []
            if batch is not None:
                held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            if large is not None:
                cut = int(np.searchsorted(held[0], large, "right"))
                found.append(whole(held[:, :cut], leads))
                held, large = held[:, cut:], large if cut == held.shape[1] else None
            cut = held.shape[1] if batch is None or not held.shape[1] else int(np.searchsorted(held[0], held[0, -1]))
            ready, held = held[:, :cut], held[:, cut:]
            region, first, size = np.unique(ready[0], return_index=True, return_counts=True)
            for i in np.flatnonzero(size > BLOCK_LINES):
                found.append(whole(ready[:, first[i] : first[i] + size[i]], {}))
            ready = ready[:, np.repeat(size <= BLOCK_LINES, size)]
            if ready.shape[1]:
                found.append(cells(ready))
            if held.shape[1] > BLOCK_LINES:
                large, leads = held[0, 0], {}
                found.append(whole(held, leads))
                held = held[:, :0]
            for cell, key in found:
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(key, pa.int64())], ["cell", "key"])

    return rows.repartition("region").sortWithinPartitions("region", "line").select("region", "line", "sim", "chars").mapInArrow(run, "cell long, key long")


def block_regions(lines: DataFrame) -> DataFrame:
    """(region, line, sim, chars), odd regions: lines whose SimHashes are at most MAX_BITS_APART bits apart share one.

    They agree on one of four blocks of 16 bits. A block of very many lines
    divides again: what differs in at most three of the other 48 bits agrees
    on one of four parts of these.
    """
    mask = F.lit(0xFFFF).cast("long")
    blocks = F.array(*[F.shiftleft(F.lit(i).cast("long"), 16).bitwiseOR(F.shiftrightunsigned("sim", 16 * i).bitwiseAND(mask)) for i in range(BLOCKS)])
    rows = lines.select("line", "sim", "chars", F.explode(blocks).alias("block"))
    some = lines.where(F.pmod("line", F.lit(SAMPLE)) == 0).select(F.explode(blocks).alias("block")) if BLOCK_LINES >= SAMPLE else rows
    large = some.groupBy("block").count().where(F.col("count") * (SAMPLE if BLOCK_LINES >= SAMPLE else 1) > BLOCK_LINES / 2)
    large = [r[0] for r in large.select("block").collect()]  # of 4 * 65,536 blocks
    odd = F.shiftleft("block", 1).bitwiseOR(F.lit(1).cast("long")).alias("region")
    if not large:
        return rows.select(odd, "line", "sim", "chars")
    spark = lines.sparkSession
    large = F.broadcast(spark.createDataFrame([(x,) for x in large], "block long"))
    which = F.shiftright("block", 16)  # the other bits, as 48
    low = F.expr("sim & (shiftleft(1L, cast(16 * which as int)) - 1)")
    others = F.expr("shiftleft(shiftrightunsigned(sim, cast(least(16 * which + 16, 63) as int)), cast(16 * which as int))")
    others = F.when(which == BLOCKS - 1, low).otherwise(low.bitwiseOR(others))
    part = F.explode(F.array(*[F.xxhash64("block", F.lit(i), F.expr(f"shiftrightunsigned(others, {12 * i}) & 4095")) for i in range(4)])).alias("part")
    divided = rows.join(large, "block").withColumn("which", which).withColumn("others", others).select(part, "line", "sim", "chars")
    divided = divided.select(F.col("part").bitwiseOR(F.lit(1).cast("long")).alias("region"), "line", "sim", "chars")
    return rows.join(large, "block", "left_anti").select(odd, "line", "sim", "chars").unionByName(divided)


def line_cells(lines: DataFrame, similarity: float) -> DataFrame:
    """Distinct (cell, key, rank) of the lines that meet a line that may be like them in a block of SimHashes or a band."""
    lines = lines.where("sim is not null").select("line", "sim", "chars", "bands")
    bands = lines.select(F.explode("bands").alias("region"), "line", "sim", "chars")
    rows = bands.withColumn("region", F.col("region").bitwiseAND(F.lit(-2).cast("long"))).unionByName(block_regions(lines))
    met = stash(region_cells(rows, similarity).distinct(), "met")
    return stash(met.unionByName(met.select("cell", F.col("cell").alias("key")).distinct()).withColumn("rank", F.lit(0)), "cells")


def line_texts(docs: DataFrame, at: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, weight, item) for lines at (d_id, d_hash, line_no, line, sim): the normalised text with sim, and its length."""
    per_doc = stash(at.groupBy("d_id", "d_hash").agg(F.collect_list(F.struct("line_no", "line", "sim")).alias("wanted")), "wanted-lines")
    rows = _documents(docs, id_col, text_col).select("d_id", "d_hash", "text", F.col("d_hash").alias("h"))
    rows = possible(rows, per_doc.select(F.col("d_hash").alias("h")), per_doc.count()).where("maybe").select("d_id", "d_hash", "text")
    found = rows.join(per_doc, ["d_id", "d_hash"]).select(F.split("text", "\n").alias("all"), F.inline("wanted"))
    found = found.select(F.col("line").alias("key"), F.struct(normalised(F.get("all", F.col("line_no").cast("int"))).alias("text"), "sim").alias("item"))
    return stash(found.dropDuplicates(["key"]).withColumn("weight", F.length("item.text").cast("long")), "line-texts")


class LineSpace(Space):
    """Normalised lines with their SimHashes, linked by edit similarity where the SimHashes are at most FAR_BITS apart."""

    def __init__(self, lines: pa.StructArray, similarity: float):
        self.text, self.far = lines.field("text").to_pylist(), 1 - similarity
        self.sim = lines.field("sim").to_numpy().view(np.uint64)
        self.words, self.tables = [t.split(" ") for t in self.text], {}
        self.n = np.array([len(t) for t in self.text])
        self.weight = int(self.n.sum())

    def _pairs(self, i: int, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lines js may be linked with i, and the edits that are allowed."""
        most = np.floor(np.maximum(self.n[i], self.n[js]) * self.far + 1e-9).astype(int)
        return (np.bitwise_count(self.sim[i] ^ self.sim[js]) <= FAR_BITS) & (np.abs(self.n[i] - self.n[js]) <= most), most

    def alike(self, i: int, js: np.ndarray) -> np.ndarray:
        """Which lines have as many words as i, those that differ in few enough characters to change: linked for sure."""
        if not self.tables:
            self._table_words()
        out, most = self._pairs(i, js)
        out &= self.count[js] == self.count[i]
        k = np.flatnonzero(out)
        if len(k):
            words, sizes = self.tables[self.count[i]]
            own, others = self.row[i], self.row[js[k]]
            out[k] = ((words[others] != words[own]) * np.maximum(sizes[others], sizes[own])).sum(axis=1) <= most[k]
        return out

    def _table_words(self) -> None:
        """Numbers of words and their characters, in a table for each number of words a line."""
        number: dict[str, int] = {}
        words = [[number.setdefault(w, len(number)) for w in line] for line in self.words]
        length = np.array([len(w) for w in number], np.int32)
        self.count, self.row = np.array([len(w) for w in words]), np.zeros(len(words), int)
        for count in np.unique(self.count):
            own = np.flatnonzero(self.count == count)
            self.row[own] = np.arange(len(own))
            table = np.array([words[i] for i in own], np.int32)
            self.tables[count] = table, length[table]

    def _connect_alike(self, before: np.ndarray) -> np.ndarray:
        """The labels after the links of lines that are alike; most cells have two lines, so these go without arrays."""
        if len(before) != 2:
            return connect(before, self.alike)
        (a, b), (x, y) = self.n.tolist(), self.sim.tolist()
        most = int(max(a, b) * self.far + 1e-9)
        if (x ^ y).bit_count() <= FAR_BITS and abs(a - b) <= most and len(self.words[0]) == len(self.words[1]):
            if sum(max(len(x), len(y)) for x, y in zip(*self.words) if x != y) <= most:
                return before[:1].repeat(2)
        return before

    def linked(self, i: int, js: np.ndarray) -> np.ndarray:
        out, most = self._pairs(i, js)
        alike = self.alike(i, js)
        may = np.flatnonzero(out & ~alike)
        own = Texts([self.text[i], *[self.text[j] for j in js[may]]])
        out[may] = own.within(np.zeros(len(may), int), np.arange(1, len(may) + 1), most[may])
        return out

    def apart(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, most) of the pairs of lines of two labels that may be linked, those of the nearest SimHashes first."""
        found = []
        for lo in range(0, len(labels), 128):
            own = np.arange(lo, min(lo + 128, len(labels)))
            bits = np.bitwise_count(self.sim[own][:, None] ^ self.sim[None, lo:])
            i, j = np.nonzero((bits <= FAR_BITS) & (labels[own][:, None] != labels[None, lo:]))
            i, j = i[i < j], j[i < j]
            found.append((own[i], j + lo, bits[i, j]))
        i, j, bits = (np.concatenate(x) for x in zip(*found))
        most = np.floor(np.maximum(self.n[i], self.n[j]) * self.far + 1e-9).astype(int)
        near = np.abs(self.n[i] - self.n[j]) <= most
        order = np.argsort(bits[near], kind="stable")
        return tuple(x[near][order].astype(np.int32) for x in (i, j, most))

    @staticmethod
    def connect_all(cells: list[tuple[Space, np.ndarray]]) -> list[np.ndarray]:
        """First by lines that are alike word for word; the edit distance only of pairs that are in two groups then.

        Pairs of all cells are compared side by side, some of each cell at a
        time: what these link leaves out further pairs.
        """
        labels = [space._connect_alike(before).copy() for space, before in cells]
        left = {c: space.apart(labels[c]) for c, (space, _) in enumerate(cells) if (labels[c] != labels[c][0]).any()}
        texts = Texts([t for c in left for t in cells[c][0].text])
        first = dict(zip(left, np.cumsum([0, *[len(cells[c][0].text) for c in left]]).tolist()))
        turn = PAIRS
        while left:
            some = []
            for c, (i, j, most) in list(left.items()):
                apart = labels[c][i] != labels[c][j]
                i, j, most = i[apart], j[apart], most[apart]
                some.append((np.full(min(len(i), turn), c), i[:turn], j[:turn], most[:turn]))
                left[c] = i[turn:], j[turn:], most[turn:]
                if len(i) <= turn:
                    del left[c]
            cell, i, j, most = (np.concatenate(x) for x in zip(*some))
            at = np.array([first.get(c, 0) for c in range(len(cells))])[cell]
            for k in np.flatnonzero(texts.within(at + i, at + j, most)):
                own = labels[cell[k]]
                if own[i[k]] != own[j[k]]:
                    own[own == own[j[k]]] = own[i[k]]
            turn *= 2
        return labels


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the repeated lines taken out of the text, and n_lines and n_dropped added or replaced.

    Lines end at line feeds. Two lines link if, normalised, they are equal and
    not empty. Two lines of min_words words or more, where a character of a
    script without blanks is a word, link besides if their edit similarity is
    at least similarity and they meet: those whose SimHashes are at most
    MAX_BITS_APART bits apart do, and those that agree on one of the bands of
    MinHashes. Of each group connected by links the line of the smallest (id,
    hash of id and text, place) stays, over all documents. The remaining lines
    keep their order; a document may end up empty, and stays as a row. A null
    text is empty and has one line, the empty one; a null id is smaller than
    any other. Rows equal in id and text are one document: they get the same
    decisions. All other columns of the input stay as they are.
    """
    if min_words < 2:
        raise ValueError("a SimHash takes two words")
    lines = fingerprint_lines(docs, id_col, text_col, min_words)
    cells = line_cells(lines, similarity)
    at = lines.where("sim is not null").select("line", F.struct(*LINE, "sim").alias("place")).join(cells.select(F.col("key").alias("line")).distinct(), "line", "left_semi")
    texts = line_texts(docs, at.groupBy("line").agg(F.any_value("place").alias("place")).select("line", "place.*"), id_col, text_col)
    roots = components(join_cells(cells, texts, lambda item: LineSpace(item, similarity))).toDF("line", "root")
    repeats = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line", F.lit(None).cast("long").alias("root"))
    wanted = stash(repeats.unionByName(roots).groupBy("line").agg(F.max("root").alias("root")), "wanted")
    rows = possible(lines.select(*LINE, "line", F.xxhash64("line").alias("h")), wanted.select(F.xxhash64("line").alias("h")), wanted.count())
    rows = stash(rows.where("maybe").select(*LINE, "line"), "maybe-repeated")
    first = rows.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct(*LINE)).alias("first"))
    groups = stash(wanted.join(first, "line").withColumn("root", F.coalesce("root", "line")), "line-groups")
    keep = groups.groupBy("root").agg(F.min("first").alias("keep"))
    groups = stash(groups.join(keep, "root").select("line", "n", "keep"), "line-keeps")
    dropped = attach(rows, groups, "line", "n", rows.count())
    dropped = dropped.where(~F.struct(*LINE).eqNullSafe(F.col("keep"))).groupBy("d_id", "d_hash").agg(F.collect_set("line_no").alias("drop"))
    dropped = stash(dropped, "dropped-lines")
    rows = _documents(docs, id_col, text_col).withColumn("h", F.col("d_hash"))
    rows = possible(rows, dropped.select(F.col("d_hash").alias("h")), dropped.count())
    none = F.array().cast("array<bigint>")
    hit = rows.where("maybe").join(dropped, ["d_id", "d_hash"], "left").withColumn("drop", F.coalesce("drop", none))
    rows = rows.where("not maybe").withColumn("drop", none).unionByName(hit)
    rows = rows.withColumn("all", F.split("text", "\n"))
    # by set difference of line numbers: a text may have a million lines
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("all").cast("long") - 1), "drop")
    left = F.array_join(F.transform(stay, lambda i: F.col("all")[i.cast("int")]), "\n")
    rows = rows.select("row", F.when(F.size("drop") > 0, left).otherwise(F.col("text")).alias("text"), F.size("all").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"))
    new = {text_col: F.col("text"), "n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")}
    order = [*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns]]
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in order])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_repeated_lines over documents: doc_id, text, n_lines, n_dropped."""
    return drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
