"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_or_empty

CACHE_ENTRIES = 400_000  # pre-tokens that a Python worker remembers before it starts afresh
ROWS = 256  # texts of a batch that are held as Python objects at a time


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by id; every single byte must be one of them."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be contiguous from 0")
    return [t for _, t in ranked]


def _slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over n keys: a seed per bucket, n slots, no free slot.

    Buckets are placed from the largest down; a bucket of one key stores its
    slot as -slot-1 in place of a seed.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.buckets = max(1, n // 4)
        h = self.hashes(keys)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.order = np.full(n, -1, np.int64)
        where = h % np.uint64(self.buckets)
        members: dict[int, list[int]] = {}
        for k, b in enumerate(where.tolist()):
            members.setdefault(b, []).append(k)
        free = np.ones(n, bool)
        alone = []
        for b, ks in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(ks) == 1:
                alone.append((b, ks[0]))
                continue
            first, fits = 1, np.zeros(0, int)
            while not fits.size:  # many seeds at a time
                seeds = np.arange(first, first + 128)[:, None]
                tried = np.sort(_slots(h[ks], seeds, n), axis=1)
                fits = np.flatnonzero(free[tried].all(axis=1) & (np.diff(tried, axis=1) > 0).all(axis=1))
                first += 128
            seed = int(seeds[fits[0], 0])
            s = _slots(h[ks], np.array([seed]), n)
            self.seeds[b], free[s], self.order[s] = seed, False, ks
        for (b, k), s in zip(alone, np.flatnonzero(free).tolist()):
            self.seeds[b], self.order[s] = -s - 1, k

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only stored key that it can be equal to."""
        h = self.hashes(keys)
        seeds = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.order[np.where(seeds < 0, -seeds - 1, _slots(h, np.maximum(seeds, 0), len(self.order)))]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: the pair of lowest rank merges first, the leftmost of equals.

    Parts are linked by start offsets; entries of the heap that a merge has
    outdated are skipped when they surface, so long pieces take n log n.
    """
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if mid < 0 or mid >= stop or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes whole texts; pre-tokens already met come from a bounded cache of packed ids."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str):
        self.tokens, self.table = tokens, table
        self.split = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for piece, b, k in zip(pieces, raw, self.table.lookup(raw).tolist()):
            ids = [k] if self.tokens[k] == b else merge_bytes(b, self.ranks)
            self.known[piece] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        self.learn([*set(pieces).difference(self.known)])
        return b"".join(map(self.known.__getitem__, pieces))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds out: the token ids of the whole text as packed little-endian unsigned 32-bit integers.

    A null text is empty and has no ids. All columns of the input stay; a
    column that already has the name of out is replaced. Each row is encoded
    by itself, so nothing shuffles. The vocabulary is broadcast: its size is
    that of the rank file, whatever the corpus.
    """
    tokens = load_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens), pattern))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(*shared.value)
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                yield pd.Series([encoder.encode(t) for t in texts.iloc[at : at + ROWS]], dtype=object)

    return docs.withColumn(out, encode(text_or_empty(text_col)))


def _decoder(shared: Broadcast):
    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = shared.value
        for packed in batches:
            for at in range(0, len(packed), ROWS):
                yield pd.Series([None if p is None else b"".join(map(tokens.__getitem__, np.frombuffer(p, "<u4").tolist())) for p in packed.iloc[at : at + ROWS]], dtype=object)

    return decode


def decode_ids(docs: DataFrame, ranks_path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds out: the bytes that packed ids stand for. Null ids give null; an id outside the vocabulary is an error."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    return docs.withColumn(out, _decoder(shared)(F.col(ids_col)))


def digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_texts(docs.select(id_col, "text"), path, public_tokenizers.PATTERN)
    return digests(decode_ids(coded, path), id_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
