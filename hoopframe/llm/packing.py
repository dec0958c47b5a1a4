"""Packing of documents into sequences of equal attention cost, without padding."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .word_bpe import word_encoder

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 4096  # cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n
WINDOW = 1 << 21  # tokens of unfinished documents that are packed together; bounds a task's memory
BATCH = 4096  # pieces in a record batch

OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def assign(lengths: list[int], rooms: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """(pieces, rest): pieces (document, start, length, sequence, offset) that fill every sequence, if there is enough.

    The longest document goes to the sequence of least cost that has room, of
    equals the one with most room; what doesn't fit is cut off and waits at
    its own length. rest has (document, start) of what is left when all
    sequences are full.
    """
    waiting = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapify(waiting)
    open_ = [(0.0, -room, s) for s, room in enumerate(rooms) if room]
    heapify(open_)
    pieces = []
    while waiting and open_:
        n, k, start = heappop(waiting)
        cost, room, s = heappop(open_)
        take = min(-n, -room)
        pieces.append((k, start, take, s, rooms[s] + room))
        if take < -room:
            heappush(open_, (cost + linear * take + quadratic * take * take, room + take, s))
        if take < -n:
            heappush(waiting, (n + take, k, start + take))
    return pieces, [(k, start) for _, k, start in waiting]


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, the largest first: sequences that need no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs a stream of documents; rows() gives the pieces whose sequences are full."""

    def __init__(self, first_sequence: int, capacity: int, window: int, linear: float, quadratic: float):
        self.next, self.capacity, self.window, self.cost = first_sequence, capacity, window, (linear, quadratic)
        self.waiting: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.tokens = 0
        self.done: list[tuple] = []

    def _emit(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int, sequence: int, offset: int) -> None:
        self.done.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), doc_tokens, sequence, offset))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit(doc_id, start, ids[start : start + self.capacity], len(ids), self.next, 0)
            self.next += 1
        if whole < len(ids):
            # a copy, so that a very long document doesn't wait with its end
            self.waiting.append((doc_id, whole, ids[whole:].copy(), len(ids)))
            self.tokens += len(ids) - whole
        if self.tokens >= self.window:
            self.fill([self.capacity] * (self.tokens // self.capacity))

    def fill(self, rooms: list[int]) -> None:
        pieces, rest = assign([len(ids) for _, _, ids, _ in self.waiting], rooms, *self.cost)
        for k, start, n, s, offset in pieces:
            doc_id, first, ids, doc_tokens = self.waiting[k]
            self._emit(doc_id, first + start, ids[start : start + n], doc_tokens, self.next + s, offset)
        self.next += len(rooms)
        self.waiting = [(doc_id, first + start, ids[start:], n) for k, start in rest for doc_id, first, ids, n in [self.waiting[k]]]
        self.tokens = sum(len(ids) for _, _, ids, _ in self.waiting)

    def finish(self) -> None:
        """Full sequences as far as the tokens go, then sequences of powers of two."""
        self.fill([self.capacity] * (self.tokens // self.capacity))
        self.fill(powers(self.tokens))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, window: int = WINDOW, linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, token_ids, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, without special tokens, then
    end_id; a null text is empty, so its document is end_id alone. Repeated
    rows and null ids are documents of their own. Every id is in exactly one
    piece; the pieces of a sequence follow each other without a gap. A
    sequence has `capacity` ids, a power of two, or, at the end of a
    partition, a smaller power of two, so none has padding. token_ids are
    little-endian unsigned 32-bit integers. Other columns of the input are not
    read; an empty table gives no rows.

    Each partition packs its own documents as they come and nothing shuffles.
    Stretches of `capacity` ids are sequences; the ends of documents wait until
    there are `window` ids and are then dealt out by assign(). A sequence_id
    is unique: the partition's number in the upper bits, a counter below.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(shared.value)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, window, linear, quadratic)
        end = np.array([end_id], encoder.dtype)
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                packer.add(doc_id.as_py(), np.concatenate([encoder.encode(text.as_py() or ""), end]))
                if len(packer.done) >= BATCH:
                    yield batch(packer.done)
                    packer.done = []
        packer.finish()
        for k in range(0, len(packer.done), BATCH):
            yield batch(packer.done[k : k + BATCH])

    kind = "doc_id bigint, start bigint, length bigint, token_ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pack_partition, kind)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, their ids as crc32."""
    import public_tokenizers

    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
